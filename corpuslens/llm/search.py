"""Ranked lexical search with one score for each bag of words.

Only the terms of the items matter for a document's score, besides its length
norm m. Documents are therefore restricted to the items' vocabulary: one pass
over the texts leaves a short vector of term frequencies. Documents with the
same vector and the same m form a class (a grouping whose key is hashed and then
compared in full, so equal hashes of different vectors stay apart). Each class
is scored once against the items' postings, a task keeps the best ``k`` classes
of each item, and the few classes that win are expanded into their documents by
ascending doc_id.

The best ``k`` documents of an item lie in its first ``k`` classes by score and
least doc_id: every class before a document's own has a document before it.

Items are taken in blocks of about ``POSTINGS`` pairs of item and term; each block is
a pass over the documents, so what a task holds does not grow with the items.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .staging import arrow_map, hinted, staged
from .words import chunks, find_words, hash_ranges, same_ranges

#: The terms of a text, once A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POSTINGS = 1 << 18
#: Scores and score parts that a task holds at once.
CELLS = 1 << 21

_PART = np.ones(256, bool)
_PART[0x00:0x30] = _PART[0x3A:0x41] = _PART[0x5B:0x61] = _PART[0x7B:0x80] = False
_FILTER_BITS = 20


@dataclass
class Vocabulary:
    """The sorted term hashes of a block, with the terms' bytes."""

    hashes: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    maybe: np.ndarray

    @classmethod
    def of(cls, terms: list[str]) -> tuple[Vocabulary, list[str]]:
        """The vocabulary and its terms in the order of their numbers."""
        coded = [t.encode() for t in terms]
        end = np.cumsum([len(t) for t in coded], dtype=np.int64)
        start = end - np.array([len(t) for t in coded], np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8)
        hashes = hash_ranges(data, start, end)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        if (hashes[1:] == hashes[:-1]).any():
            raise ValueError("two terms of one block share a 64-bit hash")
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        return cls(hashes, data, start[order], end[order], maybe), [terms[i] for i in order]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that are terms, the terms' numbers)."""
        h = hash_ranges(data, start, end, lower=True)
        at = np.flatnonzero(self.maybe[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[number] == h[at]
        at, number = at[hit], number[hit]
        same = same_ranges(data, start[at], end[at], self.data, self.start[number], self.end[number], lower=True)
        return at[same], number[same]


def _bags(vocabulary):
    """Texts as (number of terms, the block's terms in them, frequencies)."""
    def run(batches):
        v = vocabulary.value
        for b in batches:
            n, first, terms, tfs = [], [np.zeros(1, np.int64)], [], []
            total = 0
            for c in chunks(b.column("text")):
                w = find_words(c, _PART)
                at, number = v.find(c.data, w.start, w.end)
                key, tf = np.unique(w.doc[at] * len(v.hashes) + number, return_counts=True)
                doc, term = np.divmod(key, len(v.hashes))
                n.append(np.diff(w.first))
                first.append(total + np.searchsorted(doc, np.arange(1, c.hi - c.lo + 1)))
                total += len(key)
                terms.append(term)
                tfs.append(tf)
            join = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
            offsets = pa.array(np.concatenate(first), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(join(n, np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array(join(terms, np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(join(tfs, np.int32)))], ["doc_id", "n", "terms", "tfs"])
    return run


@dataclass
class Postings:
    """For each term the items that hold it, and its weight."""

    first: np.ndarray
    items: np.ndarray
    weight: np.ndarray
    n_items: int


class Best:
    """The first ``k`` classes of each item by score, least doc_id and cid."""

    def __init__(self, n_items: int, k: int):
        self.k, self.n_items = k, n_items
        self.least = np.ones(n_items, np.int64)
        self.rows = np.zeros((4, 0), np.int64)  # item, score, first, cid

    def add(self, scores: np.ndarray, first: np.ndarray, cid: np.ndarray) -> None:
        """Take in scores of classes (rows) for items (columns)."""
        if len(scores) > self.k:
            low = np.maximum(self.least, np.partition(scores, len(scores) - self.k, axis=0)[-self.k])
        else:
            low = self.least
        c, item = np.nonzero(scores >= low)
        rows = np.concatenate([self.rows, np.stack([item, scores[c, item], first[c], cid[c]])], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        start = np.searchsorted(rows[0], np.arange(self.n_items + 1))
        self.rows = rows[:, np.arange(rows.shape[1]) - start[rows[0]] < self.k]
        full = np.searchsorted(self.rows[0], np.arange(self.n_items + 1))
        for_item = np.flatnonzero(np.diff(full) == self.k)
        self.least[for_item] = self.rows[1][full[for_item + 1] - 1]


def class_scores(p: Postings, m: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray):
    """Scores of consecutive classes in slices (lo, matrix of classes by items);
    class ``row[e]`` holds ``term[e]`` ``tf[e]`` times. All in 64-bit integers."""
    part = p.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
    count = np.diff(p.first)[term]
    upto = np.concatenate([[0], np.cumsum(np.bincount(row, weights=count, minlength=len(m)).astype(np.int64))])
    starts = np.searchsorted(row, np.arange(len(m) + 1))
    most, lo = max(1, CELLS // max(1, p.n_items)), 0
    while lo < len(m):
        hi = min(lo + most, max(lo + 1, int(np.searchsorted(upto, upto[lo] + CELLS, "right")) - 1))
        e = slice(starts[lo], starts[hi])
        size = count[e]
        begin = np.concatenate([[0], np.cumsum(size)])
        within = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
        item = p.items[np.repeat(p.first[term[e]], size) + within]
        scores = np.zeros((hi - lo) * p.n_items, np.int64)
        np.add.at(scores, np.repeat(row[e] - lo, size) * p.n_items + item, np.repeat(part[e], size))
        yield lo, scores.reshape(hi - lo, p.n_items)
        lo = hi


def _scored(postings, k: int):
    def run(batches):
        p = postings.value
        best = Best(p.n_items, k)
        for b in batches:
            m, first, cid = (b.column(c).to_numpy() for c in ("m", "first", "cid"))
            terms = b.column("terms")
            row = np.repeat(np.arange(b.num_rows), terms.value_lengths().to_numpy())
            flat = lambda c: c.flatten().to_numpy().astype(np.int64)
            for lo, scores in class_scores(p, m, row, flat(terms), flat(b.column("tfs"))):
                hi = lo + len(scores)
                best.add(scores, first[lo:hi], cid[lo:hi])
        if best.rows.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in best.rows], ["item", "score", "first", "cid"])
    return run


def _lower(text: str):
    return F.translate(F.col(text).cast("string"), UPPER, LOWER)


def _search_block(docs: DataFrame, pairs: pa.Table, item_type: T.DataType, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary, terms = Vocabulary.of(sorted(set(pairs.column("term").to_pylist())))
    number = {t: n for n, t in enumerate(terms)}
    ids: dict = {}
    item = np.array([ids.setdefault(i, len(ids)) for i in pairs.column("item_id").to_pylist()], np.int64)
    term = np.array([number[t] for t in pairs.column("term").to_pylist()], np.int64)

    bags = staged(arrow_map(docs, _bags(spark.sparkContext.broadcast(vocabulary)),
                            "doc_id long, n long, terms array<int>, tfs array<int>"), "search-bags")
    N, L = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for r in bags.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
        df[r[0]] = r[1]
    weight = np.array([math.floor(1000 * math.log((2 * N + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    order = np.argsort(term, kind="stable")
    postings = Postings(np.searchsorted(term[order], np.arange(len(terms) + 1)), item[order], weight, len(ids))

    m = F.lit(10) + F.expr(f"cast(n as decimal(20,0)) * 90 * cast({N} as decimal(17,0)) div {max(L, 1)}")
    bagged = bags.where(F.size("terms") > 0).select("doc_id", m.cast("long").alias("m"), "terms", "tfs")
    classes = bagged.groupBy("m", "terms", "tfs").agg(F.coalesce(F.min("doc_id"), F.lit(2**63 - 1)).alias("first"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "search-classes")

    found = arrow_map(classes, _scored(spark.sparkContext.broadcast(postings), k),
                      "item long, score long, first long, cid long")
    place = Window.partitionBy("item").orderBy(F.desc("score"), "first", "cid")
    top = staged(found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
                 .select("item", "score", "cid"), "search-top")
    winners = staged(classes.join(hinted(staged(top.select("cid").distinct(), "search-winners")), "cid")
                     .select("cid", "m", "terms", "tfs"), "search-bags-won")
    members = bagged.join(hinted(winners), ["m", "terms", "tfs"]).select("cid", "doc_id")
    nth = Window.partitionBy("cid").orderBy(F.asc_nulls_last("doc_id"))
    members = members.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k).select("cid", "doc_id")

    last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = top.join(members, "cid").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for i, n in ids.items()],
                                  T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type)]))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of ``docs(doc_id long, text string, ...)`` for
    each item of ``items(item_id, text, ...)``: ``item_id, rank int, doc_id, score``.

    Terms are maximal runs of characters outside ASCII punctuation, space and
    control characters, with A-Z lower-cased. N documents hold a term, L is all
    their terms, df the documents with a term. A term weighs
    ``floor(1000 ln((2N + 2) / (2 df + 1)))``, a document's norm is
    ``m = 10 + 90 n N div L``, and its score sums ``weight * (10^9 tf div (1000 tf + 8 m))``
    over the item's distinct terms. Scores above 0 are ranked, equal ones by
    ascending doc_id.

    Null or term-less text: counted nowhere, never found; an item without terms has no
    rows. Rows that repeat an item_id are one item with the terms of all; a null item_id
    is an item too. Every row of ``docs`` is a document, also where it repeats a
    doc_id; one without a doc_id comes last among equal scores. Other columns
    are ignored; an empty table gives no rows.
    """
    item_type = items.schema["item_id"].dataType
    pairs = staged(items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(_lower("text"), F.lit(TERM), F.lit(0))))
                                .alias("term")).distinct(), "search-items")
    blocks = math.ceil(pairs.count() / POSTINGS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [_search_block(docs, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow(), item_type, k)
             for b in range(blocks)]
    if not parts:
        schema = T.StructType([T.StructField("item_id", item_type), *T.StructType.fromDDL("rank int, doc_id long, score long")])
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)

"""URL filters: host and path rules, and a character language-model ratio.

Rules decide the URLs they fit. All others are judged by two variable-order
Markov models over characters, one learned from the URLs that rules accept and
one from those that rules reject: counts of each character after contexts of
zero to four characters, smoothed by Witten and Bell's estimate, in which a
context that was seen with many different characters trusts the shorter one
more. The score is the difference of the log-likelihoods by character; it is
calibrated on labelled URLs that the counts leave out, and a URL passes from the
calibrated threshold up.

A character and the four before it are a gram; the counts of all shorter
contexts are sums over grams. Grams are counted exactly, in a Spark table that
grows with the URLs. Those that share three characters of context meet in one
task, at most 64 x 64 of them, which turns each into the logarithm of its two
estimates' ratio; shorter contexts are at most 64^3 and are sent to all tasks.
A URL's score is the mean of the ratios of its grams. Their table is broadcast
where its counted size proves it small; else chunks of URLs are joined to it,
with the same sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import SENT_ROWS, arrow_map, schema_with, staged

ORDERS = 5
#: Kinds of characters, and bits of one.
SYMBOLS, BITS = 64, 6
#: Orders up to which the counts of all contexts are sent to every task.
SENT_ORDERS = 3
#: URLs of a chunk that is joined to the grams' ratios.
CHUNK = 1024
#: One labelled URL in so many calibrates instead of being counted.
CALIBRATION = 5
#: Scores are calibrated on a grid of this step.
GRID = 0.005

_KNOWN = b"abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%"
_SYMBOL = np.full(256, len(_KNOWN), np.int64)  # any other byte
_SYMBOL[list(_KNOWN)] = np.arange(len(_KNOWN))
_SYMBOL[0x41:0x5B] = _SYMBOL[0x61:0x7B]
_START, _END = SYMBOLS - 1, SYMBOLS - 2


@dataclass(frozen=True)
class UrlRule:
    """``allow`` or ``block`` for a host with its subdomains and a path start."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """Number of the longest rule that fits, null if none does."""
    out = None
    for k, r in sorted(enumerate(rules), key=lambda x: -len(x[1].name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return F.lit(None).cast("int") if out is None else out


def _symbols(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all URLs with start marks before and an end mark after each,
    and the place where each URL's marks begin."""
    raw = [(u or "").encode() for u in urls.to_pylist()]
    size = np.array([len(u) for u in raw], np.int64) + ORDERS
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(at[-1]), _START, np.int64)
    inner = np.ones(len(out), bool)
    for k in range(ORDERS - 1):
        inner[at[:-1] + k] = False
    inner[at[1:] - 1] = False
    out[inner] = _SYMBOL[np.frombuffer(b"".join(raw), np.uint8)]
    out[at[1:] - 1] = _END
    return out, at


def _grams(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram of each predicted character (the character in the lowest bits, the
    one before it in the next) and the number of the URL it belongs to."""
    predicted = np.ones(len(symbols), bool)
    for k in range(ORDERS - 1):
        predicted[at[:-1] + k] = False
    here = np.flatnonzero(predicted)
    gram = np.zeros(len(here), np.int64)
    for order in range(ORDERS):
        gram |= symbols[here - order] << (BITS * order)
    return gram, np.searchsorted(at, here, "right") - 1


def _counts(batches):
    """Grams of ``url, accepted`` with their counts for each side; those of URLs
    that are not learned from (null) are listed once a batch, and count nothing."""
    for b in batches:
        accepted = np.array([-1 if a is None else int(a) for a in b.column(1).to_pylist()], np.int64)
        gram, url = _grams(*_symbols(b.column(0)))
        for side in (-1, 0, 1):
            slot, n = np.unique(gram[accepted[url] == side], return_counts=True)
            if len(slot):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if side < 0 else bool(side)] * len(slot), pa.bool_()), pa.array(slot),
                     pa.array(n * (side >= 0), pa.int64())], ["accepted", "slot", "n"])


def _found(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Values of the wanted keys (ascending ``keys``), 0 for those not held."""
    if not len(keys):
        return [np.zeros(len(wanted)) for _ in values]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return [np.where(keys[at] == wanted, v[at], 0) for v in values]


class UrlModels:
    """Estimates from gram counts of the accepted and the rejected URLs."""

    def __init__(self, slots: np.ndarray, accepted: np.ndarray, n: np.ndarray):
        self.sides = [(slots[own], n[own]) for own in ((accepted == side) & (n > 0) for side in (True, False))]
        self.ready = all(len(slot) for slot, _ in self.sides)
        self._tables = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": {}}  # tasks are sent the counts

    def _table(self, side: int, order: int) -> tuple[np.ndarray, ...]:
        """Cells (context and character) with counts, and contexts with their
        sum and the kinds of characters seen after them."""
        if (side, order) not in self._tables:
            slot, n = self.sides[side]
            cells, at = np.unique(slot & ((1 << BITS * (order + 1)) - 1), return_inverse=True)
            count = np.bincount(at, weights=n, minlength=len(cells))
            contexts, of = np.unique(cells >> BITS, return_inverse=True)
            self._tables[side, order] = (cells, count, contexts, np.bincount(of, weights=count, minlength=len(contexts)),
                                         np.bincount(of, minlength=len(contexts)))
        return self._tables[side, order]

    def estimates(self, grams: np.ndarray, orders: range, below: Sequence[np.ndarray] | None = None) -> list[np.ndarray]:
        """Probability of each gram's character on either side, refined by
        ``orders`` from the estimates ``below`` them."""
        out = []
        for side in range(2):
            p = below[side] if below else np.full(len(grams), 1 / SYMBOLS)
            for order in orders:
                cells, count, contexts, total, kinds = self._table(side, order)
                cell = grams & ((1 << BITS * (order + 1)) - 1)
                n, = _found(cells, cell, count)
                t, k = _found(contexts, cell >> BITS, total, kinds)
                p = np.where(t > 0, (n + k * p) / np.maximum(t + k, 1), p)
            out.append(p)
        return out

    def scores(self, urls: pa.Array) -> np.ndarray:
        """Accepted minus rejected log-likelihood of each URL, by character."""
        if not len(urls) or not self.ready:
            return np.zeros(len(urls))
        grams = np.unique(_grams(*_symbols(urls))[0])
        good, bad = self.estimates(grams, range(ORDERS))
        return mean_ratios(urls, grams, np.log(good) - np.log(bad))


def mean_ratios(urls: pa.Array, grams: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Mean of the ratios of each URL's grams (ascending ``grams``)."""
    if not len(urls):
        return np.zeros(0)
    gram, url = _grams(*_symbols(urls))
    ratio, = _found(grams, gram, ratios)
    return np.bincount(url, weights=ratio, minlength=len(urls)) / np.bincount(url, minlength=len(urls))


def _sided(slot: np.ndarray, good: np.ndarray, bad: np.ndarray) -> UrlModels:
    side = np.zeros(2 * len(slot), bool)
    side[:len(slot)] = True
    return UrlModels(np.concatenate([slot, slot]), side, np.concatenate([good, bad]))


def train(urls: DataFrame) -> DataFrame | None:
    """``slot, ratio`` for every gram of ``urls(url, accepted)``, learned from the
    rows that are accepted or rejected and not null; None where a side is missing."""
    counts = staged(arrow_map(urls.select("url", "accepted"), _counts, "accepted boolean, slot long, n long")
                    .groupBy("slot").agg(F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("good"),
                                         F.sum(F.when(~F.col("accepted"), F.col("n")).otherwise(0)).alias("bad")), "url-grams")
    short = (1 << BITS * SENT_ORDERS) - 1
    got = (counts.where("good + bad > 0").groupBy(F.col("slot").bitwiseAND(F.lit(short)).alias("slot"))
           .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow())  # at most 64^3 rows
    low = _sided(*(got[c].to_numpy() for c in ("slot", "good", "bad")))
    if not low.ready:
        return None
    shared = urls.sparkSession.sparkContext.broadcast(low)

    def ratios(slot, good, bad):
        p = shared.value.estimates(slot, range(SENT_ORDERS))
        p = _sided(slot, good, bad).estimates(slot, range(SENT_ORDERS, ORDERS), p)
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.log(p[0]) - np.log(p[1]))], ["slot", "ratio"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            if b.num_rows:
                held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns)]
                context = held[0] >> BITS & short
                cut = int(np.searchsorted(context, context[-1]))  # the last context may go on
                if cut:
                    yield ratios(*(h[:cut] for h in held))
                    held = [h[cut:] for h in held]
        if len(held[0]):
            yield ratios(*held)

    context = F.shiftright("slot", BITS).bitwiseAND(F.lit(short))
    return staged(arrow_map(counts.repartition(context).sortWithinPartitions(context), run, "slot long, ratio double"), "url-ratios")


def _chunks(batches):
    part, nth = TaskContext.get().partitionId(), 0
    for b in batches:
        for lo in range(0, b.num_rows, CHUNK):
            urls = b.column(0).slice(lo, CHUNK)
            slots = np.unique(_grams(*_symbols(urls))[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | nth]), pa.array([urls.to_pylist()], pa.list_(pa.string())),
                 pa.array([slots], pa.list_(pa.int64()))], ["chunk", "urls", "slots"])
            nth += 1


def _chunk_scores(batches):
    for b in batches:
        for urls, hits in zip(b.column(0), b.column(1)):
            slot, ratio = (hits.values.field(k).to_numpy() for k in range(2))
            order = np.argsort(slot)
            yield pa.RecordBatch.from_arrays(
                [urls.values, pa.array(mean_ratios(urls.values, slot[order], ratio[order]))], ["url", "score"])


def url_scores(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """``url, score`` of the distinct ``urls(url)``, by a join: a chunk of URLs
    asks once for each of its grams, so no gram is common."""
    chunks = staged(arrow_map(urls.select("url").distinct(), _chunks, "chunk long, urls array<string>, slots array<long>"), "url-chunks")
    hits = (chunks.select("chunk", F.explode("slots").alias("slot")).join(ratios, "slot")
            .groupBy("chunk").agg(F.collect_list(F.struct("slot", "ratio")).alias("hits")))
    met = chunks.select("chunk", "urls").join(hits, "chunk").select("urls", "hits")
    return staged(arrow_map(met, _chunk_scores, "url string, score double"), "url-scores")


def scorer(urls: DataFrame, ratios: DataFrame | None):
    """A function that adds ``score`` to rows whose ``url`` is among ``urls``."""
    if ratios is None:
        return lambda rows: rows.withColumn("score", F.lit(0.0))
    if ratios.count() > SENT_ROWS:
        scores = url_scores(urls, ratios)
        return lambda rows: rows.join(scores, "url").select(*rows.columns, "score")
    got = ratios.orderBy("slot").toArrow()
    shared = urls.sparkSession.sparkContext.broadcast((got["slot"].to_numpy(), got["ratio"].to_numpy()))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(mean_ratios(part.column("url"), *shared.value))],
                                                 [*part.schema.names, "score"])

    return lambda rows: arrow_map(rows, run, schema_with(rows.schema.fields, "score double"))


def threshold(labelled: DataFrame) -> float:
    """The score from which a URL passes: on ``labelled(score, accepted)``, where
    the shares of accepted URLs above and of rejected URLs below add up to most
    (the middle of the best stretch); 0 where a side is missing."""
    rows = (labelled.groupBy(F.floor(F.col("score") / GRID).cast("int").alias("cell"))
            .agg(F.sum(F.col("accepted").cast("long")).alias("good"), F.sum((~F.col("accepted")).cast("long")).alias("bad"))
            .orderBy("cell").collect())
    good, bad = (np.array([r[k] for r in rows], np.float64) for k in ("good", "bad"))
    if not good.sum() or not bad.sum():
        return 0.0
    value = np.concatenate([[0], np.cumsum(bad)]) / bad.sum() - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    cell = [r.cell for r in rows]
    edges = np.array([*cell, cell[-1] + 1]) * GRID  # a cut before each cell, and after the last
    best = np.flatnonzero(value == value.max())
    first = int(best[0])
    below = edges[first - 1] + GRID if first else edges[0]
    return float((below + edges[int(best[-1])]) / 2) if len(best) == 1 and first else float(edges[first])


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], url: str = "url") -> DataFrame:
    """Each row of ``pages`` as a struct ``row``, with ``host, path, rule`` (the
    number of the rule that fits, else null), ``score`` and ``verdict``.

    A null URL is an empty one: host and path empty, score 0. Rules label the
    rows the models learn from; where they accept or reject nothing, every score
    and the threshold are 0, and other URLs pass. Rows are judged one by one; an
    empty table gives no rows.
    """
    address = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), address.alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    verdicts = F.array(*(F.lit(r.verdict) for r in rules)) if rules else F.array().cast("array<string>")
    said = F.when(F.col("rule").isNotNull(), F.get(verdicts, F.col("rule")))
    aside = F.crc32(F.col("url").cast("binary")) % CALIBRATION == 0
    accepted = said == "allow"
    scored = scorer(rows, train(rows.select("url", F.when(~aside, accepted).alias("accepted"))))
    cut = threshold(scored(rows.where(F.col("rule").isNotNull() & aside).select("url", accepted.alias("accepted"))))
    return scored(rows).select("row", "host", "path", "rule", "score", F.coalesce(
        said, F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"))


def url_filter(pages: DataFrame, rules: Sequence[UrlRule], url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed."""
    return judge_urls(pages, rules, url).where("verdict = 'allow'").select("row.*")

"""Language identification of whole, possibly mixed-language texts.

A word is a run of letters (ASCII letters and all bytes of other characters).
Its score in a language is the log-likelihood of its byte 4-grams, word start
and end included, under smoothed counts learned from labelled documents. The
script of the word, by code point ranges, narrows the candidates to languages
that were seen in that script. Viterbi decoding over the words of a text, with
a penalty for every switch of language, labels spans; the language that holds
most letters is the prediction, and its share of them the score.

The model has a fixed size: ``BUCKETS`` hashed 4-gram counts for each language
(1 MB as 32-bit floats) and one share for each script.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import arrow_map, schema_with
from .words import Chunk, chunks

BUCKETS = 1 << 18
SMOOTHING = 0.05
#: Log-likelihood that a switch of language costs, and that a word loses in a
#: language never seen in its script.
SWITCH = 12.0
FOREIGN_SCRIPT = 40.0
#: Share of a language's words in a script from which it is a candidate there.
LEAST_SHARE = 0.005
#: Languages counted at a time in a training task before it hands on its counts.
HELD_LANGS = 16
#: Elements of the word x language table decoded at a time.
DECODE_ELEMENTS = 4 << 20

# First code points of Unicode script ranges, with the script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1400, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_START = np.array([lo for lo, _ in SCRIPTS])
_SCRIPT_ID = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LETTER = _ASCII_LETTER.copy()
_LETTER[0x80:] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


@dataclass
class Grams:
    """Words of a chunk and their hashed 4-grams (``first[w]`` starts word w)."""

    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    first: np.ndarray
    bucket: np.ndarray
    words_of: np.ndarray  # first word of each text, one more at the end


def word_grams(c: Chunk) -> Grams:
    letter = _LETTER[c.data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    full = c.offsets[:-1] < c.offsets[1:]
    heads, tails = c.offsets[:-1][full], c.offsets[1:][full] - 1
    begins[heads] = letter[heads]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:]
    ends[tails] = letter[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    words_of = np.searchsorted(start, c.offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Grams(start, end, none, none, none, words_of)
    lead = c.data[start].astype(np.int64)
    nxt = lambda k: c.data[np.minimum(start + k, end - 1)].astype(np.int64) & 0x3F
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 0x1F) << 6 | nxt(1), np.where(
        lead < 0xF0, (lead & 0x0F) << 12 | nxt(1) << 6 | nxt(2), (lead & 0x07) << 18 | nxt(1) << 12 | nxt(2) << 6 | nxt(3))))
    script = _SCRIPT_ID[np.searchsorted(_SCRIPT_START, point, "right") - 1]

    text = _LOWER[c.data]
    after_c3 = np.zeros(len(text), bool)
    after_c3[1:] = text[:-1] == 0xC3
    capital = after_c3 & (text >= 0x80) & (text <= 0x9E) & (text != 0x97)  # accented capitals of Latin-1
    text[capital] += 0x20
    size = end - start
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    b = text[place + np.repeat(start, size)].astype(np.uint32)
    code = b.copy()
    for k in (1, 2, 3):
        code[k:] |= b[:-k] << np.uint32(8 * k)
    code &= _MASKS[np.minimum(place, 3)]
    first = at + np.arange(len(start))
    grams = np.empty(len(code) + len(start), np.uint32)
    closing = first + size
    inner = np.ones(len(grams), bool)
    inner[closing] = False
    grams[inner] = code
    grams[closing] = code[at + size - 1] << np.uint32(8)
    bucket = (grams * np.uint32(2654435761)) >> np.uint32(32 - 18)
    return Grams(start, end, script, first, bucket.astype(np.int32), words_of)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(batches):
    held: dict[str, np.ndarray] = {}

    def flush():
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(n[at])],
                ["lang", "slot", "n"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for c in chunks(batch.column(1)):
            g = word_grams(c)
            own = np.repeat(langs[c.lo:c.hi], np.diff(g.words_of))
            per_word = np.diff(np.concatenate([g.first, [len(g.bucket)]]))
            for lang in set(own):
                words = own == lang
                if lang not in held:
                    if len(held) >= HELD_LANGS:
                        yield from flush()
                    held[lang] = np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64)
                held[lang][:BUCKETS] += np.bincount(g.bucket[np.repeat(words, per_word)], minlength=BUCKETS)
                held[lang][BUCKETS:] += np.bincount(g.script[words], minlength=len(SCRIPT_NAMES))
    yield from flush()


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray     # BUCKETS x languages
    foreign: np.ndarray  # scripts x languages: what a word loses


def train(docs: DataFrame) -> Model:
    """Learn from all rows of ``docs(lang, text)``; rows with a null lang or
    text add nothing. Tasks count n-grams of their texts and Spark adds the
    counts, so only the model (of fixed size for each language) is collected."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    rows = (arrow_map(known, _counts, "lang string, slot long, n long")
            .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow())
    coded = rows["lang"].combine_chunks().dictionary_encode()
    found = coded.dictionary.to_pylist()
    langs = sorted(found)
    n = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    if langs:
        column = np.array([langs.index(x) for x in found])
        n[rows["slot"].to_numpy(), column[coded.indices.to_numpy()]] = rows["n"].to_numpy()
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    logp = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    candidate = share >= LEAST_SHARE
    candidate |= ~candidate.any(axis=1, keepdims=True)  # an unseen script narrows nothing
    return Model(langs, logp, np.where(candidate, 0, FOREIGN_SCRIPT).astype(np.float32))


def word_scores(g: Grams, model: Model) -> np.ndarray:
    if not len(g.first):
        return np.zeros((0, len(model.langs)), np.float32)
    return np.add.reduceat(model.logp[g.bucket], g.first, axis=0) - model.foreign[g.script]


def decode(scores: np.ndarray, words_of: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word: Viterbi over each text, all texts in step.
    Ties stay in the language at hand, else take the first."""
    label = np.zeros(len(scores), np.int16)
    size = np.diff(words_of)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return label
    begin, size = words_of[:-1][order], size[order]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), "left")  # texts longer than t
    stay = np.ones(scores.shape, bool)
    came = np.zeros(len(scores), np.int16)
    best = np.zeros((len(order), scores.shape[1]), np.float32)
    last = np.zeros(len(order), np.int16)
    for t in range(steps):
        k = int(active[t])
        v = best[:k]
        if t:
            top = v.max(axis=1)
            floor = (top - switch)[:, None]
            w = begin[:k] + t
            stay[w] = v >= floor
            came[w] = v.argmax(axis=1)
            v = np.maximum(v, floor) - top[:, None]
        best[:k] = v + scores[begin[:k] + t]
        done = int(active[t + 1]) if t + 1 < steps else 0
        last[done:k] = best[done:k].argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = int(active[t])
        w = begin[:k] + t
        label[w] = last[:k]
        last[:k] = np.where(stay[w, last[:k]], last[:k], came[w])
    return label


def _identify(model):
    def run(batches):
        m = model.value
        n_langs = max(len(m.langs), 1)
        for batch in batches:
            held, elements = [], 0
            texts = batch.column(1)
            for c in chunks(texts):
                g = word_grams(c)
                points = np.concatenate([[0], np.cumsum(_HEAD[c.data])])
                base = np.repeat(points[c.offsets[:-1]], np.diff(g.words_of))
                plain = np.concatenate([[0], np.cumsum(_ASCII_LETTER[c.data])])
                plain = plain[c.offsets[1:]] > plain[c.offsets[:-1]]
                real = np.array([p or any(x.isalpha() for x in (texts[c.lo + d].as_py() or "")) for d, p in enumerate(plain)], bool)
                start, end = points[g.start] - base, points[g.end] - base
                held.append((c, g.words_of, word_scores(g, m), start.astype(np.int32), end.astype(np.int32), real))
                elements += len(start) * n_langs
                if elements >= DECODE_ELEMENTS:
                    yield _labelled(batch, held, m)
                    held, elements = [], 0
            if held:
                yield _labelled(batch, held, m)
    return run


def _labelled(batch, held, m) -> pa.RecordBatch:
    lo, hi = held[0][0].lo, held[-1][0].hi
    counts = np.concatenate([np.diff(h[1]) for h in held])
    words_of = np.concatenate([[0], np.cumsum(counts)])
    scores, start, end = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
    real = np.concatenate([h[5] for h in held])
    held.clear()
    n, doc = hi - lo, np.repeat(np.arange(hi - lo), counts)
    if m.langs:
        label = decode(scores, words_of)
        letters = np.bincount(doc * len(m.langs) + label, weights=end - start, minlength=n * len(m.langs)).reshape(n, -1)
        pred, total = letters.argmax(axis=1), letters.sum(axis=1)
        known = real & (total > 0)
        share = np.where(known, letters.max(axis=1) / np.maximum(total, 1), 0.0)
    else:
        label, pred, known, share = np.zeros(len(doc), np.int16), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n)
    names = pa.array(m.langs or ["und"], pa.string())
    turn = np.ones(len(doc), bool)
    turn[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
    turn &= known[doc]
    opens = np.flatnonzero(turn)
    closes = np.flatnonzero(np.concatenate([(label[1:] != label[:-1]) | (doc[1:] != doc[:-1]), np.ones(min(len(doc), 1), bool)]) & known[doc])
    spans = pa.StructArray.from_arrays(
        [pa.array(start[opens].astype(np.int64)), pa.array(end[closes].astype(np.int64)), names.take(pa.array(label[opens].astype(np.int64)))], ["start", "end", "lang"])
    at = np.concatenate([[0], np.cumsum(np.bincount(doc[opens], minlength=n))]).astype(np.int32)
    lang = names.take(pa.array(pred)).to_numpy(zero_copy_only=False).astype(object)
    lang[~known] = "und"
    return pa.RecordBatch.from_arrays(
        [batch.column(0).slice(lo, n), pa.array(lang, pa.string()), pa.array(share), pa.ListArray.from_arrays(pa.array(at), spans)],
        ["row", "lang_pred", "score", "spans"])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, with ``lang_pred``, ``score``
    (0 to 1) and ``spans`` (start, end in code points, lang) of its whole text.

    Null text or text without a letter: ``und``, score 0, no spans; likewise for
    every row when the model knows no language. Columns of ``docs`` may have any
    names and nulls; an empty table gives no rows.
    """
    row = [F.col(f"`{c}`") for c in docs.columns]
    src = docs.select(F.struct(*row).alias("row"), F.col(text).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(src, _identify(shared), schema_with(
        [src.schema["row"]], "lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"))


def trained_on_rest(docs: DataFrame) -> Model:
    """The model learned from the labelled documents that are not held out."""
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return train(known.select(F.col("lang").cast("string"), F.col("text").cast("string")))


def language_filter(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, ...)`` with a language: predicted and
    not ``und``. A text in several languages stays, however evenly they share it;
    ``least_score`` can ask for a share of the letters in one language."""
    found = identify(docs, trained_on_rest(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("row.*")

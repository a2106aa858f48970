"""Packing of token pieces into sequences by a configuration linear program.

The lengths of all pieces make a histogram of at most ``capacity`` values, the
only thing that reaches the driver. A configuration is a way to fill one
sequence: how many pieces of each length. The program asks for the fewest
configurations, fractionally, that cover the histogram. Multiplicative weights
solve it: every length has a weight that falls as it is covered, the next
configuration is the dearest one under the weights (an unbounded knapsack, by
dynamic programming over the capacity), and it is used as often as its scarcest
length allows. Every configuration of the solution is rounded down to whole
sequences that use no piece twice, the other pieces are placed best fit, in
groups of equal length, and the fewest sequences are kept: of that, of the same
with full configurations only, and of best fit alone. The weights also price
every length, which bounds the sequences from below; while the plan is further than
GAP above that, the program is solved again with smaller steps.

Pieces are then numbered within their length and look up their place in the
plan, whose size depends on the number of configurations, not on the data.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .memo import REMEMBERED, UnitMemo
from .staging import arrow_map, schema_with, staged

#: Multiplicative weights: fall of a weight as its length is covered once, and
#: lead in coverage from which a length has no value.
RATE, AHEAD = 10.0, 0.3
#: Runs of the program: coverage of one step, and steps at most. The next run, with
#: smaller steps, is made only while the sequences are more than GAP (and more than
#: one) above the best lower bound that the weights of any step have proved; the
#: last one only if the others have found better plans than best fit.
RUNS = ((0.1, 300), (0.02, 1200), (0.005, 2500))
GAP = 0.001

# The pre-tokenising pattern of byte-level BPE.
# PLAIN_TOKENS is the same for texts without a character that ODD finds, on
# which the two regex libraries' classes of letters, digits and spaces agree.
PRE_TOKENS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
PLAIN_TOKENS = rf" ?[{_LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"
ODD = "[^\x00-\x1b\x20-\x84\x86-±´-¸º»¿-ɏ]"


class ByteTokens:
    """A byte-level BPE tokenizer file; frequent pre-tokens are remembered."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unit, self.plain, self.odd = regex.compile(PRE_TOKENS), re.compile(PLAIN_TOKENS), re.compile(ODD)
        self.memo = UnitMemo(self._ids, remembered)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as the machine's 32-bit integers; the strings of
        added tokens are those tokens, as in the library."""
        if any(t in text for t in self.added):
            return np.array(self._ids([text])[0], np.uint32).tobytes()
        return self.memo.joined((self.unit if self.odd.search(text) else self.plain).findall(text))


@lru_cache(maxsize=2)
def byte_tokens(path: str, remembered: int) -> ByteTokens:
    return ByteTokens(path, remembered)


def _ranks(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Place of each value among the equal values so far; ``seen`` is updated."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    within = np.arange(len(values)) - np.repeat(head, np.diff(np.concatenate([head, [len(values)]])))
    out = np.empty(len(values), np.int64)
    out[order] = within + seen[ordered]
    seen += np.bincount(values, minlength=len(seen))
    return out


def _pieces(path: str, capacity: int, closing: int, remembered: int):
    def run(batches):
        tokens, seen = byte_tokens(path, remembered), np.zeros(capacity + 1, np.int64)
        end = np.array([closing], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                own = batch.slice(lo, 512)
                row, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(own.column(1).to_pylist()):
                    ids = tokens.encode(text or "") + end
                    n = len(ids) // 4
                    at, size = 0, (n - 1) % capacity + 1
                    while at < n:
                        row.append(k)
                        piece.append(0 if at == 0 else piece[-1] + 1)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * at:4 * (at + size)]))
                        at, size = at + size, capacity
                lengths = np.array(length, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(lengths), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()),
                     pa.array(_ranks(lengths, seen))],
                    ["row", "piece", "start", "length", "ids_crc32", "part", "nth"])
    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, closing: int = 2, text: str = "text",
                 remembered: int = REMEMBERED) -> DataFrame:
    """Cut the tokens of every text (null: empty), each closed by the id
    ``closing``, into pieces of at most ``capacity`` tokens.

    Only texts of more tokens are cut, into full pieces after a first piece with
    the rest. Returns a staged table ``row`` (struct of all columns but the
    text), ``piece, start, length, ids_crc32`` and ``part, nth``, the task that
    cut the piece and the piece's number there among those of its length. A Python
    worker remembers the ids of twice ``remembered`` pre-tokens (some 200 bytes each).
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    src = docs.select(F.struct(*rest).alias("row"), F.col(text).cast("string").alias("_text"))
    out = arrow_map(src, _pieces(path, capacity, closing, remembered), schema_with(
        [src.schema["row"]], "piece int, start long, length long, ids_crc32 long, part int, nth long"))
    return staged(out, "pack-pieces")


def priciest_fill(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each size (ascending) that fill ``capacity`` at the highest
    price: an unbounded knapsack. Room left over is filled with nothings of size 1."""
    dense = np.full(capacity + 1, -np.inf)
    dense[1] = 0.0
    dense[sizes] = np.where(sizes == 1, np.maximum(price, 0), price)
    backwards = dense[::-1].copy()
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = value[:c] + backwards[capacity - c:capacity]
        best = int(worth.argmax())
        value[c], last[c] = worth[best], c - best
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        k = int(np.searchsorted(sizes, last[c]))
        if k < len(sizes) and sizes[k] == last[c] and price[k] > 0:
            counts[k] += 1
        c -= int(last[c])
    return counts


def fractional_cover(sizes: np.ndarray, need: np.ndarray, capacity: int, step: float,
                     steps: int) -> tuple[list[tuple[float, np.ndarray]], float]:
    """Configurations and how often each is used: a fractional solution that
    uses no length more often than ``need`` (positive) and covers as much of it
    as it can; and a lower bound of the sequences that all of ``need`` takes. A
    length's weight falls with its coverage, and a length that runs ``AHEAD`` of the
    mean is worth nothing until the others catch up; a step covers ``step`` of the
    scarcest length of the configuration. Prices under which no filling is worth
    more than one sequence bound the sequences from below by what ``need`` is worth."""
    covered = np.zeros(len(sizes))
    used: dict[bytes, list] = {}
    bound = 0.0
    for _ in range(steps):
        weight = np.exp(-RATE * (covered - covered.mean())) - np.exp(-RATE * AHEAD)
        price = np.maximum(sizes * weight, 0)
        fill = priciest_fill(sizes, price, capacity)
        inside = fill > 0
        if not inside.any():
            break
        bound = max(bound, float((need * price).sum() / (fill * price).sum()))
        times = step * float((need[inside] / fill[inside]).min())
        covered += fill * times / need
        used.setdefault(fill.tobytes(), [0.0, fill])[0] += times
        if covered.min() >= 3:
            break
    return [(times / covered.max(), fill) for times, fill in used.values()], bound


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Place ``left`` (length: pieces), longest first, each in the fullest open
    sequence that holds it; equal sequences are kept as one group."""
    free: dict[int, dict[tuple, int]] = {}

    def put(fill: tuple, room: int, n: int) -> None:
        groups = free.setdefault(room, {})
        groups[fill] = groups.get(fill, 0) + n

    for size in sorted(left, reverse=True):
        n = left[size]
        while n > 0:
            room = min((r for r in free if r >= size), default=None)
            if room is None:
                each = min(capacity // size, n)
                put(((size, each),), capacity - each * size, n // each)
                n %= each
                continue
            fill, count = free[room].popitem()
            if not free[room]:
                del free[room]
            each = min(room // size, n)
            some = min(count, n // each)
            if count > some:
                put(fill, room, count - some)
            put((*fill, (size, each)), room - each * size, some)
            n -= each * some
    return [(fill, n) for groups in free.values() for fill, n in groups.items()]


def _rounded(solution: list[tuple[float, np.ndarray]], sizes: np.ndarray, need: np.ndarray, capacity: int,
             least: int) -> list[tuple[tuple, int]]:
    """Whole sequences of the configurations that fill ``least`` at least, the
    fullest first, and the other pieces best fit."""
    rest, out = need.copy(), []
    fullest = sorted(solution, key=lambda x: -int((x[1] * sizes).sum()))
    for times, fill in fullest:
        inside = fill > 0
        whole = round(times) if int((fill * sizes).sum()) == capacity else int(times + 1e-9)
        n = min(whole, int((rest[inside] // fill[inside]).min()))
        if n and int((fill * sizes).sum()) >= least:
            rest -= n * fill
            out.append((tuple((int(s), int(a)) for s, a in zip(sizes[inside], fill[inside])), n))
    return out + best_fit({int(s): int(n) for s, n in zip(sizes, rest) if n}, capacity)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Whole sequences that hold exactly the pieces of ``histogram``: fillings
    ``((length, pieces), ...)`` and how many sequences have each."""
    left = {size: n for size, n in histogram.items() if n > 0}
    out = []
    if left.get(capacity):
        out.append((((capacity, 1),), left.pop(capacity)))
    if not left:
        return out
    sizes = np.array(sorted(left), np.int64)
    need = np.array([left[s] for s in sizes.tolist()], np.int64)
    count = lambda way: sum(n for _, n in way)
    best, bound = best_fit(left, capacity), float((need * sizes).sum()) / capacity
    alone = count(best)
    for k, (step, steps) in enumerate(RUNS):
        if k == len(RUNS) - 1 and count(best) == alone:
            break
        solution, proved = fractional_cover(sizes, need.astype(float), capacity, step, steps)
        bound = max(bound, proved)
        best = min([best, *(_rounded(solution, sizes, need, capacity, least) for least in (capacity, 0))], key=count)
        if count(best) <= math.ceil(bound - 1e-6) + max(1, GAP * bound):
            break
    return out + best


class Places:
    """Where the r-th piece of each length goes under a plan."""

    def __init__(self, fills: list[tuple[tuple, int]]):
        slots: dict[int, list] = {}
        base = 0
        for fill, n in fills:
            offset = 0
            for size, each in fill:
                table = slots.setdefault(size, [[0], [], [], []])
                table[0].append(table[0][-1] + each * n)
                for column, x in zip(table[1:], (each, base, offset)):
                    column.append(x)
                offset += size * each
            base += n
        self.sequences = base
        self.slots = {size: tuple(np.array(x, np.int64) for x in t) for size, t in slots.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for size in np.unique(length).tolist():
            own = length == size
            first, each, base, start = self.slots[size]
            k = np.searchsorted(first, rank[own], "right") - 1
            nth = rank[own] - first[k]
            sequence[own] = base[k] + nth // each[k]
            offset[own] = start[k] + nth % each[k] * size
        return sequence, offset


def _placed(places):
    def run(batches):
        for b in batches:
            sequence, offset = places.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("row", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                ["row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def packed(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Place every row of ``token_pieces`` in a sequence of at most
    ``capacity`` tokens: adds ``sequence_id`` and ``offset`` (gapless from 0).

    A piece's rank among all pieces of its length is its number in its task plus
    those of earlier tasks, so no length, however common, is sorted in one task.
    """
    counts = staged(pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")), "pack-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("base"))
    return arrow_map(ranked, _placed(Places(plan(histogram, capacity))), schema_with(
        [pieces.schema["row"]], "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, closing: int = 2, remembered: int = REMEMBERED) -> DataFrame:
    """Tokenise, cut and pack ``docs(text, ...)``: one row for each piece.

    Null text is empty and still closes with ``closing``, so every row has a
    piece; repeated rows are packed one by one; other columns, of any name, stay
    in ``row``; an empty table gives no rows.
    """
    return packed(token_pieces(docs, path, capacity, closing, remembered=remembered), capacity)

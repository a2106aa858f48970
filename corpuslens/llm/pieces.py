"""SentencePiece (BPE) encoding by a prefix table, and decoding.

Every prefix of a text has one last token in its encoding, and the encoding of
a text without its last token is that of the shorter prefix. So encoding fills
a table: an Aho-Corasick automaton over the pieces reports, at each position,
the pieces that end there; the one whose left neighbour (the last token of the
prefix before it) is compatible with it is the last token at that position. The
ids are then read off backwards. Work is linear in the text, also for a very
long word.

Two tokens are compatible when byte-pair merging leaves the border between them
alone. Read a piece's rank as the time of its merge: a part of a token exists
from its own merge to that of the part it goes into. The border is crossed when
some right-edge part of the left token and left-edge part of the right token
form a piece whose time comes before both are used up; at equal times the
leftmost merge comes first, as in the library.

No piece holds a character before a space mark, nor joins a character that is
in no longer piece, so texts are cut there into units and units are remembered.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo import UnitMemo
from .staging import arrow_map, schema_with

SPACE = "▁"
#: Units in each of two generations, and token pairs before they start afresh,
#: that a Python worker remembers.
REMEMBERED = 500_000
_NEVER = 1 << 60


class PieceModel:
    """A SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "ﬁ ①  Á\t　 "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model must keep texts as they are but for a leading space")
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.control = np.array([sp.is_control(i) for i in range(n)])
        self.unknown = sp.unk_id()
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        if len(self.byte_id) != 256:
            raise ValueError("the model must have byte fallback")
        # what an id stands for by itself; bytes from 0x80 on are parts of a character
        self.surface = ["" if self.control[i] else " ⁇ " if i == self.unknown else p for i, p in enumerate(self.pieces)]
        for i, b in self.byte_of.items():
            self.surface[i] = chr(b)
        self.whole = np.array([self.byte_of.get(i, 0) < 0x80 for i in range(n)])
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        order = {s: k for k, s in enumerate(sorted({-sp.get_score(i) for i in plain}))}
        self.id_of = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: order[-sp.get_score(i)] for i in plain}
        self._edges()
        self._units()
        self.pairs: dict[int, bool] = {}
        self.memo = UnitMemo(lambda units: [self._encode_unit(u) for u in units], REMEMBERED)

    def _merges(self, word: str) -> list:
        """Byte-pair merging of a short string: the remaining parts, each a
        ``(text, left part, right part)`` tree."""
        parts: list = [(c, None, None) for c in word]
        while len(parts) > 1:
            ranks = [self.rank.get(a[0] + b[0], _NEVER) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == _NEVER:
                break
            k = ranks.index(best)
            parts[k:k + 2] = [(parts[k][0] + parts[k + 1][0], parts[k], parts[k + 1])]
        return parts

    def _edges(self) -> None:
        """Left and right edge parts of every token, each with the time at which
        it is used up, and the automaton of the tokens that merging can make."""
        self.left: dict[int, list[tuple[str, int]]] = {}
        self.right: dict[int, list[tuple[str, int]]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            parts = self._merges(piece)
            if len(parts) != 1:
                continue  # merging its characters gives other tokens
            for side, child in ((self.left, 1), (self.right, 2)):
                node, until, chain = parts[0], _NEVER, []
                while node is not None:
                    chain.append((node[0], until))
                    until = self.rank.get(node[0], _NEVER)
                    node = node[child]
                side[i] = chain
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()

    def _units(self) -> None:
        joined = {c for p in self.id_of if len(p) > 1 for c in p}
        inside = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of)
        lone = [chr(c) for c in range(128) if chr(c) not in joined and chr(c) != " "]
        alone = "".join(re.escape(c) for c in lone)
        if inside:
            self.unit = re.compile(r"(?s).+")
        else:
            self.unit = re.compile(f"[{alone}]| +[^ {alone}]*|[^ {alone}]+" if alone else r" +[^ ]*|[^ ]+")

    def compatible(self, a: int, b: int) -> bool:
        rank = self.rank
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                at = rank.get(x + y, _NEVER)
                if at < x_until and at <= y_until:
                    return False
        return True

    def _encode_unit(self, unit: str) -> list[int]:
        """Ids of a unit by its prefix table."""
        unit = unit.replace(" ", SPACE)
        n = len(unit)
        last = [-1] * (n + 1)   # token that ends the encoding of each prefix; -1: a character without piece
        width = [1] * (n + 1)
        pairs, ended = self.pairs, 0
        for end, (token, size) in self.automaton.iter(unit):
            end += 1
            if end == ended:
                continue  # a prefix has one last token
            before = end - size
            if before and (left := last[before]) >= 0:
                key = left << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= REMEMBERED:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(left, token)
                if not fits:
                    continue
            last[end], width[end], ended = token, size, end
        ids: list[int] = []
        while n:
            if last[n] >= 0:
                ids.append(last[n])
            else:
                ids.extend(self.byte_id[b] for b in reversed(unit[n - 1].encode()))
            n -= width[n]
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as the machine's 32-bit integers."""
        return self.memo.joined(self.unit.findall(" " + text.replace(SPACE, " "))) if text else b""

    def decode(self, ids) -> str:
        """Text of ids as the library's ``decode``: byte pieces are read as
        UTF-8 (U+FFFD for a byte that is none), control ids give nothing and
        the space mark that opens the text is dropped."""
        byte_of, ids = self.byte_of, np.asarray(ids, np.int64)
        whole, ids = bool(self.whole[ids].all()), ids.tolist()
        if whole:
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in byte_of:
                    run.append(byte_of[i])
                    continue
                if run:
                    out.append(_utf8(bytes(run)))
                    run.clear()
                out.append(self.surface[i])
            if run:
                out.append(_utf8(bytes(run)))
            text = "".join(out)
        return (text[1:] if text[:1] == SPACE else text).replace(SPACE, " ")


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, k = [], 0
    while k < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[k:k + size].decode())
                k += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """The model file at ``path``, read once in each Python worker."""
    return PieceModel(path)


def _rows_of(batch: pa.RecordBatch, limit: int = 2 << 20):
    """Slices of a batch with about ``limit`` bytes in their last column."""
    if not batch.num_rows:
        return
    column = batch.column(batch.num_columns - 1)
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64))
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _encoded(path: str):
    def run(batches):
        m = piece_model(path)
        for batch in batches:
            for part in _rows_of(batch):
                ids = [m.encode(t or "") for t in part.column(1).to_pylist()]
                flat = pa.Array.from_buffers(pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))])
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["row", "ids"])
    return run


def _decoded(path: str):
    def run(batches):
        m = piece_model(path)
        for batch in batches:
            for part in _rows_of(batch, 1 << 19):
                ids = part.column(1)
                ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
                texts = [m.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.string())], ["row", "ids", "text"])
    return run


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Each row of ``docs`` (all columns but the text) as a struct ``row``, with
    the ``ids`` (array<int>) of its whole text under the model file ``path``, no
    begin or end ids. Null text is empty text: no ids. Rows are independent, so
    repeated rows, nulls and any other columns pass through; an empty table
    gives no rows."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    src = docs.select(F.struct(*rest).alias("row"), F.col(text).cast("string").alias("_text"))
    return arrow_map(src, _encoded(path), schema_with([src.schema["row"]], "ids array<int>"))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows(row, ids)`` of ``encode`` with their decoded ``text``; null ids
    are no ids, whose text is empty."""
    src = rows.select("row", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return arrow_map(src, _decoded(path), schema_with([src.schema["row"]], "ids array<int>, text string"))

"""Repair of conversation structure by alignment to the role grammar.

The initials of a sound conversation's roles are ``(s?(ua)+)?``. For a given
length only one string of the grammar exists for each beginning, and all its lengths are
prefixes of one alternating string: one Wagner-Fischer table of turns against
that string holds the cost of every feasible length in its last row. Ukkonen
bands bound the table: a narrow one gives an incumbent cost, and a path that
leaves the band of a third of that cost inserts or deletes too much to be as
cheap. Each length with the least cost is traced back to its ASCII-least
audit, and these are compared.

Turns are cut into segments of ``SEGMENT`` rows of a range partition of all turns,
so a long conversation is aligned by many tasks. A segment is aligned from
every state the string may be in at its start to every state at its end; its
inserts come before a turn, never after the last, so audits of equal cost can
be compared segment by segment. One pass over segments and texts, sorted by
conversation, joins the segments (cost, then audit), adds what is missing at the
end and writes the repaired turns as a stream; a text is held one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import arrow_map, hinted, schema_with, staged

#: Rows that one alignment holds.
SEGMENT = 64
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
SPACES = " \t\n\x0b\x0c\r"
#: States of the grammar: nothing yet, after s, after u, after a.
START, S, U, A = range(4)
#: What ends a conversation that is left in a state: cost and edits.
ENDING = {START: (0, ""), S: (2 * INSERT, "II"), U: (INSERT, "I"), A: (0, "")}
ROLES = {"u": "user", "a": "assistant"}
_BIG = 1 << 60


def _wanted(head: str, j: int) -> str:
    """Character j of the alternating string that begins with ``head``."""
    if head == "s":
        return "s" if j == 0 else "au"[j % 2]
    return head if j % 2 == 0 else ("a" if head == "u" else "u")


def _match(turn: str, want: str) -> int:
    """Cost of making a turn the wanted role. A turn's code is its initial
    (``x`` for others), a capital one if truncated, ``-`` if it must go."""
    if turn == "-":
        return _BIG
    cost = TRUNCATED if turn.isupper() else 0
    if turn.lower() == want:
        return cost
    return _BIG if want == "s" else cost + REROLE


def _table(code: str, head: str, band: int) -> list[dict[int, int]]:
    """Row i, column j: cost of the first i turns against the first j
    characters, for ``|i - j| <= band``; the last row takes no inserts."""
    n = len(code)
    rows: list[dict[int, int]] = [{0: 0}]
    for i in range(n + 1):
        if i:
            turn, above, row = code[i - 1], rows[-1], {}
            for j in range(max(0, i - band), i + band + 1):
                best = above.get(j, _BIG) + DELETE
                if j and j - 1 in above:
                    best = min(best, above[j - 1] + _match(turn, _wanted(head, j - 1)))
                if best < _BIG:
                    row[j] = best
            rows.append(row)
        if i < n:
            row = rows[-1]
            for j in range(max(1, i - band), i + band + 1):
                if _wanted(head, j - 1) != "s" and j - 1 in row:
                    row[j] = min(row.get(j, _BIG), row[j - 1] + INSERT)
    return rows


def _least_audit(code: str, head: str, rows: list[dict[int, int]], length: int) -> str:
    """The ASCII-least cheapest edits against the first ``length`` characters."""
    n = len(code)
    good: list[set[int]] = [set() for _ in range(n + 1)]
    good[n].add(length)
    for i in range(n, -1, -1):
        row = rows[i]
        if i < n:
            for j in range(max(good[i], default=0), 0, -1):
                if j in good[i] and _wanted(head, j - 1) != "s" and row.get(j - 1, _BIG) + INSERT == row[j]:
                    good[i].add(j - 1)
        if i:
            for j in good[i]:
                if rows[i - 1].get(j, _BIG) + DELETE == row[j]:
                    good[i - 1].add(j)
                if j and rows[i - 1].get(j - 1, _BIG) + _match(code[i - 1], _wanted(head, j - 1)) == row[j]:
                    good[i - 1].add(j - 1)
    i, j, out = 0, 0, []
    while i < n:
        here, below = rows[i][j], rows[i + 1]
        if j in good[i + 1] and below[j] == here + DELETE:
            out.append("D")
            i += 1
        elif j + 1 in good[i] and _wanted(head, j) != "s" and rows[i][j + 1] == here + INSERT:
            out.append("I")
            j += 1
        else:
            out.append("K" if code[i].lower() == _wanted(head, j) else "R")
            i, j = i + 1, j + 1
    return "".join(out)


def _ends(code: str, head: str, least: int) -> Iterator[tuple[int, int, str]]:
    """For even and odd lengths of at least ``least``: (parity, cost, audit)."""
    band = 2
    while True:
        rows = _table(code, head, band)
        last = {j: c for j, c in rows[-1].items() if j >= least}
        best = [min((c for j, c in last.items() if j % 2 == p), default=_BIG) for p in (0, 1)]
        need = len(code) + 2 if max(best) >= _BIG else max(best) // INSERT
        if need <= band:
            break
        band = need
    for p in (0, 1):
        if best[p] < _BIG:
            yield p, best[p], min(_least_audit(code, head, rows, j) for j, c in last.items() if j % 2 == p and c == best[p])


@lru_cache(maxsize=1 << 14)
def align(code: str) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest edits of a segment's turns for every state before and
    after it: (cost, ASCII-least audit). Ends with an edit of a turn."""
    n = len(code)
    found: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(key, cost, audit):
        found[key] = min(found.get(key, (_BIG, "")), (cost, audit))

    for state in (START, S, U, A):
        offer((state, state), DELETE * n, "D" * n)
    for p, cost, audit in _ends(code, "u", 1):
        for state in (START, S, A):
            offer((state, U if p else A), cost, audit)
    for p, cost, audit in _ends(code, "a", 1):
        offer((U, A if p else U), cost, audit)
    if "s" in code or "S" in code:
        for k, turn in enumerate(code):
            if turn in "sS":
                offer((START, S), DELETE * (n - 1) + _match(turn, "s"), "D" * k + "K" + "D" * (n - 1 - k))
        for p, cost, audit in _ends(code, "s", 2):
            offer((START, A if p else U), cost, audit)
    return found


def joined(segments: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """The cheapest edits of consecutive segments: (cost, ASCII-least audit)."""
    live = {START: (0, 0)}  # state: cost, place of its audit among the states' audits
    back = []
    for seg in segments:
        best: dict[int, tuple] = {}
        for (before, after), (cost, audit) in seg.items():
            if before in live:
                new = (live[before][0] + cost, live[before][1], audit, before)
                best[after] = min(best.get(after, new), new)
        order = {key: place for place, key in enumerate(sorted({(b[1], b[2]) for b in best.values()}))}
        live = {state: (b[0], order[b[1], b[2]]) for state, b in best.items()}
        back.append(best)
    cost, _, tail, state = min((c + ENDING[s][0], place, ENDING[s][1], s) for s, (c, place) in live.items())
    audit = [tail]
    for best in reversed(back):
        _, _, part, state = best[state]
        audit.append(part)
    return cost, "".join(reversed(audit))


@dataclass
class Totals:
    """Counts of a run of sorted turns; runs are added up in order."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None
    code: list = field(default_factory=list)

    def add(self, other: Totals) -> None:
        self.blank += other.blank
        self.duplicate += other.duplicate
        self.truncated += other.truncated
        self.illegal += other.illegal
        if self.last is not None and other.first is not None:
            self.illegal += self.last + other.first not in ("su", "ua", "au")
        if other.low is not None:
            self.turns += other.turns - (self.high == other.low)
            self.low = other.low if self.low is None else self.low
            self.high = other.high
        self.first = other.first if self.first is None else self.first
        self.last = other.last if other.last is not None else self.last

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")
_SEGMENT_SCHEMA = ("ck string, part int, seq long, blank long, duplicate long, truncated long, illegal long, "
                   "turns long, low long, high long, first string, last string, code string")


def _segments(batches):
    """Sorted turns as rows of segments."""
    now, ck, seq, before, out = Totals(), None, 0, None, []

    def flush():
        nonlocal now, seq
        if now.code:
            out.append((ck, part, seq, *(getattr(now, c) for c in _COUNTS), "".join(now.code)))
            seq += 1
        now = Totals()

    part = 0
    names = _SEGMENT_SCHEMA.replace(",", "").split()[::2]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    kinds = [types[t] for t in _SEGMENT_SCHEMA.replace(",", "").split()[1::2]]

    def batch():
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    for b in batches:
        for key, turn, initial, digest, blank, truncated, later, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != ck or len(now.code) >= SEGMENT:
                flush()
            ck, part = key, p
            again = later or (key, turn, digest) == before
            before = (key, turn, digest)
            one = Totals(first=initial, last=initial)
            code = initial if initial in ("s", "u", "a") else "x"
            if blank:
                one.blank, code = 1, "-"
            elif again:
                one.duplicate, code = 1, "-"
            elif truncated:
                one.truncated, code = 1, code.upper()
            if turn is not None:
                one.turns, one.low, one.high = 1, turn, turn
            now.add(one)
            now.code.append(code)
        if len(out) >= 4096:
            yield batch()
            out.clear()
    flush()
    yield batch()


def _repaired(as_turns: bool):
    """Rows of one conversation after another (the id, its segments, its turns)
    as audits with a digest, or as repaired turns."""
    def run(batches):
        state = None
        rows: list = []

        def begin(conv_id):
            return {"id": conv_id, "totals": Totals(), "segments": [], "cost": 0, "audit": None, "at": 0, "next": "u",
                    "emitted": 0, "sha": hashlib.sha256()}

        def emit(s, edit, turn, role, text):
            if as_turns:
                rows.append((s["id"], s["emitted"], edit, turn, role, text))
            else:
                s["sha"].update((("\n" if s["emitted"] else "") + role + ":").encode())
                s["sha"].update(text.encode())
            s["emitted"] += 1
            s["next"] = "a" if role[:1] == "u" else "u"

        def inserts(s):
            while s["at"] < len(s["audit"]) and s["audit"][s["at"]] == "I":
                emit(s, "I", None, ROLES[s["next"]], "")
                s["at"] += 1

        def settle(s):
            if s["audit"] is None:
                s["cost"], s["audit"] = joined([align(c) for c in s["segments"]])

        def finish(s):
            settle(s)
            inserts(s)
            if not as_turns:
                t = s["totals"]
                rows.append((s["id"], t.gaps(), t.blank, t.duplicate, t.truncated, t.illegal, s["cost"], s["audit"],
                             s["sha"].hexdigest()))

        schema = None
        for b in batches:
            if schema is None:
                id_type = b.schema.field("conv_id").type
                schema = pa.schema([("conv_id", id_type), *_TURNS] if as_turns else [("conv_id", id_type), *_AUDIT])
            for r in b.to_pylist():
                if r["kind"] == 0:
                    if state:
                        finish(state)
                    state = begin(r["conv_id"])
                elif r["kind"] == 1:
                    state["totals"].add(Totals(*(r[c] for c in _COUNTS)))
                    state["segments"].append(r["code"])
                else:
                    settle(state)
                    inserts(state)
                    edit = state["audit"][state["at"]]
                    state["at"] += 1
                    if edit != "D":
                        emit(state, edit, r["turn"], r["role"] if edit == "K" else ROLES[state["next"]], r["text"])
                if len(rows) >= 1024:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)
                    rows.clear()
        if state:
            finish(state)
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)
    return run


_TURNS = [("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
_AUDIT = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + \
    [("audit", pa.string()), ("repaired_sha256", pa.string())]
_DDL = {pa.int64(): "long", pa.string(): "string"}


def _aligned(turns: DataFrame, conversations: DataFrame | None, as_turns: bool) -> DataFrame:
    key = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("ck")
    blank = F.lit(" ")
    rows = turns.select(key, "conv_id", F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
                        F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    order = [F.col("ck"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    narrow = staged(rows.select("ck", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"),
                                (trimmed == "").alias("blank"),
                                (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated")), "conv-turns")

    seen = narrow.groupBy("ck", "digest").agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("open"),
                                              F.min("turn").alias("first")).where("n > 1").drop("n")
    later = F.when(F.col("open"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    flagged = narrow.join(hinted(staged(seen, "conv-repeats")), ["ck", "digest"], "left") \
        .select(*narrow.columns, F.coalesce(later, F.lit(False)).alias("later"))
    ranged = flagged.repartitionByRange(*order).sortWithinPartitions(*order) \
        .select("ck", "turn", "initial", "digest", "blank", "truncated", "later", F.spark_partition_id().alias("part"))
    segments = staged(arrow_map(ranged, _segments, _SEGMENT_SCHEMA), "conv-segments")

    ids = (turns if conversations is None else conversations).select(key, "conv_id").distinct()
    all_rows = ids.withColumn("kind", F.lit(0)).unionByName(segments.withColumn("kind", F.lit(1)), allowMissingColumns=True) \
        .unionByName(rows.drop("conv_id").withColumn("kind", F.lit(2)), allowMissingColumns=True)
    by = ["ck", "kind", "part", "seq", F.col("turn").asc_nulls_first(), "role", "digest"]
    all_rows = all_rows.repartition("ck").sortWithinPartitions(*by).drop("ck", "part", "seq", "digest")
    added = ", ".join(f"{c} {_DDL[t]}" for c, t in (_TURNS if as_turns else _AUDIT))
    return arrow_map(all_rows, _repaired(as_turns), schema_with([ids.schema["conv_id"]], added))


def audited(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The faults and the cheapest repair of every conversation of
    ``turns(conv_id, turn long, role string, text string, ...)``.

    Turns are taken by ``turn`` (nulls first; equal ones by role, then by a
    digest of role and text). A turn counts once: blank (no character but white space),
    else duplicate (its role and text were seen earlier), else truncated (its last character
    that is not white space is not one of ``.!?``). ``illegal`` counts neighbours whose
    role initials are not su, ua or au; ``gaps`` the turn numbers missing between
    least and greatest. Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (blank
    and duplicate turns must go), Insert an empty user or assistant turn 3; a
    truncated turn that stays adds 3. ``audit`` is the initials of the cheapest edits
    that give role initials ``(s?(ua)+)?``, the ASCII-least of equal ones.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` (of the repaired ``role:text``, joined by newlines) for each conv_id of
    ``conversations`` (default: of ``turns``), a null one included; one without turns has zeros, an
    empty audit and the digest of an empty string. A null role or text is one space.
    A role that begins with none of s, u, a can be reroled or deleted only. Other columns
    are ignored; an empty table gives no rows.
    """
    return _aligned(turns, conversations, False)


def repaired_turns(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The repaired conversations themselves: ``conv_id, place (from 0), edit (K, R
    or I), turn (null if inserted), role, text``, as ``audited`` decides."""
    return _aligned(turns, conversations, True)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults dealt by crc32(``conv_id:turn``) % 20: 0 drops
    a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role
    user. Nulls are one space."""
    blank = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    lot = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), lot.alias("lot")).where("lot <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", ""))
                       .otherwise(F.col("text")).alias("text"),
                       F.explode(F.array_repeat(F.lit(1), F.when(F.col("lot") == 3, 2).otherwise(1))).alias("copy")).drop("copy")

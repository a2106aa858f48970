"""Conversation repair against a plain search over all edits."""

import functools
import hashlib
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import conversations as module
from corpuslens.llm.catalog import QUERIES
from corpuslens.llm.conversations import align, audited, damaged, joined, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"
sys.setrecursionlimit(20_000)  # the plain search recurses by turn
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(turns):
    """(cost, audit) of [(initial, fault)] by trying every edit at every turn."""
    n = len(turns)

    @functools.cache
    def rest(i, state, inserts):
        found = [(0, "")] if i == n and state in ("", "a") else []

        def go(letter, cost, *after):
            c, a = rest(*after)
            found.append((c + cost, letter + a))

        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if inserts < 2:
            for want in nexts.replace("s", ""):
                go("I", 3, i, want, inserts + 1)
        if i < n:
            initial, fault = turns[i]
            go("D", 4, i + 1, state, 0)
            if fault not in ("blank", "duplicate"):
                for want in nexts:
                    if want == initial:
                        go("K", 3 * (fault == "truncated"), i + 1, want, 0)
                    elif want != "s":
                        go("R", 3 + 3 * (fault == "truncated"), i + 1, want, 0)
        return min(found, default=(10**9, ""))

    return rest(0, "", 0)


def damage(rows):
    out = []
    blank = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        role, text = blank(role), blank(text)
        lot = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role = "user" if lot == 4 else role
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def plain(rows, ids):
    """The rows of ``audited`` for turns whose order has no ties but repeats."""
    out = []
    for conv in ids:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0))
        mine = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in mine]
        faults = []
        for k, (_, role, text) in enumerate(mine):
            solid = SOLID.findall(text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in [m[1:] for m in mine[:k]]
                          else "truncated" if solid[-1] not in ".!?" else "")
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(list(zip(initials, faults)))
        lines, k, want = [], 0, "user"
        for edit in audit:
            if edit == "D":
                k += 1
                continue
            role, text = (want, "") if edit == "I" else (mine[k][1] if edit == "K" else want, mine[k][2])
            k += edit != "I"
            lines.append(f"{role}:{text}")
            want = "assistant" if role[:1] == "u" else "user"
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal,
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def some(rng, conversations, longest):
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            rows.append((c, t * rng.choice([1, 1, 2]) + 40 * t, role, rng.choice(["Yes.", "no", "", " \t", "Why? ", "a.b", "Long text!", f"t{t}."])))
    return rows


def key(r):
    return tuple((x is not None, x) for x in r)


def check(spark, rows, ids=None, extra=()):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    every = spark.createDataFrame([(i,) for i in ids], "conv_id long") if ids is not None else None
    got = [tuple(r) for r in audited(df, every).collect()]
    want = plain(rows, ids if ids is not None else {r[0] for r in rows})
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("alphabet", ["uauauauas-UAx", "s-xSX-u", "uuuu-U", "aaaaS"])
@pytest.mark.parametrize("size", [1, 3, 64])
def test_alignment_equals_every_edit(alphabet, size):
    rng = random.Random(alphabet + str(size))
    fault = lambda c: "blank" if c == "-" else "truncated" if c.isupper() else ""
    for _ in range(150):
        code = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 13)))
        parts = [align(code[i:i + size]) for i in range(0, len(code), size)]
        assert joined(parts) == cheapest([(c.lower(), fault(c)) for c in code]), code


def test_random_conversations(spark):
    rng = random.Random(4)
    rows = some(rng, 60, 12)
    rng.shuffle(rows)
    check(spark, rows)


def test_segments_of_long_conversations(spark, monkeypatch):
    rng = random.Random(9)
    check(spark, some(rng, 3, 150) + [(7, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(200)])
    assert len(module.align("ua" * 400)[0, 3][1]) == 800


def test_edge_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "Hi."), (2, None, "assistant", "A."), (None, 3, "user", "x"),
            (None, 5, "assistant", "y."), (4, 1, "system", "Be kind."), (5, 1, "user", "same."), (5, 1, "user", "same."),
            (5, 9, "user", "same."), (6, 1, "ünicode", "é"), (6, 2, "user", "w" * 200_000 + " ."),
            (8, -4, "user", "日本。"), (8, 2**40, "assistant", "ok?")]
    check(spark, rows, ids=[1, 2, None, 4, 5, 6, 8, 99], extra=["kind", "ck", "cost", "audit", "place", "code", "a.b"])


def test_no_rows(spark):
    out = audited(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[0] == "conv_id" and out.columns[-1] == "repaired_sha256"


def test_damage(spark):
    rng = random.Random(2)
    rows = some(rng, 80, 9) + [(None, None, None, None), (3, None, "user", None)]
    got = [tuple(r) for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=key) == sorted(damage(rows), key=key)


def test_repaired_turns_follow_the_grammar(spark):
    rows = some(random.Random(6), 40, 10)
    out = repaired_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.place)):
        by.setdefault(r.conv_id, []).append(r)
    for turns in by.values():
        assert [r.place for r in turns] == list(range(len(turns)))
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in turns))
    digests = {c: hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in t).encode()).hexdigest() for c, t in by.items()}
    want = {r[0]: r[-1] for r in plain(rows, {r[0] for r in rows})}
    assert {c: d for c, d in want.items() if c in digests} == digests


def test_query_on_the_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in QUERIES["op12_conversations"](spark, path).collect()]
    assert sorted(got, key=key) == sorted(plain(damage(rows), {r[0] for r in rows}), key=key)

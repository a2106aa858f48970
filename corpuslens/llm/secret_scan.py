"""Secret scanning by a trigram inverted index and exact verification.

Each rule's regular expression is turned into a Boolean query over the trigrams
that every match must hold: an OR of AND-sets. Spark posts ``(trigram, doc_id)``
for the trigrams that some query names, intersects the postings of each AND-set
and so finds the candidates of each rule; only those run its expression. A rule
without a mandatory trigram (a run of hex digits) scans every text.

The main path holds DataFrame functions only. Expressions must mean the same in
Java; the queries are derived on the driver with Python's own regex parser.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import hinted, staged

#: Strings followed at a time, and AND-sets of a query; beyond, a part of the
#: expression asks for nothing, which widens the candidates but loses none.
MOST_STRINGS, MOST_SETS = 24, 64


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of capture ``group`` (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
)

# A private key goes from BEGIN through the next END (no five dashes between
# them, which would be another BEGIN), or, without END, over its header lines
# and the base64 lines that follow, line breaks also as \n, with a last short
# one. Loops over single characters, for Java's loops over groups use its stack.
_KEY = r"[A-Z\x20]{0,40}PRIVATE KEY-----"
_TO_END = rf"[^-]*(?:--?-?-?[^-]+){{0,250}}-----END {_KEY}"
_BASE64 = (r"(?:[\t\r\n\x20]{0,9}(?:Proc-Type|DEK-Info):[^\r\n]*){0,4}"
           r"[\t\r\n\x20\\A-Za-z0-9+/=]*[A-Za-z0-9+/=]{32,}(?:\r?\n[\t\x20]*[A-Za-z0-9+/]+={0,2})?")

# Public formats of well-known credentials.
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", f"-----BEGIN {_KEY}(?:{_TO_END}|{_BASE64})?"),
)

RULES = (*BASE_RULES, *MORE_RULES)

#: An AND-set of trigrams for each way to match; one empty set: no condition.
Query = tuple[frozenset[str], ...]


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[k:k + 3] for k in range(len(text) - 2))


def _both(a: set, b: set) -> set:
    """AND of two ORs of AND-sets; a product too large leaves ``b`` out."""
    product = {x | y for x in a for y in b}
    return product if len(product) <= MOST_SETS else a


def _class_members(items) -> list[str] | None:
    out: list[str] = []
    for op, arg in items:
        if op is sre.LITERAL:
            out.append(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < MOST_STRINGS:
            out.extend(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return None
    return out if len({c.lower() for c in out}) <= 6 else None


def _walk(tokens, exact: set, known: set) -> tuple[set, set]:
    """Follow a sequence: ``exact`` are the strings the text may end with so
    far, ``known`` the AND-sets established before them."""
    for op, arg in tokens:
        tails: set | None = None  # what this part may add, if that is a small set
        inner = None              # else the AND-sets that it asks for itself
        if op is sre.LITERAL:
            tails = {chr(arg).lower()}
        elif op is sre.IN and (members := _class_members(arg)) is not None:
            tails = {c.lower() for c in members}
        elif op is sre.SUBPATTERN:
            tails, inner = _alone(arg[-1])
        elif op is sre.BRANCH:
            ways = [_alone(x) for x in arg[1]]
            if all(t is not None for t, _ in ways):
                tails = set().union(*(t for t, _ in ways))
            else:
                inner = set().union(*(n if t is None else {_trigrams(s) for s in t} for t, n in ways))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            more, inner = _alone(body)
            if more is not None and (low, high) == (0, 1):
                tails = more | {""}
            elif more is not None and low == high and len(more) ** low <= MOST_STRINGS:
                tails = {""}
                for _ in range(low):
                    tails = {a + b for a in tails for b in more}
            elif low == 0:
                inner = None
            elif more is not None:
                inner = {_trigrams(s * low) for s in more} if len(more) == 1 else None
        elif op is sre.AT:
            continue
        if tails is not None and len(exact) * len(tails) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in tails}
            continue
        known = _both(known, {_trigrams(s) for s in exact})
        if inner is not None:
            known = _both(known, inner)
        exact = tails if tails is not None and len(tails) <= MOST_STRINGS else {""}
    return exact, known


def _alone(tokens) -> tuple[set | None, set]:
    exact, known = _walk(tokens, {""}, {frozenset()})
    if known == {frozenset()} and not _breaks(tokens):
        return exact, known
    return None, _both(known, {_trigrams(s) for s in exact})


def _breaks(tokens) -> bool:
    """Whether a part of the sequence is not a small set of strings."""
    for op, arg in tokens:
        if op is sre.LITERAL or op is sre.AT or op is sre.IN and _class_members(arg) is not None:
            continue
        if op is sre.SUBPATTERN and _alone(arg[-1])[0] is not None:
            continue
        if op is sre.BRANCH and all(_alone(x)[0] is not None for x in arg[1]):
            continue
        if op is sre.MAX_REPEAT and _alone(arg[2])[0] is not None and (arg[0], arg[1]) == (0, 1):
            continue
        return True
    return False


def trigram_query(pattern: str) -> Query:
    """Trigrams, in lower case, that every match of ``pattern`` must hold."""
    exact, known = _walk(sre_parser.parse(pattern), {""}, {frozenset()})
    sets = _both(known, {_trigrams(s) for s in exact})
    if frozenset() in sets:
        return (frozenset(),)
    least = [s for s in sets if not any(t < s for t in sets)]
    return tuple(sorted(least, key=sorted))


def postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """The inverted index, for the given trigrams: ``trigram, doc_id``."""
    low = docs.select("doc_id", F.lower(F.col("text")).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select(F.explode(held).alias("trigram"), "doc_id")


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``doc_id, asked``: the rules (bits of a long) to verify on a document;
    rules without trigrams are not listed, for they are asked of all."""
    sets = [(k, s) for k, r in enumerate(rules) for s in trigram_query(r.pattern) if s]
    uses: dict[str, list] = {}
    for n, (_, s) in enumerate(sets):
        for bit, t in enumerate(sorted(s)):
            uses.setdefault(t, []).append((n, 1 << bit))
    if not uses:
        return docs.select("doc_id", F.lit(0).cast("long").alias("asked")).limit(0)
    used = F.create_map(*(x for t, at in uses.items() for x in (F.lit(t), F.array(
        *(F.struct(F.lit(n).alias("n"), F.lit(b).cast("long").alias("bit")) for n, b in at)))))
    full = F.create_map(*(F.lit(x) for n, (_, s) in enumerate(sets) for x in (n, (1 << len(s)) - 1)))
    rule = F.create_map(*(x for n, (k, _) in enumerate(sets) for x in (F.lit(n), F.lit(1 << k).cast("long"))))
    hits = postings(docs, sorted(uses)).select("doc_id", F.inline(used[F.col("trigram")]))
    met = hits.groupBy("doc_id", "n").agg(F.bit_or("bit").alias("bits")).where(F.col("bits") == full[F.col("n")])
    return met.groupBy("doc_id").agg(F.bit_or(rule[F.col("n")]).alias("asked"))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later expressions read as values: behind a
    generator they are not copied into the lambdas that use them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _scan(x: Column, join) -> Column:
    """Inclusive running values of a short int array."""
    return F.aggregate(x, F.array().cast("array<int>"), lambda acc, v: F.concat(
        acc, F.array(join(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), v))))


def running(df: DataFrame, names: Sequence[str], join=lambda a, b: a + b, block: int = 256) -> DataFrame:
    """``df`` with each array of ``names`` (ints from 0) replaced by its running
    sums, or the running values of another ``join`` with 0 as its unit. Blocks
    are joined first, so the work stays near linear for long arrays."""
    def cut(c: str) -> Column:
        n = F.col(c)
        return F.when(F.size(n) > 0, F.transform(F.sequence(F.lit(1), F.size(n), F.lit(block)),
                                                 lambda i: F.slice(n, i, block)))

    df = settled(df, **{f"{c}_b": cut(c) for c in names})
    df = settled(df, **{f"{c}_t": F.transform(f"{c}_b", lambda b: F.aggregate(b, F.lit(0), join)) for c in names})
    before = lambda c: F.slice(F.concat(F.array(F.lit(0)), _scan(F.col(f"{c}_t"), join)), F.lit(1), F.size(f"{c}_t"))
    df = settled(df, **{f"{c}_o": F.when(F.col(f"{c}_t").isNotNull(), before(c)) for c in names})
    sums = {f"{c}_r": F.flatten(F.zip_with(f"{c}_b", f"{c}_o", lambda b, base: F.transform(_scan(b, join), lambda v: join(base, v))))
            for c in names}
    df = settled(df, **sums)
    return df.drop(*names, *(f"{c}_{x}" for c in names for x in "bto")).withColumnsRenamed({f"{c}_r": c for c in names})


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """All rows of ``docs(doc_id, text, ...)`` as a struct ``row``, with
    ``spans``: array of ``start, rank, end`` (code points, end exclusive; rank
    is the place of the rule) in order of start, then rank: leftmost
    non-overlapping matches of each rule. Positions are the lengths of a rule's
    matches and of the gaps between them, added up.

    Null text is empty; repeated rows and repeated or null doc_ids are scanned
    each by itself; other columns may have any name; an empty table gives no
    rows.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = hinted(staged(candidates(texts, rules), "secret-candidates"))
    # the columns travel under other names, and flat: struct fields are not pruned through generators
    kept = [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, kept)), F.col("doc_id").alias("_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = own.join(asked.withColumnRenamed("doc_id", "_doc"), F.col("_id").eqNullSafe(F.col("_doc")), "left")

    found = {}
    for k, r in enumerate(rules):
        found[f"f{k}"] = F.col("_text").rlike(_quick(r))  # most texts that are asked hold no match
        if trigram_query(r.pattern) != (frozenset(),):
            bit = F.coalesce(F.col("asked"), F.lit(0)).bitwiseAND(F.lit(1 << k).cast("long")) != 0
            found[f"f{k}"] = F.when(bit, found[f"f{k}"]).otherwise(False)
    rows = settled(rows, **found)
    sizes, ks = {}, range(len(rules))
    for k, r in enumerate(rules):
        all_of = lambda g: F.transform(F.regexp_extract_all("_text", F.lit(r.pattern), F.lit(g)), F.length)  # noqa: E731, B023
        sizes[f"h{k}"] = F.when(F.col(f"f{k}"), all_of(0))
        sizes[f"a{k}"] = F.when(F.col(f"f{k}"), all_of(r.group))
        sizes[f"g{k}"] = F.when(F.col(f"f{k}"), F.transform(F.split("_text", r.pattern, -1), F.length))
    rows = settled(rows, **sizes)
    rows = settled(rows, **{f"s{k}": F.zip_with(f"g{k}", F.concat(F.array(F.lit(0)), f"h{k}"), lambda g, h: g + h) for k in ks})
    rows = running(rows, [f"s{k}" for k in ks])
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    spans = []
    for k, r in enumerate(rules):
        each = F.filter(F.arrays_zip(f"s{k}", f"h{k}", f"a{k}"), lambda x: x[f"a{k}"] >= r.least)  # noqa: B023
        each = F.transform(each, lambda x: F.struct(
            x[f"s{k}"].alias("start"), F.lit(k).alias("rank"), (x[f"s{k}"] + x[f"h{k}"]).alias("end")))  # noqa: B023
        spans.append(F.coalesce(each, none))
    rows = settled(rows.select(*kept, *(x.alias(f"p{k}") for k, x in enumerate(spans))),
                   spans=F.array_sort(F.concat(*(f"p{k}" for k in ks))))
    return rows.select(F.struct(*(F.col(k).alias(c) for c, k in zip(docs.columns, kept))).alias("row"), "spans")


def _quick(rule: Rule) -> str:
    """An expression that matches wherever ``rule`` has a span: for a bare run
    that must be long, the run with that length."""
    if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return f"{rule.pattern[:-1]}{{{rule.least}}}"
    return rule.pattern


def listed(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Code points of a block of a text that is redacted.
BLOCK = 1024


def redacted(rows: DataFrame, text: Column, mark: str = "[SECRET]") -> DataFrame:
    """``rows(spans, ...)`` with ``_new``: ``text`` with every span, overlapping
    ones as one, replaced by ``mark``.

    The work is near linear in the text and its spans: a span begins a new
    part where it starts at or after all earlier ends (a running maximum), and
    the gaps between parts are cut from blocks of the text, not from its start."""
    some = F.size("spans") > 0
    rows = settled(rows, _from=F.when(some, F.transform("spans", lambda s: s["start"])),
                   _to=F.when(some, F.transform("spans", lambda s: s["end"])), _len=F.length(text),
                   _blocks=F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    rows = running(rows, ["_to"], lambda a, b: F.greatest(a, b))
    zero = F.array(F.lit(0))
    rows = settled(rows, _gaps=F.filter(
        F.zip_with(F.concat(zero, "_to"), F.concat("_from", F.array("_len")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda g: g["a"] <= g["b"]))
    at = lambda x: F.floor(x / BLOCK).cast("int")

    def cut(g: Column) -> Column:
        first, last, start = at(g["a"]), at(g["b"] - 1), g["a"] % BLOCK + 1
        long = F.concat(F.substring(F.get("_blocks", first), start, F.lit(BLOCK)),
                        F.array_join(F.slice("_blocks", first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                        F.substring(F.get("_blocks", last), F.lit(1), g["b"] - last * BLOCK))
        return F.when(g["a"] == g["b"], "").when(first == last, F.substring(F.get("_blocks", first), start, g["b"] - g["a"])) \
            .otherwise(long)

    rows = settled(rows, _new=F.when(some, F.array_join(F.transform("_gaps", cut), mark)).otherwise(text))
    return rows.drop("_from", "_to", "_len", "_blocks", "_gaps")


def redact_documents(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` with secrets replaced in ``text`` and, where there
    is such a column, ``n_chars`` counted anew; null texts stay null."""
    text = F.col("row.text")
    rows = redacted(scan(docs, rules), text)
    out = []
    for c, kind in docs.dtypes:
        if c == "text":
            out.append(F.col("_new").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.size("spans") > 0, F.length("_new")).otherwise(F.col("row.n_chars")).cast(kind).alias(c))
        else:
            out.append(F.col(f"row.`{c}`"))
    return rows.select(*out)

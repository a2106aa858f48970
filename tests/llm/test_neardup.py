import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cases import edge_docs, no_docs
from conftest import SMOKE
from corpuslens.llm import catalog, neardup
from corpuslens.llm.graph import connected_components
from corpuslens.llm.neardup import BANDS, band_keys, deduplicated, near_duplicates, shingle_sets, signature, tile_links

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k:k + size]) for k in range(max(len(words) - size + 1, 1))} if words else set()


def brute_force(texts, size=4, threshold=80):
    sets = {d: shingles(t, size) for d, t in texts.items()}
    group = {d: d for d in texts}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in texts}


def planted(seed=5):
    """Families around the threshold, exact copies, and texts with a shared passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts, passage = {}, " ".join(word() for _ in range(40))
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 12, 60, 150]))]
        for _ in range(rng.randrange(2, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = word()
            text = " ".join(copy)
            texts[len(texts)] = rng.choice([text, text.upper(), passage + " " + text, text.replace(" ", "\n")])
    for _ in range(20):
        texts[len(texts)] = passage + " " + " ".join(word() for _ in range(rng.choice([5, 20])))
    ids = list(texts)
    rng.shuffle(ids)
    return {i * 7: texts[k] for k, i in enumerate(ids)}


def result(rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_planted_groups_equal_brute_force(spark):
    texts = planted()
    got = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 80).collect()
    assert result(got) == brute_force(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_rest_alone_finds_all_links(spark, monkeypatch):
    """Without stars the tiles must find every group, also over several blocks."""
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(neardup, "TILE", 4)
    texts = planted(6)
    got = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 80).collect()
    assert result(got) == brute_force(texts)


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    assert result(catalog.QUERIES["op3_neardup"](spark, SMOKE).collect()) == brute_force(texts)


def test_edge_rows(spark):
    rows = near_duplicates(edge_docs(spark), 4, 80).collect()
    assert len(rows) == 12
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)]
    assert by[3] == [(0, 3, True)] and by[4] == [(1, 4, True)]
    assert by[5] == [(2, 5, True)]  # one word over and over, then another
    assert by[7] == [(4, 7, True)] * 2 and by[8] == [(4, 7, False)]
    assert sorted(by[None]) == [(0, None, True), (2, None, True)]
    assert near_duplicates(no_docs(spark)).count() == 0


def test_filter_keeps_one_of_each_group(spark):
    kept = deduplicated(edge_docs(spark), 4, 80)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 3, 4, 5, 6, None, None, 7, 9], key=str)
    assert kept.columns == edge_docs(spark).columns
    assert deduplicated(no_docs(spark)).count() == 0


def test_signatures_of_equal_and_near_sets():
    rng = np.random.default_rng(0)
    full = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2))
    for size in (1, 3, 40, 400):
        s = full[:size]
        assert (signature(s) == signature(s.copy())).all()
        assert np.isin(signature(s), s).all()  # every bin holds a member, own or lent
    near = np.sort(np.concatenate([full[:355], np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64))]))
    assert (band_keys(signature(full)) == band_keys(signature(near))).sum() >= BANDS // 6


def test_short_sequences_differ_from_full_shingles():
    sets = list(shingle_sets(pa.array(["a b c", "a b c d", None, "A B C", " a\tb\nc "]), 4))
    assert [len(s) for s in sets] == [1, 1, 0, 1, 1]
    assert sets[0] == sets[3] == sets[4] and sets[0] != sets[1]


def test_tile_links_span_components_only():
    sets = [np.arange(10), np.arange(10), np.arange(1, 11), np.arange(50, 60)]
    links = tile_links(np.arange(4), np.arange(4), np.zeros(4, int), sets, 80)
    assert len(links) == 2 and {x for p in links for x in p} == {0, 1, 2}
    assert tile_links(np.arange(4), np.zeros(4, int), np.zeros(4, int), sets, 80) == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 100), (7, 7), (None, 3), (200, 90)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 100: 90, 200: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

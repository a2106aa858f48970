import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cases import edge_docs, edge_rows, no_docs, some_docs
from conftest import SMOKE
from corpuslens.llm import catalog
from corpuslens.llm.packing import ByteTokens, best_fit, fractional_cover, pack_documents, plan, priciest_fill

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, texts, library, capacity=1024):
    """Pieces are each document's ids in order, and sequences are gapless."""
    wanted = Counter()
    for text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_tokens_equal_the_library(library):
    rng = random.Random(2)
    parts = ["a", "Be", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "'s", "'S", "é", "12", "²", "😀", "日", "<|endoftext|>", "!", "_", "\u200b", "ა"]
    tokens = ByteTokens(PATH)
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert list(memoryview(tokens.encode(text)).cast("i")) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_query_equals_brute_force(spark, library):
    texts = [r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    rows = catalog.QUERIES["op8_packing"](spark, SMOKE).collect()
    n = check(rows, texts, library)
    assert n <= 1.01 * sum(r.length for r in rows) / 1024 + 1


def test_edge_rows(spark, library):
    rows = pack_documents(edge_docs(spark), PATH).collect()
    check(rows, [t for _, t, *_ in edge_rows()], library)
    assert {r.row["a.b"] for r in rows} == {"clash"}
    assert pack_documents(no_docs(spark), PATH).count() == 0


def test_other_capacities(spark, library):
    docs = some_docs(spark, 40)
    for capacity in (16, 100):
        check(pack_documents(docs, PATH, capacity).collect(), [r.text for r in docs.collect()], library, capacity)


def test_knapsack_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 40), 5, replace=False))
        price = rng.random(5) * sizes

        def best(room, k=0):
            if k == len(sizes):
                return 0.0
            return max(n * price[k] + best(room - n * sizes[k], k + 1) for n in range(room // sizes[k] + 1))

        fill = priciest_fill(sizes, price, 60)
        assert (fill * sizes).sum() <= 60 and np.isclose((fill * price).sum(), best(60))


@pytest.mark.parametrize("histogram", [{}, {1024: 5}, {1: 3}, {700: 10, 300: 4}, {1023: 2, 1: 9, 512: 3}])
def test_plans_hold_exactly_the_histogram(histogram):
    held = Counter()
    for fill, n in plan(histogram, 1024):
        assert n > 0 and sum(s * a for s, a in fill) <= 1024
        for s, a in fill:
            held[s] += a * n
    assert held == Counter(histogram)


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    histogram = Counter(np.minimum(1 + rng.lognormal(5.5, 0.9, 40_000).astype(int), 1024).tolist())
    used = sum(n for _, n in plan(histogram, 1024))
    bound = sum(s * n for s, n in histogram.items()) / 1024
    assert used <= 1.005 * bound + 1
    assert used <= 1.005 * sum(n for _, n in best_fit(dict(histogram), 1024)) + 1


@pytest.mark.parametrize("histogram, optimum", [({400: 100_000, 300: 50_000}, 62_500), ({350: 9000, 260: 9000, 205: 9000}, 7364)])
def test_plan_solves_the_program(histogram, optimum):
    """Far from best fit, the weights settle on the optimum of the program."""
    used = sum(n for _, n in plan(histogram, 1024))
    assert optimum <= used <= 1.001 * optimum
    assert used < 0.95 * sum(n for _, n in best_fit(dict(histogram), 1024))


def test_bound_is_below_every_plan_and_uniform_lengths_are_near_it():
    histogram = {s: 255 for s in range(1, 1024)}
    sizes, need = np.array(sorted(histogram)), np.full(1023, 255.0)
    _, bound = fractional_cover(sizes, need, 1024, 0.1, 30)
    used = sum(n for _, n in plan(histogram, 1024))
    assert bound <= used <= 1.01 * bound
    _, small = fractional_cover(np.array([300, 400]), np.array([50_000.0, 100_000.0]), 1024, 0.02, 1500)
    assert 62_000 < small <= 62_500


@pytest.mark.parametrize("n", [1, 10, 1000])
def test_plan_uses_configurations_that_are_not_full(n):
    """No filling of these lengths is 1024; the bound is 1020 tokens a sequence."""
    histogram = {515: 6 * n, 265: 6 * n, 260: 6 * n, 245: 12 * n}
    held, used = Counter(), 0
    for fill, k in plan(histogram, 1024):
        used += k
        assert sum(s * a for s, a in fill) <= 1020
        for s, a in fill:
            held[s] += a * k
    assert held == Counter(histogram)
    assert 9 * n <= used <= 1.01 * 9 * n
    assert used < sum(k for _, k in best_fit(dict(histogram), 1024))

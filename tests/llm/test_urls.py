import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SMOKE
from corpuslens.llm import catalog, urls
from corpuslens.llm.urls import UrlModels, UrlRule, judge_urls, threshold, url_filter

RULES = catalog.URL_RULES


def brute_force(url):
    _, mark, rest = (url or "").partition("://")
    ends = [k for k in (rest.find(c) for c in "/?#") if k >= 0] if mark else []
    host = rest[:min(ends, default=len(rest))] if mark else ""
    path = rest[len(host):] if mark else ""
    path = path[:min((k for k in (path.find(c) for c in "?#") if k >= 0), default=len(path))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


CASES = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x?y#z", "http://www.example.com/en/1", "http://x.www.example.com/en/",
         "https://www.b.example.com/en/1", "ftp://a.net/es/", "http://a.net/es", "http://net/fr/1", "http://notnet/fr/1", "http://a.com",
         "http://a.com?x=/", "http://a.com#://b.net/es/", "a://b://c/d", "http://É.COM/ä\n/b", "http://a.org/" + "x" * 40_000, "http://a.org/q", "http://a.org/q"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("row", F.lit(1))
    rows = judge_urls(df, RULES).collect()
    assert len(rows) == len(CASES)
    for r in rows:
        host, path, rule, verdict = brute_force(r.row.url)
        assert (r.host, r.path) == (host, path), r.row.url
        assert (None if r.rule is None else RULES[r.rule].name) == rule, r.row.url
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert judge_urls(df.limit(0), RULES).count() == 0


def test_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SMOKE}/pages.parquet").collect()}
    rows = catalog.QUERIES["op7_urls"](spark, SMOKE).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = brute_force(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_scores_equal_a_plain_model():
    """The tables against Witten-Bell smoothing spelt out over strings."""
    good, bad = ["http://a.de/x", "http://b.de/xy"], ["http://c.fr/z", "http://d.fr/zz"]

    def model(texts):
        n = {}
        for t in texts:
            s = ["<"] * 4 + list(t) + [">"]
            for k in range(4, len(s)):
                for o in range(5):
                    n.setdefault(tuple(s[k - o:k]), {}).setdefault(s[k], 0)
                    n[tuple(s[k - o:k])][s[k]] += 1

        def logp(t):
            s, total = ["<"] * 4 + list(t) + [">"], 0.0
            for k in range(4, len(s)):
                p = 1 / urls.SYMBOLS
                for o in range(5):
                    seen = n.get(tuple(s[k - o:k]))
                    if seen:
                        all_, kinds = sum(seen.values()), len(seen)
                        p = (seen.get(s[k], 0) + kinds * p) / (all_ + kinds)
                total += np.log(p)
            return total / (len(t) + 1)
        return logp

    batch = lambda texts, ok: pa.RecordBatch.from_arrays([pa.array(texts), pa.array([ok] * len(texts))], ["url", "accepted"])
    got = list(urls._counts([batch(good, True), batch(bad, False)]))
    models = UrlModels(np.concatenate([b["slot"].to_numpy() for b in got]), np.concatenate([np.array(b["accepted"].to_pylist()) for b in got]),
                       np.concatenate([b["n"].to_numpy() for b in got]))
    tests = ["http://a.de/x", "http://e.fr/z", "", "q"]
    a, b = model(good), model(bad)
    assert np.allclose(models.scores(pa.array(tests)), [a(t) - b(t) for t in tests], atol=1e-4)


def test_learned_verdicts_separate_unseen_urls(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = [f"http://{word()}.good/{word()}.html" for _ in range(300)] + [f"http://{word()}.bad/win-{word()}?id=9" for _ in range(300)]
    rows += [f"http://{word()}.new/{word()}.html" for _ in range(50)] + [f"http://{word()}.new/win-{word()}?id=9" for _ in range(50)]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "page_id long, url string")
    rules = (UrlRule("allow", "good", "/"), UrlRule("block", "bad", "/"))
    got = {r.row.page_id: r.verdict for r in judge_urls(df, rules).collect()}
    right = [got[k] == ("allow" if k < 650 else "block") for k in range(600, 700)]
    assert np.mean(right) >= 0.95
    assert url_filter(df, rules).columns == df.columns


def test_threshold(spark):
    df = lambda rows: spark.createDataFrame(rows, "score double, accepted boolean")
    assert 0.1 < threshold(df([(0.5, True), (0.4, True), (0.1, False), (-1.0, False)])) <= 0.4
    assert threshold(df([(0.5, True)])) == 0.0 and threshold(df([])) == 0.0


def test_models_keep_every_context_apart():
    """Counts of as many contexts as a large table has, against plain ones."""
    rng = np.random.default_rng(5)
    good, bad = (["http://" + "".join(rng.choice(list(letters), 40)) for _ in range(3000)] for letters in ("abcdefghijklmnopqrst", "klmnopqrstuvwxyz0123"))
    batch = lambda texts, ok: pa.RecordBatch.from_arrays([pa.array(texts), pa.array([ok] * len(texts))], ["url", "accepted"])
    got = list(urls._counts([batch(good, True), batch(bad, False)]))
    column = lambda c: np.concatenate([np.array(b[c].to_pylist()) for b in got])
    n = [{}, {}]
    for side, texts in zip(n, (good, bad)):
        for t in texts:
            s = "<" * 4 + t + ">"
            for k in range(4, len(s)):
                for o in range(5):
                    seen = side.setdefault(s[k - o:k], {})
                    seen[s[k]] = seen.get(s[k], 0) + 1

    def logp(side, t):
        s, total = "<" * 4 + t + ">", 0.0
        for k in range(4, len(s)):
            p = 1 / urls.SYMBOLS
            for o in range(5):
                if seen := side.get(s[k - o:k]):
                    p = (seen.get(s[k], 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
            total += np.log(p)
        return total / (len(t) + 1)

    tests = [*good[:20], *bad[:20], "http://aabbkkzz", "q"]
    scores = UrlModels(column("slot"), column("accepted"), column("n")).scores(pa.array(tests))
    assert np.allclose(scores, [logp(n[0], t) - logp(n[1], t) for t in tests], atol=1e-9)


def test_joined_scores_equal_sent_ones(spark, monkeypatch):
    df = spark.read.parquet(f"{SMOKE}/pages.parquet").select("page_id", "url").unionByName(
        spark.createDataFrame([(10**6 + k, u) for k, u in enumerate(CASES)], "page_id long, url string"))
    rows = lambda: sorted((r.row.page_id, r.url_score, r.verdict) for r in judge_urls(df, RULES).withColumnRenamed("score", "url_score").collect())
    sent = rows()
    monkeypatch.setattr(urls, "SENT_ROWS", 0)
    monkeypatch.setattr(urls, "CHUNK", 7)
    assert rows() == sent and len({s for _, s, _ in sent}) > 10

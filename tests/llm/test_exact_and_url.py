import hashlib

import pytest
from sightline.llm import exact_dedup as exact_dedup_module
from sightline.llm import queries
from sightline.llm.exact_dedup import copies, exact_dedup, exact_dedup_stage
from sightline.llm.url_filter import RULES, url_filter


def test_oracles(same):
    for name in ("op1_exact_dedup", "op5_url_filter"):
        same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_exact_dedup_edges(spark):
    long = "x" * 300_000
    rows = [(1, None, "a"), (2, "", "b"), (3, "t", "c"), (4, "t", None), (5, long, "d"), (6, long + " ", "e"), (7, "t ", "f"), (None, "t", "g"), (3, "t", "c"), (8, "é", "k"), (9, "é", "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    got = sorted(map(tuple, exact_dedup(df).collect()), key=repr)
    want = []
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t, _ in rows:
        g = groups[t or ""]
        keep = max(x for x in g if x is not None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("most", [500_000, 0])
def test_stage_keeps_one_row_of_each_text(spark, monkeypatch, most):
    """Open classes broadcast, and joined; ids that are unique and that repeat."""
    monkeypatch.setattr(exact_dedup_module, "BROADCAST_CLASSES", most)
    texts = ["t", "t ", "é", None, "", "long " * 5_000, "same start " * 20 + "a", "same start " * 20 + "b", "t", "é", "once"] * 2 + ["alone"]
    for ids in (list(range(len(texts))), [i % 7 for i in range(len(texts))], [None, *range(1, len(texts))]):
        rows = [(i, t, "x") for i, t in zip(ids, texts, strict=True)]
        df = spark.createDataFrame(rows, "doc_id long, text string, sha string").repartition(4)
        got = [tuple(r) for r in exact_dedup_stage(spark, df, "").collect()]
        assert len(got) == len({t or "" for t in texts}) == len({t or "" for _, t, _ in got}) and set(got) <= set(rows)
        for i, t, _ in got:
            assert (i if i is not None else -1) == max(j if j is not None else -1 for j, u, _ in rows if (u or "") == (t or ""))
    assert exact_dedup_stage(spark, df.limit(0), "").collect() == [] and copies(df.limit(0)).collect() == []


def test_exact_dedup_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_url_edges(spark):
    urls = ["http://Foo.COM", None, "nope", "", "a://x.net/fr/a?b=/es/", "h://www.example.com/en/x#y", "h://com/", "h://example.com/en", "://net/es//", "h://a..net/es/q", "h://net/es/q", "h://net/es/q", "h://example.com:80/en/", "h://a.example.com/en/" + "p/" * 3000, "a://b://c.com/x"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter(df, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host, after = rest[:cut].lower(), rest[cut:]
        path = after[: next((k for k, c in enumerate(after) if c in "?#"), len(after))]
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert got[i] == (host, path, best[1], best[2]), u


def test_url_rule_inside_a_segment(spark):
    rules = spark.createDataFrame([("x.com", "/ab", "block"), ("x.com", "/", "allow"), ("x.com", None, "block")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "h://x.com/abc"), (2, "h://x.com/a"), (3, "h://x.com")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter(df, rules).collect()} == {1: "block", 2: "allow", 3: "allow"}
    assert url_filter(df.limit(0), rules).collect() == []
    assert {r["verdict"] for r in url_filter(df, rules.limit(0)).collect()} == {"allow"}

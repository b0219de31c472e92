import subprocess
import sys

import pytest

from sightline.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["host_scores", "host_actions", "cost_gated"])
def test_query_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_without_the_corpus_operators(tmp_path):
    """The entry imports and keeps its queries where llm and the pipeline are gone."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/sightline", tmp_path / "sightline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'host_scores' in q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_url_parts_says_where_a_fetch_may_go(spark, duck, tmp_path):
    """Its SQL finds it from the urls too, not as a constant."""
    public = ["https://www.a.kr/faq?x=1#y", "HTTP://A.kr", "http://u:p@8.8.8.8:80/", "https://172.15.0.1/", "http://172.32.0.1", "http://100.128.0.1/", "http://192.169.0.1/", "http://198.17.0.1/", "http://198.20.0.1/", "http://[2001:db8::1]/", "http://10.a.kr/", "http://local/", "https://fc.kr/"]
    private = ["http://localhost:8080/", "http://x.Localhost/", "http://printer.local", "http://a.internal/", "http://metadata.google.internal/v1", "http://10.0.0.1/", "http://127.0.0.1/", "http://0.0.0.0/", "http://172.16.0.1/", "https://172.31.255.255:1/", "http://192.168.1.1/",
        "http://169.254.169.254/latest", "http://100.64.0.1", "http://198.18.0.1/", "http://198.19.255.1/", "http://224.0.0.1/", "http://255.1.1.1/", "http://u@10.1.1.1/", "http://[::1]/", "http://[::]/", "http://[FD12::1]/", "http://[fe80::1]/", "http://[::ffff:127.0.0.1]/", "ftp://a.kr/", "file:///etc", "http:///x", "a.kr/x", "", None]
    want = dict(enumerate([True] * len(public) + [False] * len(private)))
    spark.createDataFrame(list(enumerate(public + private)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["url_parts"](spark, str(tmp_path))
    assert got.columns == ["page_id", "scheme", "host", "site", "path", "depth", "is_public", "crawl_priority"]
    assert {r["page_id"]: r["is_public"] for r in got.collect()} == want
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert dict(con.execute(f"SELECT page_id, is_public FROM ({ORACLE_SQL['url_parts']})").fetchall()) == want

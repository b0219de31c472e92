"""robots.txt, redirects and crawl orders against plain Python."""

import re
from urllib.parse import urljoin

import numpy as np
from pyspark.sql import functions as F

from sightline.operators.crawl import crawl_order, redirect_chains, resolve
from sightline.operators.robots import robots_allowed, robots_rules


def plain_allowed(body, path, agent):
    """Whether a path may be visited; rules are read line by line."""
    groups, agents, open_ = {}, [], False
    for line in re.split(r"\r\n|\r|\n", body or ""):
        line = line.split("#")[0].strip()
        if ":" not in line:
            continue
        name, value = (x.strip() for x in line.split(":", 1))
        if name.lower() == "user-agent":
            agents = [*agents, value.lower()] if open_ else [value.lower()]
            groups.setdefault(value.lower(), [])
            open_ = True
            continue
        open_ = False
        if name.lower() in ("allow", "disallow") and value:
            for a in agents:
                groups[a].append((value, name.lower() == "allow"))
    best = (-1, True)
    for pattern, allow in groups.get(agent.lower(), groups.get("*", [])):
        end = pattern.endswith("$")
        bare = re.escape(pattern[:-1] if end else pattern).replace(r"\*", ".*")
        if re.match(bare + ("$" if end else ""), path, re.S):
            best = max(best, (len(pattern), allow))
    return best[1]


def test_robots_equal_plain_python(spark):
    rng = np.random.default_rng(3)
    lines = ["User-agent: *", "User-Agent:Bot", "user-agent: other # x", "Disallow: /a", "Allow: /a/b", "Disallow: /*.x$", "Disallow:", "Disallow: /", "Allow: /a*c", "Crawl-delay: 1", "nonsense", "# only", "Disallow: /a.b(c", "Allow: /$", "Sitemap: https://e/s.xml"]
    bodies = ["\n".join(rng.choice(lines, rng.integers(0, 9))) for _ in range(60)] + [None, "", "Disallow: /a", "User-agent: bot"]
    paths = ["/", "/a", "/a/b", "/a/b/c", "/x.x", "/x.xy", "/a.b(c", "/axb(c", "/a?c=1", "/ab/c"]
    files = spark.createDataFrame([(i, 200, b) for i, b in enumerate(bodies)] + [(900, 404, "User-agent: *\nDisallow: /"), (901, 200, "User-agent: *\nDisallow: /"), (901, 500, "x")], "site_id long, status int, body string")
    rows = [(i, f"https://e.example{p}") for i in [*range(len(bodies)), 900, 901, 902] for p in paths]
    got = robots_allowed(spark.createDataFrame(rows, "site_id long, url string"), files, "Bot").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["allowed"] == (r["site_id"] >= 900 or plain_allowed(bodies[r["site_id"]], r["url"][17:], "Bot")), r
    assert robots_rules(files.limit(0)).collect() == []


def test_resolve_like_urljoin(spark):
    base = ["https://e.example/a/b/c?x#y", "http://e.example", "https://e.example/a/"]
    loc = ["/x", "x", "../x", "./x/../y", "?q=1", "//f.example/z", "https://g.example/p", "../../../x", "/x/./y/..", "..", "#f"]
    df = spark.createDataFrame([(b, x) for b in base for x in loc], "b string, x string").withColumn("r", resolve(F.col("b"), F.col("x")))
    for r in df.collect():
        want = urljoin(r["b"] if r["b"].count("/") > 2 else r["b"] + "/", r["x"])
        # what stands behind # of the base is no part of the target, nor is its query
        assert r["r"] == (want if r["x"] not in ("?q=1", "#f") else re.sub(r"[?#].*", "", r["b"] if r["b"].count("/") > 2 else r["b"] + "/") + r["x"]), r
    odd = spark.createDataFrame([("https://e.example/", ""), ("https://e.example/", None), ("nothing", "x"), (None, "/x")], "b string, x string")
    assert [r[0] for r in odd.select(resolve(F.col("b"), F.col("x"))).collect()] == [None] * 4


def test_redirects_by_hand(spark):
    u = "https://e.example/"
    hops = [(u + "a", 301, "/b"), (u + "b", 302, "c"), (u + "c", 200, None), (u + "loop", 301, "/loop"), (u + "in", 307, "http://192.168.0.1/x"), (u + "none", 301, None), (u + "gone", 308, "/missing"), (u + "late", 302, "/e5"), (u + "e5", 503, None), (u + "x1", 301, "/x2"), (u + "x2", 301, "/x3"), (u + "x3", 301, "/x4"), (u + "x4", 301, "/x5"), (u + "a", 302, "/z")]
    fetched = spark.createDataFrame(hops, "url string, status int, location string")
    starts = spark.createDataFrame(list(enumerate([u + x for x in ("a", "c", "loop", "in", "none", "gone", "late", "x1", "nowhere")] + ["http://localhost/", None, u + "a"])), "id int, url string")
    got = {r["id"]: (r["final_url"], r["status"], r["chain_length"], r["looped"], r["reason"]) for r in redirect_chains(starts, fetched).collect()}
    no = "CONNECTION_REFUSED"
    assert got == {
        0: (u + "c", 200, 2, False, None), 1: (u + "c", 200, 0, False, None), 2: (u + "loop", 301, 3, True, None), 3: (u + "in", None, 0, False, no), 4: (u + "none", 301, 0, False, None), 5: (u + "missing", None, 1, False, no),
        6: (u + "e5", 503, 1, False, "HTTP_5xx"), 7: (u + "x4", 301, 3, False, None), 8: (u + "nowhere", None, 0, False, no), 9: ("http://localhost/", None, 0, False, no), 10: (None, None, 0, False, no), 11: (u + "c", 200, 2, False, None),
    }
    assert redirect_chains(starts.limit(0), fetched).collect() == []


def test_crawl_order_on_random_link_graphs(spark):
    rng = np.random.default_rng(5)
    kinds = ["/faq", "/about", "/services/x", "/contact", "/product", "/z", "/no/1", "/no/ok", ""]
    priority = lambda url: next((k for k, p in enumerate(["/faq", "/about", "/service", "/contact", "/product"]) if p in url), 5)
    sites, links, maps = [], [], []
    for s in range(40):
        start = "http://127.0.0.1" if s == 7 else f"https://s{s}.example"
        sites.append((s, start, int(rng.integers(0, 7))))
        found = [f"{rng.choice([f'https://s{s}.example', f'https://www.s{s}.example', 'https://t.example'])}{rng.choice(kinds)}{rng.choice(['', '/', '/1'])}" for _ in range(rng.integers(0, 12))]
        links += [(s, i, x) for i, x in enumerate(found)]
        if s % 3 == 0:
            maps += [(s, i, x, None if rng.random() < 0.3 else float(rng.integers(0, 4))) for i, x in enumerate(found[::-1])]
    body = "User-agent: *\nDisallow: /no\nAllow: /no/ok"
    files = [(s, 200, "User-agent: *\nDisallow: /" if s == 9 else body) for s in range(0, 40, 2)] + [(9, 200, "User-agent: *\nDisallow: /")]
    got = crawl_order(
        spark.createDataFrame(sites, "site_id long, start_url string, budget long"), spark.createDataFrame(links, "site_id long, pos long, url string"), spark.createDataFrame(maps, "site_id long, pos long, url string, priority double"),
        spark.createDataFrame(files, "site_id long, status int, body string"), "bot", F.col("budget"),
    ).collect()
    for s, start, budget in sites:
        allowed = lambda url: plain_allowed({x[0]: x[2] for x in files}.get(s), re.sub(r"^https?://[^/]*", "", url) or "/", "bot")  # noqa: B023, E731
        want = []
        if s != 7 and budget and allowed(start):
            mine = [(-(p or 0), i, x) for t, i, x, p in maps if t == s] or [(priority(x.lower()), i, x) for t, i, x in links if t == s]
            want = [start + "/"]
            for _, _, x in sorted(mine):
                if len(want) < budget and x not in want and re.match(rf"https://(www\.)?s{s}\.example", x) and allowed(x):
                    want.append(x)
        assert [r["url"] for r in sorted(got, key=lambda r: r["place"]) if r["site_id"] == s] == want, s

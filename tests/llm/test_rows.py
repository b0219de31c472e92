"""Operators that judge each row on its own, against plain Python."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from sightline.llm.html_extract import Tree, default_model, extract, extract_pages, labelled_pages
from sightline.llm.mixing import first_words, mix, mixing_stage, splitting_tree, targets
from sightline.llm.packing import cut_points, default_tokenizer, pack
from sightline.llm.secrets import checksum62, find_secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- secrets


def plain_spans(text):
    out = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.A):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    kinds = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def test_secrets_equal_plain_search(spark):
    rng = np.random.default_rng(0)
    bits = ["token", "TOKEN", "api_key", "apiKey", "secret", "passwd", "password", "=", ":", " = ", '"', "'", "AKIA", "ABCDEFGH12345678", "abc123", "0123456789abcdef", "deadbeef", "é", " ", "\n", "x", "ſecret", "toKen", "==", "z.z", " ", "ghp_", "😀"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(1500)] + [None, "", "a" * 100_000 + " token=abcdef" + "0" * 50]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in find_secrets(df).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in ("assign", "access", "hex")]
        assert got == plain_spans(texts[r["doc_id"]] or ""), texts[r["doc_id"]]


def test_secret_checksums(spark):
    body = "Ab3" * 10
    good = "ghp_" + body + checksum62(body.encode()).decode()
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    df = spark.createDataFrame([(1, f"é {good}."), (2, bad), (3, good + "x"), (4, "npm_" + good[4:])], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in find_secrets(df).collect()}
    assert got == {1: [("github", 2, 42)], 2: [], 3: [], 4: [("npm", 0, 40)]}
    assert find_secrets(df.limit(0)).collect() == []


# ---- packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    tok.encode_special_tokens = True
    rng = np.random.default_rng(1)
    bits = ["the ", "Wörter, ", "l'eau ", "\n\n", "  ", "it's ", "12 ", "一二", "😀", "...", "'ll", "\t", "re'd", "x" * 30]
    texts = ["".join(rng.choice(bits, rng.integers(0, 1500))) for _ in range(120)] + [None, "", "<|endoftext|>", "word " * 30_000]
    df = spark.createDataFrame([(i % 120, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").withColumn("doc_id", F.monotonically_increasing_id())
    by_id = {r["doc_id"]: r["text"] for r in df.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack(df).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(by_id)
    for i, text in by_id.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    used = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        used += at
    assert used / (2048 * len(sequences)) > 0.9
    assert pack(df.limit(0)).collect() == []


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_ids_of_words_that_polynomials_confuse(n):
    from sightline.llm.tokens import Encoder

    encoder = Encoder(default_tokenizer())
    words = [*thue_morse(n), "x " + thue_morse(n)[0]]
    assert [x.tolist() for x in encoder.encode(words)] == [encoder._plain(w) for w in words]


def test_ids_where_all_hashes_collide(monkeypatch):
    from sightline.llm import tokens

    monkeypatch.setattr(tokens, "mix", lambda x: np.full_like(x, 1 << 60))
    encoder = tokens.Encoder(default_tokenizer())
    texts = ["one two three two", "three, one!", "", "one"]
    assert [x.tolist() for x in encoder.encode(texts)] == [encoder._plain(t) for t in texts]


def test_cut_points_fill_their_class():
    for n in range(1, 6000, 7):
        ends = cut_points(n)
        assert ends[-1] == n and ends == sorted(set(ends))
        sizes = np.diff([0, *ends])
        assert all(s <= 2048 for s in sizes)
        assert sum(2048 // (2048 // s) - s for s in sizes) < 90  # gaps in the classes' places


# ---- mixing


def test_targets():
    assert targets([10, 10, 10], [5, 2, 1]) == [20, pytest.approx(50 / 3), pytest.approx(25 / 3)]
    assert targets([0, 0], [5, 2]) == [0, 0] and targets([], []) == []
    t = targets([1000, 1, 1, 1], [5, 2, 1, 5])
    assert sum(t) == pytest.approx(1.5 * 1003) and all(x <= 2 * s + 1e-9 for x, s in zip(t, [1000, 1, 1, 1]))


def test_splitting_tree_is_exact():
    q = np.array([1000, 0, 3, 77])
    s = splitting_tree(q, 7)
    assert (s.sum(axis=0) == q).all() and np.ptp(s.sum(axis=1)) <= 1 and (s >= 0).all()


def mixed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string")


def test_mix_reaches_its_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))) or None, [None, "a", "b", "é", "z"][min(int(rng.integers(0, 9)), 4)], "x") for i in range(900)]
    rows += [(5000, "w " * 20_000, "b", "x"), (5000, "w " * 20_000, "b", "x"), (None, "a b", "only", "x"), (5001, None, "empty", "x")]
    df = mixed(spark, rows)
    got = mix(df).collect()
    again = {(r["doc_id"], r["size"], r["taken"]) for r in mix(df.repartition(7)).collect()}
    assert len(got) == len(rows) and again == {(r["doc_id"], r["size"], r["taken"]) for r in got}
    size, taken, want = defaultdict(int), defaultdict(int), {}
    source = {r[0]: r[2] for r in rows}
    for r in got:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        want[s] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == sum(d["words"] for d in r["draws"]) and r["size"] == len(WORD.findall(next(t for i, t, *_ in rows if i == r["doc_id"]) or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    assert [want[s] for s in order] == pytest.approx(targets([size[s] for s in order], [[5, 2, 1][k % 3] for k in range(len(order))]))
    for s in order:
        assert abs(taken[s] - want[s]) <= 1
    assert mix(df.limit(0)).collect() == []


@pytest.mark.parametrize(("rows", "words"), [(100, 10), (100, 1000), (2, 3), (60, 1)])
def test_repeats_of_a_row_reach_the_target(spark, rows, words):
    """Of equal rows as many are taken as the target asks for, one of them in part."""
    df = mixed(spark, [(7, "w " * words, "s", "x")] * rows).repartition(5)
    got = mix(df).collect()
    assert len(got) == rows and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 1 and got[0]["target"] == 1.5 * rows * words
    assert sum(words < r["taken"] < 2 * words for r in got) <= 1 and all(words <= r["taken"] <= 2 * words for r in got)
    assert sum(len((r["text"] or "").split()) for r in mixing_stage(spark, df, "").collect()) == sum(r["taken"] for r in got)


@pytest.mark.parametrize("again", [0, 90])
def test_mixing_stage_takes_what_it_says(spark, again):
    rows = [(i, f"  a{i} b\tc\n" * (1 + i % 5), "st"[i % 2], "k") for i in range(200)] + [(7, "x y z " * 40, "s", "k")] * again
    df = mixed(spark, rows)
    out = mixing_stage(spark, df, "")
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    taken = defaultdict(int)
    for r in mix(df).collect():
        taken[r["doc_id"]] += r["taken"]
    assert {i: n for i, n in words.items() if n} == {i: n for i, n in taken.items() if n}


def plain_mix(rows, shards=64, seed=20240607, blocks=1024):
    """The tree and the ranges of permuted blocks in plain Python."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def h(*values):  # 64-bit values and texts; nulls leave the hash as it is
        out = 42
        for v in values:
            data = v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else None if v is None else (v & ((1 << 64) - 1)).to_bytes(8, "little")
            out = out if data is None else xxhash.xxh64_intdigest(data, out)
        return signed(out)

    small = lambda x: x.to_bytes(4, "little")
    sources = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    docs = [(i, s, h(i, t or ""), len(WORD.findall(t or ""))) for i, t, s in rows]
    size = {s: sum(n for _, d, _, n in docs if d == s) for s in sources}
    goal = dict(zip(sources, targets([size[s] for s in sources], [[5, 2, 1][k % 3] for k in range(len(sources))]), strict=True))
    order = lambda key, level: h(key, small(seed), small(level)) % blocks
    out, quota, plan, turn = [], [], {}, defaultdict(int)
    for s in sources:
        passes = min(int(goal[s] // size[s]), 2) if size[s] else 0
        part = int(goal[s] + 0.5) - passes * size[s]
        end = None
        for b, c, k, n in sorted((order(k, 1), order(k, 2), k, n) for _, d, k, n in docs if d == s):
            if part > 0 and n:
                # equal rows follow each other; what is left before the first of them
                end = end if end and end[:3] == (b, c, k) else (b, c, k, part)
                part -= n
                if part <= 0:
                    break
        else:
            end = None
        plan[s] = (passes, end)
        quota.append(passes * blocks + (end[0] + 1 if end else 0))
    tree = np.cumsum(splitting_tree(np.array(quota), shards, seed), axis=0)
    for i, s, k, n in docs:
        passes, end = plan[s]
        at = (order(k, 1), order(k, 2), k)
        draws = [n] * passes
        if end and at < end[:3]:
            draws.append(n)
        elif end and at == end[:3]:
            draws.append(min(n, max(0, end[3] - n * turn[s, i])))
            turn[s, i] += 1
        where = [int((tree[:, sources.index(s)] <= at[0] + p * blocks).sum()) for p in range(len(draws))]
        out.append((i, n, size[s], goal[s], sum(draws), [(w, d, h(k, small(p), small(seed))) for p, (w, d) in enumerate(zip(where, draws, strict=True))]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("repeats", [[(7, "x " * 5_000, "b")] * 2, [(7, "x " * 1_000, "b")] * 100, [(7, "x y", "s"), (9, "z", "s")] * 50])
def test_mix_equals_plain_python(spark, repeats):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))) or None, ["a", "b", "é", None, "z"][int(rng.integers(0, 5))]) for i in range(700)]
    rows += [(None, "x y z", "a"), (8, "", "only"), *repeats]
    df = mixed(spark, [(*r, "k") for r in rows])
    got = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"], [tuple(d) for d in r["draws"]]) for r in mix(df).collect()]
    assert sorted(got, key=repr) == plain_mix(rows)


def test_mixing_stage_deals_shards_to_tasks(spark, monkeypatch):
    """Every task has draws of one shard; columns whose names could clash stay."""
    from sightline.llm import mixing

    monkeypatch.setattr(mixing, "PART_WORDS", 20)
    df = mixed(spark, [(i, "a b c d", "st"[i % 2], "k") for i in range(1200)]).withColumns({c: F.lit(1) for c in ("shard", "place", "row", "draw", "_s", "_n", "size", "words")})
    out = mixing_stage(spark, df, "")
    assert out.columns == df.columns and out.rdd.getNumPartitions() == 64 * 6
    drawn = {r["doc_id"]: r["draws"] for r in mix(df).collect()}
    seen = 0
    for k, rows in enumerate(out.rdd.map(lambda r: r["doc_id"]).glom().collect()):
        assert all(any(d["shard"] == k // 6 for d in drawn[i]) for i in rows)
        seen += len(rows)
    assert seen == sum(len(d) for d in drawn.values())
    assert mixing_stage(spark, df.limit(0), "").collect() == []


def test_first_words(spark):
    df = spark.createDataFrame([(" a b  c ", 2), ("a", 1), ("é\tü x", 1)], "t string, n int")
    assert [r[0] for r in df.select(first_words(F.col("t"), F.col("n"))).collect()] == ["a b", "a", "é"]


# ---- HTML


def test_html_of_unseen_pages():
    pages = labelled_pages(150, seed=77)
    got = extract_pages([h for h, _ in pages], default_model())
    assert np.mean([g[0] == "\n".join(w) for g, (_, w) in zip(got, pages)]) > 0.85


def test_html_cases(spark):
    article = "<article><h1>T &amp; U</h1><p>One  two<br>three &#233;&nbsp;x.<p>Short<p>Same.</p><p>Same.</p></article>"
    page = f'<html><head><title>no</title><script>var a="</p><p>no</p>";</script><style>p{{}}</style></head><body><header>Site name</header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div>{article}<aside>More links</aside><form><label>Mail</label></form><section id="comments"><p>Great post, thanks!</p></section><footer>&copy; x</footer>'
    deep = "<div>" * 3000 + "<p>Deep text stands here, and it is long enough.</p>"
    rows = [(1, page, "u"), (2, None, None), (3, "", "u"), (4, deep, "u"), (5, "<p>a<p", "u"), (6, "<!-- <p>no</p> --><article><p>Yes, this is it.</p></article>", "u"), (6, "<article><p>" + "long words " * 50_000 + "</p></article>", "u")]
    got = defaultdict(list)
    for r in extract(spark.createDataFrame(rows, "page_id long, html string, url string")).collect():
        got[r["page_id"]].append(r["text"])
    assert got[1] == ["T & U\nOne two three é x.\nShort\nSame.\nSame."]
    assert got[2] == [""] and got[3] == [""] and "no" not in got[6][0] + got[6][1]
    assert "Yes, this is it." in got[6] and max(map(len, got[6])) == len("long words " * 50_000) - 1
    assert len(got[4]) == 1


@pytest.mark.parametrize("html", [
    "<a" * 500_000, "<!" * 500_000, '<a "' * 250_001, "<a '\"" * 200_000, '<a "x>' * 150_001, "<noscript>" * 100_000, "<script>" + "</script " * 100_000, "<head>" * 150_000, "<div>" * 90_000 + "</ul>" * 90_000,
    "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000, "<head>" + ("</head" + " " * 100) * 9_000, "&" * 1_000_000, "<p " + 'a="' * 300_000 + ">x",
])
def test_html_of_damaged_pages_takes_linear_time(html):
    import time

    began = time.process_time()
    Tree(html)
    assert time.process_time() - began < 10


def test_html_tags():
    leaves = lambda h: [text for _, text in Tree(h).leaves]
    assert leaves("<p title='a>b' x=\"c>d\">one</p><p title=\"open>two</p><p a='>'>three") == ["one", "two", "'>three"]  # after an open quote tags end at their first >
    assert leaves("<p>a <!-- <p>b --> c <!-- d") == ["a c"] and leaves("a < b <3 </ c") == ["a < b <3 </ c"] and leaves("<p>x<a href=") == ["x<a href="]
    assert leaves("<script>if (a<b) '</p>'</SCRIPT x>y<style>z") == ["y"]


def test_html_tree_repairs():
    t = Tree("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<div>y</div>z")
    assert [text for _, text in t.leaves] == ["a", "b", "1", "2", "3", "x", "y", "z"]


def test_html_marginals_match_enumeration():
    """Messages give the marginals of the enumerated joint distribution."""
    from itertools import product

    from sightline.llm.html_extract import Forest

    rng = np.random.default_rng(0)
    f = Forest([Tree("<div><p>a</p><ul><li>b</li></ul></div>")])
    weight, edge = rng.normal(size=len(default_model()[0])), rng.normal(size=(2, 2, 2))
    local = np.bincount(f.row, weights=weight[f.col], minlength=f.n)
    total, content = 0.0, np.zeros(f.n)
    for y in product((0, 1), repeat=f.n):
        e = sum(local[i] for i in range(f.n) if y[i]) + sum(edge[f.leaf[i], y[f.parent[i]], y[i]] for i in range(f.n) if f.parent[i] >= 0)
        total += np.exp(e)
        content += np.exp(e) * np.array(y)
    assert f.marginals(weight, edge)[0] == pytest.approx(content / total)

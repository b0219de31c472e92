import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from sightline.llm import common, minhash, textvec
from sightline.llm.common import connected_components
from sightline.llm.embedding_dedup import near_vectors
from sightline.llm.minhash import near_duplicates, sketch


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({" ".join(words)} if words else set())


def brute(rows, linked):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if linked(a, b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def near_copies(rng, n, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_words_match_the_pattern():
    texts = ["A b\tC", "", " x ", "ÀB c\u00a0d", "a" * 50, "one\x0btwo\x1cthree", "\n\n"]
    for _, raw, off in textvec.buffers(pa.array(texts + [None])):
        w = textvec.Words(raw, off)
        assert w.count().tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts] + [0]


def test_minhash_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [t for k in range(12) for t in near_copies(rng, 12, rng.choice([8, 40, 150, 600]), rng.choice([1, 3, 8]))]
    texts += [None, "", "  ", "a b c", "A  B\nC", "a b c d", "a b c d e", "A b c d e", "x " * 3000, "x " * 4000]
    rng.shuffle(texts)
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    sets = {i: shingle_set(t) for i, t in rows}
    want = brute([(i, sets[i]) for i, _ in rows], lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b))
    got = near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in got)


def test_minhash_words_that_polynomials_confuse(spark):
    rows = []
    for n in (1024, 2048, 4096):
        word = "a"
        while len(word) < n:
            word += word.translate(str.maketrans("ab", "ba"))
        rows += [(2 * n, word), (2 * n + 1, word.translate(str.maketrans("ab", "ba")))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i for i, _ in rows}


def test_minhash_crowded_band(spark):
    """A cloud around the threshold, whose links need more than the leaders."""
    rng = random.Random(5)
    texts = near_copies(rng, 150, 150, 5)
    rows = list(enumerate(texts))
    sets = {i: shingle_set(t) for i, t in rows}
    want = brute([(i, sets[i]) for i, _ in rows], lambda a, b: 100 * len(a & b) >= 85 * len(a | b))
    old = minhash.BLOCK_NODES
    minhash.BLOCK_NODES = 40  # several tiles
    try:
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        minhash.BLOCK_NODES = old
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_minhash_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}
    assert got == {(1, 1, True), (None, None, True), (2, 2, True)}
    assert near_duplicates(df.limit(0)).collect() == []


def test_minhash_ids_that_repeat(spark):
    """An id in many rows, with one text and with several; each text is judged apart."""
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " more"
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text)] * 3000 + [(2, near)] * 3000 + [(1, other)] * 500 + [(3, other + " end")] + [(1, f"alone {i} " * 5) for i in range(300)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (2, 1, False), (3, 1, False)}
    # a larger id does not link the texts of a smaller one
    rows = [(9, text), (9, other), (5, near), (7, other + " end")]
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(9, 5), (9, 7), (5, 5), (7, 7)}


def test_minhash_hot_leader(spark):
    """Hundreds of near copies of one text with random small ids: whoever leads, all are one."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(120)]
    rows = [(rng.randrange(10**9), " ".join(words + [f"end{i}"])) for i in range(700)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {min(i for i, _ in rows)} and sum(r["kept"] for r in got) == 1


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))])
    s = sketch(np.concatenate([a, b, a[:1]]), np.repeat([0, 1, 2], [len(a), len(b), 1]), 3)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.15


def brute_vectors(rows):
    unit = {}
    for i, v in rows:
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, float)
        unit[i] = x / np.linalg.norm(x)
    near = lambda a, b: len(a) == len(b) and a @ b >= 0.95
    links = {i: sum(near(unit[i], unit[j]) for j in unit if j != i) if i in unit else 0 for i, _ in rows}
    comp = brute([(i, unit.get(i)) for i, _ in rows], lambda a, b: a is not None and b is not None and near(a, b))
    return links, comp


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(int(3 * i % 997), (base[i % 60] + rng.normal(size=16) * rng.choice([0.05, 0.15, 0.3])).tolist()) for i in range(300)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] + [1.0] * 15), (2005, [1.0, 2.0]), (2006, [2.0, 4.1]), (2007, base[0].tolist()), (2008, (base[0] * 1e30).tolist())]
    links, comp = brute_vectors(rows)
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (links[i], comp[i]) for i, _ in rows} and sum(links.values()) > 500
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_vectors_with_thousands_of_links(spark):
    """Clusters of all sizes whose cosines lie on both sides of the threshold."""
    rng = np.random.default_rng(21)
    rows, i = [], 0
    for size in [1] * 150 + [2] * 60 + [5] * 30 + [20] * 10 + [60] * 3:
        x = rng.normal(size=24)
        for _ in range(size):
            rows.append((i, (x + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.2])).tolist()))
            i += 1
    links, comp = brute_vectors(rows)
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(links.values()) > 5_000
    # recall of the index on this fixture is 1; none is invented
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (links[i], comp[i]) for i, _ in rows}


def test_vectors_in_tiles(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=8)
    rows = [(i, (x + rng.normal(size=8) * 0.05).tolist()) for i in range(120)]
    links, comp = brute_vectors(rows)
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=64, tile=30).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (links[i], comp[i]) for i, _ in rows}


def test_copies_of_vectors_are_counted(spark):
    """Half of the rows are one vector, others repeat ids; names that clash."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=12)
    rows = [(i, x.tolist(), "a") for i in range(200)] + [(1000 + i, (x + rng.normal(size=12) * 0.05).tolist(), "b") for i in range(40)] + [(2000 + i, rng.normal(size=12).tolist(), "c") for i in range(150)]
    links, comp = brute_vectors([(i, v) for i, v, _ in rows])
    for kind in ("double", "float"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, k string").withColumns({c: F.col("k") for c in ("m", "n", "rep", "id", "v", "component")})
        got = near_vectors(df).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (links[i], comp[i], comp[i] == i) for i, _, _ in rows}
    again = near_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-0.0, 1.0]), (3, [0.0, 1.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, again), key=repr) == [(1, 2, 1, True), (1, 2, 1, True), (2, 1, 2, True), (3, 1, 2, False), (None, 0, None, True)]


def test_components_of_long_paths_and_random_graphs(spark, monkeypatch):
    monkeypatch.setattr(common, "DRIVER_LINKS", 20)
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(1000)] + [(i, i + k) for i in range(2000, 2400) for k in range(1, 6)]
    pairs += [(5000, 5000 + i) for i in range(1, 300)] + [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(220)] + [(-5, 9999), (7, 7), (8000, 8000)]
    rng.shuffle(pairs)
    linked = {frozenset(p) for p in pairs}
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
    want = {i: i for i in nodes}
    todo = True
    while todo:
        todo = False
        for a, b in map(tuple, (p for p in linked if len(p) == 2)):
            low = min(want[a], want[b])
            if want[a] != low or want[b] != low:
                want[a] = want[b] = low
                todo = True
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(nodes) and {r["node"]: r["component"] for r in got} == want
    assert connected_components(spark.createDataFrame([(7, 7)], "a long, b long")).collect() == []


def test_minhash_path_of_revisions(spark):
    """1,000 texts with rising ids, each similar to its neighbours only."""
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 17))) for i in range(1000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1000 and {r["component_id"] for r in got} == {0} and [r["doc_id"] for r in got if r["kept"]] == [0]


def test_vectors_on_a_path(spark):
    """1,000 vectors with rising ids, each close to its neighbours only."""
    x = np.zeros((1000, 1030))
    for i in range(1000):
        x[i, i : i + 30] = 1  # cosine 0.967 with the next one, 0.933 with the one after
    got = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 1000 and {r["component_id"] for r in got} == {0} and sum(r["n_links"] for r in got) == 2 * 999

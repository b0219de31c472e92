import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sightline.llm import quality, toxicity
from sightline.llm.mixing import mix


def prose(rng, n):
    return " ".join(rng.choice(["the", "river", "stands", "over", "old", "stone", "and", "its", "green", "fields"]) + rng.choice(["", "", "s", "ed", ","]) for _ in range(n)) + "."


def documents(spark, n=500, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good, bad_words = rng.random() < 0.75, rng.random() < 0.3
        t = prose(rng, rng.randint(10, 200))
        if bad_words:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["snargle", "snargled", "Snargling!", "grumfex", "grumfexen"]))
            t = " ".join(w)
        if not good:
            t = rng.choice([lambda x: x.upper().replace(" ", "!! "), lambda x: " ".join(w + "###" for w in x.split()), lambda x: " ".join([x.split()[0]] * 80)])(t)
        docs.append((i, t, rng.choice(["en", "de"]), "s", len(t)))
        labels.append((i, int(good), int(bad_words and (good or "snar" in t.lower() or "grum" in t.lower()))))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, "word " * 40_000, "en", "s", 5)]
    labels += [(n, None, None), (10**6, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = documents(spark)
    model = quality.fit(docs, quality.learnable(labels))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(got) == 503 and all(0 <= s <= 1 for s in got.values())
    held = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in got and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == bool(q) for q, s in held]) > 0.95


def test_quality_edges(spark):
    docs, labels = documents(spark, 20)
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), None).collect() == []


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    kx, ky = quality.isotonic(x, (x + rng.normal(size=300) > 0).astype(float))
    assert (np.diff(kx) > 0).all() and (np.diff(ky) >= 0).all() and ky[0] >= 0 and ky[-1] <= 1


def test_statistics_do_not_depend_on_neighbours():
    import pyarrow as pa
    from sightline.llm.textvec import buffers

    texts = ["A b!! c", "", "é é é", "x y\nz | w"]
    together = np.vstack([quality.statistics(r, o) for _, r, o in buffers(pa.array(texts))])
    alone = np.vstack([quality.statistics(r, o) for t in texts for _, r, o in buffers(pa.array([t]))])
    assert np.allclose(together, alone)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = documents(spark, 700, 1)
    learn = labels.where(quality.crc_mod("doc_id") != 1)
    chain = toxicity.fit(toxicity.labelled_categories(docs, learn), toxicity.CATEGORIES)
    got = {r["doc_id"]: r["p_toxic"] for r in toxicity.score(docs, chain, toxicity.CATEGORIES).collect()}
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels.collect() if r["toxic"] is not None and r["doc_id"] in got and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([(p >= 0.5) == bool(t) for t, p in held]) > 0.95
    assert len(chain.models) == 2 and len(chain.models[1]) == len(chain.models[0]) + 1  # an earlier probability


def plain_hash(*values):
    """Spark's hash of a long and texts, unsigned."""
    import xxhash

    out = 42
    for v in values:
        out = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), out)
    return out


def bucket_of(text):
    """The bucket of one feature: of the word, or of its beginning of k bytes."""
    import pyarrow as pa
    from sightline.llm.textvec import Words, buffers, mix

    shift = np.uint64(64 - toxicity.BUCKET_BITS)
    (_, raw, off), = buffers(pa.array([text[0]]))
    w = Words(raw, off, letters_only=True)
    h = w.hash if text[1] is None else mix(w.span_hash(w.start, w.start + text[1]) + np.uint64(text[1]))
    return int((h >> shift)[0])


def plain_chain(docs, labelled, categories):
    """The chain as dense matrices over features counted word by word."""
    from sightline.llm.textvec import mix

    known = {}

    def features(text):
        times = Counter()
        for word in re.findall(r"[a-z\x80-\uffff]+", text.lower()):
            for key in [(word, None), *((word, k) for k in toxicity.PREFIXES if len(word.encode()) >= k)]:
                key = (word, None) if key[1] is None else (word.encode()[: key[1]].decode("latin-1"), key[1])
                if key not in known:
                    known[key] = bucket_of(key)
                times[known[key]] += 1
        out = set(times)
        for bucket, n in times.items():
            out |= {int(mix(np.array([bucket * 64 + k], np.uint64))[0] >> np.uint64(64 - toxicity.BUCKET_BITS)) for k in toxicity.TIMES if n >= k}
        return out

    train = sorted((np.int64(np.uint64(plain_hash(i, t))), i, features(t), [r[c] for c in categories]) for i, t, r in labelled)
    seen = Counter(f for _, _, fs, _ in train for f in fs)
    n = len(train)
    fold = [int(mix(np.array([h], np.int64).view(np.uint64))[0] % np.uint64(toxicity.FOLDS)) for h, *_ in train]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    half_logit = lambda p: np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3))) / 2

    def fit(x, dense, y):
        x = np.column_stack([x, dense, np.ones(len(y))])
        share = min(max(y.mean(), 1e-4), 1 - 1e-4)
        w = np.zeros(x.shape[1])
        w[-1] = np.log(share / (1 - share))
        scale = (np.abs(x) * np.abs(x).sum(axis=1, keepdims=True)).mean(axis=0) * 0.25 + toxicity.RIDGE
        ahead, t = w, 1.0
        for _ in range(toxicity.STEPS):
            g = x.T @ (sigmoid(x @ ahead) - y) / len(y) + toxicity.RIDGE * np.append(ahead[:-1], 0)
            new = ahead - g / scale
            u = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, w, t = new + (t - 1) / u * (new - w), new, u
        return w

    texts = [features(t) for _, t in docs]
    dense, scored, out = np.zeros((n, 0)), np.zeros((len(docs), 0)), []
    for c in range(len(categories)):
        y = np.array([float(r[3][c]) for r in train])
        k = y.sum()
        chi = {}
        for f, b in seen.items():
            a = sum(y[i] for i, r in enumerate(train) if f in r[2])
            if b >= toxicity.LEAST_TEXTS and 0 < b < n:
                chi[f] = n * (a * n - b * k) ** 2 / (b * (n - b) * k * (n - k))
        chosen = sorted(f for f in chi if chi[f] > 8)
        assert len(chosen) < toxicity.SELECTED
        x = np.array([[f in r[2] for f in chosen] for r in train], float)
        unseen = np.zeros(n)
        for f in range(toxicity.FOLDS):
            test = np.array(fold) == f
            w = fit(x[~test], dense[~test], y[~test])
            unseen[test] = sigmoid(np.column_stack([x, dense, np.ones(n)]) @ w)[test]
        w = fit(x, dense, y)
        p = sigmoid(np.column_stack([np.array([[f in t for f in chosen] for t in texts], float), scored, np.ones(len(docs))]) @ w)
        out.append(p)
        dense, scored = np.column_stack([dense, half_logit(unseen)]), np.column_stack([scored, half_logit(p)])
    return np.column_stack(out)


def test_toxicity_equals_plain_python(spark):
    docs, labels = documents(spark, 160, 5)
    docs = docs.where("n_chars < 100000 OR n_chars IS NULL").withColumns({c: F.lit(1) for c in ("h", "t", "y0", "id", "f", "_id", "low_quality", "toxic", "quality")})
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    marks = {r["doc_id"]: {"low_quality": int(r["quality"] < 1), "toxic": r["toxic"]} for r in labels.dropna().collect() if r["doc_id"] in texts}
    want = plain_chain(list(texts.items()), [(i, texts[i], m) for i, m in marks.items()], toxicity.CATEGORIES)
    chain = toxicity.fit(toxicity.labelled_categories(docs, labels), toxicity.CATEGORIES)
    got = {r["doc_id"]: [r[f"p_{c}"] for c in toxicity.CATEGORIES] for r in toxicity.score(docs, chain, toxicity.CATEGORIES).collect()}
    assert np.array([got[i] for i in texts]) == pytest.approx(want, abs=1e-6)


def test_a_long_text_counts_whole(spark):
    """What stands at the very end of a long text decides."""
    docs = _marked(spark, 0.4, lambda i: "snargle")
    chain = toxicity.fit(docs, ["bad"])
    long = spark.createDataFrame([(1, "river stone " * 200_000 + "snargle"), (2, "river stone " * 200_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["p_bad"] >= 0.5 for r in toxicity.score(long, chain, ["bad"]).collect()} == {1: True, 2: False}


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    data = text.encode()
    size = max(len(data), 1)
    kinds = [1 if 65 <= b < 91 else 2 if 97 <= b < 123 else 3 if 48 <= b < 58 else 4 if b >= 128 else 5 if 33 <= b < 127 else 0 for b in data]
    share = lambda *k: sum(x in k for x in kinds) / size
    n = max(len(words), 1)
    length = [len(w.encode()) for w in words]
    mean = sum(length) / n
    same = [a == b for a, b in zip(low, low[1:])]
    runs = [len(m[0]) for m in re.finditer("1+", "".join("01"[s] for s in same))]
    times = Counter(low)
    is_mark = lambda c: 33 <= ord(c) < 127 and not c.isalnum()
    letters = kinds.count(1) + kinds.count(2) + kinds.count(4) / 2
    return [
        np.log1p(len(words)), np.log1p(mean), np.log1p(np.sqrt(max(sum(x * x for x in length) / n - mean * mean, 0))), share(1, 2, 4), share(1), share(3), share(5), sum(b <= 32 for b in data) / size,
        sum(is_mark(w[-1]) for w in words) / n, sum(a == b == 5 for a, b in zip(kinds, kinds[1:])) / size, sum(len(w) == 1 and is_mark(w) for w in words) / n, sum(same) / n,
        (len(times) / len(words) if words else 0) + 0.1 * np.log1p(len(words)), (max(times.values()) / len(words) if words else 0), np.log1p(max(runs, default=0)), share(4), text.count("\n") / n, kinds.count(1) / max(letters, 1),
    ]


def plain_scores(texts, labels):
    """Scores of all texts (by id) by a model of the labelled ones."""
    import xxhash

    train = [(i, texts[i], float(q)) for i, q in labels if i in texts]
    x, y = np.array([plain_statistics(t) for _, t, _ in train]), np.array([q for *_, q in train])
    rng = np.random.default_rng(quality.SEED)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd <= 1e-9] = 1
    direction, phase = rng.normal(0, 1 / quality.WIDTH, (x.shape[1], quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = lambda s: np.column_stack([np.ones(len(s)), np.cos(np.clip((s - mean) / sd, -6, 6) @ direction + phase) * np.sqrt(2 / quality.FEATURES)])
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    held = np.array([signed(xxhash.xxh64_intdigest(quality.SEED.to_bytes(4, "little"), plain_hash(i))) % 4 == 0 for i, *_ in train])
    w = np.linalg.solve(z(x[~held]).T @ z(x[~held]) + quality.RIDGE * np.eye(quality.FEATURES + 1), z(x[~held]).T @ y[~held])
    raw = z(x[held]) @ w
    order = np.argsort(raw)
    level = [max(min(np.mean(y[held][order][a : b + 1]) for b in range(k, len(order))) for a in range(k + 1)) for k in range(len(order))]  # isotonic by its min-max formula
    blocks = {}
    for v, r in zip(level, raw[order], strict=True):
        blocks.setdefault(round(v, 12), []).append(r)
    knots = sorted((np.mean(r), v) for v, r in blocks.items())
    every = z(np.array([plain_statistics(t) for t in texts.values()])) @ w
    return dict(zip(texts, np.clip(np.interp(every, [k for k, _ in knots], [v for _, v in knots]), 0, 1).tolist(), strict=True))


def test_quality_equals_plain_python(spark):
    docs, labels = documents(spark, 200, 3)
    docs = docs.unionByName(docs.where("doc_id < 9")).withColumns({c: F.lit(1) for c in ("id", "stats", "_y", "_fold", "_h", "_id", "quality", "score")})
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = plain_scores(texts, [(r["doc_id"], r["quality"]) for r in quality.learnable(labels).dropna().collect()])
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, quality.learnable(labels))).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def _marked(spark, share, words):
    """300 texts, the first share of them toxic and with words(i)."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 30) + " " + (words(i) if i < share * 300 else ""), int(i < share * 300)) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, bad int")


def test_toxicity_keeps_a_very_common_word(spark):
    docs = _marked(spark, 0.4, lambda i: "snargle")
    chain = toxicity.fit(docs, ["bad"])
    got = {r["doc_id"]: r["p_bad"] for r in toxicity.score(docs, chain, ["bad"]).collect()}
    assert all((got[i] >= 0.5) == (i < 120) for i in got)


def test_toxicity_keeps_many_rare_words(spark):
    """300 words in four toxic texts each: 1,200 features of chi-square 8.1."""
    names = ["".join("bcdfghjklm"[int(c)] for c in f"{k:03d}") + "ozzle" for k in range(300)]
    docs = _marked(spark, 1 / 3, lambda i: " ".join(names[(12 * i + j) % 300] for j in range(12)))
    chain = toxicity.fit(docs, ["bad"])
    assert len(chain.selected) >= 1190
    held = spark.createDataFrame([(k, f"the river {n} stands") for k, n in enumerate(names)] + [(1000, "the river stands over old stone")], "doc_id long, text string")
    got = {r["doc_id"]: r["p_bad"] for r in toxicity.score(held, chain, ["bad"]).collect()}
    assert sum(got[k] > got[1000] for k in range(300)) >= 299


def test_toxicity_edges(spark):
    docs, labels = documents(spark, 20)
    assert toxicity.fit(toxicity.labelled_categories(docs, labels.limit(0)), toxicity.CATEGORIES) is None
    assert {r["p_toxic"] for r in toxicity.score(docs, None, toxicity.CATEGORIES).collect()} == {0.0}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard int, place string, kept boolean, _key0 long, _s string, row int, _doc long"


def stage_rows(rows):
    return [(i, t, "en", s, len(t or ""), k, "p", None, 1, "x", 2, 3) for k, (i, t, s) in enumerate(rows)]


def test_exact_stage_drops_rows_not_ids(spark):
    from sightline.llm.exact_dedup import exact_dedup_stage

    rows = [(5, "A", "s"), (9, "A", "s"), (5, "only here", "s"), (None, "Z", "s"), (10, "Z", None), (None, "Y", "s"), (None, "Y", "s"), (7, None, "s"), (8, "", "s"), (11, "B", "s"), (11, "B", "t"), (12, "x" * 200_000, "s")]
    df = spark.createDataFrame(stage_rows(rows), COLUMNS)
    out = exact_dedup_stage(spark, df, "")
    assert out.columns == df.columns
    want = [(9, "A"), (5, "only here"), (10, "Z"), (None, "Y"), (8, ""), (11, "B"), (12, "x" * 200_000)]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(want, key=repr)
    ids = df.where("doc_id IN (5, 9, 10, 12) AND text <> 'only here'")
    assert sorted(r["doc_id"] for r in exact_dedup_stage(spark, ids, "").collect()) == [9, 10, 12]
    assert exact_dedup_stage(spark, df.limit(0), "").collect() == []


def test_minhash_stage_drops_rows_not_ids(spark):
    from sightline.llm.minhash import near_duplicates_stage

    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(5, a, "s"), (9, a + " end", "s"), (5, b, "s"), (2, a + " tail", "s"), (None, b + " z", "s"), (10, "c c c c c c", None), (10, "c c c c c c", "s"), (7, None, "s"), (7, "", "s"), (None, " ", "s"), (3, "word " * 50_000, "s")]
    df = spark.createDataFrame(stage_rows(rows), COLUMNS)
    out = near_duplicates_stage(spark, df, "")
    assert out.columns == df.columns
    got = [r["text"] for r in out.collect()]
    assert len(got) == 7 and len([t for t in got if t and t[0] == "a"]) == 1 and len([t for t in got if t and t[0] == "b"]) == 1 and got.count("c c c c c c") == 1
    assert sorted(map(repr, (t for t in got if not (t or "").strip()))) == sorted(map(repr, [None, "", " "]))
    ids = df.where("doc_id IN (2, 3, 9)")
    assert sorted(r["doc_id"] for r in near_duplicates_stage(spark, ids, "").collect()) == [2, 3]
    assert near_duplicates_stage(spark, df.limit(0), "").collect() == []


def test_operators_change_no_setting(spark):
    from sightline.llm.secrets import find_secrets

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    find_secrets(spark.createDataFrame([(1, "x")], "doc_id long, text string")).collect()
    assert spark.conf.get(key) == "10000"


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, sf)
        if name != "packing":
            assert out.columns == docs.columns
            rows = out.collect()
            seen = spark.createDataFrame(rows, docs.schema)
            kept.append(len(rows))
        else:
            pieces = out.collect()
    assert kept[0] >= kept[1] >= kept[2] > 0.7 * 200
    words = mix(spark.read.parquet(f"{sf}/documents.parquet")).count()
    assert words == 200 and sum(r["length"] for r in pieces) > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "minhash near-dedup", "mixing", "packing"]


def test_pipeline_equals_plain_python(spark, tmp_path):
    """Survivors, draws and ids of every stage, computed again in plain Python;
    nulls, blank texts, copies and columns whose names could clash are in."""
    import corpus_pipeline
    from sightline.llm.packing import default_tokenizer
    from test_near_duplicates import brute, shingle_set
    from test_rows import plain_mix
    from tokenizers import Tokenizer

    base, labels = documents(spark, 220, 9)
    rows = [tuple(r) for r in base.collect()]
    rng = random.Random(2)
    for i in range(40):  # exact and near copies
        t = rows[i][1]
        w = t.split()
        w[len(w) // 2] = "changed"
        rows += [(1000 + i, t, "en", rng.choice("st"), len(t)), (2000 + i, " ".join(w), "de", rng.choice("st"), len(t))]
    rows += [(3000 + i, None, None, None, None) for i in range(2)]
    names = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept boolean, score double, row string"
    spark.createDataFrame([(*r, 1, True, 0.1, "r") for r in rows], names).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    texts = {r[0]: r[1] or "" for r in rows}
    source = {r[0]: r[3] for r in rows}
    scores = plain_scores(texts, [(r["doc_id"], r["quality"]) for r in quality.learnable(labels).dropna().collect()])
    assert all(abs(s - 0.5) > 1e-4 for s in scores.values())
    left = [i for i in texts if scores[i] >= 0.5]
    of_text = {}
    for i in left:
        of_text[texts[i]] = max(i, of_text.get(texts[i], -1))
    left = sorted(of_text.values())
    sets = {i: shingle_set(texts[i]) for i in left}
    comp = brute([(i, sets[i]) for i in left], lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b))
    left = [i for i in left if comp[i] == i]
    tok = Tokenizer.from_file(default_tokenizer())
    tok.encode_special_tokens = True
    want = Counter()
    for i, size, *_, draws in plain_mix([(i, texts[i] or None, source[i]) for i in left]):
        for _, words, _ in draws:
            if words or not size:
                part = texts[i] if words == size else re.match(r"[\x20\x09-\x0D]*((?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){%d})" % words, texts[i])[1]
                want[(i, len(tok.encode(part, add_special_tokens=False).ids) + 1)] += 1
    got, tokens, at = Counter(), Counter(), {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        got[(r["doc_id"], r["doc_tokens"])] += r["start"] == 0
        tokens[(r["doc_id"], r["doc_tokens"])] += r["length"]
    assert got == want and all(n == k[1] * want[k] for k, n in tokens.items()) and max(at.values()) <= 2048
    assert len(left) < 0.8 * len(rows)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    docs, labels = documents(spark, 5)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_run(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048

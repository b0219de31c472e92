"""Best-fit packing, tokenizer alignment and importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from sightline.llm import alignment
from sightline.llm.alignment import align, default_tokenizers, link_counts, op12_alignment, pair_counts
from sightline.llm.bestfit import best_fit_pack, default_tokenizer, op11_best_fit, plan
from sightline.llm.resampling import bucket_counts, features, op13_resampling, ranked, resample
from sightline.llm.wordpieces import SentenceEncoder, WordEncoder

BITS = ["the ", "Wörter, ", "l'eau ", "\n\n", "  ", " ", "it's ", "12 ", "½²", "一二", "😀", "...", "'ll", "\t", "re'd", "x" * 60, "Σας ΣΑΣ ", "İx", "é", "“a”", "\x1c", "<|endoftext|>", "<|startoftext|>", "<s>", "<0x41>", "\0", "Ж", "▁", "'l", "ſ", "ﬁ", "ß", "͸"]


def mixed(n, most, seed=0, bits=BITS):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(bits, rng.integers(0, most))) for _ in range(n)]


def clashing(spark, texts, ids=None):
    """Documents with columns whose names the operators use for their own."""
    rows = [(i if ids is None else ids[i], t, "x", 7, 7, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, t string, length long, rank long, row long")


# ---- encoders


def test_cached_encoders_equal_the_tokenizers():
    word, sentence = WordEncoder(default_tokenizer()), SentenceEncoder(default_tokenizers()[1])
    for t in mixed(8000, 14):
        assert word.encode(t).tolist() == word.tokenizer.encode(t, add_special_tokens=False).ids, t
        if "▁" not in t:
            assert sentence.encode(t).tolist() == sentence.model.encode(t), t


# ---- best-fit packing


def one_by_one(lengths, capacity):
    """Sequences of best fit decreasing, a piece at a time."""
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits)[1]] -= x
        else:
            room.append(capacity - x)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_like_best_fit_of_single_pieces(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric([0.02, 0.1, 0.5][seed % 3], 900), 64).tolist() + [64, 1, 1]
    got = plan(Counter(lengths), 64)
    places = defaultdict(list)
    for length, rank, n, first, each, offset in got.tolist():
        for k in range(n):
            places[first + k // each].append((offset + k % each * length, length))
    assert sum(map(len, places.values())) == len(lengths) and sorted(x for p in places.values() for _, x in p) == sorted(lengths)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(places) == list(range(len(places)))
    assert len(places) == one_by_one(lengths, 64)


def test_plan_stays_small_for_many_documents():
    counts = {x: 10**9 // x for x in range(1, 2049)}
    got = plan(counts)
    assert len(got) < 3 * 2048 * 12 and got[:, 2].sum() == sum(counts.values())


def check_packing(rows, texts_by_id, capacity):
    """Rows of a packing: whole documents, gapless sequences."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    tok.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts_by_id)
    for i, text in texts_by_id.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        got = [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(pieces[i], key=lambda r: r["piece"])]
        assert got == [(k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == one_by_one([r["length"] for r in rows], capacity)


def test_best_fit_round_trip(spark):
    texts = mixed(150, 900, 1) + ["same words"] * 40 + [None, "", "<|endoftext|>", "word " * 30_000]
    df = clashing(spark, texts).repartition(7)
    rows = best_fit_pack(df, capacity=256, with_ids=True).collect()
    check_packing(rows, dict(enumerate(texts)), 256)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_best_fit_of_repeats_nulls_and_nothing(spark):
    df = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    rows = best_fit_pack(df).collect()
    assert sorted((r["doc_id"] or 0, r["length"], r["offset"]) for r in rows) == [(0, 1, 8), (0, 2, 6), (5, 3, 0), (5, 3, 3)]
    assert {r["sequence_id"] for r in rows} == {0}
    assert best_fit_pack(df.limit(0)).collect() == []
    named = best_fit_pack(df.withColumnsRenamed({"doc_id": "k", "text": "v"}), id_col="k", text_col="v")
    assert named.columns == ["k", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and named.count() == 4


def test_best_fit_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op11_best_fit(spark, sf)
    check_packing(got.collect(), {r["doc_id"]: r["text"] for r in docs}, 2048)
    assert dict(got.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}


# ---- alignment


def plain_alignment(texts):
    """Groups and links of each text by comparing all ranges; counts over all texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = default_tokenizers()
    ta, tb = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    ta.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    spell_a = lambda i: bytes(byte[c] for c in ta.id_to_token(i))
    spell_b = lambda i: bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()
    out, docs = [], Counter()
    for text in texts:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(map(spell_a, a)) != raw or b"".join(map(spell_b, b)) != raw:
            a, b = [], []
        ends = lambda ids, spell: np.cumsum([len(spell(i)) for i in ids]).astype(int).tolist()
        ea, eb = ends(a, spell_a), ends(b, spell_b)
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        links = Counter((x, y) for x, p, q in zip(a, sa, ea, strict=False) for y, r, s in zip(b, sb, eb, strict=False) if p < s and r < q)
        both = sorted({*ea} & {*eb})
        groups = [([x for x, q in zip(a, ea, strict=True) if p < q <= g], [y for y, s in zip(b, eb, strict=True) if p < s <= g]) for p, g in zip([0, *both], both, strict=False)]
        shown_groups = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.update(links.keys())
        out.append([len(a), len(b), len(groups), links, hashlib.sha256(shown_groups.encode()).hexdigest() if groups else ""])
    best = Counter()
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    return [(na, nb, ng, sum(k.values()), sum(n for (x, y), n in k.items() if docs[x, y] == best[x]), sum(n * docs[p] for p, n in k.items()), sha) for na, nb, ng, k, sha in out]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_alignment_equals_plain_python(spark, monkeypatch, most):
    """Pair counts broadcast, and joined by a shuffle."""
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    texts = mixed(120, 40, 2) + mixed(60, 25, 3, [b for b in BITS if b != "▁"]) + [None, "", " ", "   ", "a ", "naïve  café\n\n  x ", "same", "same", "<|endoftext|>", "▁", "日本語テキスト" * 30]
    aligned = align(clashing(spark, texts).repartition(5)).persist()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in link_counts(aligned).collect()}
    assert got == dict(enumerate(plain_alignment(texts)))
    for r in aligned.collect():
        assert len(r["a_ids"]) == r["n_a"] and len(r["b_ids"]) == r["n_b"] and len(r["a_ends"]) == len(r["b_ends"]) == r["n_groups"]
        assert sum(r["pair_links"]) == r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]
        if r["n_groups"]:
            assert (r["a_ends"][-1], r["b_ends"][-1]) == (r["n_a"], r["n_b"])
    aligned.unpersist()


def test_alignment_of_repeats_nulls_and_nothing(spark):
    df = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "a"), (6, None)], "doc_id long, text string")
    plain = plain_alignment(["a b", "a b", "a", None])
    got = sorted((r["doc_id"] or 0, *(r[c] for c in COLUMNS)) for r in link_counts(align(df)).collect())
    assert got == sorted([(5, *plain[0]), (5, *plain[1]), (0, *plain[2]), (6, *plain[3])])
    assert link_counts(align(df.limit(0))).collect() == [] and pair_counts(align(df.limit(0))).collect() == []


def test_alignment_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = [k for k, r in enumerate(docs) if len(r["text"] or "") < 1500]
    got = {r["doc_id"]: r for r in op12_alignment(spark, sf).collect()}
    assert len(got) == len(docs)
    # links and groups of single texts; counts need the whole corpus and are compared above
    for k, want in zip(short, plain_alignment([docs[k]["text"] for k in short]), strict=True):
        r = got[docs[k]["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (*want[:4], want[6])


# ---- importance resampling


def plain_resample(docs, target, least=20, share=25):
    """Rows (id, n_features, weight, score, rank) for (id, text) pairs."""

    def read(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return words, [zlib.crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(read(x)[1])
    for x in target:
        t.update(read(x)[1])
    of, to = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        words, buckets = read(x)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (of + 10000) / ((s[b] + 1) * (to + 10000)))) for b in buckets)
        weight = total // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: k for k, r in enumerate(able[: share * len(able) // 100], 1)}
    return {r[0]: (*r[2:], rank.get(r[0])) for r in rows}


DRAWN = ["n_features", "weight", "score", "rank"]


def test_resampling_equals_plain_python(spark):
    bits = ["the ", "Wörter, ", "L'EAU ", "\n\n", "İ ", "12x ", "a_b ", "é", "日本 ", "...", "\x7f", "\x80", "Ünï ", "zebra "]
    texts = mixed(500, 90, 4, bits) + [None, "", "?!", "one", "one two", "word " * 20_000]
    target = mixed(20, 40, 5, bits[:6]) + [None, ""]
    got = resample(clashing(spark, texts).repartition(6), spark.createDataFrame([(t,) for t in target], "text string"))
    want = plain_resample(list(enumerate(texts)), target)
    assert {r["doc_id"]: tuple(r[c] for c in DRAWN) for r in got.collect()} == want
    assert sum(x[3] is not None for x in want.values()) > 60 and dict(got.dtypes) == dict.fromkeys(["doc_id", *DRAWN], "bigint")


def test_resampling_of_repeats_ties_and_nothing(spark):
    text = " ".join(map(str, range(30)))
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema)
    df = spark.createDataFrame([(9, text)] * 6 + [(None, text)] * 2 + [(4, "few words")], schema)
    rows = resample(df, empty).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2] and len(rows) == 9
    top = max(r["score"] for r in rows if r["n_features"] == 59)
    assert {r["score"] for r in rows if r["rank"]} == {top}
    assert all(r["rank"] is None and r["n_features"] == 3 for r in rows if r["doc_id"] == 4)
    assert resample(empty, df).collect() == [] and bucket_counts(empty).sum() == 0
    whole = resample(df, empty, share=100, least_words=0)
    assert sorted(r["rank"] for r in whole.collect()) == list(range(1, 10))


def test_ranks_of_one_hot_value(spark):
    rows = spark.range(0, 5000, 1, 6).select(F.lit(3).cast("long").alias("v"), F.col("id"))
    got = ranked(rows, F.col("v").desc())
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 5001))


def test_features_of_plain_words():
    assert features("")[0] == 0 and len(features("")[1]) == 0
    n, buckets = features("A b-C")
    assert n == 3 and buckets.tolist() == [zlib.crc32(x) % 10_000 for x in (b"a", b"b", b"c", b"a b", b"b c")]


def test_resampling_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    target = spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in DRAWN) for r in op13_resampling(spark, sf).collect()}
    assert got == plain_resample([tuple(r) for r in docs], [r["text"] for r in target])

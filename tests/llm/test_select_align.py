"""Resampling, exact top-k and token alignment against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm import align, impact, resample

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [None, "", " ", "  ", "a ", "x▁y", "<|endoftext|> a</s><s>", "\0 \t\r\n　 ﬁ ", " lead", "日本語テキスト 😀😀 ok  ", "é é", "Ünïcode-WORD's 12 34"]


def _texts():
    rng = random.Random(5)
    words = ["the", "cat", "Straße", "naïve", "x1", "don't", "42", "sat", "on", "mat", "日本"]
    return ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["the cat sat on the mat " * 5] * 20 + [" ".join(rng.choice(words) for _ in range(30_000))]


# ---- op11


def _features(text, runs):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    return len(words), [" ".join(words[i : i + r]) for r in range(1, runs + 1) for i in range(len(words) - r + 1)]


def _drawn(docs, items, runs, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    held = {k: Counter(bucket(f) for t in texts for f in _features(t, runs)[1]) for k, texts in (("s", [t for _, t in docs]), ("t", items))}
    s_all, t_all = (sum(held[k].values()) for k in "st")
    rows = []
    for i, text in docs:
        n, found = _features(text, runs)
        gains = [math.floor(1000 * math.log((held["t"][b] + 1) * (s_all + buckets) / ((held["s"][b] + 1) * (t_all + buckets)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], r[2]))
    out = [(*r[:1], *r[2:], k if k <= percent * len(enough) // 100 else None) for k, r in enumerate(enough, 1)]
    return Counter(out + [(*r[:1], *r[2:], None) for r in rows if r[1] < least])


@pytest.mark.parametrize(("runs", "buckets", "chunk"), [(1, 10_000, 8 << 20), (2, 50, 500)])
def test_resampling_is_that_of_brute_force(spark, monkeypatch, runs, buckets, chunk):
    monkeypatch.setattr(resample, "CHUNK", chunk)
    docs = [(k, t) for k, t in enumerate(_texts())] + [(3, "the cat sat on a mat " * 9), (None, "mat " * 25), (7, "mat " * 25), (7, "mat " * 25)]
    items = ["the cat sat on the mat", None, "", "Straße 42 42"]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, bucket string, weight int")
    target = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    got = resample.resample(frame.repartition(3), target, buckets=buckets, runs=runs, percent=30).collect()
    assert Counter(map(tuple, got)) == _drawn(docs, items, runs, buckets, 30, 20)


def test_resampling_of_empty_tables(spark):
    frame, none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(frame.limit(0), none).count() == 0
    assert Counter(map(tuple, resample.resample(frame, none, least_words=1).collect())) == _drawn([(1, "a b"), (2, None)], [], 1, 10_000, 10, 1)


# ---- op12


def _top(rows, k=10):
    vectors = {}
    usable = [(i, tuple(math.floor(1024 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, v in usable:
        if i % 100 == 0:
            vectors[i] = min(vectors.get(i, v), v)
    out = []
    for q, v in vectors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return Counter(out)


@pytest.mark.parametrize(("slice_size", "block", "stop"), [(8192, 512, 1024), (60, 2, 12)])
def test_top_k_is_that_of_brute_force(spark, monkeypatch, slice_size, block, stop):
    for name, value in (("SLICE", slice_size), ("BLOCK", block), ("STOP", stop)):
        monkeypatch.setattr(impact, name, value)
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for k in range(700)]
    rows += [(1000 + k, rows[5][1]) for k in range(150)]  # one vector very often
    rows += [(300, rows[9][1]), (5, rows[5][1]), (2000, [0.0] * 8), (2100, None), (2200, [None] * 8), (2300, [float("nan")] * 8), (2400, [float("inf")] + [0.0] * 7), (None, rows[1][1]), (2500, [0.5, 0.5]), (2501, [0.25, -0.5]), (2600, [])]
    frame = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    assert Counter(map(tuple, impact.top_k(frame.repartition(3), F.col("vec_id") % 100 == 0).collect())) == _top(rows)
    assert impact.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_a_query_stops_on_proof_alone():
    rng = np.random.default_rng(1)
    x = np.unique(np.concatenate([rng.integers(-40, 40, (3000, 16)), rng.integers(-40, 40, (30, 16)) + 400]), axis=0)
    index, all_of = impact.ImpactIndex(x), np.ones(len(x), bool)
    for q in rng.integers(-50, 50, (20, 16)):
        found = index.possible(q, 10, all_of, 50)
        score = x @ q
        assert set(np.flatnonzero(score >= np.sort(score)[-10])) <= set(found.vectors.tolist())
    # far apart groups are told apart before all postings are read
    found = index.possible(np.full(16, 30), 10, all_of, 50)
    assert len(found.vectors) <= 50 and found.postings < x.size / 2
    # sums that no double holds exactly
    big = index.x * (1 << 21)
    score = big.astype(object) @ (np.full(16, 30) * (1 << 24))
    kept = impact.ImpactIndex(big).possible(np.full(16, 30) * (1 << 24), 10, all_of, 50).vectors
    assert {int(k) for k in np.argsort(score)[-10:]} <= set(kept.tolist())


def test_products_beyond_64_bits_are_an_error(spark):
    frame = spark.createDataFrame([(k, [1e15, 1.0]) for k in (0, 1)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        impact.top_k(frame, F.col("vec_id") == 0).collect()


# ---- op13


def _aligned(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    model, tokenizer, of = sentencepiece.SentencePieceProcessor(model_file=B), Tokenizer.from_file(A), align.byte_alphabet()
    tokenizer.encode_special_tokens = True
    rows, held = [], Counter()
    for i, text in docs:
        a, b = [], []
        if text:
            e = tokenizer.encode(" " + text, add_special_tokens=False)
            a = [(k, bytes(of[c] for c in tokenizer.id_to_token(k))) for k in e.ids]
            b = [(k, bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode()) for k, p in ((k, model.id_to_piece(k)) for k in model.encode(text))]
            if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
                a, b = [], []
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, at = [], [], [0, 0]
        for c in cuts:
            parts = []
            for s, side in enumerate((a, b)):
                upto = ends[s].index(c) + 1
                parts.append([k for k, _ in side[at[s] : upto]])
                at[s] = upto
            links.append((parts[0][-1], parts[1][-1]))
            groups.append("|".join(",".join(map(str, p)) for p in parts))
        held.update(links)
        rows.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, k), n in held.items():
        most[k] = max(most[k], n)
    return Counter((i, a, b, g, len(links), sum(held[x] == most[x[1]] for x in links), sum(held[x] for x in links), h) for i, a, b, g, links, h in rows), held


@pytest.mark.parametrize(("chunk", "remembered"), [(1 << 20, 150_000), (200, 20)])
def test_alignment_is_that_of_brute_force(spark, monkeypatch, chunk, remembered):
    monkeypatch.setattr(align, "CHUNK", chunk)
    monkeypatch.setattr(align, "REMEMBERED", remembered)
    docs = list(enumerate(_texts())) + [(None, "the mat"), (2, "again")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, chunk int, pair string")
    want, held = _aligned(docs)
    assert Counter(map(tuple, align.align(frame.repartition(3), A, B).collect())) == want
    table = {(r.a_id, r.b_id): r["count"] for r in align.pair_table(frame, A, B).collect()}
    assert table == held
    assert align.align(frame.limit(0), A, B).count() == 0


def test_tokens_of_no_bytes_are_linked_with_all_that_end_there():
    aligner = align.Aligner.of(A, B)
    made = align.Aligner.__new__(align.Aligner)
    made.__dict__.update(aligner.__dict__)
    made.lengths = [np.array([0, 1, 2]), np.array([0, 1, 3])]
    made._tokens = lambda texts: ([np.array([1, 0, 2])], [np.array([1, 0, 1, 1])])
    figures, links = made.align(["abc"])
    # ends of A: 1 1 3; of B: 1 1 2 3
    assert figures["n_groups"] == [2] and figures["n_links"] == [5]
    assert sorted(divmod(int(x), made.n_b) for x in links["pair"]) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 1)]


def test_pieces_are_encoded_as_whole_texts_are():
    pieces = align.PieceTokens(B)
    assert pieces.apart
    rng = random.Random(8)
    alphabet = ["a", "the", " ", "  ", "\n", "é", "日", "😀", ".", "-", "\t", "3", "́"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    cut = pieces._by_units(texts)[1]
    assert cut == pieces._encode(texts)

"""Operators on small tables with nulls, empties, ties, repeats and clashing columns, against brute force."""

import hashlib
import itertools
import math
import pathlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm import ann, chat, components, decontaminate, hamming, html, lines, lm, packing, simhash, tokens, toxicity
from lodestat.llm.common import ASCII_LOWER, new_folder

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "of", "and", "a", "in", "to", "is", "on", "by", "it", *[x + y + z for x in ("ba", "ke", "lo") for y in ("mi", "nu", "ra") for z in ("", "t", "sh")]]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    """Near copies, exact copies, repeated rows, nulls, empties, short and long texts."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(60, 400)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[k].replace(" ", "\n", 1)) for k in range(5)] + [(110 + k, base[k] + " " + rng.choice(WORDS)) for k in range(10)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "Word"), (204, "two Words"), (205, "Word"), (None, base[0]), (None, None), (7, base[7]), (8, "another text of eight"), (300, "  \n" + prose(rng, 5000))]
    return rows


def union_find(nodes, links):
    at = {n: n for n in nodes}

    def root(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == union_find({n for e in real for n in e}, real)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("group", [4096, 12])
def test_linked_splits_hot_groups_and_loses_no_link(spark, group):
    rng = np.random.default_rng(2)
    codes = np.unique(np.concatenate([np.uint64(0xFFFF0000FFFF0000) ^ (np.uint64(1) << rng.integers(0, 20, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)), rng.integers(0, 2**64, 100, dtype=np.uint64), np.zeros(1, np.uint64)]))
    fps = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    edges = hamming.linked(fps, 3, group).collect()
    signed = codes.view(np.int64).tolist()
    near = [(signed[i], signed[j]) for i, j in zip(*np.nonzero(np.bitwise_count(codes[:, None] ^ codes) <= 3), strict=True) if i < j]
    assert union_find(signed, [(e.a, e.b) for e in edges]) == union_find(signed, near)


def test_near_duplicates(spark, texts):
    got = simhash.near_duplicates(documents(spark, texts).withColumn("fp", F.lit(1))).collect()
    assert len(got) == len(texts)
    fp = [(d, simhash.fingerprint(t)) for d, t in texts]
    roots = union_find(range(len(fp)), [(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if (fp[i][1] ^ fp[j][1]).bit_count() <= 3])
    least = {}
    for k, r in roots.items():
        least[r] = min((x for x in (least.get(r), fp[k][0]) if x is not None), default=None)
    assert Counter(tuple(r) for r in got) == Counter((d, f"{f:016x}", least[roots[k]]) for k, (d, f) in enumerate(fp))
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    kept = simhash.keep_first(documents(spark, texts))
    assert kept.columns == documents(spark, []).columns
    ids = {r.doc_id for r in kept.collect()}
    assert None in ids and 203 in ids and 205 not in ids and 0 in ids and not ids & {100, 101, 110}


def test_shards_round_trip(spark, texts):
    tokenizer = tokens.Encoder(BPE).tokenizer
    for rows, shards in ((texts, 3), (texts, None), ([], None), ([(None, "x"), (None, None)], 2)):
        folder = new_folder(spark, "t")
        tokens.write_shards(documents(spark, rows).withColumn("ids", F.lit("x")), folder, BPE, shards=shards)
        got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in tokens.read_shards(spark, folder).collect()]
        plain = [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for d, t in rows]
        assert Counter((d, x) for d, _, _, x in got) == Counter(plain)
        at = 0
        for d, start, n, x in sorted(got, key=lambda r: r[1]):
            assert start == at and n == len(x) // 4
            at += n
        order = [d for d, *_ in sorted(got, key=lambda r: r[1])]
        assert order == sorted(order, key=lambda d: (d is not None, d or 0))
        keys = spark.createDataFrame([(d,) for d in (7, 7, 203, -5, 10**12, None, 300)], "doc_id long")
        found = Counter((r.doc_id, bytes(r.ids)) for r in tokens.lookup(keys, folder).collect())
        assert found == Counter((d, x) for d, x in plain if d in (7, 203, 300))


def test_scores(spark, texts):
    rows = texts + [(1000 + k, t) for k, (_, t) in enumerate(texts)]
    got = lm.scores(documents(spark, rows).withColumn("word", F.lit("x"))).collect()
    words = [(d, (t or "").encode().translate(ASCII_LOWER).split() + [b""]) for d, t in rows]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    counts = Counter(w for d, own in words if not held(d) for w in own)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((d is not None, d or 0, held(d), len(own), sum(counts[w] > 0 for w in own), round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own), 6)) for d, own in words)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 and r.n_bytes > 0 for r in got)
    # texts of two languages: held-out texts of known words are likelier under the model
    rng = random.Random(12)
    tongues = [[x + y + e for x in ("ba", "ke", "lo", "mi") for y in z for e in ("", "t", "sh")] for z in (("nu", "ra"), ("fe", "wi"))]
    two = [(k, " ".join(rng.choices(tongues[k % 2], [9, 8, 7] + [1] * 21, k=150))) for k in range(300)]
    out = [r for r in lm.scores(documents(spark, two)).collect() if r.held_out]
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out) and all(r.score > r.base_score for r in out)
    assert lm.scores(documents(spark, [])).count() == 0
    only = [d for d in range(100) if held(d)][:2]
    alone = lm.scores(documents(spark, [(d, "a b") for d in only])).collect()
    assert [r.train_tokens for r in alone] == [0, 0] and all(math.isfinite(r.score) for r in alone)


def test_lines(spark):
    rng = random.Random(3)
    body = [prose(rng, 120) for _ in range(6)]
    near = body[0].replace("the", "thee", 1)
    rows = [(1, f"{body[0]}\nOk.\n{body[1]}"), (2, f"{near}\n{body[2]}\nOk."), (3, body[0].upper() + "!"), (4, None), (5, ""), (6, "Ok.\nOk.\n\n"), (2, body[3]), (7, f"{body[4]}\n{body[4]}"), (None, body[2]), (8, "a b c d"), (9, "a b c d"), (10, f"{body[5]}"), (10, f"{body[5]}")]
    docs = documents(spark, rows).withColumn("gone", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = lines.dedup_lines(docs).collect()
    assert "gone" in got[0].asDict() and len(got) == len(rows)

    # brute force over all pairs of occurrences; equal (doc_id, text) rows are one document
    entries = []
    for d, t in dict.fromkeys(rows):
        for k, line in enumerate(lines.normal_lines(t or "")):
            if line:
                entries.append((d, t, k, line.decode()))
    links = [(i, j) for i, j in itertools.combinations(range(len(entries)), 2) if lines.similar(entries[i][3], entries[j][3])]
    groups = {}
    for k, r in union_find(range(len(entries)), links).items():
        groups.setdefault(r, []).append(entries[k])
    texts = {(r.doc_id, r.n_lines, r.n_removed, r.text) for r in got}
    lost = set()
    for own in groups.values():
        best = min((d is None, d or 0) for d, *_ in own)
        first = min(k for d, _, k, *_ in own if (d is None, d or 0) == best)
        lost |= {(d, t, k) for d, t, k, *_ in own if ((d is None, d or 0), k) != (best, first)}
    want = set()
    for d, t in rows:
        own = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(own) if (d, t, k) not in lost]
        want.add((d, len(own), len(own) - len(kept), None if t is None else "\n".join(kept)))
    assert texts == want
    assert lines.dedup_lines(documents(spark, [])).count() == 0


def test_links_of_lines_found_by_blocks_only(spark):
    """Many lines that are near each other: all pairs by brute force, groups split."""
    rng = random.Random(4)
    base = prose(rng, 150).split()
    body = []
    for _ in range(60):
        own = base[:]
        own[rng.randrange(150)] = rng.choice(WORDS)
        body.append(" ".join(own))
    got = lines.dedup_lines(documents(spark, list(enumerate(body)))).collect()
    roots = union_find(range(60), [(i, j) for i, j in itertools.combinations(range(60), 2) if lines.similar(body[i], body[j])])
    assert {r.doc_id for r in got if r.n_removed} == {k for k in roots if roots[k] != k}


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[50:60] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (600, [0.0] * 16), (700, [float("nan")] * 16), (800, [1.0] * 3), (900, []), (None, [1.0] * 16), (1000, [None] * 16), (1100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("label", F.lit(0))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = sorted((d[k], k) for k in range(400) if k != q)[:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(s == d[v] for _, v, s in found) and sorted((s, v) for _, v, s in found) == [(s, v) for _, v, s in sorted(found)]
        hits += len({v for _, v, _ in found} & {k for _, k in want})
        if q == 100:
            assert [v for _, v, _ in sorted(found)] == list(range(50, 60))
    assert hits >= 36
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert [(r.vec_id, r["rank"]) for r in ann.nearest(df.where("vec_id IN (0, 1)"), F.col("vec_id") == 0).collect()] == [(1, 1)]


def test_decontamination(spark):
    rng = random.Random(6)
    pool = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ana", "ilo", "uke", "ore", "ym")]
    items = [(k, " ".join(rng.choices(pool, k=rng.randint(20, 60)))) for k in range(12)] + [(50, None), (51, "too few"), (None, "one two three four five six"), (3, "again " * 9)]
    around = lambda: " ".join(rng.choices(pool, k=30))
    docs = [(k, f"{around()} {items[k][1].upper()}\n{around()}") for k in range(6)]
    edited = items[7][1].split()
    edited[len(edited) // 2] = "changed"
    docs += [(20, " ".join(edited)), (21, items[8][1].rsplit(" ", 2)[0]), (22, around()), (23, None), (24, ""), (25, f"x {items[9][1]} y {items[10][1]}"), (26, "again " * 9), (27, "again " * 4), (1, around()), (None, items[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit("x"))
    df = documents(spark, docs).withColumn("words", F.lit("x"))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.matches(df, table).collect()}

    def shingles(words):
        return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))

    real = [(i, t.lower().split()) for i, t in items if i is not None and t and len(t.split()) >= 5]
    holders = Counter(s for _, w in real for s in shingles(w))
    want = {}
    for d, t in docs:
        words = (t or "").lower().split()
        for i, w in real:
            for a in range(max(1, len(words) - len(w) + 1)):
                x, y = shingles(words[a : a + len(w)]), shingles(w)
                weight = lambda s: 1 / max(1, holders[s])
                both = sum(weight(s) * min(x[s], y[s]) for s in x)
                all_ = sum(weight(s) * max(x[s], y[s]) for s in x | y)
                if all_ and both / all_ >= 0.8:
                    want[d, i] = max(want.get((d, i), 0), round(both / all_, 9))
    assert got == want and (20, 7) not in want or got == want
    kept = decontaminate.keep_uncontaminated(df, table)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((d, t or "") for d, t in docs if not any((d, i) in want for i, _ in real) or (d, t) == docs[-2])
    assert decontaminate.matches(df.limit(0), table).count() == 0 == decontaminate.matches(df, table.limit(0)).count()


def test_decontamination_runs_no_python(spark):
    df = documents(spark, [(1, "a b c d e f g")])
    plan = decontaminate.matches(df, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pages(spark):
    rows = [(1, "u", "<article><p>Hi  there</p></article>"), (2, None, None), (None, "v", ""), (1, "u", "<article><p>Hi  there</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = html.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter(map(tuple, got.collect())) == Counter([(1, "u", "Hi there", 8), (2, None, "", 0), (None, "v", "", 0), (1, "u", "Hi there", 8)])
    assert html.extract(df.limit(0)).count() == 0


def test_chats(spark):
    trap = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", trap), (1, 1, "assistant", f"\\-{trap}\\"), (1, 2, "user", "é😀"), (1, 3, "assistant", ""), (2, 1, "assistant", None), (2, 0, None, "x\n\ny"), (3, None, "system", "s"), (3, 0, "assistant", "a" * 5000), (None, 0, "assistant", "n"), (4, 0, "assistant", "twice"), (4, 0, "assistant", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df, BPE), BPE).collect()}
    groups = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0)):
        groups.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(chat.OPEN + chat.TEXT + chat.CLOSE) + len(chat.escape(r)) + len(chat.escape(t)) for r, t in turns)
        assert tuple(got[c]) == (c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    assert chat.digests(chat.format_chats(df.limit(0), BPE), BPE).count() == 0


def test_packing(spark, texts):
    for rows, longest, budget in ((texts, 64, 500), (texts, 2048, 4096), ([], 64, 500)):
        got = packing.pack(documents(spark, rows).withColumn("bucket", F.lit(1)), max_length=longest, buckets=4, budget=budget).collect()
        sizes = [(d, len([w for w in (t or "").translate({k: " " for k in range(9, 14)}).split(" ") if w]) + 1) for d, t in rows]
        want = Counter((d, p, p * longest, min(longest, n - p * longest)) for d, n in sizes for p in range(-(-n // longest)))
        assert Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in got) == want
        hist = Counter(x[3] for x in want.elements())
        lengths = np.array(sorted(hist), dtype=np.int64)
        bounds = packing.boundaries(lengths, np.array([hist[x] for x in lengths], dtype=np.int64), 4)
        assert all(r.bucket == min(b for b in bounds if b >= r.n_tokens) for r in got)
        for bucket in bounds:
            own = sorted((r.batch, r.place) for r in got if r.bucket == bucket)
            room = max(1, budget // bucket)
            assert own == [(k // room, k % room) for k in range(len(own))]


def test_toxicity(spark):
    rng = random.Random(9)
    insults = ["zorbish", "grumlak", "idiot"]
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(WORDS) for _ in range(40)]
        toxic = k % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((k, " ".join(words)))
        if k % 3:
            labels.append((k, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "idiot idiot idiot"), (3, rows[3][1])]
    table = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    df = documents(spark, rows).withColumn("score", F.lit("x")).withColumn("toxic", F.lit("x"))
    got = toxicity.scores(df, table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert sum(by[k] != (k % 4 == 0) for k in range(400)) <= 4
    assert by[1000] == by[1001] == 0
    kept = toxicity.keep_clean(df, table)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.scores(df, table.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.scores(df.limit(0), table).count() == 0


def test_pipeline(spark, tmp_path, texts):
    import corpus_pipeline

    rng = random.Random(10)
    items = [(k, " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(30))) for k in range(3)]
    rows = [(d, t) for d, t in texts if d is not None] + [(500, f"start here {items[1][1]} and end"), (501, "only idiot words of a moron and trash clown loser")]
    rows += [(600 + k, f"{prose(rng, 30)} idiot {prose(rng, 9)} moron trash clown {prose(rng, 9)}") for k in range(12)] + [(700 + k, prose(rng, 50)) for k in range(40)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(600 + k, 1, 1) for k in range(12)] + [(700 + k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert len(corpus_pipeline.STAGES) in (4, 5) and corpus_pipeline.ORACLE_SQL is None
    docs, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        names, docs = docs.columns, spark.read.parquet(f"{tmp_path}/stage{k}")
        assert k == 4 or docs.columns == names
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert seen[0] >= set(range(700, 740)) and not seen[0] & set(range(600, 612))
    assert seen[1] >= seen[2] >= seen[3] == seen[4]
    assert 500 in seen[2] and 500 not in seen[3] and {0, 1, 2} <= seen[4]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.select("doc_id").collect()} == seen[4]


def test_shuffle_files_of_a_written_step_are_gone(spark):
    """Steps of a long job do not add up on local disks."""
    from lodestat.storage import CLEANUP, written

    held = lambda: {str(p) for root in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for p in pathlib.Path(root).rglob("shuffle_*.data")}
    before = held()
    table = written(spark.range(20_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "probe")
    assert held() <= before
    assert table.count() == 7
    assert spark.conf.get(CLEANUP, "false") == "false"

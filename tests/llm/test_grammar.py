"""The toxicity grammar, main text by ratios, and scores that do not depend on how rows are dealt."""

import random
import zlib

import pytest

from lodestat.llm import html, lm, toxicity

DOCS = "doc_id long, text string"


def plain_weight(symbols):
    """One clause by plain rules: counters of scope, and what was seen before."""
    negation = report = 0
    state, total = "start", 0.0
    seen_target = False
    for symbol, weight in symbols:
        if symbol == "negation":
            negation = toxicity.SCOPE
            continue
        if symbol == "report":
            report = toxicity.SCOPE
            continue
        own = weight * (toxicity.NEGATED if negation else 1.0) * (toxicity.REPORTED if report else 1.0)
        negation, report = max(0, negation - 1), max(0, report - 1)
        if symbol in ("insult", "threat"):
            total += own
            if state != "aimed":
                state = "aimed" if state == "start" and seen_target else "insult" if symbol == "insult" or state == "insult" else "threat"
        elif symbol == "target":
            seen_target = True
            if state != "start":
                state = "aimed"
    return {"insult": total, "aimed": toxicity.AIMED * total}.get(state, 0.0)


def test_the_composed_machine_against_plain_rules():
    rng = random.Random(1)
    assert len(toxicity._ARCS) == (toxicity.SCOPE + 1) ** 2 * 5
    for _ in range(20_000):
        clause = [(s, rng.random() * 3 if s in ("insult", "threat") else 0.0) for s in rng.choices(toxicity.SYMBOLS, k=rng.randint(0, 12))]
        assert toxicity.clause_weight(clause) == pytest.approx(plain_weight(clause)), clause


def auc(scores, labels):
    ones, zeros = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_clauses_beat_isolated_words(spark):
    """Toxic and clean texts of the same words: only who is meant, negated or quoted tells them apart."""
    rng = random.Random(2)
    filler = "garden river window letter morning table paper village market road".split()
    rows, labels = [], []
    for k in range(400):
        insult, toxic = rng.choice(toxicity.INSULTS), k % 2
        words = rng.choices(filler, k=8)
        clause = f"you are a {insult} and {words[0]}" if toxic else rng.choice([f"you are not a {insult} and {words[0]}", f"they said {insult} and you are a {words[0]}"])
        rest = f"{' '.join(words[1:4])} said not they. {' '.join(words[4:])}" if toxic else f"{' '.join(words[1:4])} you. {' '.join(words[4:])}"
        rows.append((k, f"{rest}. {clause}."))
        labels.append((k, toxic))
    got = {r.doc_id: r.score for r in toxicity.scores(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    lexicon = toxicity.Lexicon({})
    sums = [sum(lexicon.symbol(w)[1] for w in rows[k][1].lower().split()) for k in held]
    truth = [labels[k][1] for k in held]
    assert auc([got[k] for k in held], truth) > 0.95 > 0.7 > auc(sums, truth)


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " . ! "), (None, "you idiot"), (5, "you idiot. " * 20_000), (5, "you idiot. " * 20_000)]
    df = spark.createDataFrame(rows, DOCS)
    got = toxicity.scores(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.scores(df.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


PAGE = """<html><body><div class="{ad}">Buy now, a short line of an advert.</div><nav><a href="/">Home</a></nav>
<article><h1>The title of it</h1>{body}<div class="note share-price">Shares fell a little today, they said.</div></article><footer>f</footer></body></html>"""


def test_main_text_comes_through_ratios_not_names():
    rng = random.Random(3)
    words = "one two three four five six seven".split()
    body = [" ".join(rng.choices(words, k=rng.randint(5, 60))) + "." for _ in range(6)]
    want = "\n".join(["The title of it", *body, "Shares fell a little today, they said."])
    for ad in ("ad", "zz", "x1"):
        assert html.main_text(PAGE.format(ad=ad, body="".join(f"<p>{x}</p>" for x in body))) == want


def test_ratios_of_paths_against_a_plain_table():
    page = "<div><p>A first one, long enough to count.</p><p>Two.</p></div><ul><li><a>x</a></li><li><a>y</a></li></ul>"
    paths = html.Paths()
    nodes = list(html.text_nodes(page, paths))
    sums = {}
    for n in nodes:
        own = sums.setdefault(n.path, [0, 0, 0])
        own[0] += 0 if n.linked else len(n.text)
        own[1] += 0 if n.linked else sum(c in ".,;:!?" for c in n.text)
        own[2] += 1
    assert sorted(sums.values()) == [[0, 0, 2], [38, 3, 2]]
    got = html._ratios(nodes, paths)
    assert len(got) == 2 and max(got, key=got.get) == nodes[0].path
    assert html.main_text(page) == "A first one, long enough to count.\nTwo."


def test_markup_of_broken_tags_and_depth():
    assert html.main_text('<p class="x>Hello</p>') == "Hello"
    assert html.main_text("<b>" * 50_000 + "deep") == "deep"
    assert html.main_text("<div>" * 20_000 + "</x>" * 20_000 + "text") == "text"
    assert html.main_text("<article><p>" + "long word " * 100_000) == ("long word " * 100_000).strip()


def test_language_scores_do_not_depend_on_batches_and_partitions(spark):
    rng = random.Random(4)
    pool = [a + b for a in ("ba", "ke", "lo", "mi", "http://x.y/") for b in ("nu", "ra", "fe", "wi", "so", "tel")]
    df = spark.createDataFrame([(k, " ".join(rng.choices(pool, k=40))) for k in range(120)] + [(None, None), (200, ""), (200, "")], DOCS)
    got = []
    for batch, parts, split in ((10_000, 4, 2), (10, 7, 5)):
        kept = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got.append(sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9), round(r.base_score, 9)) for r in lm.scores(df.repartition(split)).collect()))
        finally:
            for k, v in kept.items():
                spark.conf.set(k, v)
    assert got[0] == got[1]


def test_hot_starts_are_split(spark):
    words = [f"http://site/{k}".encode() for k in range(50)] + [b"http", b"other"]
    pairs = spark.createDataFrame([(0, w, 1) for w in words], "state int, word binary, c long")
    got = {bytes(r.word): r.cut for r in lm.with_starts(pairs, 10).collect()}
    assert got[b"other"] == lm.DEEP and got[b"http"] == 2 * lm.DEEP
    groups = {}
    for w, cut in got.items():
        groups.setdefault(w[:cut], []).append(cut)
    assert all(len(set(cuts)) == 1 for cuts in groups.values()) and max(map(len, groups.values())) <= 12

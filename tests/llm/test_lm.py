"""Counts of a start's words that several parts hold, and words and states of whole batches."""

import pickle
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestat.llm import lm
from lodestat.llm.common import ASCII_LOWER


def hot_start(spark):
    rng = random.Random(3)
    words = {b"http", b"http\x01a", b"http\xff", b"httq", b"htt", b"", b"https", b"other"} | {f"http://{''.join(rng.choices('ab/', k=rng.randint(0, 6)))}".encode() for _ in range(120)}
    rows = [(s, w, rng.choice([0, 1, 1, 2, 5])) for w in sorted(words) for s in range(3) if rng.random() < 0.7]
    code = lm.prefix_code(np.bincount(np.frombuffer(b"".join(w for _, w, _ in rows) + b" \n", np.uint8), minlength=256))
    return rows, spark.createDataFrame(rows, "state int, word binary, c long"), code


def test_counts_of_beginnings_in_parts_of_a_start_are_whole(spark, monkeypatch):
    """A start of many words is dealt out in parts, and each part counts the words of all: in one bucket and in several."""
    monkeypatch.setattr(lm, "SPLIT", 3)
    rows, pairs, code = hot_start(spark)
    for dealt, want in zip(lm.parted(pairs), (rows, [r for r in rows if r[2]]), strict=True):
        table = dealt.toArrow()
        assert sorted((r["state"], r["word"], r["c"]) for r in table.to_pylist() if r["own"]) == sorted(want)
        parts = {r["part"] for r in table.to_pylist() if r["own"] and r["word"].startswith(b"http")}
        assert len(parts) > 10
        paths = [(s, "".join(map(str, b.bit)), c) for s, w, c in want for b in [lm.Bits([w], np.zeros(1, np.int64), code)]]
        for bucket in (table, *(table.filter([p % 3 == k for p in table["part"].to_pylist()]) for k in range(3))):
            _, bits, own, part, state, c = lm._rows(bucket, code)
            got = [bits.beginnings(bits.order(), group, c) for group in (part, part * (lm.GROUPS + 1) + state)]
            for row in range(own):
                path = "".join(map(str, bits.bit[bits.begin[row] :][: bits.size[row]]))
                for k in range(bits.size[row]):
                    at = bits.begin[row] + k
                    if bits.place[bits.byte[at]] >= lm.DEEP:
                        for (n, n1), own_state in zip(got, (None, state[row]), strict=True):
                            of = [(p, c) for s, p, c in paths if own_state in (None, s)]
                            assert n[at] == sum(c for p, c in of if p.startswith(path[:k]))
                            assert n1[at] == sum(c for p, c in of if p.startswith(path[:k] + "1"))


def test_model_scores_do_not_depend_on_how_a_start_is_split(spark, monkeypatch):
    rows, pairs, code = hot_start(spark)
    rng = np.random.default_rng(2)
    tables = SimpleNamespace(value=rng.integers(0, 9, (len(lm.CONTEXTS), 2, 1 << lm.BITS)).astype(float))
    model = SimpleNamespace(value=(rng.random((lm.COUNTS * lm.PLACES, lm.INPUTS)).astype(np.float32), np.full((lm.COUNTS, lm.BINS), 0.5, np.float32)))
    got = []
    for split in (10**9, 3):
        monkeypatch.setattr(lm, "SPLIT", split)
        table = lm.parted(pairs)[0].toArrow()
        out = [r for p in set(table["part"].to_pylist()) for r in lm._score(tables, code, model)(table.filter(pc.equal(table["part"], p))).to_pylist()]
        got.append(sorted((r["word"], r["state"], r["c"], r["n"], round(r["model"], 9)) for r in out))
        assert sum(r["first"] for r in out) == len({r["word"] for r in out})
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_tables_of_a_small_corpus_take_little_disk(spark, monkeypatch):
    """What is broadcast lies on the disks of the driver and of each executor: 64 MB each, were it plain."""
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: sent.append(len(pickle.dumps(value))) or broadcast(sc, value))
    rows = hot_start(spark)[1]
    scored = {(r.state, r.word): r.model for r in lm.pair_scores(rows).collect()}
    assert sum(sent) < 1 << 20
    monkeypatch.setattr(lm, "Packed", lambda n: n)
    assert {(r.state, r.word): r.model for r in lm.pair_scores(rows).collect()} == scored
    for top in (5, 2**33):
        plain = np.array([[0, 1, top], [7, 0, 3]], float)
        assert (pickle.loads(pickle.dumps(lm.Packed(plain))) == plain).all()


def test_words_of_a_batch_are_those_of_each_text():
    """Words, and the state before each, worked out for a batch together."""
    rng = random.Random(5)
    texts = [None, b"", b"  ", *(bytes(rng.choice(b" \t\n\r\x0b\x0cAaBb\x1c\x85\xc3\x00") for _ in range(rng.randrange(30))) for _ in range(300))]
    plain = [(t or b"").translate(ASCII_LOWER).split() for t in texts]
    for a, column in ((0, pa.array(texts, pa.binary())), (2, pa.array(texts, pa.binary()).slice(2)), (0, pa.array(texts, pa.large_binary()))):
        words, n = lm._tokens(column)
        assert n.tolist() == [len(w) for w in plain[a:]] and lm._binary(words).to_pylist() == [w for own in plain[a:] for w in own]
    known = {b"a": 1, b"bb": 2}
    before, end = lm._states(np.array([known.get(w, 0) for own in plain for w in own]), np.array([len(w) for w in plain]))
    want, last = [], []
    for own in plain:
        state = 0
        for w in own:
            want.append(state)
            state = known.get(w, state)
        last.append(state)
    assert before.tolist() == want and end.tolist() == last

"""Toxicity scores from a weighted finite-state pattern grammar.

The lexicon maps a word to a symbol (insult, threat, target, negation, report,
other) and a weight; insult weights are learned from labelled texts, for whole
words and for their first letters, so that languages without a seed list are
covered.  Four weighted transducers read the symbols of a clause: negation and
reported speech scale the insults and threats that they govern, the target
transducer marks those that follow a target, the clause transducer accepts
insult and threat clauses.  They are composed, pairs of states for states and
products of weights for weights, into one machine that does a step a word.
The score of a text is a logistic function of the weights of its matched
clauses, not of isolated words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Hashable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, written

#: Seed words of the grammar's classes (fixed values).
INSULTS = "asshole bastard bitch clown coward creep cretin disgusting dumb fool garbage idiot imbecile jerk liar loser moron pathetic pig rat scum stupid trash ugly useless vermin worthless".split()
THREATS = "kill hurt destroy beat punch stab shoot crush burn strangle hang attack".split()
TARGETS = "you your yours yourself u ur he she they him her them his their these those people tú usted ustedes vous tu toi du ihr euch sie".split()
NEGATIONS = "not no never none neither nor without isn't aren't wasn't don't doesn't didn't won't can't cannot nicht kein keine nie pas jamais nunca ni".split()
REPORTS = "said says say called calls quoted quote wrote writes reported reports claimed claims word term dijo dit sagte".split()
SEED_WEIGHT, THREAT_WEIGHT = 2.0, 2.0

#: Labelled rows that are used, a bound by hash.
TRAIN_ROWS = 40_000
#: Texts that must hold a learned entry, log-odds and log-likelihood ratio (doubled) it must reach among the very many
#: entries tried, first letters tried.
MIN_TEXTS, MIN_ODDS, MIN_RATIO, STEMS = 3, 2.0, 18.0, (4, 5, 6, 7)
#: Words after a negation or report that it governs; factors of the two and of a clause with a target.
SCOPE, NEGATED, REPORTED, AIMED = 4, 0.3, 0.5, 1.5
#: Words whose symbol a worker remembers.
REMEMBERED = 500_000

_CLAUSE_END = re.compile(r"[.!?;:\n]")
_EDGE = "\"'`´‘’“”«»()[]{}<>.,;:!?¡¿*#$%&+-_=~/\\|@^…"


class Lexicon:
    """First transducer: word -> (symbol, weight)."""

    def __init__(self, learned: dict[str, float]):
        self.entries: dict[str, tuple[str, float]] = {}
        for symbol, words, weight in (("report", REPORTS, 0.0), ("negation", NEGATIONS, 0.0), ("target", TARGETS, 0.0), ("threat", THREATS, THREAT_WEIGHT), ("insult", INSULTS, SEED_WEIGHT)):
            self.entries.update({w: (symbol, weight) for w in words})
        self.stems = {w[:-1]: v for w, v in learned.items() if w.endswith("*")}
        for w, v in learned.items():
            if not w.endswith("*") and self.entries.get(w, ("insult",))[0] in ("insult", "threat"):
                self.entries[w] = ("insult", max(v, self.entries.get(w, ("", 0.0))[1]))
        self.known: dict[str, tuple[str, float]] = {}

    def symbol(self, token: str) -> tuple[str, float]:
        """Of a lower-cased token with whatever signs stand at its edges."""
        if (got := self.known.get(token)) is not None:
            return got
        word = token.strip(_EDGE)
        got = self.entries.get(word)
        if got is None:
            weights = [self.stems[word[:k]] for k in STEMS if word[:k] in self.stems]
            got = ("insult", max(weights)) if weights else ("other", 0.0)
        if len(self.known) < REMEMBERED:
            self.known[token] = got
        return got


SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")
#: An insult or threat that follows a target.
AFTER = {"insult": "insult after target", "threat": "threat after target"}


class Transducer(NamedTuple):
    """Weighted and deterministic: (state, symbol) -> (state, symbol out, weight), and the weights of final states."""

    start: Hashable
    arcs: dict[tuple[Hashable, str], tuple[Hashable, str, float]]
    final: dict[Hashable, float]


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What ``b`` makes of the output of ``a``: states are pairs, weights multiply; states that cannot be reached are left out."""
    leaving: dict = {}
    for (state, symbol), arc in a.arcs.items():
        leaving.setdefault(state, []).append((symbol, arc))
    start = (a.start, b.start)
    arcs, seen, todo = {}, {start}, [start]
    while todo:
        p, q = todo.pop()
        for symbol, (p2, out, w) in leaving.get(p, ()):
            if (q, out) in b.arcs:
                q2, out2, v = b.arcs[q, out]
                arcs[(p, q), symbol] = ((p2, q2), out2, w * v)
                if (p2, q2) not in seen:
                    seen.add((p2, q2))
                    todo.append((p2, q2))
    return Transducer(start, arcs, {(p, q): a.final[p] * b.final[q] for p, q in seen if p in a.final and q in b.final})


def scope(mark: str, factor: float, symbols: Iterable[str] = SYMBOLS) -> Transducer:
    """States are the words left under ``mark``; insults and threats among them weigh ``factor``."""
    arcs = {}
    for left in range(SCOPE + 1):
        for x in symbols:
            to = SCOPE if x == mark else left if x in ("negation", "report") else max(0, left - 1)
            arcs[left, x] = (to, x, factor if left and x in ("insult", "threat") else 1.0)
    return Transducer(0, arcs, {left: 1.0 for left in range(SCOPE + 1)})


def targets() -> Transducer:
    """Marks insults and threats that follow a target of the clause."""
    arcs = {(seen, x): (seen or x == "target", AFTER.get(x, x) if seen else x, 1.0) for seen in (False, True) for x in SYMBOLS}
    return Transducer(False, arcs, {False: 1.0, True: 1.0})


def clauses() -> Transducer:
    """Accepts clauses with an insult, those with a target weigh more; a threat counts only with a target before or after it."""
    moves = {
        ("start", "insult"): "insult",
        ("start", "threat"): "threat",
        ("start", AFTER["insult"]): "aimed",
        ("start", AFTER["threat"]): "aimed",
        ("threat", "insult"): "insult",
        ("threat", "target"): "aimed",
        ("insult", "target"): "aimed",
    }
    arcs = {}
    for state in ("start", "insult", "threat", "aimed"):
        for x in (*SYMBOLS, *AFTER.values()):
            arcs[state, x] = (moves.get((state, x), state), x, 1.0 if x.split()[0] in AFTER else 0.0)
    return Transducer("start", arcs, {"insult": 1.0, "aimed": AIMED, "start": 0.0, "threat": 0.0})


def machine() -> tuple[list[dict[str, tuple[int, float]]], list[float]]:
    """The composed grammar with numbered states: the arcs of each, and the weights of final states; state 0 is the start."""
    t = compose(compose(compose(scope("negation", NEGATED), scope("report", REPORTED)), targets()), clauses())
    number = {t.start: 0}
    for (state, _), (to, _, _) in t.arcs.items():
        number.setdefault(state, len(number))
        number.setdefault(to, len(number))
    arcs: list[dict[str, tuple[int, float]]] = [{} for _ in number]
    for (state, symbol), (to, _, w) in t.arcs.items():
        arcs[number[state]][symbol] = (number[to], w)
    return arcs, [t.final.get(state, 0.0) for state in number]


_ARCS, _FINAL = machine()


def clause_weight(symbols: Iterable[tuple[str, float]]) -> float:
    """Weight of one clause under the composed grammar; 0 if it is not accepted."""
    state, total = 0, 0.0
    for symbol, weight in symbols:
        state, w = _ARCS[state][symbol]
        total += w * weight
    return _FINAL[state] * total


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    """(largest clause weight, log1p of the clauses' sum, log1p of the matched clauses) of a whole text."""
    text = (text or "").lower()
    symbol = lexicon.symbol
    if not any(symbol(w)[1] for w in set(text.split())):
        return 0.0, 0.0, 0.0
    weights = []
    for clause in _CLAUSE_END.split(text):
        symbols = [symbol(w) for w in clause.split()]
        if any(w for _, w in symbols) and (total := clause_weight(symbols)) > 0:
            weights.append(total)
    return max(weights, default=0.0), math.log1p(sum(weights)), math.log1p(len(weights))


def _entries(text: str | None) -> set[str]:
    """Words of a text and their first letters, marked by ``*``."""
    words = {w.strip(_EDGE) for w in set((text or "").lower().split())}
    words.discard("")
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[Counter] = [Counter() for _ in range(4)]
        for text, toxic, fold in zip(*[batch.column(c).to_pylist() for c in ("text", "toxic", "fold")], strict=True):
            counts[2 * fold + toxic].update(_entries(text))
        both = list(set().union(*counts))
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *[pa.array([c[w] for w in both], pa.int64()) for c in counts]], ["entry", "clean0", "toxic0", "clean1", "toxic1"])


def learn_lexicons(train: DataFrame) -> list[dict[str, float]]:
    """Entries that mark toxic texts, with their log-odds, from rows (text, toxic, fold): of fold 0, of fold 1, of both."""
    n = {(r.fold, r.toxic): r["count"] for r in train.groupBy("fold", "toxic").count().collect()}
    names = ("clean0", "toxic0", "clean1", "toxic1")
    counts = train.mapInArrow(_count, "entry string, clean0 long, toxic0 long, clean1 long, toxic1 long").groupBy("entry").agg(*[F.sum(c).alias(c) for c in names])
    counts = counts.where(F.col("toxic0") + F.col("toxic1") >= MIN_TEXTS)
    counts = written(counts.where(F.col("toxic0") + F.col("toxic1") > F.col("clean0") + F.col("clean1")), "entries")
    out = []
    for folds in ((0,), (1,), (0, 1)):
        clean, toxic = (sum((F.col(f"{kind}{f}") for f in folds[1:]), F.col(f"{kind}{folds[0]}")) for kind in ("clean", "toxic"))
        all_clean, all_toxic = (sum(n.get((f, t), 0) for f in folds) for t in (0, 1))
        if not all_clean or not all_toxic:
            out.append({})
            continue
        # the prior shrinks rare entries, and sums to one text
        prior = all_toxic / (all_clean + all_toxic)
        odds = F.log((toxic + prior) / all_toxic) - F.log((clean + 1 - prior) / all_clean)
        share = lambda x, rate: F.when(x > 0, x * F.log(x / ((toxic + clean) * rate))).otherwise(0.0)
        ratio = 2 * (share(toxic, prior) + share(clean, 1 - prior))
        got = counts.select("entry", odds.alias("odds"), ratio.alias("ratio"), (toxic >= MIN_TEXTS).alias("often"))
        got = got.where(F.col("often") & (F.col("odds") >= MIN_ODDS) & (F.col("ratio") >= MIN_RATIO))
        # the labelled texts are bounded, and so are entries with this much evidence in them
        out.append({r.entry: float(r.odds) for r in got.select("entry", "odds").collect()})
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Penalised Newton fit of a logistic function with intercept; without both classes, the intercept alone."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = -2.0
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * np.append(w[:-1], 0)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - pull)
        w += np.clip(step, -2, 2)
    return w


def _features(lexicons):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = [Lexicon(lexicons.value[1]), Lexicon(lexicons.value[0])]
        for batch in batches:
            x = np.array([features(t, other[f]) for t, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column(1)], ["a", "b", "c", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, weights) from labelled rows that are not held out.

    At most about TRAIN_ROWS labelled rows are used, chosen by a hash of their
    doc_id.  The logistic function is fitted to texts whose clauses were weighed
    by a lexicon of the other half; the lexicon returned is that of all.
    """
    sc = docs.sparkSession.sparkContext
    usable = labels.where(~held_out).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n, scale = usable.count(), 1 << 20
    part = usable.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(scale))).where(F.col("h") < min(scale, scale * TRAIN_ROWS // max(1, n)))
    part = part.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)).cast("int").alias("fold"))
    # at most about TRAIN_ROWS rows of 16 bytes
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(part), "doc_id").select("text", "toxic", "fold")
    train = written(train, "train")  # used three times
    lexicons = learn_lexicons(train)
    got = train.mapInArrow(_features(sc.broadcast(lexicons[:2])), "a double, b double, c double, toxic int").toPandas()
    return lexicons[2], fit_logistic(got[["a", "b", "c"]].to_numpy(), got["toxic"].to_numpy(float))


def _add_score(lexicon_of, w: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(lexicon_of.value)
        for batch in batches:
            x = np.array([(*features(t, lexicon), 1.0) for t in batch.column(0).to_pylist()]).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p)], [*batch.schema.names[1:], "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, folds: int = 5, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns of every row of ``docs`` with score (0 to 1) and predicted (1 from 0.5 on).

    Learns from labels whose crc32(doc_id as text) mod ``folds`` is not 0; of a
    doc_id labelled more than once the larger label counts, labels without doc_id, with other values or without
    a document count nothing; equal clauses weigh equally, a text of any length is read whole.  Null and empty texts score as texts without a
    match.  Without labels of both kinds the seed words alone decide nothing: all
    scores are low and equal.  Rows that repeat are scored each; other columns never matter.
    """
    held_out = id_remainder(F.col("doc_id"), folds) == 0
    lexicon, w = fit(docs, labels, held_out)
    kept = docs.select(F.col("text").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[1:]) + ", score double"
    out = kept.mapInArrow(_add_score(docs.sparkSession.sparkContext.broadcast(lexicon), w), schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    names = tuple(docs.columns)
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = f"c{names.index('text')}"
    held_out = id_remainder(F.col("doc_id"), folds) == 0
    lexicon, w = fit(docs, labels, held_out)
    kept = rows.select(F.col(text).cast("string").alias("__text"), *rows.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", score double"
    out = kept.mapInArrow(_add_score(docs.sparkSession.sparkContext.broadcast(lexicon), w), schema)
    return out.where("score < 0.5").drop("score").toDF(*names)

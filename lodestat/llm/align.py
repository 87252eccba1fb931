"""Alignment of two tokenizers over the same bytes.

Each text is encoded by a byte-level tokenizer (A) and a piece tokenizer (B).
Where tokens of both end at the same byte the text is cut; the tokens between
two cuts are a group, and the tokens that end at a cut are linked.  Tasks work on
chunks of documents with whole-array NumPy steps and keep, for each chunk, its
distinct linked pairs and which documents hold them.  Pairs are counted over the
corpus by a salted shuffle in two stages; the counts go back to the chunks
that hold the pair, one row for each pair and chunk, so that a pair that is in every document
costs a row a chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written
from .tokens import Encoder

#: Characters of text that are aligned at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
#: Parts into which the rows of one pair are dealt in the first stage of counting.
SALTS = 16
#: Runs of blanks with a word of which a worker remembers the ids, twice over.
REMEMBERED = 150_000
#: The character that stands for a blank in pieces.
BLANK = "▁"

_UNIT = re.compile(" +[^ ]*")
_LINKS = pa.schema([("chunk", pa.int64()), ("pairs", pa.binary()), ("held", pa.binary()), ("at", pa.binary()), ("times", pa.binary()), ("n_pairs", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("groups_sha256", pa.list_(pa.string()))])
_SCHEMA = "chunk long, pairs binary, held binary, at binary, times binary, n_pairs array<long>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def given_back(side: ByteTokens | PieceTokens, ids: np.ndarray, text: str) -> bool:
    return b"".join(map(side.bytes.__getitem__, ids.tolist())) == text.encode()


class ByteTokens(Encoder):
    """Ids by a byte-level tokenizer; special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path, plain=True)
        of, vocab = byte_alphabet(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(of.__getitem__, token)) if all(c in of for c in token) else token.encode()
        self.exact = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = super()._ids(texts)
        self.exact = self.exact and all(given_back(self, np.frombuffer(x, f"<u{self.width}"), t) for x, t in zip(out, texts, strict=True))
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of blank + text; none if they do not give it back."""
        out = [np.frombuffer(x, f"<u{self.width}").astype(np.int64) for x in self.encode([" " + t for t in texts])]
        # pieces that are all given back give the text back
        return out if self.exact else [x if given_back(self, x, " " + t) else x[:0] for x, t in zip(out, texts, strict=True)]


class PieceTokens:
    """Ids by a piece tokenizer that puts a blank before the text.

    If no piece holds a blank after another character, no merge crosses the
    start of a run of blanks, so the ids of a text are those of its runs of
    blanks with the word behind; these are remembered.  Else whole texts are encoded.
    (Texts that hold the blank's sign itself are not given back, however they are cut.)
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.blank = self._encode(["x "])[0][len(self._encode(["x"])[0]) :]
        self.known: dict[str, bytes] = {" ": self.blank}
        self.older: dict[str, bytes] = {}
        self.lossy: set[str] = set()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self.model.encode(texts, num_threads=1)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of blank + text; none if they do not give it back."""
        cut = None
        if not self.apart:
            out = self._encode(texts)
        else:
            cut, out = self._by_units(texts)
        ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in out]
        suspect = range(len(texts)) if cut is None else [k for k, units in enumerate(cut) if self.lossy and not self.lossy.isdisjoint(units)]
        for k in suspect:
            if not given_back(self, ids[k], " " + texts[k]):
                ids[k] = ids[k][:0]
        return ids

    def _by_units(self, texts: list[str]) -> tuple[list[list[str]], list[bytes]]:
        cut = [_UNIT.findall(" " + t) for t in texts]
        missing = set().union(*cut).difference(self.known)
        if len(self.known) + len(missing) > REMEMBERED:
            # what was not met since the last time is forgotten
            self.known, self.older = {" ": self.blank}, self.known
            self.lossy &= self.older.keys()
            missing = set().union(*cut).difference(self.known)
        again = self.older.keys() & missing
        self.known.update((u, self.older[u]) for u in again)
        new = list(missing - again)
        for u, x in zip(new, self._encode([u[1:] for u in new]), strict=True):
            self.known[u] = x
            if not given_back(self, np.frombuffer(x, "<u4"), u):
                self.lossy.add(u)
        return cut, [b"".join(map(self.known.__getitem__, units)) for units in cut]


class Aligner:
    """Aligns lists of texts; one for each worker and pair of tokenizers."""

    _made: dict[tuple[str, str], Aligner] = {}

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.lengths = [np.array(list(map(len, x.bytes)), np.int64) for x in (self.a, self.b)]
        self.n_a, self.n_b = len(self.a.bytes), len(self.b.bytes)
        # an id as text, with the sign behind it: inside its side of a group, and at the end of the side
        self.written = [b"%d%s" % (i, sign) for n, signs in ((self.n_a, (b",", b"|")), (self.n_b, (b",", b";"))) for sign in signs for i in range(n)]

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._made:
            cls._made[path_a, path_b] = cls(path_a, path_b)
        return cls._made[path_a, path_b]

    def _tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none for a text that is empty or that either side does not give back byte by byte."""
        sides = self.a.ids(texts), self.b.ids(texts)
        for k, (a, b, text) in enumerate(zip(*sides, texts, strict=True)):
            if not (text and len(a) and len(b)):
                sides[0][k], sides[1][k] = a[:0], b[:0]
        return sides

    def align(self, texts: list[str]) -> tuple[dict[str, list], dict[str, np.ndarray]]:
        """Figures of each text, and the links: ``text`` and ``pair`` (A's id times B's vocabulary plus B's id) of each."""
        side_a, side_b = self._tokens(texts)
        a, b = np.concatenate([*side_a, np.zeros(0, np.int64)]), np.concatenate([*side_b, np.zeros(0, np.int64)])
        count_a, count_b = np.array([len(x) for x in side_a]), np.array([len(x) for x in side_b])
        ends = [np.cumsum(size[ids]) for size, ids in zip(self.lengths, (a, b), strict=True)]
        # ends of tokens that are not empty differ
        cuts = np.intersect1d(*ends, assume_unique=all(len(ids) == 0 or size[ids].min() > 0 for size, ids in zip(self.lengths, (a, b), strict=True)))
        label_a, label_b = (np.searchsorted(cuts, e) for e in ends)
        # the texts follow each other, so a text's last token ends at a cut
        text_of = np.searchsorted(np.cumsum(count_a), np.searchsorted(label_a, np.arange(len(cuts))), side="right")
        n_groups = np.bincount(text_of, minlength=len(texts))
        last_a, last_b = (np.flatnonzero(e == cuts[label]) if len(cuts) else np.zeros(0, np.int64) for e, label in zip(ends, (label_a, label_b), strict=True))
        # each token of A at a cut is repeated for each token of B at the cut
        begin = np.searchsorted(label_b[last_b], np.arange(len(cuts)))
        each = np.diff(np.append(begin, len(last_b)))[label_a[last_a]]
        left = np.repeat(last_a, each)
        step = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
        right = last_b[begin[label_a[left]] + step]
        links = {"text": text_of[label_a[left]], "pair": a[left] * self.n_b + b[right]}
        figures = {"n_a": count_a.tolist(), "n_b": count_b.tolist(), "n_groups": n_groups.tolist(), "n_links": np.bincount(links["text"], minlength=len(texts)).tolist()}
        return figures | {"groups_sha256": self._digests(a, b, label_a, label_b, count_a + count_b)}, links

    def _digests(self, a: np.ndarray, b: np.ndarray, label_a: np.ndarray, label_b: np.ndarray, counts: np.ndarray) -> list[str]:
        """sha256 of each text's groups, written as ``a1,a2|b1;a3|b2``."""
        order = np.empty(len(a) + len(b), np.int64)
        ends = np.append(label_a[1:] != label_a[:-1], True) if len(a) else np.zeros(0, bool)
        order[np.arange(len(a)) + np.searchsorted(label_b, label_a)] = a + self.n_a * ends
        ends = np.append(label_b[1:] != label_b[:-1], True) if len(b) else np.zeros(0, bool)
        order[np.arange(len(b)) + np.searchsorted(label_a, label_b, side="right")] = 2 * self.n_a + b + self.n_b * ends
        upto, get = np.cumsum(counts), self.written.__getitem__
        return [hashlib.sha256(b"".join(map(get, order[e - n : e].tolist()))[:-1]).hexdigest() if n else "" for n, e in zip(counts.tolist(), upto.tolist(), strict=True)]


def _chunk(aligner: Aligner, number: int, ids: list, texts: list[str]) -> dict:
    figures, links = aligner.align(texts)
    most = aligner.n_a * aligner.n_b
    mixed, times = np.unique(links["text"] * most + links["pair"], return_counts=True)
    pairs, at = np.unique(mixed % most, return_inverse=True)
    held = np.bincount(at, weights=times, minlength=len(pairs)).astype("<i8")
    per_text = np.bincount(mixed // most, minlength=len(texts)).tolist()
    return {"chunk": number, "pairs": pairs.astype("<i8").tobytes(), "held": held.tobytes(), "at": at.astype("<u4").tobytes(), "times": times.astype("<u4").tobytes(), "n_pairs": per_text, "doc_id": ids, **figures}


def _align(path_a: str, path_b: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner.of(path_a, path_b), TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if texts and size + len(text) > CHUNK:
                    yield pa.RecordBatch.from_pylist([_chunk(aligner, number, ids, texts)], _LINKS)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield pa.RecordBatch.from_pylist([_chunk(aligner, number, ids, texts)], _LINKS)

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each chunk: figures of its documents, its distinct pairs, and which document holds which how often."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_align(path_a, path_b), _SCHEMA)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            pair, held = (np.frombuffer(row[c], "<i8") for c in ("pairs", "held"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), row["chunk"])), pa.array(pair), pa.array(held)], ["chunk", "pair", "held"])


def pair_counts(held: DataFrame, n_b: int) -> DataFrame:
    """(chunk, pair, held) -> each pair's ``count`` over the corpus and whether it is ``best`` for its id of B."""
    salted = held.groupBy("pair", F.pmod("chunk", F.lit(SALTS)).alias("salt")).agg(F.sum("held").alias("n"))
    counts = salted.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % n_b)
    counts = written(counts, "pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _sums(chunks: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    out = []
    for row in chunks.itertuples():
        pairs, at, times = np.frombuffer(row.pairs, "<i8"), np.frombuffer(row.at, "<u4"), np.frombuffer(row.times, "<u4").astype(np.int64)
        c = counts.set_index("pair").loc[pairs]
        count, best = c["count"].to_numpy(np.int64)[at], c["best"].to_numpy(bool)[at]
        upto = np.append(0, np.cumsum(row.n_pairs))
        totals = [np.append(0, np.cumsum(x))[upto] for x in (times * best, times * count)]
        figures = {c: getattr(row, c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        figures["doc_id"] = pd.array([None if x is None or x != x else int(x) for x in figures["doc_id"]], "Int64")
        out.append(pd.DataFrame(figures | {"n_best": np.diff(totals[0]), "count_sum": np.diff(totals[1])}))
    names = [x.split()[0] for x in _OUT.split(", ")]
    return pd.concat(out)[names] if out else pd.DataFrame({c: pd.Series(dtype="str" if c == "groups_sha256" else "Int64") for c in names})


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows (doc_id, text) -> how A's and B's tokens of blank + text meet.

    Gives doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose
    pair has the corpus-wide highest count of its id of B, ties included), count_sum (the
    counts of all links) and groups_sha256.  A text that is null, empty or not given
    back byte by byte by both tokenizers has no tokens: zeros and an empty digest.  Rows that repeat
    count and are returned each; rows without doc_id are kept; other columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    n_b = Aligner.of(path_a, path_b).n_b
    chunks = written(aligned(docs, path_a, path_b), "aligned")
    held = chunks.select("chunk", "pairs", "held").mapInArrow(_pairs, "chunk long, pair long, held long")
    counts = pair_counts(held, n_b)
    found = held.select("chunk", "pair").join(counts, "pair")
    rows = chunks.drop("held").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(lambda l, r: _sums(l, r), _OUT)
    out = written(rows, "alignment")
    remove(spark, chunks)
    return out


def pair_table(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The linked pairs of a corpus: a_id, b_id, count (links), best (the highest count of its b_id)."""
    n_b = Aligner.of(path_a, path_b).n_b
    held = written(aligned(docs, path_a, path_b).select("chunk", "pairs", "held"), "aligned").mapInArrow(_pairs, "chunk long, pair long, held long")
    return pair_counts(held, n_b).select(F.floor(F.col("pair") / n_b).alias("a_id"), (F.col("pair") % n_b).alias("b_id"), "count", "best")

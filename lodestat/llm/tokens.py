"""Token ids in binary shards with a minimal perfect hash index.

A shard is three files in a shared folder: ``.ids`` (little-endian unsigned
ids of its documents, back to back, two bytes each if the vocabulary allows), ``.keys`` (their doc_ids,
ascending) and ``.index`` (the hash function, a stored fingerprint and the
record range of each key, and the offsets of the records).  A key is found
with a fixed number of probes and one ranged read of the payload.  Tasks write under a name of their own and
rename at the end, so a repeated task leaves the same files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Distinct pieces of text of which a worker remembers the ids, twice over; others are encoded again.
REMEMBERED = 400_000
#: Bits per key and level of the hash function; levels before the rest is stored outright.
GAMMA, LEVELS = 2.0, 24
#: Bytes of payload read at once, and ids of a shard that one task reads back.
READ, PIECE = 8 << 20, 8_000_000

#: White space as the tokenizer's pattern has it.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and signs that meet in one of the pattern's borders.
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
#: A piece is a run of other characters with one blank before it, cut where a sign follows letters only.
_PIECES = re.compile(rf" ?(?:[{_LETTER}]++(?:(?=[{_SIGN}])|[^{_WS}]*+)|[^{_WS}]++)|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Encodes whole texts with a byte-level tokenizer, remembering the ids of pieces.

    Byte-level pre-tokenizing never joins text across the borders of pieces, so
    the ids of a text are those of its pieces; a text that holds the string of a
    special token is encoded in one call (``plain``: as if it were none).  Ids are little-endian unsigned
    integers of ``width`` bytes, two if the vocabulary allows it.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is the empty text."""
        cut = [None if any(s in t for s in self.special) else _PIECES.findall(t) for t in (t or "" for t in texts)]
        missing = set().union(*[pieces for pieces in cut if pieces]).difference(self.known)
        if len(self.known) + len(missing) > REMEMBERED:
            # what was not met since the last time is forgotten
            self.known, self.older = {}, self.known
            missing = set().union(*[pieces for pieces in cut if pieces])
        again = self.older.keys() & missing
        self.known.update((p, self.older[p]) for p in again)
        new = list(missing - again)
        self.known.update(zip(new, self._ids(new), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) if pieces is not None else self._ids([t])[0] for t, pieces in zip(texts, cut, strict=True)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        return [np.array(e.ids, kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer of the key with a seed."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a cascade of bit sets, numbered by rank.

    A key that is alone in its place of a level has its number there: the set
    bits before it.  Keys that collide go to the next level.
    """

    def __init__(self, sizes: list[int], words: np.ndarray, last: np.ndarray):
        self.sizes, self.words, self.last = sizes, words, last
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.base = np.concatenate([[0], np.cumsum([s // 64 for s in sizes])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, sizes, words = keys.view(np.uint64), [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            m = -(-int(len(keys) * GAMMA + 1) // 64) * 64
            at = _mix(keys, level + 1) % np.uint64(m)
            alone = np.bincount(at.astype(np.int64), minlength=m) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(m)
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, "<u8"), np.sort(keys))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, from 0; for a key that was not built in, some number or -1."""
        keys = keys.view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            at = (_mix(keys[open_], level + 1) % np.uint64(m)).astype(np.int64)
            word, bit = self.base[level] + at // 64, (at % 64).astype(np.uint64)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            low = held & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.before[word] + np.bitwise_count(low))[hit]
            open_ = open_[~hit]
        if len(self.last) and len(open_):
            at = np.minimum(np.searchsorted(self.last, keys[open_]), len(self.last) - 1)
            hit = self.last[at] == keys[open_]
            out[open_[hit]] = self.before[-1] + at[hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.view(np.uint64), 0) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: np.ndarray, offsets: np.ndarray, nulls: int, width: int) -> bytes:
    """keys: doc_ids of all records but the first ``nulls``, ascending; offsets: of all records and the end, in ids."""
    own, first, count = np.unique(keys, return_index=True, return_counts=True)
    h = PerfectHash.build(own)
    slot = h.slot(own)
    table = np.zeros(len(own), [("fp", "<u4"), ("n", "<u4"), ("first", "<i8")])
    table["fp"][slot], table["n"][slot], table["first"][slot] = fingerprint(own), count, first + nulls
    head = np.array([len(own), nulls, len(offsets), len(h.sizes), len(h.words), len(h.last), width], "<i8")
    return b"".join(x.tobytes() for x in (head, np.array(h.sizes, "<i8"), h.words.astype("<u8"), h.last.astype("<u8"), table, offsets.astype("<i8")))


class Index:
    def __init__(self, data: bytes):
        n, self.nulls, n_off, n_sizes, n_words, n_last, self.width = (int(x) for x in np.frombuffer(data, "<i8", 7))
        at = 56

        def take(kind, k):
            nonlocal at
            got = np.frombuffer(data, kind, k, at)
            at += got.nbytes
            return got

        sizes = [int(x) for x in take("<i8", n_sizes)]
        self.hash = PerfectHash(sizes, take("<u8", n_words), take("<u8", n_last))
        self.table = take([("fp", "<u4"), ("n", "<u4"), ("first", "<i8")], n)
        self.offsets = take("<i8", n_off)

    def find(self, keys: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; 0 records if its fingerprint is not the stored one.

        One unknown key in 2**32 has a fingerprint that is stored in its place,
        so the key itself is compared with the shard's ``stored`` keys too.
        """
        if not len(self.table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.hash.slot(keys)
        row = self.table[np.maximum(slot, 0)]
        hit = (slot >= 0) & (row["fp"] == fingerprint(keys))
        hit &= stored[np.minimum(row["first"] - self.nulls, len(stored) - 1)] == keys
        return np.where(hit, row["first"], 0), np.where(hit, row["n"], 0).astype(np.int64)


def _fs(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _name(root: str, shard: int, kind: str) -> str:
    return f"{root}/shard-{shard:06d}.{kind}"


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    own = f"{path}.{xxhash.xxh64_hexdigest(data)}.part"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, path)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Write the ids of all whole texts, in ascending doc_id order, to ``folder``; returns the manifest, a row for each shard.

    Ranges of doc_id become shards, about one for each shuffle partition that
    AQE leaves (``shards`` sets their number).  Rows without doc_id come first and have records but
    no key; rows that repeat a doc_id are records of one key, in the order of a
    hash of their text; null texts are empty; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(*([shards] if shards else []), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, (fs, root), enc = TaskContext.get(), _fs(folder), encoder(tokenizer)
        shard, width = context.partitionId(), enc.width
        end = end_id.to_bytes(width, "little")
        own = f"{_name(root, shard, 'ids')}.{context.taskAttemptId()}.part"
        keys, sizes, nulls, out = [], [], 0, None
        for pdf in batches:
            if out is None:
                fs.create_dir(root)
                out = fs.open_output_stream(own)
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                for ids in enc.encode([t if isinstance(t, str) else None for t in part["text"]]):
                    out.write(ids)
                    out.write(end)
                    sizes.append(len(ids) // width + 1)
            nulls += int(pdf["doc_id"].isna().sum())
            keys.append(pdf["doc_id"].dropna().to_numpy(np.int64))
        if out is None:
            return
        out.close()
        fs.move(own, _name(root, shard, "ids"))
        key, offsets = np.concatenate(keys).astype("<i8"), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        _put(fs, _name(root, shard, "keys"), key.tobytes())
        _put(fs, _name(root, shard, "index"), index_bytes(key, offsets, nulls, width))
        first, last = (int(key[0]), int(key[-1])) if len(key) else (None, None)
        yield pd.DataFrame({"shard": [shard], "n_docs": [len(sizes)], "n_ids": [int(offsets[-1])], "first_id": pd.array([first], "Int64"), "last_id": pd.array([last], "Int64")})

    made = rows.mapInPandas(run, "shard int, n_docs long, n_ids long, first_id long, last_id long")
    made.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(made.schema).parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every record, each key looked up through the index of its shard.

    A shard is read in pieces of about PIECE ids, each by a task of its own.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    # one row for each shard: the running total needs a single small task
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    pieces = F.greatest(F.ceil(F.col("n_ids") / PIECE), F.lit(1)).cast("int")
    shards = manifest.select("shard", pieces.alias("pieces"), F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("base"))
    shards = shards.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    n = manifest.agg(F.coalesce(F.sum(pieces), F.lit(1))).first()[0]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _fs(folder)
        for pdf in batches:
            for shard, pieces, piece, base in zip(pdf["shard"], pdf["pieces"], pdf["piece"], pdf["base"], strict=True):
                index, stored = _open(fs, root, shard)
                keys = np.unique(stored)
                keys = keys[len(keys) * piece // pieces : len(keys) * (piece + 1) // pieces]
                first, count = index.find(keys, stored)
                if (count == 0).any():
                    raise ValueError(f"shard {shard}: a stored key is not in the index")
                nulls = index.nulls if piece == 0 else 0
                record = np.concatenate([np.arange(nulls), _runs(first, count)]).astype(np.int64)
                doc = pd.array([pd.NA] * nulls + np.repeat(keys, count).tolist(), "Int64")
                yield from _records(fs, root, shard, index, record, doc, int(base))

    # a number given outright is kept by AQE, which sees only the few bytes of the manifest
    return shards.repartitionByRange(int(n), "shard", "piece").mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def _open(fs, root: str, shard: int) -> tuple[Index, np.ndarray]:
    """Index and stored keys of a shard."""
    return Index(fs.open_input_file(_name(root, shard, "index")).read()), np.frombuffer(fs.open_input_file(_name(root, shard, "keys")).read(), "<i8")


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run of ``count`` numbers."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _records(fs, root, shard, index, record, doc, base) -> Iterator[pd.DataFrame]:
    """Records in runs that lie together; ids come out as unsigned 32-bit integers whatever the file's width."""
    start, end, width = index.offsets[record], index.offsets[record + 1], index.width
    with fs.open_input_file(_name(root, shard, "ids")) as payload:
        at = 0
        while at < len(record):
            to = at + 1
            while to < len(record) and start[to] == end[to - 1] and (end[to] - start[at]) * width <= READ:
                to += 1
            ids = np.frombuffer(payload.read_at(int(end[to - 1] - start[at]) * width, int(start[at]) * width), f"<u{width}").astype("<u4").tobytes()
            own = [ids[(a - start[at]) * 4 : (b - start[at]) * 4] for a, b in zip(start[at:to], end[at:to], strict=True)]
            yield pd.DataFrame({"doc_id": doc[at:to], "start": start[at:to] + base, "n_tokens": end[at:to] - start[at:to], "ids": own})
            at = to


def lookup(keys: DataFrame, folder: str, most_shards: int = 1_000_000) -> DataFrame:
    """Records of the given doc_ids (column doc_id; repeats count once) by the index; unknown and null keys give no row.

    The driver holds the first key of each shard, 8 bytes of a shard of many
    megabytes; above ``most_shards`` shards it refuses.
    """
    spark = keys.sparkSession
    manifest = spark.read.parquet(f"{folder}/manifest").where("first_id IS NOT NULL")
    if (n := manifest.count()) > most_shards:
        raise ValueError(f"{n} shards; the first keys of at most {most_shards} are held")
    bounds = np.array(sorted((r.first_id, r.shard) for r in manifest.select("first_id", "shard").collect()), np.int64).reshape(-1, 2)

    def route(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.searchsorted(bounds[:, 0], pdf["doc_id"], side="right") - 1
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "shard": bounds[np.maximum(at, 0), 1]})[at >= 0]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (fs, root), held, index, stored = _fs(folder), None, None, None
        for pdf in batches:
            for shard, own in pdf.groupby("shard", sort=False):
                if shard != held:
                    held, (index, stored) = shard, _open(fs, root, shard)
                key = own["doc_id"].to_numpy(np.int64)
                first, count = index.find(key, stored)
                record = _runs(first, count)
                for out in _records(fs, root, shard, index, record, pd.array(np.repeat(key, count), "Int64"), 0):
                    yield out[["doc_id", "n_tokens", "ids"]]

    if not len(bounds):
        return spark.createDataFrame([], "doc_id long, n_tokens long, ids binary")
    routed = keys.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct().mapInPandas(route, "doc_id long, shard long")
    return routed.repartition(len(bounds), "shard").sortWithinPartitions("shard", "doc_id").mapInPandas(run, "doc_id long, n_tokens long, ids binary")

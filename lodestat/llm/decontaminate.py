"""Benchmark decontamination with DataFrame functions only.

Item-sized windows of a document are placed where a run of five-word shingles
of an item begins: a window of similarity 0.8 shares shingles with its item, so
no other window can pass, and most positions need no SimHash.  Windows, each text once, and items
get SimHashes of their words.  Multi-index blocks bring together all of one size that
differ in at most RADIUS bits: of BLOCKS = RADIUS + 2 blocks two at least agree, so
keys are pairs of blocks.  An exact weighted-shingle similarity decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Words of a shingle, least similarity, differing bits of SimHashes that are still compared, and blocks of their 64 bits.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 11
BLOCKS = RADIUS + 2
#: Rows (about 40 bytes each) up to which a table made from the benchmark is sent to all tasks; beyond, joins shuffle.
BROADCAST_ROWS = 500_000
_SPACE = " \t\n\u000b\f\r"


def _words(text: Column) -> Column:
    """Words between ASCII white space, A-Z lower-cased; none for null, empty and white texts."""
    bare = F.btrim(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def _shingle(i: Column) -> Column:
    return F.xxhash64(*[F.col("words")[i + k] for k in range(SHINGLE)])


def _positions(rows: DataFrame) -> DataFrame:
    """Each position i, from 0, at which a shingle begins; explode_outer keeps the optimizer from repeating the split in a filter."""
    n = F.size("words")
    return rows.withColumn("i", F.explode_outer(F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)))).where("i IS NOT NULL")


def _sent(df: DataFrame) -> DataFrame:
    """Broadcast a written table whose size was counted and is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """(key, fp): 64-bit SimHash of the words of each row."""
    words = rows.select(key, F.explode("words").alias("w")).select(key, F.xxhash64("w").alias("h"))
    sums = [F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    counted = words.groupBy(key).agg(F.count("*").alias("n"), *sums)
    bits = [F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit((1 << b) - (1 << 64 if b == 63 else 0))).otherwise(F.lit(0)).cast("long") for b in range(64)]
    fp = bits[0]
    for x in bits[1:]:
        fp = fp.bitwiseOR(x)
    return counted.select(key, fp.alias("fp"))


def _shingles(rows: DataFrame, key: str) -> DataFrame:
    """(key, h, n): shingles of each row with their number."""
    return _positions(rows).select(key, _shingle(F.col("i")).alias("h")).groupBy(key, "h").agg(F.count("*").alias("n"))


def _block_mask(k: int) -> int:
    return (1 << (64 * (k + 1) // BLOCKS)) - (1 << (64 * k // BLOCKS))


def _signed(m: int) -> int:
    return m - (1 << 64) if m >= 1 << 63 else m


#: Bits of each pair of blocks, as signed numbers.
PAIRS = [_signed(_block_mask(i) | _block_mask(j)) for i in range(BLOCKS) for j in range(i)]


def _blocks(fps: DataFrame) -> DataFrame:
    """A row for each pair of blocks of (fp, w), with ``b``, a hash of the pair's number, its bits and the size w."""
    masks = F.array(*[F.lit(m).cast("long") for m in PAIRS])
    return fps.withColumn("b", F.explode(F.transform(masks, lambda m, i: F.xxhash64(i, F.col("w"), F.col("fp").bitwiseAND(m)))))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, dk, item_id, start, n_words, similarity): the best window for each document and item that match.

    Similarity is the sum of least over the sum of largest shingle counts, each
    shingle weighing one over the number of items that hold it (one if none).
    Of equal windows the first counts.  A document shorter than an item is one
    window.  Items and documents of fewer than five words, and null texts, match nothing; items without
    item_id are left out; an item_id that repeats is matched by each of its texts, the best
    counts.  dk tells apart texts of one doc_id.  Other columns are ignored.
    """
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE).distinct()
    items = written(items.withColumn("key", F.xxhash64("item_id", "words")).withColumn("w", F.size("words")), "items")
    # a shingle's place in its item, and the shingle before it
    starts = written(_positions(items).select(_shingle(F.col("i")).alias("h"), F.when(F.col("i") > 0, _shingle(F.col("i") - 1)).alias("before"), F.col("i").alias("q"), "w"), "starts")
    weights = written(_shingles(items, "key").groupBy("h").agg((1 / F.count("*")).alias("weight")), "weights")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("dk"), _words(F.col("text")).alias("words"))
    hits = _positions(rows).withColumn("h", _shingle(F.col("i"))).join(_sent(starts), "h")
    begins = F.col("before").isNull() | (F.col("i") == 0) | (F.when(F.col("i") > 0, _shingle(F.col("i") - 1)) != F.col("before"))
    n = F.size("words")
    start = F.greatest(F.least(F.col("i") - F.col("q"), n - F.col("w")), F.lit(0))
    placed = hits.where(begins).select("doc_id", "dk", "w", "words", start.alias("start"), F.least("w", n).alias("n_words"))
    placed = placed.select("doc_id", "dk", "w", "start", "n_words", F.slice("words", F.col("start") + 1, F.col("n_words")).alias("words"))
    # two hashes of a window's words stand for them: the same words are one window from here on
    placed = written(placed.withColumn("key", F.xxhash64("w", "words")).withColumn("more", F.hash("words", F.lit(7))), "placed")
    # the words follow from the hashes, any of them will do
    windows = written(placed.groupBy("key", "more").agg(F.any_value("words").alias("words"), F.any_value("w").alias("w")).withColumn("key", F.xxhash64("key", "more")).select("key", "words", "w"), "windows")

    sizes = items.select(F.col("key").alias("item"), "w")
    item_fps = _fingerprint(items, "key").select(F.col("key").alias("item"), F.col("fp").alias("item_fp"), "fp").join(sizes, "item")
    item_fps = written(_blocks(item_fps).select("b", "item", "item_fp"), "item_blocks")
    blocks = _blocks(_fingerprint(windows, "key").join(windows.select("key", "w"), "key"))
    pairs = blocks.join(_sent(item_fps), "b").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("key", "item").distinct()

    weighed = F.coalesce("weight", F.lit(1.0)) * F.col("n")
    shingles = _shingles(windows, "key").join(_sent(weights), "h", "left")
    own = written(shingles.select("key", "h", "n", F.coalesce("weight", F.lit(1.0)).alias("weight")), "window_shingles")
    theirs = written(_shingles(items, "key").join(weights, "h").select(F.col("key").alias("item"), "h", F.col("n").alias("item_n"), "weight"), "item_shingles")
    total = own.groupBy("key").agg(F.sum(weighed).alias("total"))
    item_total = written(theirs.groupBy("item").agg(F.sum(F.col("weight") * F.col("item_n")).alias("item_total")), "item_totals")
    common = pairs.join(own.select("key", "h", "n"), "key").join(_sent(theirs), ["item", "h"]).groupBy("key", "item").agg(F.sum(F.col("weight") * F.least("n", "item_n")).alias("common"))
    similarity = F.col("common") / (F.col("total") + F.col("item_total") - F.col("common"))
    good = common.join(total, "key").join(_sent(item_total), "item").select("key", "item", similarity.alias("similarity")).where(F.col("similarity") >= least - 1e-12)
    good = written(good.join(_sent(items.select(F.col("key").alias("item"), "item_id")), "item").select("key", "item_id", "similarity"), "good")
    best = F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", -F.col("start")))
    # a passage that very many documents share is one row of good: where that is large, AQE splits the side of documents
    found = placed.select(F.xxhash64("key", "more").alias("key"), "doc_id", "dk", "start", "n_words").join(_sent(good), "key")
    return found.groupBy("doc_id", "dk", "item_id").agg(best.alias("b")).select("doc_id", "dk", "item_id", "b.start", "b.n_words", "b.similarity")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns."""
    bad = written(matches(docs, benchmark, least).select(F.col("doc_id").alias("__id"), F.col("dk").alias("__dk")).distinct(), "contaminated")
    key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return docs.join(_sent(bad), (key == bad["__dk"]) & docs["doc_id"].cast("long").eqNullSafe(bad["__id"]), "left_anti")

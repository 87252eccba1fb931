"""Language-model scores: add-0.1 unigrams and a context-mixing model of bits.

The model writes a text as its tokens' bytes, a blank after each word and a
line feed at the end, each byte in a prefix code of the training corpus, and
predicts one bit after the other.  Contexts are the last one to four bytes of
the word (hashed tables of fixed size, counted over the whole training
corpus), the whole beginning of the word (exact counts over the whole training corpus, whatever
the number of words that begin alike), and each of these with the text's state: the group of
the frequent word seen last, groups being frequent words that keep company
(in practice, languages).  The predictions are stretched, combined by weights
that a gate selects, trained online over all training words with each count's own occurrence left out,
and refined by an adaptive table.  Counts are whole numbers held as doubles, words are sorted
before they are learned: scores do not depend on how rows are dealt to batches and tasks.  Given the state, a word's probability does
not depend on the text, so that it is worked out once for all its occurrences.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, shuffle_buckets, written

#: Add-constant of the unigram score.
ALPHA = 0.1
#: Hashed contexts as (bytes, with state), log2 of a table's cells, and pseudo-count of a bit.
CONTEXTS, BITS, DELTA = ((2, False), (4, False), (3, True), (4, True)), 20, 0.04
DEEP = 4
INPUTS = len(CONTEXTS) + 3
#: Frequent words that set the state, and groups of them.
STATE_WORDS, GROUPS = 64, 6
#: Most frequent (state, word) pairs that every task holds, and the longest of them in bytes.
FREQUENT, FREQUENT_BYTES = 400_000, 64
#: Words of one bucket, bits of one online step, learning rate, least number of groups that learn apart and are averaged, words of one.
BUCKET, STEP, RATE, TRAINERS, TRAINED = 60_000, 8192, 0.3, 12, 100_000
#: A training word is a border between parts of its start (its first DEEP bytes) if its hash is 0 modulo SPLIT: a part has so many words on average.
SPLIT = 10_000
#: Rows of one start from which ``with_starts`` cuts deeper.
HOT = 20_000
#: Gate: counts of the beginning by powers of two, times the position in the word.
COUNTS, PLACES, BINS = 10, 8, 33
#: Bits treated together: what a processor's cache holds.
SLAB = 32_768
END = b""


def _tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one after the other, and how many each text has."""
    kind = pa.large_string() if pa.types.is_large_binary(column.type) else pa.string()
    column = column.fill_null(b"")
    # the kernels look at ASCII bytes alone, so that any bytes will do
    words = pc.ascii_split_whitespace(pc.ascii_lower(pa.Array.from_buffers(kind, len(column), [None, *column.buffers()[1:]], offset=column.offset)))
    flat, n = words.flatten(), words.value_lengths().to_numpy().astype(np.int64)
    solid = pc.binary_length(flat).to_numpy() > 0
    if not solid.all():  # blanks at the ends of a text
        n = np.bincount(np.repeat(np.arange(len(n)), n)[solid], minlength=len(n))
        flat = flat.filter(pa.array(solid))
    return flat, n


def _binary(words: pa.Array) -> pa.Array:
    return words.cast(pa.binary())


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of up to FREQUENT_BYTES with their number, a row for each word of a batch."""
    for batch in batches:
        seen = _tokens(batch.column(0))[0].value_counts()
        seen = seen.filter(pc.less_equal(pc.binary_length(seen.field("values")), FREQUENT_BYTES))
        yield pa.RecordBatch.from_arrays([_binary(seen.field("values")), seen.field("counts")], ["word", "c"])


def _company(names: list[bytes]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that hold both of two words (one: ``a`` = ``b``), a row for each pair of a task."""
        n = np.zeros((len(names), len(names)), np.int64)
        for batch in batches:
            words, size = _tokens(batch.column(0))
            known = pc.index_in(_binary(words), pa.array(names, pa.binary())).fill_null(-1).to_numpy()
            own = np.zeros((len(size), len(names)))
            own[np.repeat(np.arange(len(size)), size)[known >= 0], known[known >= 0]] = 1
            n += (own.T @ own).astype(np.int64)
        a, b = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n[a, b])], ["a", "b", "n"])

    return run


def state_groups(company: np.ndarray, groups: int = GROUPS) -> list[int]:
    """Group, from 1, of each word: average linkage on how much more often than by chance two words share a text."""
    n = len(company)
    own = np.maximum(np.diag(company), 1)
    near = company / np.sqrt(own[:, None] * own)
    member = [[k] for k in range(n)]
    while len(member) > groups:
        best = max(((near[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(member) for j, b in enumerate(member[:i])), default=None)
        i, j = -best[1], -best[2]
        member[j] += member.pop(i)
    out = [0] * n
    for g, own_words in enumerate(member):
        for k in own_words:
            out[k] = g + 1
    return out


def _states(sets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State before each word and at the end of each text of ``n`` words: the group that was set last (0: none yet); ``sets``: what a word sets, 0 if nothing."""
    begin = np.cumsum(n) - n
    last = np.maximum.accumulate(np.where(sets > 0, np.arange(len(sets)), -1)) if len(sets) else np.zeros(0, np.int64)
    after = np.where(last >= np.repeat(begin, n), sets[last], 0)
    some = n > 0
    before, end = np.append(0, after)[: len(sets)], np.zeros(len(n), np.int64)
    before[begin[some]] = 0
    end[some] = after[(begin + n - 1)[some]]
    return before, end


def _count_pairs(states):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = _tokens(batch.column(0))
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            words = words.dictionary_encode()
            number, names = words.indices.to_numpy(), _binary(words.dictionary)
            known = states.value
            sets = np.zeros(len(names) + 1, np.int64)
            at = pc.index_in(pa.array(list(known), pa.binary()), names).fill_null(len(names)).to_numpy()
            sets[at] = list(known.values())
            sets[len(names)] = 0
            before, end = _states(sets[number], n)
            # one column for each word and one for the end, for training texts and for those held out
            size = len(names) + 1
            rows = np.concatenate([before * size + number, end * size + len(names)])
            out = np.concatenate([np.repeat(held, n), held]) * ((GROUPS + 1) * size)
            counts = np.bincount(rows + out, minlength=2 * (GROUPS + 1) * size).reshape(2, -1)
            row = np.flatnonzero(counts.any(0))
            word = pa.concat_arrays([names, pa.array([END], pa.binary())]).take(pa.array(row % size))
            yield pa.RecordBatch.from_arrays([pa.array((row // size).astype(np.int32)), word, pa.array(counts[0, row])], ["state", "word", "c"])

    return run


def prefix_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman code of the 256 bytes: length of each, its inner nodes and its bits, by position."""
    heap = [(float(c) + 1e-3, k, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    inner, children = 256, {}
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        children[inner] = (x, y)
        heapq.heappush(heap, (a + b, inner, inner))
        inner += 1
    paths: dict[int, list] = {}
    todo = [(heap[0][2], [])]
    while todo:
        node, path = todo.pop()
        if node < 256:
            paths[node] = path
        else:
            todo += [(child, [*path, (node - 255, bit)]) for bit, child in enumerate(children[node])]
    length = np.array([len(paths[k]) for k in range(256)])
    node, bit = np.zeros((256, length.max()), np.uint64), np.zeros((256, length.max()), np.uint8)
    for k, path in paths.items():
        node[k, : len(path)], bit[k, : len(path)] = zip(*path, strict=True)
    return length, node, bit


class Bits:
    """The bits of (state, word) rows, row after row: their byte, node and value, and what their contexts are."""

    def __init__(self, words: list[bytes], state: np.ndarray, code: tuple):
        size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        flat = np.frombuffer(b"".join([w + b" " if w else b"\n" for w in words]), np.uint8)
        begins = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        place = np.arange(len(flat)) - np.repeat(begins, size)
        before = np.zeros(len(flat), np.uint64)
        for k in range(DEEP, 0, -1):  # a 1 marks the word's start, zeros stand before it
            shifted = np.concatenate([np.zeros(k, np.uint8), flat[:-k]])[: len(flat)]
            before = before << np.uint64(8) | np.where(place >= k, shifted, place == k - 1).astype(np.uint64)
        length, node, bit = code
        times = length[flat]
        of = np.repeat(np.arange(len(flat), dtype=np.int32), times)
        nth = np.arange(len(of), dtype=np.int32) - np.repeat((np.cumsum(times) - times).astype(np.int32), times)
        value = flat[of]
        # nodes of a code of 256 bytes are numbered up to 255; cells widens them
        self.byte, self.node, self.bit = of, node[value, nth].astype(np.uint8), bit[value, nth]
        del nth, value
        self.size = np.add.reduceat(times, begins) if len(words) else np.zeros(0, np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), self.size)
        self.place, self.before = place, before
        self.state = np.repeat(state, size).astype(np.uint64)

    def contexts(self, k: int) -> np.ndarray:
        """A hash of the k-th context of each byte."""
        order, with_state = CONTEXTS[k]
        context = self.before & np.uint64((1 << 8 * order) - 1)
        if with_state:
            context = context | (self.state + np.uint64(1)) << np.uint64(40)
        return _mix(context + np.uint64(k << 56))

    def cells(self, context: np.ndarray, at: slice) -> np.ndarray:
        """Table cells of the bits ``at``."""
        return ((context[self.byte[at]] + self.node[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)

    def order(self) -> np.ndarray:
        """Rows in the order of their bits."""
        raw = self.bit.tobytes()
        keys = [raw[a : a + m] for a, m in zip(self.begin.tolist(), self.size.tolist(), strict=True)]
        return np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)

    def beginnings(self, order: np.ndarray, group: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each bit, the counts of all rows of its group that begin alike, and of those whose next bit is 1.

        In the order of their bits, rows that begin alike stand together; the
        runs are followed one bit deeper at a time.
        """
        order = order[np.argsort(group[order], kind="stable")]
        # counts are whole numbers: half the bytes hold them unless they are very large
        kind = np.uint32 if c.sum() < 2**32 else np.float64
        n, n1 = np.zeros(len(self.bit), kind), np.zeros(len(self.bit), kind)
        begin, size, group, c = self.begin[order], self.size[order], group[order], c[order]
        new = np.append(True, group[1:] != group[:-1])[: len(order)]  # a run begins here
        depth = 0
        while len(begin):
            at = begin + depth
            bit = self.bit[at]
            starts = np.flatnonzero(new)
            runs = np.diff(np.append(starts, len(at)))
            n[at] = np.repeat(np.add.reduceat(c, starts), runs)
            n1[at] = np.repeat(np.add.reduceat(c * bit, starts), runs)
            new[1:] |= bit[1:] != bit[:-1]
            depth += 1
            more = size > depth
            if not more.all():  # rows of one run are the same word or all go on: the code is prefix-free
                begin, size, c, new = begin[more], size[more], c[more], new[more]
        return n, n1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _pieces(n: int, size: int) -> Iterator[slice]:
    for a in range(0, n, size):
        yield slice(a, min(a + size, n))


def _count_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(256)
    for batch in batches:
        words, c = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        size = [len(w) + 1 for w in words]
        n += np.bincount(np.frombuffer(b"".join(w + b" " if w else b"\n" for w in words), np.uint8), np.repeat(c, size).astype(float), 256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n)], ["cell", "n"])


def _count_cells(code: tuple):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(CONTEXTS), 2 << BITS))
        for batch in batches:
            state, words, c = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
            bits = Bits(words, state, code)
            for k in range(len(CONTEXTS)):
                context = bits.contexts(k)
                for at in _pieces(len(bits.bit), 1 << 18):
                    np.add.at(n[k], 2 * bits.cells(context, at) + bits.bit[at], c[bits.word[at]])
        for k in range(len(CONTEXTS)):
            both = n[k].reshape(-1, 2)
            cell = np.flatnonzero(both.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(cell + (k << BITS)), pa.array(both[cell, 0]), pa.array(both[cell, 1])], ["cell", "n0", "n1"])

    return run


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Packed:
    """Whole numbers not below zero; pickled, they are compressed, and unpickled, they are a plain array.

    A broadcast lies on the disks of the driver and of every executor as it was pickled, and most cells of a small corpus are empty.
    """

    def __init__(self, n: np.ndarray):
        self.n = n.astype(np.uint32) if n.max(initial=0) < 2**32 else n

    def __reduce__(self) -> tuple:
        return _unpacked, (pa.compress(np.ascontiguousarray(self.n), "zstd", asbytes=True), self.n.dtype.str, self.n.shape)


def _unpacked(packed: bytes, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(packed, size, "zstd"), kind).reshape(shape)


_held: dict[int, np.ndarray] = {}


def _ratios(tables: np.ndarray) -> np.ndarray:
    """Log odds of each cell of the hashed contexts, worked out once a worker."""
    if id(tables) not in _held:
        _held.clear()
        _held[id(tables)] = np.log((tables[:-1, 1] + DELTA) / (tables[:-1, 0] + DELTA)).astype(np.float32)
    return _held[id(tables)]


def _predictions(bits: Bits, own: int, part: np.ndarray, state: np.ndarray, c: np.ndarray, tables: np.ndarray, left_out: bool) -> Iterator[tuple]:
    """(bits, stretched predictions, gate) by slabs of the first ``own`` rows; ``left_out``: without one occurrence of the row's own word."""
    order = bits.order()
    plain, stated = bits.beginnings(order, part, c), bits.beginnings(order, part * (GROUPS + 1) + state, c)
    contexts = [bits.contexts(k) for k in range(len(CONTEXTS))]
    known = (c > 0).astype(np.float32)
    ratios = None if left_out else _ratios(tables)
    place = np.minimum(bits.place, PLACES - 1).astype(np.int16)
    for at in _pieces(int(bits.size[:own].sum()), SLAB):
        bit, byte = bits.bit[at], bits.byte[at]
        one_more = bit.astype(np.float32)
        less1 = known[bits.word[at]] * one_more if left_out else np.float32(0)
        less0 = known[bits.word[at]] * (1 - one_more) if left_out else np.float32(0)
        x = np.empty((INPUTS, len(bit)), np.float32)
        for k, context in enumerate(contexts):
            cell = bits.cells(context, at)
            if left_out or k == len(contexts) - 1:
                n0, n1 = tables[k, 0, cell] - less0, tables[k, 1, cell] - less1
                count = n0 + n1
                x[k] = np.log((np.maximum(n1, 0) + DELTA) / (np.maximum(n0, 0) + DELTA))
            else:
                x[k] = ratios[k, cell]
        deep = np.flatnonzero(bits.place[byte] >= DEEP)
        less1, less0 = (v[deep] if left_out else v for v in (less1, less0))
        for k, ((n, n1), shallow) in enumerate(zip((plain, stated), (1, len(contexts) - 1), strict=True), len(contexts)):
            all_of, ones = n[at][deep].astype(float), n1[at][deep].astype(float)
            one, zero = ones - less1, all_of - ones - less0
            x[k] = x[shallow]
            x[k, deep] = np.log((np.maximum(one, 0) + DELTA) / (np.maximum(zero, 0) + DELTA))
        count[deep] = one + zero
        x[-1] = 0.3
        gate = np.minimum(np.log2(np.maximum(count, 0) + 1).astype(np.int16), COUNTS - 1) * PLACES + place[byte]
        yield at, x, gate.astype(np.int64)


def _bin(s: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(s * 2) + BINS // 2, 0, BINS - 1).astype(np.int64)


def _rows(table: pa.Table, code: tuple) -> tuple:
    """Bits of a table's rows, how many of them are its own (first, the same order however rows were dealt), and the columns."""
    table = table.sort_by([("own", "descending"), ("word", "ascending"), ("state", "ascending")])
    words, (state, part, c) = table["word"].to_pylist(), (table[name].to_numpy().astype(np.int64) for name in ("state", "part", "c"))
    return table, Bits(words, state, code), pc.sum(table["own"]).as_py() or 0, part, state, c.astype(float)


def _train(tables, code: tuple):
    def run(table: pa.Table) -> pa.Table:
        """Online descent over a bucket's words; gives its weights and the counts of the adaptive table."""
        k = COUNTS * PLACES
        w, power = np.full((k, INPUTS), 0.3, np.float32), np.full((k, INPUTS), 1e-2)
        steps, refine = np.zeros(k), np.zeros((COUNTS, BINS, 2))
        _, bits, own, part, state, c = _rows(table, code)
        for at, x, gate in _predictions(bits, own, part, state, c, tables.value, True):
            much = np.minimum(c, 30.0)[bits.word[at]]
            for a in range(0, x.shape[1], STEP):
                xs, g, y, m = x[:, a : a + STEP], gate[a : a + STEP], bits.bit[at][a : a + STEP], much[a : a + STEP]
                s = xs[0] * w[:, 0][g]
                for j in range(1, INPUTS):
                    s += xs[j] * w[:, j][g]
                refine += np.bincount((g // PLACES * BINS + _bin(s)) * 2 + y, m, refine.size).reshape(refine.shape)
                total, miss = np.bincount(g, m, k), (y - _squash(s)) * m
                up = np.stack([np.bincount(g, xs[j] * miss, k) for j in range(INPUTS)], axis=1).astype(np.float32)
                # each weight's step shrinks with its past gradients
                up /= np.maximum(total, 1e-9)[:, None].astype(np.float32)
                power += up.astype(float) ** 2
                w += np.where(total[:, None] > 0, RATE * up / np.sqrt(power), 0).astype(np.float32)
                steps += total
        return pa.table({"x": pa.array([np.concatenate([(w * steps[:, None]).ravel(), steps, refine.ravel()])], pa.list_(pa.float64()))})

    return run


def _score(tables, code: tuple, model):
    def run(table: pa.Table) -> pa.Table:
        """Model log10 probability of each (state, word), the word's count in all states, and a mark on one row of each word."""
        w, refine = model.value
        table, bits, rows, part, state, c = _rows(table, code)
        logp = np.zeros(rows)
        columns = np.ascontiguousarray(w.T)
        for at, x, gate in _predictions(bits, rows, part, state, c, tables.value, False):
            s = x[0] * columns[0][gate]
            for k in range(1, INPUTS):
                s += x[k] * columns[k][gate]
            p = np.clip(0.5 * _squash(s) + 0.5 * refine[gate // PLACES, _bin(s)], 1e-6, 1 - 1e-6)
            own = bits.word[at]
            logp[own[0] : own[-1] + 1] += np.bincount(own - own[0], np.log10(np.where(bits.bit[at] == 1, p, 1 - p)))
        table = table.slice(0, rows)
        word, count = table["word"].combine_chunks(), table["c"].to_numpy()
        first = np.append(True, pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False))[:rows]
        n = np.add.reduceat(count, np.flatnonzero(first))[np.cumsum(first) - 1] if rows else count
        return pa.table({"state": table["state"], "word": word, "c": table["c"], "n": pa.array(n, pa.int64()), "first": pa.array(first, pa.bool_()), "model": pa.array(logp)})

    return run


def with_starts(pairs: DataFrame, most: int = HOT) -> DataFrame:
    """Adds ``cut``: words of one group share their first ``cut`` bytes, DEEP or, where more than ``most`` rows do, more.

    Scores do not use it: see ``parted``, whose parts keep the counts of beginnings whole.
    """
    rows = pairs.withColumn("cut", F.lit(DEEP))
    for length in (DEEP, 2 * DEEP, 4 * DEEP, 8 * DEEP):
        start = F.substring("word", 1, length)
        hot = written(rows.where(F.col("cut") == length).groupBy(start.alias("start")).count().where(F.col("count") > most).select("start"), "starts")
        if hot.isEmpty():
            break
        few = hot.count() <= FREQUENT
        rows = rows.join(F.broadcast(hot) if few else hot, (F.col("cut") == length) & (start == F.col("start")), "left").withColumn("cut", F.when(F.col("start").isNotNull(), 2 * length).otherwise(F.col("cut"))).drop("start")
    return rows


def _deal(borders):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the number of borders of their start up to the word (null: the start has none), of all and of those of training words."""
        of = borders.value
        for batch in batches:
            n = batch.num_rows
            part, trained, none = np.zeros(n, np.int32), np.zeros(n, np.int32), np.ones(n, bool)
            for k, w in enumerate(batch.column(1).to_pylist()):
                if own := of.get(w[:DEEP]):
                    part[k] = at = bisect_right(own[0], w + b" ")
                    trained[k], none[k] = own[1][at], False
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(part, mask=none), pa.array(trained, mask=none)], ["state", "word", "c", "part", "trained"])

    return run


def _branches(nodes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(state, beginning, c): the words' counts by each beginning that is one byte longer than a beginning of a border."""
        for batch in batches:
            seen: Counter = Counter()
            for state, word, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                word += b" "
                at = DEEP
                while at < len(word) and word[:at] in nodes.value:
                    at += 1
                    seen[state, word[:at]] += c
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in seen], pa.int32()), pa.array([w for _, w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["state", "word", "c"])

    return run


def _outside(nodes, kind: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows for each part of the words beyond its borders, cut behind the first byte in which they differ from the border."""
        for batch in batches:
            to, at = [], []
            for k, word in enumerate(batch.column(1).to_pylist()):
                for goes_on, numbers in nodes.value[word[:-1]]:
                    number = numbers[kind]
                    # a border is the first word of its part
                    if number and (word != goes_on or word.endswith(b" ")):
                        to.append(number - (word >= goes_on))
                        at.append(k)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(to, pa.int32())], ["state", "word", "c", "part"])

    return run


def parted(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, word, c, part, own) rows dealt into parts of starts, for scores and, of the words with a count only, for training.

    A start's words in the order of their bytes are cut into parts at its
    borders, words chosen by their hash; so one start, however many words it has,
    is many parts.  A beginning whose words lie in several parts is a beginning
    of a border between them, so a part gets the others' words of these beginnings too (``own`` false), summed up by
    the byte in which they leave the border.  With them the counts of beginnings
    in a part are those of the whole corpus.
    """
    sc = pairs.sparkSession.sparkContext
    chosen = (F.length("word") >= DEEP) & (F.pmod(F.xxhash64("word", F.lit(5)), F.lit(SPLIT)) == 0)
    # one word of SPLIT
    found = sorted((bytes(r.word) + b" ", r.seen) for r in pairs.where(chosen).groupBy("word").agg((F.max("c") > 0).alias("seen")).collect())
    by_start: dict[bytes, tuple[list, list]] = {}
    nodes: dict[bytes, list] = {}
    for border, seen in found:
        names, trained = by_start.setdefault(border[:DEEP], ([], [0]))
        names.append(border)
        trained.append(trained[-1] + seen)
        for at in range(DEEP, len(border)):
            nodes.setdefault(border[:at], []).append((border[: at + 1], (len(names), trained[-1] if seen else 0)))
    shared = sc.broadcast(nodes)
    rows = written(pairs.select("state", "word", "c").mapInArrow(_deal(sc.broadcast(by_start)), "state int, word binary, c long, part int, trained int"), "parts")
    branches = written(rows.where("part IS NOT NULL AND c > 0").select("state", "word", "c").mapInArrow(_branches(shared), "state int, word binary, c long").groupBy("state", "word").agg(F.sum("c").alias("c")), "branches")
    out = []
    for kind, own in enumerate((rows.select("state", "word", "c", "part"), rows.where("c > 0").select("state", "word", "c", F.col("trained").alias("part")))):
        beyond = branches.mapInArrow(_outside(shared, kind), "state int, word binary, c long, part int")
        both = own.withColumn("own", F.lit(True)).unionByName(beyond.withColumn("own", F.lit(False)))
        out.append(both.withColumn("part", F.coalesce("part", F.lit(0))))
    return out[0], out[1]


def _dealt(rows: DataFrame, buckets: int, *seed: Column) -> DataFrame:
    """Rows with their bucket: parts go whole; the first part of a start goes by the start alone."""
    later = F.when(F.col("part") > 0, F.col("part"))  # hashes pass over nulls
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.substring("word", 1, DEEP), *seed, later), F.lit(buckets)))


def pair_scores(pairs: DataFrame) -> DataFrame:
    """(state, word, c) -> (state, word, c, n, first, model): the log10 probability of each word in its state.

    n is the word's count in all states, first marks one row of each word.
    """
    spark = pairs.sparkSession
    sc = spark.sparkContext
    seen = pairs.where("c > 0")
    count, training = pairs.agg(F.count("*"), F.count_if(F.col("c") > 0)).first()
    got = seen.mapInArrow(_count_bytes, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    code = prefix_code(np.bincount(got["cell"], got["n"], 256))
    # at most len(CONTEXTS) * 2**BITS cells, whatever the corpus
    cells = seen.mapInArrow(_count_cells(code), "cell long, n0 double, n1 double").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    n = np.zeros((len(CONTEXTS), 2, 1 << BITS))
    cell = cells["cell"].to_numpy()
    for v in (0, 1):
        n[cell >> BITS, v, cell & ((1 << BITS) - 1)] = cells[f"n{v}"].to_numpy()
    tables = sc.broadcast(Packed(n))
    rows, seen = parted(pairs)
    rows = _dealt(rows, shuffle_buckets(spark, count, BUCKET))
    k = COUNTS * PLACES
    # trainers are groups of whole parts whose number follows the corpus alone, so that weights do not depend on the session
    trainers = max(TRAINERS, -(-training // TRAINED))
    parts = _dealt(seen, trainers, F.lit(3)).groupBy("bucket").applyInArrow(_train(tables, code), "x array<double>")
    got = parts.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("x")).toPandas()
    x = np.zeros(k * (INPUTS + 1) + COUNTS * BINS * 2)
    x[got["pos"].to_numpy(int)] = got["x"].to_numpy()
    steps = x[k * INPUTS :][:k]
    w = np.where(steps[:, None] > 0, x[: k * INPUTS].reshape(k, -1) / np.maximum(steps, 1e-9)[:, None], 0.3).astype(np.float32)
    table = x[-COUNTS * BINS * 2 :].reshape(COUNTS, BINS, 2)
    centre = _squash((np.arange(BINS) - BINS // 2) / 2)
    model = sc.broadcast((w, ((table[:, :, 1] + 8 * centre) / (table.sum(2) + 8)).astype(np.float32)))
    return rows.groupBy("bucket").applyInArrow(_score(tables, code, model), "state int, word binary, c long, n long, first boolean, model double")


def _sum_known(known):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen, base, model, group = known.value  # by word; model by state and word, NaN if not held
        end = number.get(END, -1)
        for batch in batches:
            words, n = _tokens(batch.column(2))
            bytes_of = np.bincount(np.repeat(np.arange(len(n)), n), pc.binary_length(words).to_numpy(), len(n)).astype(np.int64)
            words = words.dictionary_encode()
            token, names = words.indices.to_numpy(), _binary(words.dictionary)
            held = np.fromiter((number.get(w, -1) for w in names.to_pylist()), np.int64, len(names))
            sets = np.where(held >= 0, group[held], 0) if len(held) else held  # frequent words are all held
            before, last = _states(sets[token], n)
            # the end of a text is one more token
            text = np.concatenate([np.repeat(np.arange(len(n)), n), np.arange(len(n))])
            at, state = np.concatenate([held[token], np.full(len(n), end)]), np.concatenate([before, last])
            score = np.where(at >= 0, model[state, at], np.nan)
            new = np.isnan(score)
            told = ~new
            sums = [np.bincount(text[told], x, len(n)) for x in (seen[at[told]], base[at[told]], score[told])]
            size = len(names) + 1
            token = np.append(token, np.full(len(n), len(names)))
            row, tf = np.unique((text[new] * (GROUPS + 1) + state[new]) * size + token[new], return_counts=True)
            out = [n + 1, bytes_of + n + 1, sums[0].astype(np.int64), *sums[1:]]
            own = [batch.column(0), batch.column(1), batch.column(3), *[pa.array(v, t) for v, t in zip(out, TYPES[3:8], strict=True)], *[pa.nulls(len(n), t) for t in TYPES[8:]]]
            yield pa.RecordBatch.from_arrays(own, list(NAMES))
            if m := len(row):
                word = pa.concat_arrays([names, pa.array([END], pa.binary())]).take(pa.array(row % size))
                row //= size
                own = [batch.column(0).take(pa.array(row // (GROUPS + 1))), *[pa.nulls(m, t) for t in TYPES[1:8]], pa.array(row % (GROUPS + 1), pa.int32()), word, pa.array(tf, pa.int64())]
                yield pa.RecordBatch.from_arrays(own, list(NAMES))

    return run


NAMES = ("rid", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base", "model", "state", "word", "tf")
TYPES = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.int64())


def scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Score every whole text; a row for each row of ``docs``.

    Training documents are those whose crc32(doc_id as text) mod ``folds`` is
    not 0 (a null doc_id counts as the empty text, which has remainder 0 and is
    held out).  Columns: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, n_bytes, bits_per_byte.  Null and empty texts are the end token alone.
    Repeated rows count, and are scored, each.  Without any training document
    all counts are 0.  Other columns are ignored; empty in, empty out.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    held_out = id_remainder(F.col("doc_id"), folds) == 0
    texts = docs.select(F.col("text").cast("binary").alias("text"), held_out.alias("held_out"))
    training = texts.where("NOT held_out").select("text")
    counts = training.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    names = [bytes(r.word) for r in counts.orderBy(F.desc("c"), "word").limit(STATE_WORDS).collect()]
    met = np.zeros((len(names), len(names)))
    if names:  # at most STATE_WORDS squared rows
        for r in training.mapInArrow(_company(names), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
            met[r.a, r.b] = r.n
    states = sc.broadcast(dict(zip(names, state_groups(met), strict=True)))

    pairs = written(texts.mapInArrow(_count_pairs(states), "state int, word binary, c long").groupBy("state", "word").agg(F.sum("c").alias("c")), "pairs")
    scored = written(pair_scores(pairs), "scored")
    total, distinct = scored.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("first") & (F.col("n") > 0))).first()
    base = F.log10((F.col("n") + ALPHA) / (total + ALPHA * (distinct + 1)))
    seen = (F.col("n") > 0).cast("int")
    # a fixed number of short words, the frequent ones among them, is held by every task; all others are joined
    top = scored.where(F.length("word") <= FREQUENT_BYTES).orderBy(F.desc("c"), "word", "state").limit(FREQUENT).select("state", "word", seen.alias("seen"), base.alias("base"), "model").toArrow()
    words = top["word"].to_pylist()
    number = {w: k for k, w in enumerate(dict.fromkeys([*names, *words]))}
    at, groups = np.fromiter(map(number.__getitem__, words), np.int64, len(words)), states.value
    by_word = [np.zeros(len(number) + 1) for _ in range(2)]
    for x, name in zip(by_word, ("seen", "base"), strict=True):
        x[at] = top[name].to_numpy()
    model = np.full((GROUPS + 1, len(number) + 1), np.nan)
    model[top["state"].to_numpy(), at] = top["model"].to_numpy()
    group = np.zeros(len(number) + 1, np.int64)
    group[[number[w] for w in groups]] = list(groups.values())
    known = sc.broadcast((number, *by_word, model, group))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), held_out.alias("held_out"))
    parts = written(rows.mapInArrow(_sum_known(known), "rid long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, model double, state int, word binary, tf long"), "sums")
    rare = parts.where("word IS NOT NULL").select("rid", "state", "word", "tf").join(scored.select("state", "word", "n", "model"), ["state", "word"])
    rare = rare.groupBy("rid").agg(F.sum(F.col("tf") * seen).alias("r_n_known"), F.sum(F.col("tf") * base).alias("r_base"), F.sum(F.col("tf") * F.col("model")).alias("r_model"))
    out = parts.where("word IS NULL").drop("state", "word", "tf").join(rare, "rid", "left")
    plus = lambda c: F.col(c) + F.coalesce(F.col(f"r_{c}"), F.lit(0))
    out = out.select("doc_id", "held_out", "n_tokens", plus("n_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base").alias("base_score"), plus("model").alias("score"), "n_bytes")
    return out.withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / F.col("n_bytes"))

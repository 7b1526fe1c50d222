"""Phrase collocations per language, counted in an FM-index per shard over word ids.

Texts are lower-cased, cut into pieces and words, and written as shards: per language runs of about
SHARD words with a dictionary, the Burrows-Wheeler transform of the word ids and that of the reversed
ids, sorted by the first DEPTH words, which is as deep as phrases are asked for. The texts are not
read again. A phrase is an interval in both transforms; all intervals of a level are extended by a word to the left or
to the right at once, which keeps both intervals in step, and an interval's size is the phrase's count in the
shard. Counts are summed up across shards level by level, by cells of a hash, of which those that
reach the least count set bits in a bitmap; a phrase is extended only if both phrases that it is made of have their bit.
Phrases that share a cell can only let more through. The last pass spells the phrases that are left; they are summed up
in their task, and move in sorted and compressed blocks by their first two words. Their exact sums give counts, extensions and scores.

A document is in one shard, a shard is bounded, and a shard is a row of a table: a lost executor costs the
shards of its tasks. Frequent words and hot languages are summed up in their shards first.
"""

from __future__ import annotations

import contextlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataq.llm.shingles import mix, ragged
from strataq.storage import kept, materialize, read_table, scratch

DEPTH = 4
#: Words a shard holds before it is indexed: a row of about 1 MB; rows of a transform that are extended at a time.
SHARD, BLOCK = 1 << 17, 1 << 16
#: Bytes of texts or shards that a task gets at a time.
BATCH_BYTES = "8m"
#: Bytes of a text that are cut into words at a time.
SLICE = 1 << 20
#: Each level's bitmap of hashes has 2**FILTER_BITS bits: 8 MB when sent to the tasks, whatever the input. When it is full, more phrases are counted, and the result is the same.
#: Counts of its cells move in blocks of 2**16, and those of some tasks are summed up together first.
FILTER_BITS, PARTS = 26, 16
#: Cells, or phrases with their words, a task holds before it sums them up; if half as many cells or as many phrases are left, they move.
HELD, SPELLED = 1 << 21, 1 << 20
#: Spelled phrases move by a hash in this many buckets at least and at most; between them one per so many shards.
BUCKETS, MOST_BUCKETS, BUCKET_SHARDS = 64, 1 << 12, 32
#: The language of documents without one.
UNKNOWN = "und"
# What ends a piece, and what else parts words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
_PLAIN = bytes.maketrans(PIECE_ENDS + BLANKS, b"\n" * len(PIECE_ENDS) + b" " * len(BLANKS))
_BASE = np.uint64(0xD1342543DE82EF95)
_ROWS = 1 << 16


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text, A to Z lower-cased, in lists of about SLICE bytes; ``\\n`` stands between pieces."""
    data = text.encode().lower().translate(_PLAIN).replace(b"\n", b" \n ")
    at = 0
    while at < len(data):
        to = len(data) if at + SLICE >= len(data) else data.find(b" ", at + SLICE)
        to = len(data) if to < 0 else to
        yield [w for w in data[at:to].split(b" ") if w]
        at = to


class Words:
    """Word ids of the pieces of one language, from 1 on in the order of their first occurrence; 0 is before, between and after pieces."""

    def __init__(self):
        self.ids = array("i", [0])
        self.number: dict[bytes, int] = {b"\n": 0}

    def add(self, text: str) -> None:
        number = self.number
        for words in words_of(text):
            self.ids.extend([number.setdefault(w, len(number)) for w in words])
        self.ids.append(0)


def transform(ids: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of ids that begin and end with 0, rows sorted by their first DEPTH ids."""
    n, rank, width = len(ids), ids.astype(np.int64), 1
    while width < DEPTH:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:]
        key = rank << 32 | after
        order = np.argsort(key)
        in_order = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], in_order[1:] != in_order[:-1]]))
        width *= 2
    return ids[order - 1]


def last_to_first(bwt: np.ndarray) -> np.ndarray:
    """For each row the row that begins with its last id."""
    order = np.sort(bwt.astype(np.int64) << 32 | np.arange(len(bwt))) & 0xFFFFFFFF
    out = np.empty(len(bwt), np.int32)
    out[order] = np.arange(len(bwt), dtype=np.int32)
    return out


class Phrases:
    """Phrases of one length: their intervals' first rows in the transform of the ids and in that of the reversed ids,
    their counts, word ids, and hashes of the whole, of all but the last word, and of all but the first."""

    def __init__(self, lo, back, count, words, whole, head, tail):
        self.lo, self.back, self.count, self.words, self.whole, self.head, self.tail = lo, back, count, words, whole, head, tail

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.lo, self.back, self.count, self.words, self.whole, self.head, self.tail

    def where(self, keep: np.ndarray | slice) -> Phrases:
        return Phrases(*(x[keep] for x in self.parts()))

    def __len__(self) -> int:
        return len(self.lo)


class FMIndex:
    """Both transforms of a shard, with the hash of each word and the count of each id, 0 included."""

    def __init__(self, hashes: np.ndarray, forward: np.ndarray, backward: np.ndarray):
        self.counts, self.hashes, self.sides = np.bincount(forward, minlength=len(hashes)), hashes, (forward, backward)
        self._steps: list = [None, None]

    @classmethod
    def of(cls, ids: np.ndarray, hashes: np.ndarray) -> FMIndex:
        return cls(hashes, transform(ids), transform(ids[::-1]))

    def words(self) -> Phrases:
        """All words of the shard as phrases."""
        first = np.cumsum(self.counts) - self.counts
        zero = np.zeros(len(first) - 1, np.uint64)
        ids = np.arange(1, len(first), dtype=np.int32)[:, None]
        return Phrases(first[1:], first[1:].copy(), self.counts[1:], ids, self.hashes[1:], zero, zero)

    def extend(self, p: Phrases, left: bool) -> Phrases:
        """Every phrase with each word that stands before it, or with ``left`` unset after it; p may not be longer than DEPTH - 1."""
        upto, at, out = np.cumsum(p.count), 0, []
        while at < len(p) or not out:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, side="right")))
            out.append(self._extended(p.where(slice(at, to)), left))
            at = to
        return Phrases(*map(np.concatenate, zip(*(x.parts() for x in out))))

    def _extended(self, p: Phrases, left: bool) -> Phrases:
        side = 0 if left else 1
        bwt = self.sides[side]
        if self._steps[side] is None:
            self._steps[side] = last_to_first(bwt)
        lo, other = (p.lo, p.back) if left else (p.back, p.lo)
        rows = ragged(lo, p.count)
        parent = np.repeat(np.arange(len(p)), p.count)
        # The place is the low end of what is sorted: that is stable, and faster than argsort. Below BLOCK rows, or with one parent, it fits.
        low = len(rows).bit_length()
        key = np.sort((parent * len(self.counts) + bwt[rows]) << low | np.arange(len(rows)))
        order, key = key & ((1 << low) - 1), key >> low
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        parent, word = key[first] // len(self.counts), key[first] % len(self.counts)
        # Rows of the other interval are sorted by this word: it begins after those of smaller words.
        begin = np.cumsum(p.count) - p.count
        moved = other[parent] + first - begin[parent]
        lo = self._steps[side][rows[order[first]]]
        real = word > 0
        lo, moved, count, parent, word = lo[real], moved[real], count[real], parent[real], word[real]
        h, m = self.hashes[word], p.words.shape[1]
        old, added = p.words[parent], word.astype(np.int32)[:, None]
        with np.errstate(over="ignore"):
            if left:
                whole, head = h * _BASE ** np.uint64(m) + p.whole[parent], h * _BASE ** np.uint64(m - 1) + p.head[parent]
                return Phrases(lo, moved, count, np.hstack([added, old]), whole, head, p.whole[parent])
            return Phrases(moved, lo, count, np.hstack([old, added]), p.whole[parent] * _BASE + h, p.whole[parent], p.tail[parent] * _BASE + h)

    def levels(self, to: int, passes) -> Iterator[Phrases]:
        """The phrases of 1 to ``to`` words that ``passes(length, hashes)`` lets stand and whose parts it lets stand."""
        p = self.words()
        for m in range(1, to + 1):
            if m > 1:
                # By turns to the left and to the right: a phrase grows at both its ends.
                p = self.extend(p, left=m % 2 == 0)
                p = p.where(passes(m - 1, p.head) & passes(m - 1, p.tail))
            p = p.where(passes(m, p.whole))
            yield p


def _packed(*parts: np.ndarray | bytes) -> bytes:
    """Arrays and bytes one after another, compressed behind their length; arrays byte by byte of their places, as the upper bytes are mostly equal."""
    data = b"".join(p if isinstance(p, bytes) else p.view(np.uint8).reshape(-1, p.itemsize).T.tobytes() for p in parts)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unpacked(data: pa.Buffer) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8].to_pybytes(), "little"), asbytes=True)


def _array(data: bytes, kind: str, n: int, at: int = 0) -> np.ndarray:
    """The n numbers of a kind whose bytes ``_packed`` put at a place."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, -1).T).view(kind).ravel()


def _loaded(data: pa.Buffer) -> np.ndarray:
    raw = _unpacked(data)
    return _array(raw, "<i4", len(raw) // 4)


def _dictionary(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, and where each begins and the last ends; the first is the empty one of id 0."""
    data = np.frombuffer(joined, np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    starts = ends - np.arange(len(ends)) if len(data) else np.zeros(0, np.int64)
    return data[data != 10], np.concatenate([[0, 0], starts])


def _hashes(lang: str, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the language and each word's bytes, 0 for the empty word."""
    size = np.diff(starts)
    place = np.arange(len(data)) - np.repeat(starts[:-1], size)
    out = np.zeros(len(size), np.uint64)
    if len(data):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(size.max(), _BASE))
            out[1:] = mix(np.add.reduceat((data + np.uint64(1)) * power[place], starts[1:-1]) + np.uint64(xxhash.xxh64_intdigest(lang.encode())))
    return out


_SHARDS = "lang string, n_words bigint, words binary, forward binary, backward binary"


def index_shards(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD) -> DataFrame:
    """A row per shard: lang, n_words, the dictionary, and both transforms.

    A null or empty text has no words; a null language is UNKNOWN. A text of any length is in one
    shard, which it makes longer.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Words] = {}

        def done(lang: str) -> pa.RecordBatch:
            w = open_.pop(lang)
            names, ids = list(w.number), np.frombuffer(w.ids, np.int32)
            data = [[lang], [int((ids > 0).sum())], [_packed(b"\n".join(names[1:]))], [_packed(transform(ids))], [_packed(transform(ids[::-1]))]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(data, [pa.string(), pa.int64()] + [pa.binary()] * 3)], names=["lang", "n_words", "words", "forward", "backward"])

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                words = open_.setdefault(lang, Words())
                held -= len(words.ids)
                words.add(text)
                held += len(words.ids)
                while held >= shard_words:
                    largest = max(open_, key=lambda k: len(open_[k].ids))
                    held -= len(open_[largest].ids)
                    yield done(largest)
        for lang in list(open_):
            yield done(lang)

    read = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    return materialize(read.mapInArrow(build, _SHARDS), "phrase-shards")


def _each_index(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.StringArray, FMIndex]]:
    for batch in batches:
        for k in range(batch.num_rows):
            lang = batch.column("lang")[k].as_py()
            data, starts = _dictionary(_unpacked(batch.column("words")[k].as_buffer()))
            words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data))
            yield lang, words, FMIndex(_hashes(lang, data, starts), *(_loaded(batch.column(c)[k].as_buffer()) for c in ("forward", "backward")))


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Shards are large rows: batches of them are kept below BATCH_BYTES while the jobs in the block run."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _cells(hashes: np.ndarray, level: int) -> np.ndarray:
    return (mix(hashes + np.uint64(level)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _filter_of(bitmaps):
    """What ``FMIndex.levels`` asks: levels without a bitmap let all stand."""

    def passes(level: int, hashes: np.ndarray) -> np.ndarray:
        bits = bitmaps.value.get(level)
        if bits is None:
            return np.ones(len(hashes), bool)
        cell = _cells(hashes, level)
        return bits[cell >> 6] >> (cell & 63).astype(np.uint64) & np.uint64(1) == 1

    return passes


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The values of a sorted array, each with where it begins and ends."""
    values, first = np.unique(x, return_index=True)
    return zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(x)])


class _Counts:
    """Counts by cell, none above ``most``, which is as far as they matter; as sorted cells with their counts."""

    def __init__(self, most: int):
        # A cell and its count are one number, which sorts fast.
        self.most, self.parts, self.held, self.distinct = most, [], 0, 0

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append(cells.astype(np.uint64) << np.uint64(32) | np.minimum(counts, self.most).astype(np.uint64))
        self.held += len(cells)
        # At least as many are new as were left the last time, so that each is sorted a few times at most.
        if self.held > max(HELD, 2 * self.distinct):
            cells, counts = self.summed()
            self.parts = [cells.astype(np.uint64) << np.uint64(32) | counts]
            self.held = self.distinct = len(cells)

    def full(self) -> bool:
        return self.distinct > HELD // 2

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.sort(np.concatenate([np.zeros(0, np.uint64), *self.parts]))
        cells, counts = (both >> np.uint64(32)).astype(np.uint32), both & np.uint64(0xFFFFFFFF)
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
        return cells[first], np.minimum(np.add.reduceat(counts, first), self.most).astype(np.uint32) if len(first) else counts.astype(np.uint32)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        cells, counts = self.summed()
        for k, at, to in _runs(cells >> np.uint32(16)):
            own = slice(at, to)
            low = (cells[own] & np.uint32(0xFFFF)).astype("<u2")
            low[1:] = np.diff(low)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([_packed(low.tobytes(), counts[own].astype("<u4"))])], names=["block", "cells"])

    def read(self, batches: Iterator[pa.RecordBatch]) -> _Counts:
        for batch in batches:
            for k, data in zip(batch.column("block").to_pylist(), batch.column("cells")):
                raw = _unpacked(data.as_buffer())
                n = len(raw) // 6
                low = np.cumsum(np.frombuffer(raw, "<u2", n).astype(np.int64))
                self.add(low + (k << 16), _array(raw, "<u4", n, 2 * n))
        return self


class _Spelled:
    """Exact counts of phrases with their words, in buckets; as blocks of sorted keys with their counts."""

    shape = pa.schema([("bucket", pa.int64()), ("key", pa.large_string()), ("f", pa.int64())])

    def __init__(self):
        self.parts, self.held, self.distinct = [], 0, 0

    def add(self, bucket: pa.Array, key: pa.Array, f: pa.Array) -> None:
        self.parts.append(pa.table([bucket, key, f], schema=self.shape))
        self.held += len(f)
        if self.held > max(SPELLED, 2 * self.distinct):
            self.parts = [self.summed()]
            self.held = self.distinct = len(self.parts[0])

    def full(self) -> bool:
        return self.distinct > SPELLED

    def summed(self) -> pa.Table:
        rows = pa.concat_tables([self.shape.empty_table(), *self.parts]).group_by(["bucket", "key"], use_threads=False).aggregate([("f", "sum")])
        return rows.rename_columns({"f_sum": "f"}).select(self.shape.names)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        rows = self.summed()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("bucket", "ascending"), ("key", "ascending")])).combine_chunks()
        bucket, f = rows["bucket"].to_numpy(), rows["f"].to_numpy().astype("<i8")
        text = b"".join(x.buffers()[2].to_pybytes() for x in rows["key"].chunks if len(x))
        size = pc.binary_length(rows["key"]).to_numpy().astype("<i8")
        ends = np.concatenate([[0], np.cumsum(size)]).tolist()
        for k, at, to in _runs(bucket):
            data = _packed(f[at:to], size[at:to], text[ends[at] : ends[to]])
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([data]), pa.array([to - at])], names=["bucket", "phrases", "n"])

    def read(self, k: int, n: int, data: pa.Buffer) -> None:
        raw = _unpacked(data)
        ends = np.concatenate([[0], np.cumsum(_array(raw, "<i8", n, 8 * n))]).astype(np.int64)
        key = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(raw[16 * n :]))
        self.add(pa.array(np.full(n, k)), key, pa.array(_array(raw, "<i8", n)))


def _bitmap(counted: DataFrame, least: int) -> np.ndarray:
    """The cells of counts (block, cells) that reach ``least``, as 2**FILTER_BITS bits in words of 64; at most 2**(FILTER_BITS - 6) rows reach the driver."""

    def add(batches):
        yield from _Counts(least).read(batches).blocks()

    def mark(batches):
        cells, counts = _Counts(least).read(batches).summed()
        cells = cells[counts >= least].astype(np.int64)
        word, first = np.unique(cells >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (cells & 63).astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
        for at in range(0, len(word), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(word[at : at + _ROWS]), pa.array(bits[at : at + _ROWS].view(np.int64))], names=["word", "bits"])

    shape = "block bigint, cells binary"
    some = counted.withColumn("part", F.spark_partition_id() % PARTS).repartition("block", "part").select("block", "cells").mapInArrow(add, shape)
    rows = some.repartition("block").mapInArrow(mark, "word bigint, bits bigint").toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def phrase_counts(docs: DataFrame, max_words: int = DEPTH, min_count: int = 30, shard_words: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f, left_f, right_f) of every phrase of up to ``max_words`` words that occurs ``min_count`` times or
    more, and (lang, n) with the number of words of each language.

    left_f and right_f are the counts of the most frequent phrase of one word more to the left and to the right, 0 if
    that occurs less than ``min_count`` times or is longer than ``max_words``. Both results are written tables.
    """
    if not 1 <= max_words <= DEPTH:
        raise ValueError(f"phrases have 1 to {DEPTH} words")
    with _small_batches(docs.sparkSession):
        return _phrase_counts(docs, max_words, min_count, shard_words)


def _phrase_counts(docs: DataFrame, max_words: int, min_count: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    shards = index_shards(docs, shard_words=shard_words)
    n = shards.groupBy("lang").agg(F.sum("n_words").alias("n")).where("n > 0")
    n = materialize(n, "phrase-words")
    bitmaps: dict[int, np.ndarray] = {}

    def hashed(level: int) -> DataFrame:
        sent = spark.sparkContext.broadcast(dict(bitmaps))

        def count(batches):
            counts = _Counts(min_count)
            for _, _, index in _each_index(batches):
                for m, p in enumerate(index.levels(level, _filter_of(sent)), 1):
                    if m == level:
                        counts.add(_cells(p.whole, level), p.count)
                if counts.full():
                    yield from counts.blocks()
                    counts = _Counts(min_count)
            yield from counts.blocks()

        return shards.mapInArrow(count, "block bigint, cells binary")

    for level in range(1, max_words + 1):
        bitmaps[level] = _bitmap(hashed(level), min_count)
        # Shuffle files of a level go when the JVM collects its plan.
        spark._jvm.System.gc()
    sent = spark.sparkContext.broadcast(dict(bitmaps))

    buckets = min(MOST_BUCKETS, max(BUCKETS, 1 << (shards.count() // BUCKET_SHARDS).bit_length()))

    def spell(batches):
        spelled = _Spelled()
        for lang, names, index in _each_index(batches):
            for m, p in enumerate(index.levels(max_words, _filter_of(sent)), 1):
                with np.errstate(over="ignore"):
                    # Phrases that begin alike lie together, which compresses well.
                    start = index.hashes[p.words[:, 0]] * _BASE + (index.hashes[p.words[:, 1]] if m > 1 else np.uint64(0))
                bucket = (mix(start) & np.uint64(buckets - 1)).astype(np.int64)
                for at in range(0, len(p), _ROWS):
                    ids = p.words[at : at + _ROWS]
                    phrase = pc.binary_join_element_wise(*(names.take(pa.array(ids[:, i])) for i in range(m)), " ")
                    # One string stands for a phrase: its language, a line end, which no word holds, and its words.
                    key = pc.binary_join_element_wise(pa.scalar(lang), phrase, "\n")
                    spelled.add(pa.array(bucket[at : at + _ROWS]), key.cast(pa.large_string()), pa.array(p.count[at : at + _ROWS]))
            if spelled.full():
                yield from spelled.blocks()
                spelled = _Spelled()
        yield from spelled.blocks()

    def total(batches):
        # Buckets come one after another: one is held at a time.
        spelled, now = _Spelled(), None

        def done():
            rows = spelled.summed()
            rows = rows.filter(pc.field("f") >= min_count).select(["key", "f"])
            return rows.cast(pa.schema([("key", pa.string()), ("f", pa.int64())])).to_batches(_ROWS)

        for batch in batches:
            for k, data, n in zip(batch.column("bucket").to_pylist(), batch.column("phrases"), batch.column("n").to_pylist()):
                if k != now:
                    yield from done()
                    spelled, now = _Spelled(), k
                spelled.read(k, n, data.as_buffer())
        yield from done()

    moved = shards.mapInArrow(spell, "bucket bigint, phrases binary, n bigint").repartition("bucket").sortWithinPartitions("bucket")
    counted = moved.mapInArrow(total, "key string, f bigint")
    counted = counted.select("f", F.substring_index("key", "\n", -1).alias("phrase"), "key").select(
        F.expr("left(key, length(key) - length(phrase) - 1)").alias("lang"), "phrase", F.size(F.split("phrase", " ", -1)).alias("size"), "f"
    )
    counted = materialize(counted, "phrase-counts")
    words = F.split("phrase", " ", -1)
    without = lambda first: F.array_join(F.slice(words, F.lit(first), F.col("size") - 1), " ")
    parts = counted.where("size > 1").select("lang", "f", F.explode(F.array(F.struct(F.lit(True).alias("left"), without(2).alias("phrase")), F.struct(F.lit(False).alias("left"), without(1).alias("phrase")))).alias("part"))
    most = lambda left: F.max(F.when(F.col("part.left") == left, F.col("f")))
    longer = parts.groupBy("lang", F.col("part.phrase").alias("phrase")).agg(most(True).alias("left_f"), most(False).alias("right_f"))
    out = counted.join(longer, ["lang", "phrase"], "left").fillna(0, ["left_f", "right_f"])
    return materialize(out.select("lang", "phrase", "size", "f", "left_f", "right_f"), "phrases"), n


def collocations(
    docs: DataFrame, max_words: int = DEPTH, min_count: int = 30, top: int = 2000, scale: int = 2_000_000, absorbed: tuple[int, int] = (80, 100), shard_words: int = SHARD
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Candidates have 2 to ``max_words`` words and occur a >= ``min_count`` times. A cut has the counts l and r of its parts and
    the score floor(scale * a / (l + r)); the lowest cut counts, of equal ones the first. A candidate that a longer
    one with at least absorbed[0] / absorbed[1] of its count holds is left out; since a longer phrase occurs no more
    often than those it holds, phrases of one word more decide this. Arithmetic is in decimals of 38 places. Ties go to the higher
    count, then to the smaller phrase by its bytes. A language with no such phrase has no rows; a null language is
    UNKNOWN, null and empty texts have no words, repeated rows count each, other columns are ignored.
    """
    with scratch() as made:
        counted, n = phrase_counts(docs, max_words, min_count, shard_words)
        exact = lambda c: F.col(c).cast("decimal(38,0)")
        within = F.greatest("left_f", "right_f").cast("decimal(38,0)") * absorbed[1] >= exact("f") * absorbed[0]
        words = F.split("phrase", " ", -1)
        cuts = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
        part = lambda first, size: F.array_join(F.slice(words, first, size), " ")
        held = counted.where("size > 1").where(~within).select("lang", "phrase", "size", F.col("f").alias("a"), cuts)
        held = held.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
        of = lambda part, count: counted.select("lang", F.col("phrase").alias(part), F.col("f").alias(count))
        held = held.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
        score = F.expr(f"(cast(a as decimal(38,0)) * {scale}) div (cast(l as decimal(38,0)) + r)")
        lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
        scored = held.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
        best = scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).join(n, "lang")
        return kept(made, materialize(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, w[i:i + {m - 1}] AS p FROM pieces, range(1, len(w) - {m - 2}) r(i)" for m in range(1, DEPTH + 1))
OP12_SQL = f"""
WITH texts AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY 1),
f AS (SELECT lang, p, count(*) AS f FROM ({_GRAMS}) GROUP BY 1, 2 HAVING count(*) >= 30),
longer AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, p[2:] AS p, f FROM f WHERE len(p) > 2 UNION ALL SELECT lang, p[:-2] AS p, f FROM f WHERE len(p) > 2) GROUP BY 1, 2),
cand AS (SELECT f.lang, f.p, f.f AS a FROM f LEFT JOIN longer USING (lang, p) WHERE len(f.p) > 1 AND coalesce(100 * longer.f::HUGEINT < 80 * f.f::HUGEINT, TRUE)),
cuts AS (SELECT c.*, k, x.f AS l, y.f AS r, 2000000 * a::HUGEINT // (x.f::HUGEINT + y.f) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM cand) c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
low AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS o FROM cuts) WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low) JOIN n USING (lang) WHERE rank <= 2000
"""

"""A stored inverted index with block-max pruning.

A batch is a segment: its texts, in the order of their length within a partition, are cut into ranges of a few texts,
which are counted where they lie, so that no word is shuffled. A row of the index is a token in a range, with the texts that hold it and the greatest BM25 part that any of them
reaches, before the inverse document frequency, which changes as segments come. Summed up over a query's tokens,
these bounds say what a text of a range can reach. The ranges with the highest bounds are scored first; their k-th best
score shuts out all ranges whose bound is lower, and only what is left is read as well. The result is exact.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataq.operators.retrieval import AVERAGE, B, K1, top_k
from strataq.sources.versions import VersionedTable
from strataq.storage import materialize

SHAPE = "token string, range bigint, segment string, n bigint, most double, texts array<struct<id: bigint, tf: bigint, length: bigint>>"
#: Texts of a range, and ranges that are scored first for each query, by their bounds.
RANGE, FIRST = 32, 8
#: Words whose ranges are counted at a time, and bits of a range's number within its partition.
AT_ONCE, NUMBER_BITS = 1 << 20, 28
#: Up to so many tokens of the queries are pushed down to the files' statistics.
LISTED = 5000


def _part(tf: Column | np.ndarray, length: Column | np.ndarray, k1: float, b: float, average: float):
    """A token's BM25 part before the inverse document frequency; ``tf`` in double precision."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def _counted(scale: tuple[float, float, float]):
    """The index's rows of sorted texts (id, words, length), RANGE of them at a time."""

    def count(batches):
        number, rest = TaskContext.get().partitionId() << NUMBER_BITS, None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            full = rows.num_rows // RANGE * RANGE
            yield from _ranges(rows.slice(0, full), number, scale)
            number, rest = number + full // RANGE, rows.slice(full)
        if rest is not None:
            yield from _ranges(rest, number, scale)

    return count


def _ranges(rows: pa.Table, number: int, scale: tuple[float, float, float]):
    upto = np.cumsum(rows.column("length").to_numpy())
    at = 0
    while at < rows.num_rows:
        to = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right"))
        to = min(max(at + RANGE, to // RANGE * RANGE), rows.num_rows)
        yield from _rows_of(rows.slice(at, to - at).combine_chunks().to_batches()[0], number + at // RANGE, scale)
        at = to


def _rows_of(batch: pa.RecordBatch, number: int, scale: tuple[float, float, float]):
    ids, length = batch.column("id").to_numpy(), batch.column("length").to_numpy()
    row = np.repeat(np.arange(len(ids)), length)
    words = batch.column("words").flatten()
    if words.null_count:
        row, words = row[words.is_valid().to_numpy(zero_copy_only=False)], words.drop_null()
    if not len(row):
        return
    coded = words.dictionary_encode()
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    key = (row // RANGE * len(coded.dictionary) + coded.indices.to_numpy()) * len(ids) + place[row]
    key, tf = np.unique(key, return_counts=True)
    group, text = key // len(ids), by_id[key % len(ids)]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    most = np.maximum.reduceat(_part(tf.astype(np.float64), length[text], *scale), first)
    held = pa.StructArray.from_arrays([pa.array(ids[text]), pa.array(tf), pa.array(length[text])], names=["id", "tf", "length"])
    ends = np.append(first, len(key))
    group = group[first]
    token = coded.dictionary.take(pa.array(group % len(coded.dictionary)))
    texts = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), held)
    yield pa.RecordBatch.from_arrays([token, pa.array(number + group // len(coded.dictionary)), pa.array(np.diff(ends)), pa.array(most), texts], names=["token", "range", "n", "most", "texts"])


class InvertedIndex:
    """Postings of texts (id, words) below ``path``, every file sorted by token; ids are numbers, and new in every batch.

    Appends commit optimistically, so writers at the same time all land, and a search reads one version.
    """

    def __init__(self, spark: SparkSession, path: str, k1: float = K1, b: float = B, average: float = AVERAGE):
        self.spark, self.scale = spark, (k1, b, average)
        self.table = VersionedTable(spark, path, SHAPE)

    def append(self, texts: DataFrame) -> int:
        """Index (id, words), words with repeats; null words count as none. Returns the version."""
        sized = texts.select(F.col("id").cast("long").alias("id"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))
        sized = sized.withColumn("length", F.size("words").cast("long")).sortWithinPartitions("length", "id")
        rows = sized.mapInArrow(_counted(self.scale), SHAPE.replace(", segment string", ""))
        # A row without a token counts the texts of the segment.
        none = F.array().cast("array<struct<id: bigint, tf: bigint, length: bigint>>")
        size = texts.agg(F.count("*").alias("n")).select(F.lit("").alias("token"), F.lit(None).cast("long").alias("range"), "n", F.lit(None).cast("double").alias("most"), none.alias("texts"))
        # A token that many texts hold is dealt out by the partitions that its ranges come from.
        rows = rows.repartition("token", F.shiftright("range", NUMBER_BITS)).sortWithinPartitions("token", "range")
        return self.table.append(rows.unionByName(size).withColumn("segment", F.lit(uuid.uuid4().hex)))

    def search(self, queries: DataFrame, k: int, places: int = 6, version: int | None = None) -> DataFrame:
        """(query, id, score, place): the best ``k`` texts of each of (query, tokens) by BM25 rounded to ``places``, ties by id."""
        first, rest, scored = self._chosen(queries, k, places, version)
        found = scored(first).unionByName(scored(rest)) if rest is not None else scored(first)
        return top_k(found, k)

    def postings_read(self, queries: DataFrame, k: int, version: int | None = None) -> tuple[int, int]:
        """How many postings a search reads for its queries, and how many their tokens have."""
        first, rest, _ = self._chosen(queries, k, 6, version)
        of = lambda ranges: self._asked(ranges).agg(F.sum("n")).first()[0] or 0
        return of(first) + of(rest), of(self._bounds)

    def _asked(self, ranges: DataFrame) -> DataFrame:
        """The rows of the index, without their texts, that (query, segment, range) ask for."""
        return ranges.select("query", "segment", "range").join(self._weighed, ["query", "segment", "range"])

    def _chosen(self, queries: DataFrame, k: int, places: int, version: int | None):
        asked = materialize(queries.select("query", F.explode(F.array_distinct("tokens")).alias("token")), "posting-queries")
        rows = self.table.read(version)
        total = rows.where("token = ''").agg(F.sum("n").alias("total"))
        tokens = [r[0] for r in asked.select("token").distinct().limit(LISTED + 1).collect()]
        rows = rows.where(F.col("token").isin(tokens)) if len(tokens) <= LISTED else rows.join(asked.select("token").distinct(), "token", "left_semi")
        heads = materialize(rows.select("token", "segment", "range", "n", "most"), "posting-heads")
        df = heads.groupBy("token").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(total))
        idf = materialize(df.select("token", F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "posting-idf")
        asked = asked.join(idf, "token")
        self._weighed = heads.join(asked, "token")
        bound = self._weighed.groupBy("query", "segment", "range").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
        self._bounds = bound = materialize(bound, "posting-bounds")

        def scored(ranges: DataFrame) -> DataFrame:
            need = ranges.select("query", "segment", "range").join(asked, "query")
            met = rows.select("token", "segment", "range", "texts").join(need, ["token", "segment", "range"]).select("query", "idf", F.explode("texts").alias("x"))
            part = F.col("idf") * _part(F.col("x.tf").cast("double"), F.col("x.length"), *self.scale)
            return met.groupBy("query", F.col("x.id").alias("id")).agg(F.round(F.sum(part), places).alias("score"))

        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "segment", "range"))
        ranked = bound.withColumn("place", place).where(F.col("place") <= max(FIRST, -(-4 * k // RANGE))).drop("place")
        first = materialize(ranked, "posting-first")
        least = top_k(scored(first), k).where(F.col("place") == k).select("query", F.col("score").alias("least"))
        rest = bound.join(first, ["query", "segment", "range"], "left_anti").join(least, "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-places))
        return first, materialize(rest.drop("least"), "posting-rest"), scored

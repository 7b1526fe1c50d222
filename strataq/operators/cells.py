"""A stored index for approximate vector search: cells, 8-bit codes, and full vectors for the last step.

Vectors of length 1 belong to the cell of the nearest of some points. A number of a vector is written as one of 256
steps between two quantiles of its dimension. Points and quantiles come from a bounded sample of the first
batch and are kept with the index. Codes lie in blocks of one cell, so that a query meets a block as a matrix
product; its best candidates, a few times as many as asked for, are scored again on the full vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions import scoring as S
from strataq.operators.retrieval import top_k
from strataq.sources.versions import VersionedTable
from strataq.storage import materialize

#: Vectors of the sample per cell, vectors of a block, queries that a block meets at a time on average, and rounds of fitting.
SAMPLE, BLOCK, PACK, ROUNDS = 256, 1024, 256, 12
#: The quantiles that codes lie between.
LOW, HIGH = 0.005, 0.995
_MODEL = "points array<array<float>>, low array<float>, high array<float>"
_CODES = "cell int, n int, ids array<bigint>, codes binary"
_FULL = "cell int, id bigint, u array<float>"


def fit_points(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Means of the directions of ``sample``, each moved to those nearest to it for some rounds; the first ``cells`` vectors to begin with."""
    points = sample[:cells].copy()
    for _ in range(rounds):
        nearest = (sample @ points.T).argmax(1)
        for k in range(len(points)):
            mean = sample[nearest == k].sum(0)
            norm = np.linalg.norm(mean)
            if norm > 0:
                points[k] = mean / norm
    return points


def encoded(u: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    step = np.maximum(high - low, 1e-12) / 255
    return np.clip(np.rint((u - low) / step), 0, 255).astype(np.uint8)


def decoded(codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return codes.astype(np.float32) * (np.maximum(high - low, 1e-12) / 255).astype(np.float32) + low


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class VectorIndex:
    """An index of vectors (id, vec) below ``path``; ids are numbers, new in every batch, and vectors of one size.

    Vectors of length 0 and null ones are not found. Full vectors are committed before codes: a batch is found
    when its codes are there.
    """

    def __init__(self, spark: SparkSession, path: str, cells: int = 64):
        self.spark, self.cells = spark, cells
        self.model, self.codes, self.full = (VersionedTable(spark, f"{path}/{name}", shape) for name, shape in (("model", _MODEL), ("codes", _CODES), ("vectors", _FULL)))

    def _fitted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        row = self.model.read().first()
        return row and tuple(np.array(row[c], np.float32) for c in ("points", "low", "high"))

    def _fit(self, units: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The model of the index, from the first batch if it has none; whichever writer's comes first is kept."""
        if not self._fitted():
            rows = units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * self.cells).collect()
            if not rows:
                return None
            sample = np.array([r["u"] for r in rows], np.float32)
            low, high = (np.quantile(sample, q, axis=0).astype(np.float32) for q in (LOW, HIGH))
            made = self.spark.createDataFrame([(fit_points(sample, self.cells).tolist(), low.tolist(), high.tolist())], _MODEL)
            self.model.append(made)
        return self._fitted()

    def append(self, vectors: DataFrame) -> int:
        """Index (id, vec) and return the version of the codes."""
        units = vectors.select(F.col("id").cast("long").alias("id"), S.unit(F.col("vec")).cast("array<float>").alias("u")).where("exists(u, x -> x <> 0) AND id IS NOT NULL")
        units = materialize(units, "cell-units")
        fitted = self._fit(units)
        if fitted is None:
            return self.codes.version()
        sent = self.spark.sparkContext.broadcast(fitted)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            points = sent.value[0]
            for batch in batches:
                cell = (_matrix(batch.column("u"), points.shape[1]) @ points.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("id"), batch.column("u")], names=["cell", "id", "u"])

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            points, low, high = sent.value
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                codes = encoded(_matrix(batch.column("u"), points.shape[1]), low, high)
                cuts = np.flatnonzero(np.diff(cell)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(cell)]):
                    for at in range(a, b, BLOCK):
                        own = slice(at, min(at + BLOCK, b))
                        n = own.stop - at
                        ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column("id").slice(at, n))
                        yield pa.RecordBatch.from_arrays([pa.array([cell[at]]), pa.array([n], pa.int32()), ids, pa.array([codes[own].tobytes()])], names=["cell", "n", "ids", "codes"])

        placed = units.mapInArrow(assign, "cell int, id bigint, u array<float>")
        # Ranges are cut within a cell too, so that a hot one is dealt out.
        placed = materialize(placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "cell-vectors")
        self.full.append(placed)
        return self.codes.append(placed.sortWithinPartitions("cell", "id").mapInArrow(encode, _CODES))

    def search(self, queries: DataFrame, k: int, probes: int, rescored: int = 4) -> DataFrame:
        """(query, id, score, place): of (query, vec), a number and a vector, about the ``k`` nearest, itself left out.

        The ``probes`` nearest cells of a query are read; of their codes ``rescored`` * k candidates are scored on full vectors.
        """
        q = queries.select(F.col("query").cast("long").alias("query"), S.unit(F.col("vec")).cast("array<float>").alias("q")).where("exists(q, x -> x <> 0) AND query IS NOT NULL")
        q = materialize(q, "cell-queries")
        fitted = self._fitted()
        if not fitted:
            return q.select("query", F.col("query").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("place")).limit(0)
        sent = self.spark.sparkContext.broadcast(fitted)
        keep = k * rescored

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            points = sent.value[0]
            n = min(probes, len(points))
            for batch in batches:
                near = np.argsort(-(_matrix(batch.column("q"), points.shape[1]) @ points.T), axis=1, kind="stable")[:, :n]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column("query").take(rows), batch.column("q").take(rows)], names=["cell", "query", "q"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, low, high = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    own = batch.slice(i, 1)
                    u = decoded(np.frombuffer(own.column("codes")[0].as_buffer(), np.uint8).reshape(-1, len(low)), low, high)
                    ids, asked = own.column("ids").flatten().to_numpy(), own.column("pack").flatten()
                    names, vecs = asked.field("query").to_numpy(), _matrix(asked.field("q"), len(low))
                    scores = vecs @ u.T
                    scores[names[:, None] == ids[None, :]] = -np.inf
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
                    row = np.repeat(np.arange(len(names)), best.shape[1])
                    found = scores[row, best.ravel()]
                    real = np.isfinite(found)
                    columns = [names[row][real], ids[best.ravel()][real], found[real].astype(np.float64)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(real.sum()), own.column("cell")[0].as_py(), np.int32)), *map(pa.array, columns)], names=["cell", "query", "id", "score"])

        asked = materialize(q.mapInArrow(probe, "cell int, query bigint, q array<float>"), "cell-probes")
        packs = -(-q.count() // PACK)
        pack = asked.groupBy("cell", F.pmod(F.xxhash64("query"), F.lit(max(packs, 1))).alias("part")).agg(F.collect_list(F.struct("query", "q")).alias("pack"))
        cells = [r[0] for r in asked.select("cell").distinct().collect()]
        blocks = self.codes.read().where(F.col("cell").isin(cells)).join(pack, "cell").select("cell", "ids", "codes", "pack")
        rough = blocks.mapInArrow(score, "cell int, query bigint, id bigint, score double")
        rough = materialize(top_k(rough, keep).select("cell", "query", "id"), "cell-candidates")
        full = self.full.read().where(F.col("cell").isin(cells)).join(rough, ["cell", "id"]).join(q, "query")
        return top_k(full.select("query", "id", S.dot(F.col("u").cast("array<double>"), F.col("q").cast("array<double>")).alias("score")), k)

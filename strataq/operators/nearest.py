"""Cosines of a query set with all vectors, as matrix products of blocks.

Both sides are cut into blocks of bounded size by a hash of their ids. Every block of vectors meets every block of
queries in a task of its own, which gives on at most k rows per query, so the rows that are shuffled after it are
few and no pair of vectors is a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a block of vectors and in one of queries, and queries that are multiplied at once.
BASE_NUMBERS, QUERY_NUMBERS, AT_ONCE = 1 << 19, 1 << 17, 256


def near_pairs(queries: DataFrame, base: DataFrame, k: int | None = None, least: float | None = None, places: int | None = None, same: str | None = None, by: str | None = None) -> DataFrame:
    """(query, id, score) and ``by``: cosines of (query, vec) with (id, vec), an id with itself left out; null for a null vector.

    With ``k`` at least the best ``k`` of every query are there, ties to the smaller id, and of every value of ``by``, a column of
    ``base``, if given; the caller ranks what is left. Scores are rounded to ``places`` before they are compared, with
    one another and with ``least``. With ``same``, a column of both, only rows of equal values meet.
    """
    spark, group = queries.sparkSession, same or by
    key = lambda c: F.col(c) if c else F.lit(0)
    q = queries.where("query IS NOT NULL").select("query", F.col("vec").alias("u"), key(same).alias("key"))
    d = base.where("id IS NOT NULL").select("id", F.col("vec").alias("u"), key(group).alias("key"))
    if same:
        q, d = q.where("key IS NOT NULL"), d.where("key IS NOT NULL")
    types = {name: df.schema[name].dataType.simpleString() for name, df in (("query", q), ("id", d), ("key", d))}
    sized = lambda df: df.agg(F.count("*"), F.min(F.size("u")), F.max(F.size("u"))).first()
    (n_q, q_low, q_high), (n, low, high) = sized(q), sized(d)
    found = {x for x in (q_low, q_high, low, high) if x is not None}
    if len(found) > 1:
        raise ValueError(f"vectors of {min(found)} and of {max(found)} numbers have no cosine")
    dim = max(found, default=0)
    parts = lambda rows, numbers: max(1, -(-rows * max(dim, 1) // numbers))
    n_blocks, n_asked = parts(n, BASE_NUMBERS), parts(n_q, QUERY_NUMBERS)

    def blocks(df: DataFrame, name: str, count: int) -> DataFrame:
        row = F.struct("key", F.col(name).alias("id"), F.col("u").isNotNull().alias("ok"), F.coalesce("u", F.array_repeat(F.lit(0.0), dim)).alias("u"))
        cut = df.groupBy(F.pmod(F.xxhash64(name), F.lit(count)).cast("int").alias(f"{name}_block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
        return cut.select(f"{name}_block", *(F.col(f"rows.{c}").alias(f"{name}_{c}") for c in ("key", "id", "ok")), F.flatten("rows.u").alias(f"{name}_u"))

    asked = blocks(q, "query", n_asked).withColumn("id_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).drop("query_block")
    both = asked.join(blocks(d, "id", n_blocks).hint("shuffle_hash"), "id_block").drop("id_block")

    def match(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = {c: batch.column(c)[i].values for c in batch.schema.names}
                yield from _matched(held, dim, k, least, places, bool(same), bool(group))

    out = both.mapInArrow(match, f"query {types['query']}, id {types['id']}, score double, key {types['key']}")
    return out.select("query", "id", "score", *([F.col("key").alias(by)] if by else []))


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    return np.copysign(np.floor(np.abs(x) * 10.0**places + 0.5) / 10.0**places, x)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows as they are."""
    length = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x / np.where(length > 0, length, 1.0)


def _matched(held: dict[str, pa.Array], dim: int, k: int | None, least: float | None, places: int | None, same: bool, grouped: bool):
    """The rows of a block of queries and a block of vectors, both in order of keys and ids. Among scores,
    infinity stands for NaN, which is the greatest, minus infinity for null, and NaN for what does not count."""
    flat = lambda c: held[c].to_numpy(zero_copy_only=False)
    q, d = (unit(flat(c).reshape(-1, dim)) for c in ("query_u", "id_u"))
    q_ids, ids, q_ok, ok = flat("query_id"), flat("id_id"), flat("query_ok"), flat("id_ok")
    keys = held["id_key"].to_pylist() if grouped else [0] * len(ids)
    starts = [0, *(x for x in range(1, len(keys)) if keys[x] != keys[x - 1]), len(keys)]
    q_keys = np.array(held["query_key"].to_pylist(), dtype=object) if same else None
    slack = 10.0**-places if places is not None else 0.0
    for x, y in zip(starts, starts[1:]):
        mine = np.flatnonzero(q_keys == keys[x]) if same else np.arange(len(q_ids))
        for at in range(0, len(mine), AT_ONCE):
            rows = mine[at : at + AT_ONCE]
            score = q[rows] @ d[x:y].T
            score[np.isnan(score)] = np.inf
            score[~q_ok[rows]] = -np.inf
            score[:, ~ok[x:y]] = -np.inf
            low, high = np.searchsorted(ids[x:y], q_ids[rows], "left"), np.searchsorted(ids[x:y], q_ids[rows], "right")
            for j in np.flatnonzero(high > low):
                score[j, low[j] : high[j]] = np.nan
            bound = np.full(len(rows), -np.inf)
            if k is not None and y - x > k:
                kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                bound = np.where(np.isnan(kth), -np.inf, kth - slack)
            if least is not None:
                bound = np.maximum(bound, least - slack)
            a, c = np.nonzero(score >= bound[:, None])
            v = score[a, c] if places is None else rounded(score[a, c], places)
            if least is not None:
                a, c, v = (z[v >= least] for z in (a, c, v))
            if k is not None:
                order = np.lexsort((c, -v, a))
                a, c, v = a[order], c[order], v[order]
                some = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
                a, c, v = a[some], c[some], v[some]
            if len(a):
                values = pa.array(np.where(v == np.inf, np.nan, v), mask=v == -np.inf)
                yield pa.RecordBatch.from_arrays([held["query_id"].take(pa.array(rows[a])), held["id_id"].take(pa.array(x + c)), values, held["id_key"].take(pa.array(x + c))], names=["query", "id", "score", "key"])

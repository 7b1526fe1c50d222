"""N-gram Jaccard join: links between documents whose word-shingle sets are similar enough, and their components.

Multiple-global-order filtering. A set's tokens are sorted under several global orders; two sets of
n and m tokens whose overlap reaches the required a share a token among the first n - a + 1 of the one
and m - a + 1 of the other, under every order. All orders start with rare tokens, by a fixed-size
sketch of how often tokens occur in all documents, and break ties by different hashes. Candidates
meet on tokens of the first order, at places that the pair's own prefix lengths allow. Before any text
moves to a candidate, prefixes under the other orders and parity bitmaps of the sets do, some fourth of
a text's bytes: the pair has to meet under every order, and bits that differ bound the overlap from
above. What is left is verified on whole sets. Texts of any length are shingled whole, a piece at a time.

Equal sets are one class. Members of a token's bucket are first paired with one pivot each, which
joins most of a large group; then only pairs of different components meet, members of a bucket's
largest component with the others, so that a group of copies is never expanded into all its pairs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import shingles as S
from strataq.llm.textstats import packed, unpacked
from strataq.operators.components import connected_components
from strataq.storage import kept, materialize, read_table, scratch

#: The sketch has 2**BITS counters in 2**BLOCK_BITS blocks: 4 MB when broadcast, whatever the input.
BITS, BLOCK_BITS = 22, 4
#: Texts that no candidate pair needs are left out by a bitmap of 2**FILTER_BITS bits, 8 MB when broadcast, before the rest is shuffled.
FILTER_BITS = 26
#: Groups of tasks whose counts are summed up together first.
PARTS = 16
_SHIFT = np.uint64(64 - BITS)
_PER_BLOCK = 1 << (BITS - BLOCK_BITS)
ROWS = 1000


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, S.shingle_sets(*S.texts_of(part.column("_text")), width)


def token_sketch(text: DataFrame, width: int) -> np.ndarray:
    """How often tokens occur in all documents, by cell of their hash, on a scale of eighths of log2, in 2**BITS bytes."""

    def count(batches):
        cells = np.zeros(1 << BITS, np.int64)
        for _, sets in _sets(batches, width):
            tokens = np.concatenate([s for s in sets if len(s)] or [np.zeros(0, np.uint64)])
            cells += np.bincount((tokens >> _SHIFT).astype(np.int64), minlength=1 << BITS)
        for k in range(1 << BLOCK_BITS):
            block = np.minimum(cells[k * _PER_BLOCK : (k + 1) * _PER_BLOCK], 2**32 - 1).astype(np.uint32)
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(block.tobytes(), 1)])], names=["block", "cells"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column("block").to_pylist(), batch.column("cells")):
                own = np.frombuffer(zlib.decompress(cells.as_py()), np.uint32)
                sums[k] = sums[k] + own if k in sums else own.astype(np.int64)
        return {k: np.minimum(v, 2**32 - 1).astype(np.uint32) for k, v in sums.items()}

    def add(batches):
        for k, cells in total(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(cells.tobytes(), 1)])], names=["block", "cells"])

    def scale(batches):
        for k, cells in total(batches).items():
            scaled = np.minimum(np.round(8 * np.log2(1 + cells.astype(np.int64))), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([scaled.tobytes()])], names=["block", "cells"])

    # Summed up in two steps: no task gets the counts of all tasks.
    shape = "block bigint, cells binary"
    counted = text.select("_text").mapInArrow(count, shape).withColumn("part", F.spark_partition_id() % PARTS)
    some = counted.repartition(PARTS << BLOCK_BITS, "block", "part").select("block", "cells").mapInArrow(add, shape)
    out = np.zeros(1 << BITS, np.uint8)
    for r in some.repartition(1 << BLOCK_BITS, "block").mapInArrow(scale, shape).collect():
        out[r[0] * _PER_BLOCK : (r[0] + 1) * _PER_BLOCK] = np.frombuffer(r[1], np.uint8)
    return out


def prefixes(sets: list[np.ndarray], sketch: np.ndarray, threshold: tuple[int, int], orders: range) -> list[list[np.ndarray]]:
    """Per set its first n - ceil(t * n) + 1 tokens under each of ``orders``."""
    out = []
    for s in sets:
        n = len(s)
        p = n + threshold[0] * n // -threshold[1] + 1 if n else 0
        common = sketch[(s >> _SHIFT).astype(np.int64)]
        out.append([s[np.lexsort((S.mix(s ^ np.uint64(k + 1)), common))[:p]] for k in orders])
    return out


def parity(s: np.ndarray) -> np.ndarray:
    """A bit per cell of a set's tokens, set where their number is odd: bytes, as many as tokens or up to twice that."""
    bits = 8 << max(3, (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def most_common(x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
    """What the overlap of sets of n and m tokens with these parities can be at most: every bit that differs is a token of one of them."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (n + m - int(np.bitwise_count(x ^ y).sum())) // 2


def _index(text: DataFrame, width: int, threshold: tuple[int, int], sketch, orders: int) -> DataFrame:
    """doc_id, n, set digest, the first order's prefix, those of the others, a token in 32 bits, and the parity."""

    def run(batches):
        counts = np.frombuffer(sketch.value, np.uint8)
        for part, sets in _sets(batches, width):
            pre = prefixes(sets, counts, threshold, range(orders))
            arrays = [
                part.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([p[0].view(np.int64) for p in pre], pa.list_(pa.int64())),
                pa.array([np.concatenate([np.zeros(0, np.uint64), *p[1:]]).astype(np.uint32).view(np.int32) for p in pre], pa.list_(pa.int32())),
                pa.array([parity(s).tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "digest", "tokens", "others", "parity"])

    return text.mapInArrow(run, "doc_id bigint, n bigint, digest binary, tokens array<bigint>, others array<int>, parity binary")


def _required(n: str, m: str, threshold: tuple[int, int]) -> Column:
    """The least overlap of similar sets of sizes n and m: t / (1 + t) * (n + m), rounded up."""
    a, b = threshold
    return F.expr(f"({a} * ({n} + {m}) + {a + b - 1}) div {a + b}")


def _meets(x: str, y: str, threshold: tuple[int, int]) -> Column:
    """Whether a token stands within both prefixes that this pair needs."""
    need = _required(f"{x}_n", f"{y}_n", threshold)
    return (F.col(f"{x}_at") <= F.col(f"{x}_n") - need) & (F.col(f"{y}_at") <= F.col(f"{y}_n") - need) & (need <= F.least(f"{x}_n", f"{y}_n"))


def _thinned(text: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``text`` whose doc_id may be in ``wanted``, by a bitmap of hashed ids."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    slots = wanted.select(place(F.col("doc_id")).alias("slot"))
    maps = slots.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    at = F.bitmap_bit_position(place(F.col("doc_id")))
    byte = F.conv(F.hex(F.substr(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = text.join(F.broadcast(maps), F.bitmap_bucket_number(place(F.col("doc_id"))) == F.col("_bucket"))
    return found.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0).select(*text.columns)


def _may_link(x: tuple, y: tuple, threshold: tuple[int, int], orders: int) -> bool:
    """Whether two sets, each as (n, prefixes of the other orders, parity), meet under every other order and can overlap as much as they have to."""
    (n, p, u), (m, q, v) = x, y
    a, b = threshold
    need = -(a * (n + m) // -(a + b))
    if most_common(u, v, n, m) < need:
        return False
    # Tokens cut to 32 bits can only seem to meet.
    each = zip(np.split(p, orders - 1), np.split(q, orders - 1)) if orders > 1 else ()
    return all(len(np.intersect1d(s[: max(n - need + 1, 0)], t[: max(m - need + 1, 0)])) for s, t in each)


def filtered(pairs: DataFrame, index: DataFrame, threshold: tuple[int, int], orders: int) -> DataFrame:
    """The pairs (x, y) that may link by what ``index`` has on both."""
    near = _thinned(index.select("doc_id", "n", "others", "parity"), pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")))
    own = ("n", "others", "parity")
    side = lambda k: near.select(F.col("doc_id").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in own))

    def sets(part: pa.RecordBatch, k: str) -> Iterator[tuple]:
        n, others, bits = (part.column(f"{k}_{c}") for c in own)
        flat, ends = others.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(others).to_pylist()])
        return ((m, flat[a:b], np.frombuffer(u.as_buffer(), np.uint8)) for m, a, b, u in zip(n.to_pylist(), ends, ends[1:], bits))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                keep = pa.array([_may_link(x, y, threshold, orders) for x, y in zip(sets(part, "x"), sets(part, "y"))], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(k).filter(keep) for k in "xy"], names=["x", "y"])

    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", *(f"{k}_{c}" for k in "xy" for c in own))
    return both.mapInArrow(run, "x bigint, y bigint")


def _similar(x: list[np.ndarray], y: list[np.ndarray], threshold: tuple[int, int]) -> list[bool]:
    """For each pair of sets whether they are similar."""
    a, b = threshold
    common = [len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y)]
    return [b * c >= a * (len(s) + len(t) - c) for c, s, t in zip(common, x, y)]


def _verified(pairs: DataFrame, index: DataFrame, text: DataFrame, width: int, threshold: tuple[int, int], orders: int) -> DataFrame:
    """The pairs (x, y) that pass the filters and whose whole sets are similar.

    Texts travel to the pairs that are left, which takes less than half of what their sets would.
    """
    pairs = materialize(pairs.distinct(), "ngram-candidates")
    pairs = materialize(filtered(pairs, index, threshold, orders).distinct(), "ngram-filtered")
    near = _thinned(text, pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")))
    side = lambda k: near.select(F.col("doc_id").alias(k), F.col("_text").alias(f"{k}_text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [S.shingle_sets(*S.texts_of(part.column(f"{k}_text")), width) for k in "xy"]
                found = pa.array(_similar(*sets, threshold))
                yield pa.RecordBatch.from_arrays([part.column(k).filter(found) for k in "xy"], names=["x", "y"])

    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "x_text", "y_text")
    return materialize(both.mapInArrow(run, "x bigint, y bigint"), "ngram-links")


def ngram_components(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (4, 5), orders: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Documents link when their overlap is at least t times their union, ``threshold`` being t as a
    fraction; the component is the smallest doc_id that links reach. Words end at x20 and x09 to x0D,
    A to Z count as lower case, a text of fewer words than ``width`` is one shingle. A null text or
    one without words has an empty set and its own component. Rows that repeat a doc_id are one
    document and link by any of their texts; rows with a null doc_id link with nothing and have a
    null component. Other columns are ignored; an empty table gives no rows.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    with scratch() as made:
        # The sketch has a fixed size: the bound for this broadcast.
        sketch = docs.sparkSession.sparkContext.broadcast(token_sketch(text, width).tobytes())
        index = kept(made, materialize(_index(text, width, threshold, sketch, orders), "ngram-index"))
        of_class = index.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest")
        classes = materialize(of_class.agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "ngram-classes")

        tokens = classes.select("rep", "n", F.posexplode("tokens").alias("at", "token"))
        # The pivot has the token earliest: it has the fewest rare tokens of its own, as the text that others were made from.
        first = F.min(F.struct("at", "rep", "n")).alias("p")
        pivots = materialize(tokens.groupBy("token").agg(F.count("*").alias("size"), first).where("size > 1").select("token", "p"), "ngram-pivots")
        shared = tokens.join(pivots, "token").select("token", F.col("rep").alias("x"), F.col("n").alias("x_n"), F.col("at").alias("x_at"), F.col("p.rep").alias("y"), F.col("p.n").alias("y_n"), F.col("p.at").alias("y_at"))
        shared = materialize(shared, "ngram-shared")
        near = shared.where("x <> y").where(_meets("x", "y", threshold)).select("x", "y")
        star = _verified(near, index, text, width, threshold, orders)

        joined = connected_components(star, "x", "y").select(F.col("node").alias("x"), "component")
        rows = materialize(shared.select("token", "x", "x_n", "x_at").join(joined, "x", "left").withColumn("c", F.coalesce("component", "x")).drop("component"), "ngram-rows")
        largest = rows.groupBy("token", "c").count().groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("count", "c"))["c"].alias("top"))
        rows = materialize(rows.join(largest.where("parts > 1").select("token", "top"), "token"), "ngram-open")
        other = rows.select("token", F.col("x").alias("y"), F.col("x_n").alias("y_n"), F.col("x_at").alias("y_at"), F.col("c").alias("y_c"))
        apart = (F.col("c") != F.col("y_c")) & ((F.col("y_c") == F.col("top")) | (F.col("c") < F.col("y_c")))
        cross = rows.where("c <> top").join(other, "token").where(apart & _meets("x", "y", threshold))
        cross = cross.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        rest = _verified(cross, index, text, width, threshold, orders)

        found = connected_components(star.union(rest), "x", "y").select(F.col("node").alias("rep"), "component")
        ids = classes.select("digest", "rep").join(found, "rep", "left").select(F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("c"))
        ids = kept(made, materialize(ids, "ngram-ids"))
    known = F.col("doc_id").isNotNull()
    return index.join(ids, (F.col("digest") == F.col("_digest")) & known & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("c", "doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the smallest doc_id of their component, or none."""
    with scratch() as made:
        gone = ngram_components(docs, width, threshold).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone"))
        gone = kept(made, materialize(gone, "ngram-gone"))
    rows = docs.select(packed(docs), F.col("doc_id").cast("long").alias("_id"))
    return unpacked(rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read_table(spark, sf_dir, "documents"), 4, (85, 100))


OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

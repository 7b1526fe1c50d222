"""Fingerprints of documents by consistent weighted sampling.

A text's terms are its words, each with the word before it, weighted by how often they occur. For each of SAMPLES
places a term has draws r and c from Gamma(2, 1) and b from the uniform distribution, all from a keyed hash; with
weight S its step is t = floor(ln S / r + b), and the term with the least c / exp(r (t - b + 1)) is sampled, with its step. Two texts sample the same at a place with a chance of
the sum of the lesser over the sum of the greater weights, their generalised Jaccard similarity (Ioffe, 2010).

A document is compared with the next one by id, and with its text edited by the head of the next. Ids are
cut into ranges, the first row of a range is sent to the range before it as well, and each range is sorted: texts
are shuffled once, and no task holds more than some texts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm.shingles import mix, ragged, texts_of, words
from strataq.llm.textstats import unpacked
from strataq.storage import read_table

SAMPLES = 64
#: A longer word counts as pieces of so many bytes, so that a text without blanks has more than one term.
LONG_WORD = 32
#: Documents and bytes that are sampled at a time; terms of one longer text are taken in blocks.
CHUNK, CHUNK_BYTES, BLOCK = 64, 1 << 19, 512
#: Ranges a task gets on average, so that their number evens out.
RANGES = 4
_U = np.uint64
_KEYS = mix(np.arange(1, SAMPLES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def gamma_quantiles(u: np.ndarray) -> np.ndarray:
    """Where the distribution function of Gamma(2, 1), 1 - (1 + x) exp(-x), is u, by Newton's method from sqrt(2u) on."""
    x = np.where(u < 0.5, np.sqrt(2 * u), -np.log1p(-u) + 1)
    for _ in range(60):
        x -= (-np.expm1(-x) - x * np.exp(-x) - u) / (x * np.exp(-x))
    return x


#: Draws by 16 bits of the hash; the lowest 65536th of c, which long texts sample from, by 16 further bits.
_GRID = (np.arange(65536) + 0.5) / 65536
_R = gamma_quantiles(_GRID).astype(np.float32)
_PER_R = (1 / gamma_quantiles(_GRID)).astype(np.float32)
_LN_C = np.log(gamma_quantiles(_GRID)).astype(np.float32)
_LN_C_LOW = np.log(np.sqrt(2 * _GRID / 65536) * (1 + np.sqrt(2 * _GRID / 65536) / 3)).astype(np.float32)


def sample_keys(terms: np.ndarray, ln_weights: np.ndarray) -> np.ndarray:
    """Per term and place a number whose upper half orders like c / exp(r (t - b + 1)) and whose lower half stands for the term and its step."""
    z = mix(terms[:, None] ^ _KEYS[None, :])
    bits = z.view(np.uint16).reshape(*z.shape, 4)
    r, high = bits[..., 0].astype(np.intp), bits[..., 2].astype(np.intp)
    ln_a = _LN_C.take(high)
    low = np.flatnonzero(high.ravel() == 0)
    ln_a.ravel()[low] = _LN_C_LOW[bits[..., 3].ravel()[low]]
    back = bits[..., 1].astype(np.float32) * np.float32(2**-16) + np.float32(2**-17)
    name = np.repeat((terms & _U(0xFFFFFFFF)).astype(np.uint32)[:, None], SAMPLES, axis=1)
    # With weight 1 the step is 0.
    other = np.flatnonzero(ln_weights)
    if len(other):
        step = np.floor(ln_weights[other, None] * _PER_R.take(r[other]) + back[other])
        back[other] -= step
        name[other] += step.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
    ln_a += _R.take(r) * (back - np.float32(1))
    key = np.empty((*z.shape, 2), np.uint32)
    key[..., 0] = name
    key[..., 1] = ln_a.view(np.uint32) ^ ((ln_a.view(np.int32) >> 31).view(np.uint32) | np.uint32(0x80000000))
    return key.view("<u8")[..., 0]


def _long_word_cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places at which words of more than LONG_WORD bytes are cut."""
    blanks = np.flatnonzero(_BLANK[data])
    edges = np.sort(np.concatenate([blanks, blanks + 1, bounds]))
    size = np.diff(edges)
    long = np.flatnonzero(size > LONG_WORD)
    cuts = (size[long] - 1) // LONG_WORD
    return ragged(np.ones(len(long), np.int64), cuts) * LONG_WORD + np.repeat(edges[long], cuts)


def terms_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of texts with the word before it, or with none, and the text of each."""
    fine = np.sort(np.concatenate([bounds, _long_word_cuts(data, bounds)]))
    hashed, per_piece = words(data, fine)
    text = np.repeat(np.searchsorted(bounds, fine[:-1], side="right") - 1, per_piece)
    before = np.zeros(len(hashed), _U)
    before[1:] = np.where(text[1:] == text[:-1], hashed[:-1], _U(0))
    return mix(before * _U(0xD1342543DE82EF95) + hashed), text


def _sampled(terms: np.ndarray, ln_weights: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The least key per group and place; ``group`` is sorted. A group without terms has the greatest number."""
    out = np.full((groups, SAMPLES), ~_U(0))
    for at in range(0, len(terms), BLOCK):
        own = group[at : at + BLOCK]
        keys = sample_keys(terms[at : at + BLOCK], ln_weights[at : at + BLOCK])
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[first]] = np.minimum(out[own[first]], np.minimum.reduceat(keys, first, axis=0))
    return out


def signatures(texts: list[str], others: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """16 bits per place of each text and of its other version, and whether either has terms. At most CHUNK texts; what
    both versions hold with equal weight is drawn once."""
    n = len(texts)
    keys = []
    for side, version in enumerate([texts, others or []]):
        term, text = terms_of(*texts_of(pa.array(version, pa.large_string()))) if version else (np.zeros(0, _U), np.zeros(0, np.int64))
        # The text in the upper 6 bits, then 57 of the term, then the version.
        keys.append(text.astype(_U) << _U(58) | (term >> _U(7)) << _U(1) | _U(side))
    key = np.sort(np.concatenate(keys))
    term = key >> _U(1)
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    total = np.diff(np.append(first, len(term)))
    counts = np.zeros((2, len(first)), np.int64)
    if len(first):
        counts[1] = np.add.reduceat((key & _U(1)).astype(np.int64), first)
        counts[0] = total - counts[1]
    term = term[first]
    same = counts[0] == counts[1]
    parts = [(0, ~same & (counts[0] > 0), 0), (1, same, 0), (2, ~same & (counts[1] > 0), 1)]
    group = np.concatenate([(term[m] >> _U(57)).astype(np.int64) * 3 + kind for kind, m, _ in parts])
    weight = np.concatenate([counts[side][m] for _, m, side in parts])
    named = mix(np.concatenate([term[m] for _, m, _ in parts]) & _U((1 << 57) - 1))
    order = np.argsort(group, kind="stable")
    least = _sampled(named[order], np.log(weight[order]).astype(np.float32), group[order], 3 * n).reshape(n, 3, SAMPLES)
    own, other = np.minimum(least[:, 0], least[:, 1]), np.minimum(least[:, 1], least[:, 2])
    fold = lambda x: ((x ^ x >> _U(16)) & _U(0xFFFF)).astype(np.uint16)
    return fold(own), fold(other), own[:, 0] != ~_U(0), other[:, 0] != ~_U(0)


def likeness(a: np.ndarray, b: np.ndarray, a_any: np.ndarray, b_any: np.ndarray) -> np.ndarray:
    """The share of equal places; 1 for two texts without terms, 0 where one has none."""
    return np.where(a_any & b_any, (a == b).mean(axis=-1), (a_any == b_any).astype(float))


def same_places(a: Column, b: Column) -> Column:
    """``likeness`` of two fingerprints as strings."""
    at = F.sequence(F.lit(0), F.lit(SAMPLES - 1))
    equal = F.aggregate(at, F.lit(0), lambda n, i: n + (F.substr(a, 4 * i + 1, F.lit(4)) == F.substr(b, 4 * i + 1, F.lit(4))).cast("int"))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(equal / SAMPLES)


def _spelled(signature: np.ndarray, any_: np.ndarray) -> list[str]:
    return [s.astype(">u2").tobytes().hex() if k else "" for s, k in zip(signature, any_)]


def fingerprint_documents(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and the fingerprint of every row of ``docs`` (text): 4 hex digits a place.

    A null text is empty. A text without words has the fingerprint ''; texts of any length are read whole.
    A kept column named fingerprint gives way. Empty tables give no rows.
    """
    text = docs.select(F.struct(*keep).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))

    def run(batches):
        for batch in batches:
            for at, n in _cut(batch.column("_text").to_pylist()):
                part = batch.slice(at, n)
                own, _, any_, _ = signatures(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(_spelled(own, any_))], names=["_row", "fingerprint"])

    return unpacked(text.mapInArrow(run, f"_row {text.schema['_row'].dataType.simpleString()}, fingerprint string"), "fingerprint", names=("fingerprint",))


def _cut(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of at most CHUNK texts with about CHUNK_BYTES characters, or one longer text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and (i - at == CHUNK or size + len(t) > CHUNK_BYTES):
            yield at, i - at
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts) - at


def _range_of(key: Column, firsts: list[int]) -> Column:
    """In which range ``key`` is, counted from 0, of those that begin with ``firsts``: looked up in two steps of about the root of their number."""
    step = max(1, round(len(firsts) ** 0.5))
    blocks = [firsts[i : i + step] for i in range(0, len(firsts), step)]
    upto = lambda values: F.size(F.filter(values, lambda x: x <= key)) - 1
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    block = upto(longs([b[0] for b in blocks]))
    return block * step + upto(F.element_at(F.array(*map(longs, blocks)), block + 1))


def edited_fingerprints(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs`` (doc_id, text).

    The edited text has its last quarter of characters, rounded down, replaced by the first as many of
    the next document's, in the order of doc_id, then of text; after the last comes the first. A null
    doc_id is before all others, a null text is empty, and a single document follows itself. Texts without words are
    like one another (1.0) and like no other (0.0). Texts are read whole; a kept column named like a result gives
    way to it. Empty tables give no rows. Rows of one doc_id are in one task, which reads them one chunk at a time.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    ids = docs.select(key.alias("_id")).repartitionByRange(RANGES * parts, "_id")
    firsts = sorted(r[0] for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("_id")).select("min(_id)").distinct().collect()) or [0]
    rows = docs.select(F.struct(*keep).alias("_row"), key.alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).withColumn("_range", _range_of(F.col("_id"), firsts))
    begins = F.element_at(F.array(*(F.lit(x).cast("long") for x in firsts)), F.col("_range") + 1) == F.col("_id")
    before = F.struct(F.pmod(F.col("_range") - 1, F.lit(len(firsts))).alias("_range"), F.lit(True).alias("_next"))
    own = F.struct(F.col("_range"), F.lit(False).alias("_next"))
    placed = rows.withColumn("_place", F.explode(F.when(begins, F.array(own, before)).otherwise(F.array(own))))
    placed = placed.select("_row", "_id", "_text", "_place._range", "_place._next").repartition(parts, "_range").sortWithinPartitions("_range", "_next", "_id", "_text")
    placed = placed.select("_row", "_text", "_range", "_next")

    def chunks(batches) -> Iterator[tuple[int, bool, pa.Array, list[str]]]:
        for batch in batches:
            at_range, is_next = batch.column("_range").to_pylist(), batch.column("_next").to_pylist()
            begin = 0
            for i in range(1, batch.num_rows + 1):
                if i == batch.num_rows or at_range[i] != at_range[begin] or is_next[i] != is_next[begin]:
                    own = batch.slice(begin, i - begin)
                    texts = own.column("_text").to_pylist()
                    for at, n in _cut(texts):
                        yield at_range[begin], is_next[begin], own.column("_row").slice(at, n), texts[at : at + n]
                    begin = i

    def with_next(batches) -> Iterator[tuple[pa.Array, list[str], str, bool]]:
        """Chunks with the text after their last one, and whether that is of another range."""
        last = None
        for at_range, is_next, row, texts in chunks(batches):
            if last and last[0] == at_range:
                yield *last[1:], texts[0], is_next
            last = None if is_next else (at_range, row, texts)

    def run(batches):
        held = None

        def record(row, texts, edited, signed, near_next):
            own, other, any_, other_any = signed
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(_spelled(own, any_)), pa.array(_spelled(other, other_any))]
            return pa.RecordBatch.from_arrays([row, *columns, pa.array(likeness(own, other, any_, other_any)), pa.array(near_next)], names=["_row", *names])

        def near(signed, after):
            own, any_ = np.concatenate([signed[0], after[0][:1]]), np.concatenate([signed[2], after[2][:1]])
            return likeness(own[:-1], own[1:], any_[:-1], any_[1:])

        for row, texts, following, is_last in with_next(batches):
            edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for t, after in zip(texts, [*texts[1:], following])]
            signed = signatures(texts, edited)
            if held:
                yield record(*held, near(held[-1], signed))
            held = row, texts, edited, signed
            if is_last:
                yield record(*held, near(signed, signatures([following])))
                held = None

    names = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    shape = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return unpacked(placed.mapInArrow(run, f"_row {placed.schema['_row'].dataType.simpleString()}, {shape}"), *names, names=names)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"), [F.col("doc_id").cast("long").alias("doc_id")])

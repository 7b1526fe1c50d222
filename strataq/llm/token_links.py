"""Links between the tokens of two tokenizers over the same text, with corpus-wide counts of the linked ids.

Both tokenizations of a text are incidence matrices of tokens and bytes in CSR form, built by hand; texts of a batch
stand side by side as blocks. Gustavson's row products A times B transposed give each pair of tokens that overlap, and by
how many bytes. Offsets at which tokens of both end cut the text into groups, whose incidence
matrices multiply to the links of tokens in a shared group.

Links of a document are written as its distinct id pairs with how often each occurs; texts are tokenized once. Pairs
are counted over documents with sums in the tasks first. Pairs that hold more than 1 / HOT of all rows, fewer than HOT,
are broadcast to the documents' pairs; the others, none of which is hot, are joined by the pair.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm.shingles import ragged
from strataq.llm.textstats import unpacked
from strataq.storage import materialize, read_table

TOKENIZER_A = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER_B = public_tokenizers.path("piece_bpe_32k.model")
#: Fewer than HOT pairs are broadcast, 16 bytes each before hashing.
HOT = 1 << 20
#: Characters of the texts that are tokenized and multiplied at a time, or one longer text.
BATCH_CHARS = 1 << 19


@dataclass
class Csr:
    """A sparse matrix by rows: row i has the columns ``columns[starts[i]:starts[i + 1]]``, all with the value 1 unless ``values`` are given."""

    starts: np.ndarray
    columns: np.ndarray
    n_columns: int
    values: np.ndarray | None = None

    @property
    def n_rows(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(self.n_rows), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.n_columns))])
        return Csr(starts, self.rows()[order], self.n_rows, None if self.values is None else self.values[order])

    def times(self, other: Csr) -> Csr:
        """Row i of the product is the sum of the rows of ``other`` that row i names: all of them are laid end to end, and equal columns of a row are summed up."""
        size = np.diff(other.starts)[self.columns]
        places = ragged(other.starts[self.columns], size)
        one = lambda x: np.ones(len(x.columns), np.int64) if x.values is None else x.values
        values = np.repeat(one(self), size) * one(other)[places]
        key = np.repeat(self.rows(), size) * other.n_columns + other.columns[places]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        rows, columns = key[first] // max(other.n_columns, 1), key[first] % max(other.n_columns, 1)
        starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=self.n_rows))])
        return Csr(starts, columns, other.n_columns, np.add.reduceat(values, first) if len(first) else values)


def token_bytes(sizes: np.ndarray) -> Csr:
    """Incidence of tokens, which cover a text one after another with these sizes, and its bytes."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]), np.arange(total), total)


def group_tokens(sizes: np.ndarray, ends: np.ndarray) -> Csr:
    """Incidence of tokens and the groups that end at ``ends``."""
    group = np.searchsorted(ends, np.cumsum(sizes), side="left")
    return Csr(np.arange(len(sizes) + 1), group, len(ends))


def common_ends(a_sizes: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Byte offsets at which a token of either tokenization ends."""
    return np.intersect1d(np.cumsum(a_sizes), np.cumsum(b_sizes), assume_unique=True)


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_ranks(file: bytes) -> dict[bytes, int]:
    """The bytes of each id of a byte-level BPE file, special tokens left out. Its merges have to stand in the order of the ids
    that they make, so that ids are ranks, and its words have to be cut by the usual pattern."""
    read = json.loads(file)
    vocabulary, merges = read["model"]["vocab"], read["model"]["merges"]
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    before = read["pre_tokenizer"]
    if made != sorted(made) or read["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
        raise ValueError("not a byte-level BPE file whose merges are in the order of their ids")
    byte, special = byte_characters(), {t["content"] for t in read["added_tokens"]}
    return {bytes(byte[c] for c in token): k for token, k in vocabulary.items() if token not in special}


class Tokenizers:
    """Both tokenizers and the bytes of each of their ids. A's file is run by the faster of two libraries that give equal ids."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken

        ranks = byte_ranks(a)
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.a_bytes[k] = token
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in y]) for y in (self.a_bytes, self.b_bytes))
        # How a token is spelled in its group, and as the last of its kind there.
        ends = (("a", len(self.a_bytes), ","), ("a", len(self.a_bytes), "|"), ("b", len(self.b_bytes), ","), ("b", len(self.b_bytes), ";"))
        self.spelled = np.array([f"{k}{end}" for _, n, end in ends for k in range(n)], object)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of each text by A, which is given a space before it, and by B, which puts one there; None where the text is empty or either does not spell it."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            a, want = self.a.encode_ordinary(f" {text}"), f" {text}".encode()
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want
            out.append((a, b) if same else None)
        return out


_loaded: dict[str, Tokenizers] = {}


def _load(files: tuple[bytes, bytes]) -> Tokenizers:
    """A worker process builds the tables of a pair of files once."""
    key = hashlib.sha256(b"\0".join(files)).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizers(*files)
    return _loaded[key]


class Aligned:
    """Texts of a batch one after another: their ids, and the groups and links of all of them."""

    def __init__(self, tokens: Tokenizers, encoded: list[tuple[list[int], list[int]] | None]):
        pairs = [e or ([], []) for e in encoded]
        self.tokens = tokens
        self.a, self.b = (np.array([x for p in pairs for x in p[k]], np.int64) for k in (0, 1))
        self.a_at, self.b_at = (np.concatenate([[0], np.cumsum([len(p[k]) for p in pairs])]).astype(np.int64) for k in (0, 1))
        self.sizes = tokens.a_size[self.a], tokens.b_size[self.b]
        self.ends = common_ends(*self.sizes)
        links = token_bytes(self.sizes[0]).times(token_bytes(self.sizes[1]).transposed())
        self.link_a, self.link_b, self.overlap = links.rows(), links.columns, links.values
        self.groups = tuple(group_tokens(s, self.ends) for s in self.sizes)

    def text_of(self, a_places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.a_at, a_places, side="right") - 1

    def shared_group_links(self) -> Csr:
        """A row per token of A with the tokens of B in its group; a group of n and m tokens has n times m links."""
        return self.groups[0].times(self.groups[1].transposed())

    def spelled_groups(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text its groups as text, their number, and the number of their shared-group links."""
        in_a, in_b = (g.columns for g in self.groups)
        last_a, last_b = (np.append(g[1:] != g[:-1], [True] * (len(g) > 0)) for g in (in_a, in_b))
        before = np.cumsum([0, len(self.tokens.a_bytes), len(self.tokens.a_bytes), len(self.tokens.b_bytes)])
        held = tuple(np.bincount(g, minlength=len(self.ends)) for g in (in_a, in_b))
        upto_a, upto_b = (np.cumsum(h) for h in held)
        # A token of A stands behind those of B in the groups before its own, one of B also behind A's of its own.
        codes = np.empty(len(in_a) + len(in_b), np.int64)
        codes[np.arange(len(in_a)) + (upto_b - held[1])[in_a]] = self.a + before[np.where(last_a, 1, 0)]
        codes[np.arange(len(in_b)) + upto_a[in_b]] = self.b + before[np.where(last_b, 3, 2)]
        texts = [("".join(self.tokens.spelled[codes[i:j]].tolist()))[:-1] for i, j in zip(self.a_at + self.b_at, (self.a_at + self.b_at)[1:])]
        group_at = np.concatenate([in_a, [len(self.ends)]])[self.a_at]
        shared = np.concatenate([[0], np.cumsum(held[0] * held[1])])[group_at]
        return texts, np.diff(group_at), np.diff(shared)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about BATCH_CHARS bytes of text, or one longer row."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_CHARS, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _text_rows(docs: DataFrame, keep: list[Column]) -> DataFrame:
    return docs.select(F.struct(*keep).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))


def _files(spark: SparkSession, a: str, b: str):
    """The tokenizers' files, about 2 MB, read by the driver and sent to the tasks."""
    return spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (a, b)))


def aligned_tokens(docs: DataFrame, keep: list[Column], a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """``keep``, a_ids, b_ids, links and shared for every row of ``docs`` (text).

    links are (a, b, bytes), places of tokens from 0 with the bytes that they share; shared are (a, b), the places of
    tokens in a common group. A text that is null, empty or not spelled by both has empty arrays.
    """
    files = _files(docs.sparkSession, a, b)
    text = _text_rows(docs, keep)

    def run(batches):
        tokens = _load(files.value)
        for part in _texts(batches):
            found = Aligned(tokens, tokens.encode(part.column("_text").to_pylist()))
            shared = found.shared_group_links()
            cut = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
            place = lambda rows, columns: (pa.array((rows - found.a_at[found.text_of(rows)]).astype(np.int32)), pa.array((columns - found.b_at[found.text_of(rows)]).astype(np.int32)))
            links = pa.StructArray.from_arrays([*place(found.link_a, found.link_b), pa.array(found.overlap.astype(np.int32))], names=["a", "b", "bytes"])
            groups = pa.StructArray.from_arrays([*place(shared.rows(), shared.columns)], names=["a", "b"])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_row"), cut(found.a_at, pa.array(found.a.astype(np.int32))), cut(found.b_at, pa.array(found.b.astype(np.int32))),
                    cut(np.searchsorted(found.link_a, found.a_at), links), cut(shared.starts[found.a_at], groups),
                ],
                names=["_row", "a_ids", "b_ids", "links", "shared"],
            )

    names = ("a_ids", "b_ids", "links", "shared")
    shape = "a_ids array<int>, b_ids array<int>, links array<struct<a: int, b: int, bytes: int>>, shared array<struct<a: int, b: int>>"
    return unpacked(text.mapInArrow(run, f"_row {text.schema['_row'].dataType.simpleString()}, {shape}"), *names, names=names)


def _document_links(docs: DataFrame, keep: list[Column], a: str, b: str) -> DataFrame:
    """A written row per document: _row, the counts, and its distinct id pairs (A's id in the upper half) with their numbers of links."""
    files = _files(docs.sparkSession, a, b)
    text = _text_rows(docs, keep)

    def run(batches):
        tokens = _load(files.value)
        for part in _texts(batches):
            encoded = tokens.encode(part.column("_text").to_pylist())
            found = Aligned(tokens, encoded)
            n = len(encoded)
            doc = found.text_of(found.link_a)
            pair = found.a[found.link_a] << 32 | found.b[found.link_b]
            order = np.lexsort((pair, doc))
            doc, pair = doc[order], pair[order]
            new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])) if len(pair) else np.zeros(0, np.int64)
            starts = np.searchsorted(doc[new], np.arange(n + 1)).astype(np.int32)
            times = np.diff(np.append(new, len(pair))).astype(np.int32)
            spelled, n_groups, n_shared = found.spelled_groups()
            cut = lambda values: pa.ListArray.from_arrays(pa.array(starts), pa.array(values))
            long = lambda values: pa.array(np.asarray(values, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_row"), long(np.diff(found.a_at)), long(np.diff(found.b_at)), long(n_groups), long(np.bincount(doc, minlength=n)), long(n_shared),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled]), cut(pair[new]), cut(times),
                ],
                names=["_row", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pairs", "times"],
            )

    shape = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
    made = text.mapInArrow(run, f"_row {text.schema['_row'].dataType.simpleString()}, {shape}")
    return materialize(made.withColumn("_id", F.monotonically_increasing_id()), "token-links")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best) of the rows of ``_document_links``: in how many documents the ids are linked, and whether A's id is with no other in more."""
    n = materialize(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "token-pairs")
    a = F.call_function("shiftright", F.col("pair"), F.lit(32)).alias("a")
    most = n.groupBy(a).agg(F.max("n").alias("most"))
    return materialize(n.select("pair", "n", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "token-pair-counts")


def token_links(docs: DataFrame, keep: list[Column], a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_shared for every row of ``docs`` (text).

    A link is a pair of token occurrences whose bytes overlap; the count of its ids is the number of
    rows that hold them linked, repeated rows each. n_best counts the links that no other of their A id
    exceeds, count_sum sums their counts up, n_shared counts the links of tokens in a common group.
    A text that is null, empty or not spelled by both tokenizers has no tokens: zeros and ''. Texts are
    read whole; a kept column named like a result gives way to it. Empty tables give no rows.
    """
    found = _document_links(docs, keep, a, b)
    counts = pair_counts(found)
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") * HOT > total))
    each = found.select("_id", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_id", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    n_best, count_sum = F.when(F.col("best"), F.col("times")).otherwise(0).cast("long"), F.col("times") * F.col("n")
    of = lambda joined: joined.select("_id", n_best.alias("n_best"), count_sum.alias("count_sum")).groupBy("_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    cold = counts.where(F.col("n") * HOT <= total)
    sums = of(each.join(hot, "pair")).unionByName(of(each.join(hot, "pair", "left_anti").join(cold, "pair")))
    sums = sums.groupBy("_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = found.drop("pairs", "times").join(sums, "_id", "left").fillna(0, ["n_best", "count_sum"])
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
    return unpacked(out, *names, names=names)


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links(read_table(spark, sf_dir, "documents"), [F.col("doc_id").cast("long").alias("doc_id")])

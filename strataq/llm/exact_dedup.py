"""Exact deduplication against a persistent digest index, in DataFrame operations alone.

The index is a table bucketed and sorted by the SHA-256 of a text; it stores one row
(digest, doc_id) per distinct text ever taken in. A batch is first reduced to one row per digest
(map-side), exchanged once into the index's buckets, sort-merge anti-joined with the index, whose
side needs no exchange, and what is new is appended. A batch is written beside the index, and moved
into it when the index's log of commits takes it as the next version; if another batch got there first, the
anti-join starts again from an index that holds it. So two writers never both own a digest. Texts never move: only 32-byte digests do, so
a text of any length costs one pass of the hash over it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm.textstats import packed, unpacked, whole
from strataq.sources.versions import CommitLog, file_system
from strataq.storage import materialize, new_path, read_table


#: Begins the name of the file that holds an index's number of buckets; readers pass over names with an underscore.
MARK = "_buckets-"


def digest_of(text: Column) -> Column:
    """SHA-256 of the unchanged text in UTF-8, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(whole(text).cast("binary"), 256))


#: A digest with more than 1 / HOT of a batch's rows is hot; there are fewer than HOT of them.
HOT = 1000


def _stored_buckets(spark: SparkSession, path: str) -> int | None:
    """The bucket count that the index at ``path`` was made with, from the name of a file beside its data; None if there is no index."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    marks = [int(n.removeprefix(MARK)) for n in names if n.startswith(MARK)]
    if len(marks) > 1 or (not marks and any(n.endswith(".parquet") for n in names)):
        raise ValueError(f"{path} does not say in one way how many buckets it has")
    return marks[0] if marks else None


def _store_buckets(spark: SparkSession, path: str, buckets: int) -> None:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARK}{buckets}")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()


class DigestIndex:
    """A bucketed, sorted table of digests at ``path``.

    ``buckets`` is fixed when the index is made, by default as the session's number of shuffle
    partitions, and stored beside the data. An existing index is opened with its own number, whatever
    the session's; to ask for another one raises.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "digest-index")
        stored = _stored_buckets(spark, self.path)
        if stored and buckets and stored != buckets:
            raise ValueError(f"the index at {self.path} has {stored} buckets, not {buckets}")
        self.buckets = stored or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not stored:
            _store_buckets(spark, self.path, self.buckets)
        self.log = CommitLog(spark, self.path)
        self.name = self._named(self.path)

    def _named(self, path: str) -> str:
        """A new catalogue entry for digests at ``path``."""
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, doc_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        return name

    def _settled(self) -> int:
        """Move the files of the last commit into the index, if its writer has not; the version that the index then has."""
        version = self.log.latest()
        if version:
            commit = self.log.read(version)
            fs, at = file_system(self.spark, self.path)
            for name in commit["files"]:
                source, target = at(f"{self.path}/{commit['folder']}/{name}"), at(f"{self.path}/{name}")
                # Another process may move it at the same time.
                if not fs.exists(target) and not (fs.exists(source) and fs.rename(source, target)) and not fs.exists(target):
                    raise OSError(f"{name} is missing from {self.path}")
            fs.delete(at(f"{self.path}/{commit['folder']}"), True)
        self.spark.catalog.refreshTable(self.name)
        return version

    def _appended(self, fresh: DataFrame) -> None:
        """Append those of ``fresh`` (digest, doc_id), a row per digest, that the index lacks, as its next version."""
        fs, at = file_system(self.spark, self.path)
        while True:
            version = self._settled()
            folder = f"_batch-{uuid.uuid4().hex}"
            beside = self._named(f"{self.path}/{folder}")
            rows = fresh.repartition(self.buckets, "digest").join(self.table().hint("merge"), "digest", "left_anti")
            rows.sortWithinPartitions("digest").write.insertInto(beside)
            self.spark.sql(f"DROP TABLE {beside}")
            names = [x.getPath().getName() for x in fs.listStatus(at(f"{self.path}/{folder}"))]
            if self.log.put(version + 1, {"op": "ingest", "folder": folder, "files": [n for n in names if n.endswith(".parquet")]}):
                self._settled()
                return
            fs.delete(at(f"{self.path}/{folder}"), True)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forget the catalogue entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def compacted(self, path: str | None = None) -> DigestIndex:
        """A copy of the index at a new path with one sorted file a bucket, after many batches have left many; moves no rows between buckets."""
        out = DigestIndex(self.spark, path, self.buckets)
        self.table().repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(out.name)
        return out

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Take a batch in and return (doc_id, digest, copies, keep_id, group_size), a row per document.

        Of equal texts the row with the largest id stays, unless an earlier batch holds the text:
        then the index's id is keep_id and no row of this batch stays. Rows that repeat both id and
        text are one document with ``copies`` of them, each counted in group_size, which covers the
        batch. A null id loses against any other; rows of a text that has only null ids are one row of
        the result with keep_id null. An empty batch gives no rows. Other columns are ignored.
        """
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))
        rows = materialize(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "digests")
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.sum("copies").alias("group_size"))
        self._appended(groups.select("digest", F.col("last_id").alias("doc_id")))
        owners = self.table().groupBy("digest").agg(F.min("doc_id").alias("keep_id")).hint("merge")
        resolved = materialize(groups.select("digest", "group_size").join(owners, "digest"), "digest-owners")
        # Rows of a hot digest would meet in one task: its owner is broadcast to them, which HOT bounds.
        total = rows.agg(F.sum("copies")).first()[0] or 0
        hot = F.broadcast(resolved.where(F.col("group_size") * HOT > total))
        return rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(resolved, "digest"))


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (see ``DigestIndex.ingest``)."""
    own = index or DigestIndex(docs.sparkSession)
    found = own.ingest(docs)
    if index is None:
        own.close()
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_distinct(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, with all their columns.

    Of rows that repeat id and text one stays, whichever it is, and of rows with a null id one per
    text that no row with an id holds.
    """
    own = index or DigestIndex(docs.sparkSession)
    found = materialize(own.ingest(docs), "digest-groups")
    if index is None:
        own.close()
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone"))
    tagged = docs.select(packed(docs), F.col("doc_id").cast("long").alias("_id"), digest_of(F.col("text")).alias("_digest"))
    same = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_digest") == F.col("_gone"))
    left = tagged.join(gone, same, "left_anti")
    if found.where((F.col("copies") > 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).limit(1).count():
        left = left.dropDuplicates(["_digest"])
    return unpacked(left)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

"""Append logs, bundles and source trees as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataq.sources.versions import VersionedTable

FINDING = "id string, investigation_id string, ts string, created_at_ts long, record_type string, type string, text string, content string, finding string, source string, confidence string, tags array<string>, derived_from array<string>, resolution string, authored_by string"
VERSION = "1"
MAX_BUNDLE = 10 * 1024 * 1024


def read_jsonl(spark: SparkSession, path: str, schema: str = FINDING) -> DataFrame:
    """JSON lines with a fixed schema; blank and broken lines are left out and can be counted with ``bad_lines``."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    first = [c for c in rows.columns if c != "_corrupt_record"]
    return rows.where("_corrupt_record IS NULL").select(*first)


def bad_lines(spark: SparkSession, path: str, schema: str = FINDING) -> int:
    """How many lines are neither blank nor JSON of the schema."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull()).count()


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines. They are written to a folder of their own that readers pass over, and its files are
    moved in when they are whole, so that writers at the same time do not touch one another's files."""
    spark = rows.sparkSession
    beside = f"{path.rstrip('/')}/.append-{uuid.uuid4().hex}"
    rows.write.json(beside)
    fs, at = _fs(spark, path)
    for x in fs.listStatus(at(beside)):
        name = x.getPath().getName()
        if name.startswith("part-") and not fs.rename(x.getPath(), at(f"{path.rstrip('/')}/{name}")):
            raise OSError(f"{name} could not be moved into {path}")
    fs.delete(at(beside), True)


def normalised(rows: DataFrame) -> DataFrame:
    """Alias chains folded into one column each: record_type or type, text or content or finding."""
    return rows.withColumns({
        "record_type": F.coalesce("record_type", "type"), "text": F.coalesce("text", "content", "finding"), "confidence": F.lower(F.coalesce("confidence", F.lit("low"))),
        "tags": F.coalesce("tags", F.array().cast("array<string>")), "derived_from": F.coalesce("derived_from", F.array().cast("array<string>")),
    }).drop("type", "content", "finding")


def tail_lines(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(file, line_no, value): the last lines of each text file; a file's lines keep their order."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    return lines.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("line_no")))).where(F.col("_n") <= most).drop("_n")


def compact(spark: SparkSession, live: str, before: Column, archive: str, run: str, schema: str = FINDING) -> None:
    """Move entries before a moment from the live log to compressed files below ``archive/run=...``; the others stay, as do those without a moment.

    The new log is written beside the live one and then takes its place, so a job that fails leaves the old
    one; a retry under the same ``run`` writes the same archive files again and finishes a swap that was cut off.
    """
    _finish_swap(spark, live)
    log = spark.read.schema(schema).json(live)
    log.where(before).write.mode("overwrite").option("compression", "gzip").json(f"{archive}/run={run}")
    log.where(~F.coalesce(before, F.lit(False))).write.mode("overwrite").json(f"{live}.new")
    fs, path = _fs(spark, live)
    if not fs.rename(path(live), path(f"{live}.old")):
        raise OSError(f"{live} could not be moved")
    _finish_swap(spark, live)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _finish_swap(spark: SparkSession, live: str) -> None:
    """From the moment at which the old log was moved away, the new one is complete."""
    fs, path = _fs(spark, live)
    if fs.exists(path(f"{live}.old")):
        if not fs.exists(path(live)) and not fs.rename(path(f"{live}.new"), path(live)):
            raise OSError(f"{live}.new could not take the place of {live}")
        fs.delete(path(f"{live}.old"), True)
    elif fs.exists(path(f"{live}.new")):
        fs.delete(path(f"{live}.new"), True)


def export_bundle(manifest: DataFrame, found: DataFrame, version: str = VERSION) -> DataFrame:
    """(id, bundle, size): one JSON text per investigation, findings in log order. Bundles are bounded by
    their import limit; investigations beyond it are exported as files with ``append_jsonl``."""
    listed = found.groupBy("investigation_id").agg(F.array_sort(F.collect_list(F.struct("seq", "id", "text", "record_type", "confidence"))).alias("findings"))
    both = manifest.join(listed, manifest["id"] == listed["investigation_id"], "left")
    bundle = F.to_json(F.struct(F.lit(version).alias("version"), F.struct(*manifest.columns).alias("manifest"), F.coalesce("findings", F.array().cast(listed.schema["findings"].dataType)).alias("findings")))
    return both.select("id", bundle.alias("bundle"), F.octet_length(bundle).alias("size"))


def import_bundle(bundles: DataFrame, new_id: Column, version: str = VERSION, most: int = MAX_BUNDLE) -> tuple[DataFrame, DataFrame]:
    """(findings, rejected): findings of valid bundles under their new investigation, and why others were not taken."""
    shape = "version string, manifest struct<id:string>, findings array<struct<seq:bigint,id:string,text:string,record_type:string,confidence:string>>"
    read = bundles.withColumn("b", F.from_json("bundle", shape)).withColumn("investigation_id", new_id)
    why = F.when(F.octet_length("bundle") > most, "too large").when(F.col("b").isNull() | F.col("b.version").isNull(), "not a bundle").when(F.col("b.version") != version, "version").when(F.col("b.findings").isNull(), "no findings")
    read = read.withColumn("why", why)
    return read.where("why IS NULL").select("investigation_id", F.inline("b.findings")), read.where("why IS NOT NULL").select("investigation_id", "why")


def source_files(spark: SparkSession, root: str, most: int = 1_500_000, ignore: str = "/(\\.git|node_modules|__pycache__|\\.venv)/") -> DataFrame:
    """(path, content): text files of a tree; large ones, those with a NUL and empty ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = files.where((F.col("length") <= most) & ~F.col("path").rlike(ignore))
    return small.where(F.instr(F.decode(F.substr(F.col("content"), F.lit(1), F.lit(1024)), "ISO-8859-1"), "\0") == 0).select("path", F.decode("content", "utf-8").alias("content"))


def purge_expired(rows: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Rows younger than ``days``; rows without a time stay."""
    return rows.where(F.coalesce(F.col("created_at_ts") >= now - days * 86400, F.lit(True)))


def saved_manifests(spark: SparkSession, new: DataFrame, path: str) -> int:
    """Manifests by id into the versioned table at ``path``: those of ``new`` replace others. Readers see a version whole, and
    of writers that work at the same time each starts again from what the others left."""
    return VersionedTable(spark, path, new.schema).upsert(new, "id")


def manifests(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All manifests of a version of the table at ``path``, the latest if none is named."""
    return VersionedTable(spark, path).read(version)


def manifest(manifests: DataFrame, id_: str) -> DataFrame:
    """The manifest of an id, with empty lists where it has no acl, open questions or tags."""
    lists = [c for c in ("acl", "open_questions", "tags") if c in manifests.columns]
    return manifests.where(F.col("id") == id_).withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})


def recent_audit(spark: SparkSession, root: str, today: str, limit: int, days: int = 7, schema: str = "ts string, action string, detail string") -> DataFrame:
    """The newest ``limit`` entries of the last ``days`` daily files ``audit-YYYY-MM-DD.jsonl`` below ``root``; other days' files are not opened."""
    import datetime

    last = datetime.date.fromisoformat(today)
    fs, at = _fs(spark, root)
    names = [f"{root}/audit-{last - datetime.timedelta(days=k)}.jsonl" for k in range(days)]
    there = [n for n in names if fs.exists(at(n))]
    rows = read_jsonl(spark, there, schema) if there else spark.createDataFrame([], schema)
    return rows.orderBy(F.desc("ts"), "action", "detail").limit(limit)


#: Kind of a session log, and the shape of its lines: one message a line, an event with a nested message, a list of messages in one document, or plain text.
SESSION_SHAPES = {
    "messages": "role string, content string, ts string",
    "events": "type string, timestamp string, message struct<role:string,content:string>",
    "document": "session_id string, messages array<struct<role:string,content:string,ts:string>>",
}


def session_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, line_no, role, text, ts) of session logs of a kind; lines that do not parse, and messages without text, are left out.

    ``text`` is for process output: each line that is not blank is a message of the role process.
    """
    name = F.input_file_name().alias("file")
    if kind == "text":
        rows = spark.read.text(path).select(name, F.lit("process").alias("role"), F.col("value").alias("text"), F.lit(None).cast("string").alias("ts"))
    elif kind == "document":
        read = spark.read.schema(SESSION_SHAPES[kind]).option("multiLine", "true").json(path)
        rows = read.select(name, F.posexplode("messages").alias("line_no", "m")).select("file", F.col("line_no").cast("long").alias("line_no"), "m.role", F.col("m.content").alias("text"), "m.ts")
    else:
        read = spark.read.schema(SESSION_SHAPES[kind]).json(path)
        role, text, ts = (F.col("message.role"), F.col("message.content"), F.col("timestamp")) if kind == "events" else (F.col("role"), F.col("content"), F.col("ts"))
        rows = read.select(name, role.alias("role"), text.alias("text"), ts.alias("ts"))
    if "line_no" not in rows.columns:
        rows = rows.withColumn("line_no", F.monotonically_increasing_id())
    return rows.where(F.trim("text") != "").select("file", "line_no", "role", "text", "ts")


def upserted(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` rows replace those of ``base`` with the same key."""
    return base.join(new.select(key), key, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))

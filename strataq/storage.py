"""Tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: the files outlive any
executor, and a reread table carries no partitioning, so that both sides of a later
join are exchanged and adaptive execution can split a hot key.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one of our own only where that is unset and the
    master is local. On a cluster a missing folder is an error: executors could not read the driver's own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strataq-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strataq/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataq_path = path
    _written.add(path)
    if _made:
        _made[-1].append(out)
    return out


#: Paths that ``materialize`` wrote and nothing has deleted.
_written: set[str] = set()
#: Tables materialized in the scratch blocks that are open, innermost last.
_made: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes at its end the tables that were materialized in the block, but for those taken off the list.

    Shuffle files go when the JVM collects the plans that wrote them, so it is asked to.
    """
    own: list[DataFrame] = []
    _made.append(own)
    try:
        yield own
    finally:
        _made.pop()
        for df in own:
            discard(df)
        if own:
            own[0].sparkSession._jvm.System.gc()


def kept(made: list[DataFrame], df: DataFrame) -> DataFrame:
    """Take a table off a scratch block's list, and put it on the list of the block around it."""
    made[:] = [x for x in made if x is not df]
    if len(_made) > 1 and _made[-1] is made:
        _made[-2].append(df)
    return df


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote; for tables that no later plan reads."""
    path = getattr(df, "_strataq_path", None)
    if path:
        _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> int:
    """Delete every table that this process materialized and still has, and return their number. For a job's end or
    between jobs, when no result that reads them is needed any more: results are lazy and read them when they are used."""
    paths = sorted(_written)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.discard(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""What the corpus operators share: word and white-space classes, and tables in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as every operator here reads them (ASCII white space only).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and this machine runs all tasks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/meterlens-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read from there.

    Cuts the lineage and fixes rows that would not come out alike twice (generated
    ids, files written by tasks); a lost executor costs only a read.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False).parquet(path)  # no file but the rows': nobody else looks here
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """df computed now and kept on the executors' disks for the next few plans, until dropped().

    Its lineage stays, so a lost executor's part is computed again: what df is made of
    must be there as long, and must come out alike. Nothing is written as files that a
    task has to create in the shared folder.
    """
    return counted(df)[0]


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df as held() keeps it, and its number of rows, which keeping it has found."""
    df = df.persist(StorageLevel.DISK_ONLY)
    return df, df.count()


def dropped(df: DataFrame) -> None:
    """Lets go of a held() or deletes the files of a stored() table that no later plan reads."""
    if df.storageLevel != StorageLevel.NONE:
        df.unpersist()
        return
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(parent)
        where.getFileSystem(conf).delete(where, True)


_kept: dict = {}


def kept(name=None, make=None):
    """This Python process's object of a name, made at its first use and kept from task to task.

    Objects of other names go: a worker process runs tasks of many operators, and what one
    of them keeps would take memory from the next. Without a name everything goes.
    """
    others = [k for k in _kept if k != name]
    for other in others:
        del _kept[other]
    if others or name is None:
        pa.default_memory_pool().release_unused()
    if name is not None and name not in _kept:
        _kept[name] = make()
    return _kept.get(name)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Few rows and bytes in an Arrow batch from now on: texts are long, and a batch is held by the JVM and by Python."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans whose results are stored by now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(t, SPACE, " ")).otherwise(t)


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def values(column, rows: int = 250):
    """An Arrow column's values as Python objects, few at a time."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


def file_system(path: str):
    """(file system, path there); any store that pyarrow reaches."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.shipping import ship

#: Rows of an Arrow batch: bounds a Python worker's memory where single texts are long.
BATCH_ROWS = 512
#: Spark's own setting: shuffle files go when the execution that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before Python workers run: bounds the rows of an Arrow batch for this session, as texts may have a hundred thousand characters."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="facetloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends there, a lost executor costs nothing, and the shuffle files of what was written go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table made by cut() once nothing reads it any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """crc32(doc_id as text) mod folds = fold; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == fold, F.lit(False))


def hashed_share(key: str, rows: int, of: int) -> Column:
    """True for about twice as many of `of` rows as asked for, by a hash of the key, or for all: what is then ordered and cut to `rows` is small on every partition."""
    share = 1.0 if of <= 2 * rows else 2 * rows / of
    return F.pmod(F.xxhash64(F.lit("share"), F.col(key)), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))


def columns(df: DataFrame) -> list[Column]:
    """All columns of df by name, which may hold dots or back quotes."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(df: DataFrame, wish: str) -> str:
    """wish, with underscores appended until no column of df has it, letter case aside."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish

"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Executors and the driver must share it, so
    where none is named one is made only if all of them are one process (tests)."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Makes Spark delete a plan's shuffle files when it has run, not when the driver happens to collect its garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared checkpoint folder and cut the lineage.  The shuffle
    files that this took are deleted."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting holds for plans made under it
    finally:
        if before is None:
            spark.conf.unset(_CLEANED)
        else:
            spark.conf.set(_CLEANED, before)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `text` alone, null text as the empty text."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def keyed_texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `texts_of`, with `rid` and `key`: two hashes of the text, the first of the id as
    well, which tell rows apart that share an id or have none."""
    return texts_of(docs, id_col, text_col).select("*", *row_keys())


def row_keys() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(F.col("doc_id").cast("long"), text, F.lit(17)).alias("rid"), F.xxhash64(text).alias("key")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

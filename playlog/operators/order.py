"""One order over all plays, without a single-partition window.

Plays are dealt by time in parts of about equal size, between quantiles of their times, and
sorted by (time, scan order) in each part: one shuffle.  A play's index is its place in its
part plus the sizes of the parts before; the play before it is found in its part, or is the
last of the part before.  One row for each part goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from playlog.functions.session import cut

#: Parts for each shuffle partition, and parts at most.
PARTS, MOST = 3, 2_000


def _own() -> WindowSpec:
    return Window.partitionBy("_part").orderBy("at", "seq")



def boundaries(times: DataFrame) -> list[int]:
    """Quantiles (microseconds) of `at`, of which there are as many as parts but one."""
    parts = min(MOST, PARTS * int(times.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = times.agg(F.percentile_approx(F.unix_micros("at"), [k / parts for k in range(1, parts)], 20 * parts).alias("q")).first()
    return sorted(set(found["q"] or []))


def _part(cuts: list[int], first: int = 0) -> Column:
    """How many boundaries a play's time is over, found by halving."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(F.unix_micros("at") > cuts[half], _part(cuts[half + 1 :], first + half + 1)).otherwise(_part(cuts[:half], first))


def in_order(plays: DataFrame, carried: tuple[str, ...], cuts: list[int]) -> DataFrame:
    """`plays` (with `at` and `seq`) with `gidx` from 0 and `before`, a struct of the carried
    columns of the play before, whose fields are null at the first.  Materialised, so `plays`
    should be narrow."""
    lags = [F.lag(c).over(_own()).alias(f"_lag_{c}") for c in carried]
    placed = cut(plays.withColumn("_part", _part(cuts)).select("*", F.row_number().over(_own()).alias("_place"), F.lead(F.lit(1)).over(_own()).alias("_more"), *lags))
    ends = placed.where("_more is null").select("_part", F.col("_place").cast("long").alias("_n"), *carried)
    told, offset, last = [], 0, (None,) * len(carried)
    for part, n, *end in sorted(map(tuple, ends.collect())):  # one row for each part, MOST at most
        told.append((part, offset, *last))
        offset, last = offset + n, tuple(end)
    kinds = [placed.schema[c] for c in carried]
    schema = StructType([placed.schema["_part"], StructField("_offset", LongType()), *[StructField(f"_last_{f.name}", f.dataType) for f in kinds]])
    joined = placed.join(F.broadcast(plays.sparkSession.createDataFrame(told, schema)), "_part")
    before = [F.coalesce(f"_lag_{c}", F.when(F.col("_place") == 1, F.col(f"_last_{c}"))).alias(c) for c in carried]
    return joined.select(*plays.columns, "_part", (F.col("_offset") + F.col("_place") - 1).alias("gidx"), *([F.struct(*before).alias("before")] if before else []))


def islands(ordered: DataFrame, starts: Column, name: str) -> DataFrame:
    """`ordered` with the number (from 1) of the stretch that each play is in; `starts`
    tells the plays that begin one.  Materialised, so `ordered` should be narrow."""
    flagged = ordered.withColumn("_flag", F.when(starts, 1).otherwise(0))
    counted = cut(flagged.withColumn("_count", F.sum("_flag").over(_own().rowsBetween(Window.unboundedPreceding, 0))).drop("_flag"))
    told, offset = [], 0
    for part, n in sorted(map(tuple, counted.groupBy("_part").agg(F.max("_count")).collect())):  # MOST rows at most
        told.append((part, offset))
        offset += n
    offsets = ordered.sparkSession.createDataFrame(told, StructType([counted.schema["_part"], StructField("_offset", LongType())]))
    return counted.join(F.broadcast(offsets), "_part").select(*ordered.columns, (F.col("_offset") + F.col("_count")).alias(name))


def commonest(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """The commonest `value` of each group, of equals the first met (by `gidx`), then the
    least."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("_n"), F.min("gidx").alias("_first"))
    best = Window.partitionBy(*by).orderBy(F.desc("_n"), "_first", value)
    return counted.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(*by, F.col(value).alias(out), F.col("_n").alias(f"{out}_n"))

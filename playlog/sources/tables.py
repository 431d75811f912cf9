"""The model's inputs from Parquet: a library of our own, or the driver's star schema.

The star schema is mapped so: events are plays (a user is `user_id % 4`, users 0 and 3
share a name, the track is the number in `props`); parts are tracks, in albums of 1, 3, 5
... tracks whose names make five groups of duplicate entities; orders with their lines are
accumulated counters of a customer's user (`o_custkey % 4`) and part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Library:
    tracks: DataFrame
    plays: DataFrame
    annotations: DataFrame
    users: DataFrame


def from_parquet(spark: SparkSession, folder: str) -> Library:
    """A library stored as four tables named after the model's inputs."""
    return Library(*[spark.read.parquet(f"{folder}/{name}.parquet") for name in ("tracks", "plays", "annotations", "users")])


def from_star_schema(spark: SparkSession, sf_dir: str) -> Library:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    user_id = (F.col("user_id") % 4).cast("string")
    name = F.concat(F.lit("user-"), (F.col("user_id") % 4 % 3).cast("string"))
    plays = read("events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.regexp_extract("props", r'"k": (\d+)', 1).alias("track_id"), user_id.alias("user_id"), name.alias("user_name"))
    k = F.col("p_partkey")
    album = F.floor(F.sqrt(k.cast("double"))).cast("int")
    number = (k - album * album + 1).cast("int")
    named = F.lpad((number + F.when(k % 7 == 0, 1).otherwise(0)).cast("string"), 2, "0")
    tracks = read("part").select(
        k.alias("load_seq"),
        k.cast("string").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.concat(F.lit("Álbum "), (album % 5).cast("string")).alias("album"),
        album.cast("string").alias("album_id"),
        F.when(album < 5, "Artist X").otherwise("artist-x").alias("album_artist"),
        F.concat("p_type", F.lit("; "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("genre"),
        (F.lit(1950) + F.col("p_size")).cast("int").alias("year"),
        F.col("p_retailprice").alias("duration"),
        number.alias("track_number"),
        F.lit(1).alias("disc_number"),
        F.concat(named, F.lit(" - "), "p_name", F.lit(".flac")).alias("path"),
        F.lit("").alias("mbid"),
        F.lit(None).cast("timestamp").alias("added_at"),
    )
    lines = read("lineitem").select("l_orderkey", F.col("l_partkey").alias("track"))
    orders = read("orders").select("o_orderkey", (F.col("o_custkey") % 4).cast("string").alias("user_id"), "o_orderdate")
    annotations = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("user_id", F.col("track").cast("string").alias("track_id")).agg(F.count("*").alias("play_count"), F.max(F.col("o_orderdate").cast("timestamp")).alias("last_played"))
    users = spark.range(4).select(F.col("id").cast("string").alias("user_id"), F.concat(F.lit("user-"), (F.col("id") % 3).cast("string")).alias("user_name"))
    return Library(tracks, plays, annotations, users)

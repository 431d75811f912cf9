"""The model: tracks with their album's facts, and the log of plays in one order.

Inputs.  tracks: load_seq, id, title, artist, album, album_id, album_artist, genre, year,
duration, track_number, disc_number, path, mbid, added_at.  plays: seq, at, track_id,
user_id, user_name.  annotations: user_id, track_id, play_count, last_played.  users:
user_id, user_name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playlog.functions import scalars as S
from playlog.functions import text as T
from playlog.operators.order import boundaries, in_order

UNKNOWN_USER = "(usuario desconocido)"


def enrich(tracks: DataFrame) -> DataFrame:
    """Tracks with owner, album key, position in the album and the album's facts
    (`cat_...`: labels of its first track, size, duration, year, date added)."""
    owner = F.when(F.col("album_artist") != "", F.col("album_artist")).otherwise(F.col("artist"))
    df = tracks.withColumn("owner", owner)
    df = df.select("*", T.casefold("owner").alias("owner_key"), T.casefold("title").alias("_title"), T.casefold("artist").alias("artist_key"), T.casefold("album").alias("album_fold"))
    df = df.withColumn("album_key", F.when(F.col("album_id") != "", F.col("album_id")).otherwise(F.concat("owner_key", F.lit(S.KEY_MARK), "album_fold")))
    disc = F.when(F.col("disc_number") == 0, 1).otherwise(F.col("disc_number"))
    number = F.when(F.col("track_number") > 0, F.col("track_number")).otherwise(10_000)
    order = Window.partitionBy("album_key").orderBy(disc, number, "_title", "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.select(
        "*",
        F.row_number().over(order).alias("position"),
        F.count("*").over(whole).cast("int").alias("total"),
        F.first("album_id").over(whole).alias("cat_album_id"),
        F.first("owner").over(whole).alias("cat_artist"),
        F.first("album").over(whole).alias("cat_album"),
        F.min(F.when(F.col("year") != 0, F.col("year"))).over(whole).alias("cat_year"),
        F.min("added_at").over(whole).alias("cat_added_at"),
    )
    return df.drop("_title", "album_fold")


def catalogue(enriched: DataFrame) -> DataFrame:
    """One row for each album."""
    return enriched.groupBy("album_key").agg(
        F.first("cat_album_id").alias("album_id"),
        F.first("cat_artist").alias("artist"),
        F.first("cat_album").alias("album"),
        F.count("*").cast("int").alias("track_count"),
        F.sum(F.col("duration").cast("decimal(20,6)")).cast("double").alias("duration"),
        F.first("cat_year").alias("year"),
        F.first("cat_added_at").alias("added_at"),
    )


_TRACK = ("title", "artist", "artist_key", "album", "album_key", "owner", "owner_key", "genre", "year", "duration", "position", "total", "cat_album_id", "cat_artist", "cat_album", "cat_year")


def heard(plays: DataFrame, enriched: DataFrame) -> DataFrame:
    """Plays of known tracks with their tracks' columns; `gidx` orders them all, for
    analyses that need an order but neither places nor neighbours."""
    joined = plays.select("seq", "at", "user_id", "user_name", "track_id").join(enriched.select("id", *_TRACK), F.col("track_id") == F.col("id")).drop("id")
    return joined.withColumn("gidx", F.struct("at", "seq"))


def ordered(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Plays of known tracks in one order over all users, with `gidx` and `before`, the time,
    user and track of the play that came just before, whoever's it was."""
    known = plays.select("seq", "at", "user_id", "user_name", "track_id").join(tracks.select(F.col("id").alias("track_id")), "track_id", "left_semi")
    return in_order(known, ("at", "user_id", "track_id"), boundaries(plays))


def with_tracks(plays: DataFrame, enriched: DataFrame, *columns: str) -> DataFrame:
    """Ordered plays with these columns of their tracks, or with all."""
    return plays.join(enriched.select(F.col("id").alias("track_id"), *(columns or _TRACK)), "track_id")


def with_previous(log: DataFrame, enriched: DataFrame, *columns: str) -> DataFrame:
    """`log` with these columns of the track before in `before`."""
    facts = enriched.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    before = F.struct("before.*", *[F.col(f"_p_{c}").alias(c) for c in columns])
    joined = log.join(facts, F.col("before.track_id") == F.col("_id"), "left")
    return joined.select(*[c for c in log.columns if c != "before"], before.alias("before"))


def labelled(users: DataFrame, of: DataFrame) -> DataFrame:
    """`of` (with user_id) with `user`, the name, else the id, else a fixed label."""
    named = of.join(users, "user_id", "left")
    return named.withColumn("user", F.coalesce("user_name", F.when(F.col("user_id") != "", F.col("user_id")), F.lit(UNKNOWN_USER))).drop("user_name")


def minutes(n: float) -> Column:
    return F.lit(int(n * S.MINUTE))

"""Each user's listening sessions over a stream of plays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_sessions(plays: DataFrame, gap_minutes: int, late: str = "1 hour") -> DataFrame:
    """Sessions of each user from a stream with `at`, `user_id`, `track_id`; plays at most
    the gap apart are one session.  Plays later than the watermark allows are dropped, as
    is usual for streams.  Batch input gives the same sessions at once."""
    watched = plays.withWatermark("at", late) if plays.isStreaming else plays
    grouped = watched.groupBy("user_id", F.session_window("at", f"{gap_minutes} minutes").alias("w"))
    facts = grouped.agg(F.max("at").alias("end"), F.count("*").alias("tracks"), F.collect_set("track_id").alias("_ids"))
    return facts.select("user_id", F.col("w.start").alias("start"), "end", "tracks", F.size("_ids").alias("unique_tracks"))

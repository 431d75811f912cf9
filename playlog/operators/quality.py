"""Diagnostics of metadata: contradictions in a track's tags, albums split in several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playlog.functions import scalars as S
from playlog.functions import text as T
from playlog.operators.model import catalogue


def metadata_quality(tracks: DataFrame) -> DataFrame:
    """Visible contradictions of each track between its tags and its file's name."""
    df = tracks.select("*", S.path_track_number(F.col("path")).alias("_number"), T.title_key("title").alias("_title"), T.title_key(S.path_stem(F.col("path"))).alias("_file"))
    long = (F.length("_title") >= 4) & (F.length("_file") >= 4)
    df = df.withColumn("_ratio", T.similarity("_title", "_file")).withColumn("_ratio", F.when(long, F.col("_ratio")))
    wrong = (F.col("_number") > 0) & (F.col("track_number") != 0) & (F.col("_number") != F.col("track_number"))
    unlike = F.coalesce(F.col("_file").rlike("[a-z]") & (F.col("_ratio") < 0.28), F.lit(False))
    n = wrong.cast("int") + unlike.cast("int")
    return df.select(
        F.col("id").alias("track_id"), "artist", "album", "disc_number", "track_number", F.when(F.col("_number") > 0, F.col("_number")).alias("path_track_number"), "title", "path", S.pyround(F.col("_ratio"), 3).alias("title_path_similarity"),
        F.concat_ws(",", F.when(wrong, "track_number_vs_path"), F.when(unlike, "title_vs_path_low_similarity")).alias("issues"), F.when(n >= 2, "baja").when(n == 1, "media").otherwise("alta").alias("confidence"),
    )


def metadata_issues(quality: DataFrame) -> DataFrame:
    return quality.where("issues <> ''")


def duplicate_entities(enriched: DataFrame) -> DataFrame:
    """Distinct albums whose artist and title are the same but for marks, case and accents."""
    keyed = catalogue(enriched).select("*", T.entity_key("artist").alias("_artist"), T.entity_key("album").alias("_album"))
    keyed = keyed.where("_artist <> '' and _album <> ''")
    group = Window.partitionBy("_artist", "_album")
    facts = keyed.select(
        "*",
        F.count("*").over(group).alias("_n"),
        F.max("track_count").over(group).alias("_largest"),
        F.size(F.collect_set("artist").over(group)).alias("_spellings"),
        F.array_sort(F.collect_list(F.when(F.col("album_id") != "", F.col("album_id"))).over(group)).alias("_ids"),
        F.array_sort(F.collect_list("album_key").over(group)).alias("_keys"),
    ).where("_n >= 2")
    # keys are an album's own, and so are ids where there are any: without its own are its relatives'
    related = facts.select(
        "album_key",
        F.array_join(F.array_remove("_ids", F.col("album_id")), "; ").alias("related_album_ids"),
        F.array_join(F.array_remove("_keys", F.col("album_key")), "; ").alias("related_album_keys"),
    )

    def listed(c: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda s: s[c]), "; ")

    texts = enriched.join(facts.select("album_key"), "album_key", "left_semi").groupBy("album_key").agg(listed("id").alias("track_ids"), listed("title").alias("track_titles"), listed("path").alias("paths"))
    small = (F.col("track_count") <= 2) & (F.col("_largest") > 2)
    signals = F.concat_ws(",", F.lit("same_title_artist_multiple_entities"), F.when(small, "small_fragment_of_larger_entity"), F.when(F.col("_spellings") > 1, "album_artist_format_variation"))
    rows = facts.withColumn("signals", signals).join(related, "album_key").join(texts, "album_key")
    return rows.select("album_key", "album_id", "artist", "album", "year", "track_count", "track_ids", "track_titles", "paths", "related_album_ids", "related_album_keys", "signals")

"""Analyses of plays.  Inputs are those of `model`: `log` is its play log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playlog.functions import scalars as S
from playlog.operators.model import labelled, minutes, with_previous, with_tracks
from playlog.operators.order import commonest, islands


def _gap(before: str = "before") -> Column:
    return S.micros(F.col("at")) - S.micros(F.col(f"{before}.at"))


def _same_user() -> Column:
    return F.col("user_id") == F.col("before.user_id")


def sessions(plays: DataFrame, enriched: DataFrame, gap_minutes: int, scope: str = "all") -> DataFrame:
    """Listening sessions: a play starts one if it is the first, if the play before it in
    the order of all users is someone else's, or if it comes more than the gap later.
    With scope 'user' other users' plays don't break a session, and ids go by user.
    `plays` are ordered ones, with scope 'user' any of known tracks with `gidx`."""
    if scope == "user":
        per = Window.partitionBy("user_id").orderBy("gidx")
        late = (S.micros(F.col("at")) - F.lag(S.micros(F.col("at"))).over(per)) > minutes(gap_minutes)
        flagged = plays.withColumn("_late", F.coalesce(late, F.lit(True)).cast("int"))
        numbered = flagged.withColumn("_number", F.sum("_late").over(per)).withColumn("session_id", F.struct("user_id", "_number"))
    else:
        numbered = islands(plays, F.col("before.at").isNull() | ~_same_user() | (_gap() > minutes(gap_minutes)), "session_id")
    # all that follows goes by session, so its rows are dealt once
    facts = ("artist", "album", "genre", "duration")
    dealt = with_tracks(numbered.select("session_id", "gidx", "at", "user_name", "track_id"), enriched, *facts).repartition("session_id")
    facts = dealt.groupBy("session_id").agg(
        F.min_by("user_name", "gidx").alias("user"),
        F.min("at").alias("_start"),
        F.max("at").alias("_end"),
        F.count("*").alias("tracks"),
        F.count_distinct("track_id").alias("unique_tracks"),
        F.sum(F.greatest(F.col("duration"), F.lit(0.0)).cast("decimal(20,6)")).cast("double").alias("_seconds"),
    )

    def told(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    said = F.concat(F.array(told("artist", F.col("artist")), told("album", F.col("album"))), F.transform(S.split_genres(F.col("genre")), lambda g: told("genre", g)))
    counted = dealt.select("session_id", "gidx", F.explode(said).alias("v")).groupBy("session_id", "v").agg(F.count("*").alias("n"), F.min("gidx").alias("first"))
    # the commonest, of equals the first met, then the least
    best = F.struct(-F.col("n"), F.col("first"), F.col("v.value").alias("value"))
    tops = counted.groupBy("session_id").agg(*[F.min(F.when(F.col("v.kind") == kind, best)).alias(f"_{kind}") for kind in ("artist", "album", "genre")])
    facts = facts.join(tops.select("session_id", *[F.col(f"_{kind}.value").alias(f"top_{kind}") for kind in ("artist", "album", "genre")]), "session_id", "left")
    first = F.col("session_id") if scope != "user" else F.concat_ws(":", "session_id.user_id", "session_id._number")
    return facts.select(
        first.alias("session_id"),
        "user",
        S.iso(F.col("_start")).alias("start"),
        S.iso(F.col("_end")).alias("end"),
        S.pyround(S.span(F.col("_start"), F.col("_end"), S.MINUTE), 1).alias("span_minutes"),
        "tracks",
        "unique_tracks",
        S.pyround(F.col("_seconds") / 60.0, 1).alias("estimated_music_minutes"),
        "top_artist",
        "top_album",
        F.coalesce("top_genre", F.lit("")).alias("top_genre"),
    )


def weekly_obsessions(log: DataFrame) -> DataFrame:
    """Tracks a user played three times in an ISO week, or twice in a week of at most
    twelve plays."""
    week = ["year", "week", "user"]
    plays = log.select(S.iso_year(F.col("at")).alias("year"), F.weekofyear("at").alias("week"), F.col("user_name").alias("user"), "track_id", "artist", "title", "album", "gidx")
    counted = plays.groupBy(*week, "track_id", "artist", "title", "album").agg(F.count("*").alias("plays"), F.min("gidx").alias("_first"))
    totals = counted.withColumn("week_total", F.sum("plays").over(Window.partitionBy(*week)))
    kept = totals.where("plays >= 3 or (plays >= 2 and week_total <= 12)")
    return kept.select(*week, "plays", "week_total", S.share(F.col("plays"), F.col("week_total")).alias("share"), "artist", "title", "album", "track_id", "_first")


def resurrections(log: DataFrame, days: int) -> DataFrame:
    """Returns of a user to a track after so many days of silence or more."""
    own = Window.partitionBy("user_id", "track_id").orderBy("gidx")
    pairs = log.withColumn("_before", F.lag("at").over(own)).withColumn("_days", S.span(F.col("_before"), F.col("at"), S.DAY)).where(F.col("_days") >= days)
    return pairs.select(F.col("user_name").alias("user"), S.pyround(F.col("_days"), 1).alias("silent_days"), S.iso(F.col("_before")).alias("before"), S.iso(F.col("at")).alias("return"), "artist", "title", "album", "track_id", F.col("gidx").alias("_first"))


def _adjacent(log: DataFrame, window_minutes: int) -> DataFrame:
    return log.where(_same_user() & (_gap() <= minutes(window_minutes)) & (F.col("track_id") != F.col("before.track_id")))


def track_pairs(log: DataFrame, enriched: DataFrame, window_minutes: int) -> DataFrame:
    """Pairs of tracks that followed each other twice or more."""
    counted = (
        with_previous(_adjacent(log, window_minutes), enriched, "artist", "title")
        .groupBy("user_id", F.col("before.track_id").alias("from_track_id"), F.col("track_id").alias("to_track_id"))
        .agg(
            F.count("*").alias("times"),
            F.first("user_name").alias("user"),
            F.first("before.artist").alias("from_artist"),
            F.first("before.title").alias("from_title"),
            F.first("artist").alias("to_artist"),
            F.first("title").alias("to_title"),
            F.min("gidx").alias("_first"),
        )
    )
    return counted.where("times >= 2").select("user", "times", "from_artist", "from_title", "to_artist", "to_title", "from_track_id", "to_track_id", "_first")


def context_jumps(log: DataFrame, enriched: DataFrame, window_minutes: int) -> DataFrame:
    """How far each play is from the one before, 0 to 100, by artist, genres and year."""
    rows = with_previous(_adjacent(log, window_minutes), enriched, "artist", "artist_key", "title", "genre", "year").withColumn("_ga", S.split_genres(F.col("before.genre"))).withColumn("_gb", S.split_genres(F.col("genre")))
    both, any_ = (F.size("_ga") > 0) & (F.size("_gb") > 0), (F.size("_ga") > 0) | (F.size("_gb") > 0)
    ya, yb = F.col("before.year"), F.col("year")
    years = F.coalesce((ya != 0) & (yb != 0), F.lit(False))
    dy = F.abs(ya - yb)
    artist = F.col("before.artist_key") != F.col("artist_key")
    alike = F.size(F.array_intersect("_ga", "_gb")) / F.size(F.array_union("_ga", "_gb"))
    score = F.when(artist, 25.0).otherwise(0.0) + F.when(both, 50.0 * (1.0 - alike)).when(any_, 18.0).otherwise(0.0) + F.when(years, F.least(F.lit(25.0), dy / 2.0)).otherwise(0.0)
    evidence = F.concat_ws(", ", F.when(artist, "artista"), F.when(both, "género").when(any_, "género parcial"), F.when(years & (dy >= 10), F.concat(dy.cast("string"), F.lit(" años"))))
    return rows.select(
        F.col("user_name").alias("user"),
        S.iso(F.col("at")).alias("at"),
        S.pyround(F.least(F.lit(100.0), score), 1).alias("score"),
        F.when(both & years, "alta").when(both, "media").otherwise("baja").alias("confidence"),
        F.col("before.artist").alias("from_artist"),
        F.col("before.title").alias("from_title"),
        F.col("before.genre").alias("from_genre"),
        F.when(ya != 0, ya).alias("from_year"),
        F.col("artist").alias("to_artist"),
        F.col("title").alias("to_title"),
        F.col("genre").alias("to_genre"),
        F.when(yb != 0, yb).alias("to_year"),
        evidence.alias("evidence"),
        F.col("gidx").alias("_first"),
    )


def discoveries(log: DataFrame) -> DataFrame:
    """Tracks a user played three times or more, and for how long."""
    counted = log.groupBy("user_id", "track_id").agg(
        F.count("*").alias("plays"), F.min("at").alias("_from"), F.max("at").alias("_to"), F.first("user_name").alias("user"), F.first("artist").alias("artist"), F.first("title").alias("title"), F.first("album").alias("album"), F.min("gidx").alias("_first")
    )
    return counted.where("plays >= 3").select(
        "user", "plays", S.pyround(S.span(F.col("_from"), F.col("_to"), S.DAY), 1).alias("lifespan_days"), S.iso(F.col("_from")).alias("first_play"), S.iso(F.col("_to")).alias("last_play"), "artist", "title", "album", "track_id", "_first"
    )


def weekly_dominance(log: DataFrame, level: str) -> DataFrame:
    """The album or artist a user played most in each ISO week; labels are the last ones
    met anywhere."""
    key = F.col("album_key") if level == "album" else F.col("owner_key")
    plays = log.select(F.col("user_name").alias("user"), S.iso_year(F.col("at")).alias("year"), F.weekofyear("at").alias("week"), F.to_date(F.date_trunc("week", "at")).alias("_monday"), key.alias("entity_key"), "owner", "album", "gidx")
    week = ["user", "year", "week"]
    labels = plays.groupBy("entity_key").agg(F.max_by("owner", "gidx").alias("artist"), (F.max_by("album", "gidx") if level == "album" else F.lit("")).alias("album"))
    totals = plays.groupBy(*week).agg(F.count("*").alias("week_total"), F.first("_monday").alias("_monday"))
    best = commonest(plays, week, "entity_key", "_best").select(*week, F.col("_best").alias("entity_key"), F.col("_best_n").alias("plays"))
    rows = best.join(totals, week).join(labels, "entity_key")
    return rows.select(*week, F.date_format("_monday", "yyyy-MM-dd").alias("week_start"), "plays", "week_total", S.share(F.col("plays"), F.col("week_total")).alias("share_pct"), "artist", "album", "entity_key")


def dominance_eras(weekly: DataFrame, level: str) -> DataFrame:
    """Runs of weeks, one after the other, that the same album or artist dominated."""
    own = Window.partitionBy("user").orderBy("week_start")
    same = (F.col("entity_key") == F.lag("entity_key").over(own)) & (F.datediff(F.to_date("week_start"), F.lag(F.to_date("week_start")).over(own)) == 7)
    flagged = weekly.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    numbered = flagged.withColumn("_era", F.sum("_new").over(own))

    def label(pick: Column) -> Column:
        return F.format_string("%d-W%02d", pick["year"], pick["week"])

    week = F.struct("year", "week")
    grouped = numbered.groupBy("user", "_era").agg(
        F.min_by(week, "week_start").alias("_a"),
        F.max_by(week, "week_start").alias("_b"),
        F.count("*").alias("weeks"),
        F.min_by("artist", "week_start").alias("artist"),
        F.min_by("album", "week_start").alias("album"),
        F.sum("plays").alias("dominant_plays"),
        F.sum("week_total").alias("period_total"),
        S.exact_mean(F.col("share_pct")).alias("_mean"),
    )
    return grouped.select("user", F.lit(level).alias("level"), label(F.col("_a")).alias("start_week"), label(F.col("_b")).alias("end_week"), "weeks", "artist", "album", "dominant_plays", "period_total", S.pyround(F.col("_mean"), 1).alias("avg_share_pct"))


def historical_vs_recent(log: DataFrame, enriched: DataFrame, annotations: DataFrame, users: DataFrame, level: str) -> DataFrame:
    """Accumulated counts against dated plays, by album or artist.  Of several spellings
    of a name the least track id's is shown."""
    recent = log.groupBy("user_id", "track_id").agg(F.count("*").alias("_recent"))
    both = annotations.select("user_id", "track_id", F.col("play_count").alias("_total")).join(recent, ["user_id", "track_id"], "full_outer").na.fill(0, ["_total", "_recent"])
    rows = both.join(enriched.select(F.col("id").alias("track_id"), "owner", "owner_key", "album", "album_key"), "track_id")
    key = "album_key" if level == "album" else "owner_key"
    total, new = F.col("_total"), F.col("_recent")
    summed = rows.groupBy("user_id", key).agg(
        F.min_by("owner", "track_id").alias("artist"),
        F.min_by("album", "track_id").alias("album"),
        F.sum(total).alias("historical_total"),
        F.sum(new).alias("recent_scrobbles"),
        F.sum(F.greatest(F.lit(0), total - new)).alias("estimated_before_history"),
        F.sum(F.when((new > total) & (total > 0), 1).otherwise(0)).alias("mismatch_tracks"),
    )
    older, new = F.col("estimated_before_history"), F.col("recent_scrobbles")
    profile = F.when(older >= F.greatest(F.lit(10), 2 * new), "histórica").when(new >= F.greatest(F.lit(10), 2 * older), "reciente").when((older >= 10) & (new >= 10), "persistente").otherwise("mixta")
    share = F.when(F.col("historical_total") != 0, S.share(new, F.col("historical_total"))).alias("recent_share_pct")
    names = ["artist", "album", "album_key"] if level == "album" else ["artist"]
    return labelled(users, summed).select("user", *names, "historical_total", "recent_scrobbles", "estimated_before_history", share, "mismatch_tracks", profile.alias("profile"))


def artist_depth(log: DataFrame, enriched: DataFrame) -> DataFrame:
    """How much of each artist's library has been heard, all users together."""
    library = enriched.groupBy("owner_key").agg(F.count_distinct("id").alias("library_tracks"), F.count_distinct("album_key").alias("library_albums"))
    by_track = log.groupBy("owner_key", "album_key", "track_id").agg(F.count("*").alias("_n"), F.max(F.struct("gidx", "owner")).alias("_last"))
    by_album = by_track.groupBy("owner_key", "album_key").agg(F.sum("_n").alias("_n"), F.max("_n").alias("_top"), F.count("*").alias("_tracks"), F.max("_last").alias("_last"))
    played = by_album.groupBy("owner_key").agg(F.sum("_n").alias("plays"), F.max("_n").alias("_album"), F.max("_top").alias("_track"), F.sum("_tracks").alias("heard_tracks"), F.count("*").alias("heard_albums"), F.max("_last")["owner"].alias("artist"))
    rows = played.join(library, "owner_key", "left").na.fill(0, ["library_tracks", "library_albums"])
    return rows.select(
        "artist",
        "plays",
        "library_tracks",
        "heard_tracks",
        S.share(F.col("heard_tracks"), F.col("library_tracks")).alias("track_breadth_pct"),
        "library_albums",
        "heard_albums",
        S.share(F.col("heard_albums"), F.col("library_albums")).alias("album_breadth_pct"),
        S.share(F.col("_album"), F.col("plays")).alias("top_album_share_pct"),
        S.share(F.col("_track"), F.col("plays")).alias("top_track_share_pct"),
    )


def top_tracks(log: DataFrame) -> DataFrame:
    counted = log.groupBy("track_id", "artist", "title", "album", "genre", "year").agg(F.count("*").alias("plays"), F.min("gidx").alias("_first"))
    return counted.select("plays", "artist", "title", "album", "genre", F.when(F.col("year") != 0, F.col("year")).alias("release_year"), "track_id", "_first")


def counts_by(log: DataFrame, **keys: Column) -> DataFrame:
    """Plays by the given keys (month, year, hour, user, artist ...)."""
    return log.groupBy(*[c.alias(name) for name, c in keys.items()]).agg(F.count("*").alias("plays"))


def genre_counts(log: DataFrame) -> DataFrame:
    return log.select(F.explode(S.split_genres(F.col("genre"))).alias("genre")).groupBy("genre").agg(F.count("*").alias("plays"))


def plays_export(log: DataFrame, enriched: DataFrame) -> DataFrame:
    """Every play with its date parts and track."""
    more = enriched.select(F.col("id").alias("track_id"), "album_artist", "album_id", "disc_number", "track_number", "path", "mbid")
    at = F.col("at")
    return log.join(more, "track_id").select(
        S.iso(at).alias("datetime"), F.date_format(at, "yyyy-MM-dd").alias("date"), F.year(at).alias("year"), F.date_format(at, "yyyy-MM").alias("month"), F.date_format(at, "EEEE").alias("weekday"), F.hour(at).alias("hour"), F.col("user_name").alias("user"),
        "track_id", "artist", "album_artist", "album", "album_id", "disc_number", "track_number", "title", "genre", F.when(F.col("year") != 0, F.col("year")).alias("release_year"), "duration", "path", "mbid", F.col("gidx").alias("_first"),
    )


def library_summary(enriched: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Totals of the catalogue, and how many of its tracks were never played."""
    totals = enriched.agg(
        F.count("*").alias("tracks"),
        F.count_distinct("owner_key").alias("artists"),
        F.count_distinct("album_key").alias("albums"),
        F.coalesce(F.sum(F.col("duration").cast("decimal(20,6)")).cast("double"), F.lit(0.0)).alias("duration"),
    )
    if log is None:
        return totals.withColumn("unplayed", F.lit(None).cast("long"))
    unheard = enriched.join(log.select(F.col("track_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("unplayed"))
    return totals.join(F.broadcast(unheard))

"""Analyses of albums: coverage, runs, threads and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playlog.functions import scalars as S
from playlog.functions import text as T
from playlog.functions.session import cut
from playlog.operators.model import catalogue, labelled, minutes, with_previous, with_tracks
from playlog.operators.order import boundaries, commonest, in_order, islands


def library_coverage(log: DataFrame, enriched: DataFrame, annotations: DataFrame, users: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """What each user is known to have heard of every album: an annotation or a dated play
    marks a track as heard; an annotation's count goes before that of plays."""
    dated = log.groupBy("user_id", "track_id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    noted = annotations.select("user_id", "track_id", F.col("play_count").alias("_count"), F.col("last_played").alias("_last"), F.lit(1).alias("_noted"))
    heard = noted.join(dated, ["user_id", "track_id"], "full_outer")
    by_album = (
        heard.join(enriched.select(F.col("id").alias("track_id"), "album_key"), "track_id")
        .groupBy("user_id", "album_key")
        .agg(F.count("*").alias("_heard"), F.sum(F.when(F.col("_noted") == 1, F.col("_count")).otherwise(F.col("_n"))).alias("_plays"), F.max(F.greatest("_last", "_at")).alias("_when"))
    )
    spark = log.sparkSession
    if selected is not None:
        who = spark.createDataFrame([(u,) for u in selected], "user_id string")
    else:
        who = users.select("user_id").union(heard.select("user_id")).distinct()
    who = labelled(users, who)
    if selected is None:
        empty = spark.sql("select '' as user_id, '(usuario desconocido)' as user")
        who = who.unionByName(empty.join(who.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti"))
    genre = enriched.where("genre <> ''").groupBy("album_key").agg(F.min_by("genre", "position").alias("genre"))
    albums = catalogue(enriched).join(genre, "album_key", "left")
    # every user with every album is what is asked for; what was heard is summed before
    rows = albums.crossJoin(who).join(by_album, ["user_id", "album_key"], "left").na.fill(0, ["_heard", "_plays"])
    return rows.select(
        "user", "album_id", "artist", "album", S.iso(F.col("added_at")).alias("added_at"), F.col("track_count").alias("total_tracks"), F.col("_heard").alias("tracks_heard"), (F.col("track_count") - F.col("_heard")).alias("tracks_unheard"),
        S.share(F.col("_heard"), F.col("track_count")).alias("heard_pct"), F.col("_plays").alias("play_count"), S.iso(F.col("_when")).alias("last_played"), "year", F.coalesce("genre", F.lit("")).alias("genre"),
    )


def _flags(first: Column, last: Column, total: Column) -> tuple[Column, Column]:
    return (first > 0) & (first <= 2), (last > 0) & (last >= F.greatest(F.lit(1), total - 1))


def _meaningful(unique: Column, total: Column) -> Column:
    return (unique >= F.least(F.lit(3), total)) | (unique / total >= 0.50)


def album_runs(plays: DataFrame, enriched: DataFrame, gap_minutes: int, complete: float) -> DataFrame:
    """Stretches of plays of one album, nothing else in between, in the order of all
    users' plays; going back to the start after most of the album begins a new one."""
    log = with_previous(with_tracks(plays, enriched, "album_key", "position", "total"), enriched, "album_key", "position")
    gap = S.micros(F.col("at")) - S.micros(F.col("before.at"))
    prev, now = F.col("before.position"), F.col("position")
    restart = (now <= 2) & (prev >= F.greatest(F.lit(3), F.ceil(F.col("total") * 0.60)))
    goes_on = (F.col("user_id") == F.col("before.user_id")) & (F.col("album_key") == F.col("before.album_key")) & (gap <= minutes(gap_minutes)) & ~restart
    numbered = islands(log, ~F.coalesce(goes_on, F.lit(False)), "run_id").select("run_id", "track_id", "gidx", "at", "user_name", "position")
    facts = with_tracks(numbered.drop("position"), enriched, "title", "album_key", "cat_album_id", "cat_artist", "cat_album", "cat_year", "total")
    facts = facts.groupBy("run_id").agg(
        F.min_by(F.struct("user_name", "album_key", "cat_album_id", "cat_artist", "cat_album", "cat_year", "total"), "gidx").alias("f"),
        F.min("at").alias("_start"),
        F.max("at").alias("_end"),
        F.count("*").alias("scrobbles"),
        F.max_by("title", "gidx").alias("stop_track"),
    )
    firsts = numbered.groupBy("run_id", "track_id").agg(F.min("gidx").alias("_at"), F.first("position").alias("position"))
    own = Window.partitionBy("run_id").orderBy("_at")
    moved = firsts.withColumn("_prev", F.lag("position").over(own))
    steps = moved.groupBy("run_id").agg(
        F.count("*").alias("unique_tracks"),
        F.count("_prev").alias("_steps"),
        F.count_if(F.col("position") == F.col("_prev") + 1).alias("_next"),
        F.count_if(F.col("position") > F.col("_prev")).alias("_forward"),
        F.min_by("position", "_at").alias("first_position"),
        F.max_by("position", "_at").alias("last_position"),
    )
    rows = facts.join(steps, "run_id").select("*", "f.*").drop("f")
    total, unique, n = F.col("total"), F.col("unique_tracks"), F.col("_steps")
    rows = rows.select("*", (unique / total).alias("_completion"), F.when(n == 0, 1.0).otherwise(F.col("_next") / n).alias("_seq"), F.when(n == 0, 1.0).otherwise(F.col("_forward") / n).alias("_fwd"))
    starts, reaches = _flags(F.col("first_position"), F.col("last_position"), total)
    whole = F.col("_completion") >= complete
    ordered = (F.col("_seq") >= 0.60) | ((unique <= 2) & (F.col("_fwd") >= 0.5))
    full = whole & starts & reaches & ordered
    meant = _meaningful(unique, total)
    status = F.when(full, "completo_probable").when(whole, "casi_completo").when(meant & starts, "parcial_desde_inicio").when(meant, "parcial").otherwise("pista_suelta")
    mode = F.when(unique <= 2, "indeterminado").when(F.col("_seq") >= 0.65, "orden").when(F.col("_fwd") < 0.50, "shuffle_o_manual").otherwise("mixto")
    hundred = F.lit(100.0)
    return rows.select(
        "run_id", F.col("user_name").alias("user"), S.iso(F.col("_start")).alias("start"), S.iso(F.col("_end")).alias("end"), S.pyround(S.span(F.col("_start"), F.col("_end"), S.MINUTE), 1).alias("span_minutes"),
        "album_key", F.col("cat_album_id").alias("album_id"), F.col("cat_artist").alias("artist"), F.col("cat_album").alias("album"), F.col("cat_year").alias("release_year"), total.alias("library_tracks"), "scrobbles", "unique_tracks",
        S.pyround(hundred * F.col("_completion"), 1).alias("completion_pct"), S.pyround(hundred * F.col("_seq"), 1).alias("sequential_pct"), S.pyround(hundred * F.col("_fwd"), 1).alias("forward_pct"), "first_position", "last_position",
        starts.cast("int").alias("starts_at_beginning"), reaches.cast("int").alias("reaches_end"), whole.cast("int").alias("complete_like"), full.cast("int").alias("full_pass"), meant.cast("int").alias("meaningful"), status.alias("status"), mode.alias("listening_mode"), "stop_track",
        "_start", "_end",
    )


def _shared(pick: str) -> list[Column]:
    return [F.min_by(c, pick).alias(c) for c in ("album_id", "artist", "album", "release_year", "library_tracks")]


def album_completion(runs: DataFrame) -> DataFrame:
    """Meaningful runs by user and album."""
    rows = runs.where("meaningful = 1")
    by = ["user", "album_key"]
    started, whole = F.col("starts_at_beginning") == 1, F.col("complete_like") == 1
    stops = commonest(rows.where(started & ~whole).withColumn("gidx", F.col("run_id")), by, "stop_track", "favorite_stop_track").drop("favorite_stop_track_n")
    out = rows.groupBy(*by).agg(
        *_shared("run_id"),
        F.count("*").alias("album_runs"),
        F.sum("full_pass").alias("probable_full_plays"),
        F.sum("complete_like").alias("near_complete_runs"),
        F.sum("starts_at_beginning").alias("started_from_beginning"),
        F.count_if(started & ~whole & (F.col("completion_pct") >= 15)).alias("probable_abandons"),
        S.exact_mean(F.col("completion_pct")).alias("_mean"),
        F.median("completion_pct").alias("_median"),
        S.exact_mean(F.col("sequential_pct")).alias("_seq"),
    )
    return out.join(stops, by, "left").select(
        *by, "album_id", "artist", "album", "release_year", "library_tracks", "album_runs", "probable_full_plays", "near_complete_runs", "started_from_beginning", "probable_abandons",
        S.pyround(F.col("_mean"), 1).alias("avg_completion_pct"), S.pyround(F.col("_median"), 1).alias("median_completion_pct"), S.pyround(F.col("_seq"), 1).alias("avg_sequential_pct"),
        F.coalesce("favorite_stop_track", F.lit("")).alias("favorite_stop_track"), S.share(F.col("probable_full_plays"), F.col("album_runs")).alias("full_play_rate_pct"),
    )


def _returns(rows: DataFrame, days: int, left: str, number: str, pct: str) -> DataFrame:
    """Meaningful rows that follow the one before of the same user and album after so many
    days, counted from its `left` column to the next start."""
    own = Window.partitionBy("user", "album_key").orderBy("_start", number)
    pairs = rows.where("meaningful = 1").select("*", F.lag(left).over(own).alias("_before"), F.lag(pct).over(own).alias(f"before_{pct}"))
    silent = pairs.withColumn("_days", S.span(F.col("_before"), F.col("_start"), S.DAY)).where(F.col("_days") >= days)
    return silent.select("user", S.pyround(F.col("_days"), 1).alias("silent_days"), S.iso(F.col("_before")).alias("before"), F.col("start").alias("return"), "artist", "album", f"before_{pct}", F.col(pct).alias(f"return_{pct}"), "album_key")


def album_resurrections(runs: DataFrame, days: int) -> DataFrame:
    """Returns to an album, from start to start."""
    return _returns(runs, days, "_start", "run_id", "completion_pct")


def thread_resurrections(threads: DataFrame, days: int) -> DataFrame:
    """Returns to an album, from a thread's end to the next one's start."""
    return _returns(threads, days, "_end", "thread_id", "coverage_pct")


def album_transitions(runs: DataFrame, window_minutes: int) -> DataFrame:
    """Which album follows which in a user's meaningful runs."""
    own = Window.partitionBy("user").orderBy("_start", "run_id")
    pairs = runs.where("meaningful = 1").withColumn("_p", F.lag(F.struct("album_key", "artist", "album", "_end")).over(own))
    near = (F.col("_p.album_key") != F.col("album_key")) & (S.micros(F.col("_start")) - S.micros(F.col("_p._end")) <= minutes(window_minutes))
    grouped = pairs.where(near).groupBy("user", F.col("_p.album_key").alias("from_album_key"), F.col("album_key").alias("to_album_key"))
    out = grouped.agg(F.count("*").alias("times"), F.first("_p.artist").alias("from_artist"), F.first("_p.album").alias("from_album"), F.first("artist").alias("to_artist"), F.first("album").alias("to_album"))
    return out.select("user", "times", "from_artist", "from_album", "to_artist", "to_album", "from_album_key", "to_album_key")


def threaded(plays: DataFrame, enriched: DataFrame, gap_minutes: int, hours: float, slack: int) -> DataFrame:
    """Plays with `thread_id` and, in `prev`, the play before in the same thread."""
    key = ["user_id", "album_key"]
    own = Window.partitionBy(*key).orderBy("gidx")
    df = with_tracks(plays.drop("before", "seq", "_part"), enriched, "title", "album_key", "position", "total").withColumn("prev", F.lag(F.struct("at", "position", "gidx", "title")).over(own))
    gap = S.micros(F.col("at")) - S.micros(F.col("prev.at"))
    now, prev, total = F.col("position"), F.col("prev.position"), F.col("total")
    restart = (now <= 2) & (prev >= F.greatest(F.lit(3), F.ceil(total * 0.55)))
    back = now < prev - max(1, slack)
    forward = (now >= prev) & (now <= prev + 1 + max(0, slack))
    local = (F.col("gidx") == F.col("prev.gidx") + 1) & (gap <= minutes(max(1, gap_minutes)))
    goes_on = (gap <= F.lit(int(max(1.0, hours) * S.HOUR))) & ~restart & ~back & (forward | local | (now == prev))
    df = df.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    df = df.withColumn("_chunk", F.sum("_new").over(own)).withColumn("prev", F.when(F.col("_new") == 0, F.col("prev")))
    df = cut(df)
    # numbered by their first play; of equal times by the group first met, then in its order
    heads = df.where("_new = 1").withColumn("_group", F.min("gidx").over(Window.partitionBy(*key)))
    heads = heads.select(*key, "_chunk", "at", F.struct("_group", "_chunk").alias("seq"))
    placed = in_order(heads, (), boundaries(plays))
    numbered = placed.select(*key, "_chunk", (F.col("gidx") + 1).alias("thread_id"))
    return df.join(numbered, [*key, "_chunk"])


def album_threads(plays: DataFrame, enriched: DataFrame, quality: DataFrame, gap_minutes: int, hours: float, slack: int, complete: float) -> tuple[DataFrame, DataFrame]:
    """Threads of an album that a user takes up again and again, whatever is played in
    between, and the pauses in them."""
    plays = with_tracks(threaded(plays, enriched, gap_minutes, hours, slack), enriched, "cat_album_id", "cat_artist", "cat_album", "cat_year").join(quality.select("track_id", "confidence"), "track_id")
    rank = F.when(F.col("confidence") == "baja", 0).when(F.col("confidence") == "media", 1).otherwise(2)
    name = F.when(F.col("_worst") == 0, "baja").when(F.col("_worst") == 1, "media").otherwise("alta")
    own = Window.partitionBy("thread_id")
    plays = plays.select("*", (S.micros(F.col("at")) - F.min(S.micros(F.col("at"))).over(own)).alias("_since"), (S.micros(F.col("at")) - S.micros(F.col("prev.at"))).alias("_pause"))
    limit = minutes(max(1, gap_minutes))

    facts = plays.groupBy("thread_id").agg(
        F.min_by(F.struct("user_name", "album_key", "cat_album_id", "cat_artist", "cat_album", "cat_year", "total"), "gidx").alias("f"),
        F.min("at").alias("_start"),
        F.max("at").alias("_end"),
        F.count("*").alias("scrobbles"),
        F.array_sort(F.collect_list(F.struct("gidx", "position")))["position"].alias("_all"),
        F.count_if(F.col("_since") <= 24 * S.HOUR).alias("_n24"),
        F.count_if(F.col("_since") <= 48 * S.HOUR).alias("_n48"),
        F.min_by("position", "gidx").alias("first_position"),
        F.max_by("position", "gidx").alias("last_position"),
        F.count_if(F.col("_pause") > limit).alias("resume_count"),
        F.coalesce(F.max("_pause"), F.lit(0)).alias("_longest"),
        F.min(rank).alias("_worst"),
    )
    # plays go by time, so those of the first hours come first
    rows = facts.select("*", "f.*", T.rising("_all", "_n24", "_n48").alias("r")).drop("f").select("*", "r.*").drop("r").withColumnRenamed("_u", "unique_tracks")
    total, unique = F.col("total"), F.col("unique_tracks")
    starts, reaches = _flags(F.col("first_position"), F.col("last_position"), total)
    whole, ordered = unique / total >= complete, F.col("_l") / total >= max(0.50, complete - 0.20)
    full, meant = whole & starts & reaches & ordered, _meaningful(unique, total)
    status = F.when(full, "completo_logico").when(whole & ordered, "casi_completo_logico").when(meant & starts, "parcial_desde_inicio").when(meant, "parcial").otherwise("pista_suelta")

    def part(c: str) -> Column:
        return S.pyround(F.lit(100.0) * (F.col(c) / total), 1)

    threads = rows.select(
        "thread_id", F.col("user_name").alias("user"), S.iso(F.col("_start")).alias("start"), S.iso(F.col("_end")).alias("end"), S.pyround(S.span(F.col("_start"), F.col("_end"), S.HOUR), 2).alias("span_hours"),
        "album_key", F.col("cat_album_id").alias("album_id"), F.col("cat_artist").alias("artist"), F.col("cat_album").alias("album"), F.col("cat_year").alias("release_year"), total.alias("library_tracks"), "scrobbles", "unique_tracks",
        part("unique_tracks").alias("coverage_pct"), part("_l").alias("ordered_coverage_pct"), part("_u24").alias("coverage_24h_pct"), part("_l24").alias("ordered_coverage_24h_pct"), part("_u48").alias("coverage_48h_pct"), part("_l48").alias("ordered_coverage_48h_pct"),
        "first_position", "last_position", starts.cast("int").alias("starts_at_beginning"), reaches.cast("int").alias("reaches_end"), "resume_count", S.pyround(F.col("_longest") / F.lit(1e6) / F.lit(3600.0), 2).alias("max_pause_hours"),
        whole.cast("int").alias("complete_like"), full.cast("int").alias("full_thread"), meant.cast("int").alias("meaningful"), status.alias("status"), name.alias("metadata_confidence"),
        "_start", "_end",
    )
    resumed = plays.where(F.col("_pause") > limit).join(facts.select("thread_id", "_worst"), "thread_id")
    resumes = resumed.select(
        "thread_id", F.col("user_name").alias("user"), F.col("cat_artist").alias("artist"), F.col("cat_album").alias("album"), S.pyround(F.col("_pause") / F.lit(1e6) / F.lit(3600.0), 2).alias("pause_hours"), S.iso(F.col("prev.at")).alias("from_time"), S.iso(F.col("at")).alias("to_time"),
        F.col("prev.position").alias("from_position"), F.col("position").alias("to_position"), F.col("prev.title").alias("from_title"), F.col("title").alias("to_title"), (F.col("gidx") - F.col("prev.gidx") - 1).alias("interleaved_scrobbles"), name.alias("metadata_confidence"),
    )
    return threads, resumes


def thread_completion(threads: DataFrame) -> DataFrame:
    """Meaningful threads by user and album."""
    by = ["user", "album_key"]
    started, whole = F.col("starts_at_beginning") == 1, F.col("complete_like") == 1
    out = threads.where("meaningful = 1").groupBy(*by).agg(
        *_shared("thread_id"),
        F.count("*").alias("logical_threads"),
        F.sum("full_thread").alias("probable_full_plays"),
        F.count_if(F.col("resume_count") > 0).alias("resumed_threads"),
        F.count_if(started & ~whole & (F.col("coverage_pct") >= 15)).alias("probable_abandons_after_window"),
        S.exact_mean(F.col("coverage_pct")).alias("_mean"),
        F.median("coverage_pct").alias("_median"),
        S.exact_mean(F.col("ordered_coverage_pct")).alias("_ordered"),
        S.exact_mean(F.col("coverage_24h_pct")).alias("_c24"),
        S.exact_mean(F.col("coverage_48h_pct")).alias("_c48"),
    )
    return out.select(
        *by, "album_id", "artist", "album", "release_year", "library_tracks", "logical_threads", "probable_full_plays", "resumed_threads", "probable_abandons_after_window",
        S.pyround(F.col("_mean"), 1).alias("avg_coverage_pct"), S.pyround(F.col("_median"), 1).alias("median_coverage_pct"), S.pyround(F.col("_ordered"), 1).alias("avg_ordered_coverage_pct"),
        S.pyround(F.col("_c24"), 1).alias("avg_coverage_24h_pct"), S.pyround(F.col("_c48"), 1).alias("avg_coverage_48h_pct"), S.share(F.col("probable_full_plays"), F.col("logical_threads")).alias("full_play_rate_pct"),
    )

"""The fixed catalogue of queries over a library, and the same as SQL for the driver's
star schema."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.config import EngineConfig
from playlog.functions.session import cut
from playlog.operators import albums, model, plays, quality
from playlog.sources.tables import Library, from_star_schema

#: The star schema's events span thirty days.
STAR_CONFIG = EngineConfig(resurrection_days=7, transition_window=24 * 60)


class Analyses:
    """All analyses of a library, each built when first asked for; what several need is
    built once and, with `keep`, materialised."""

    def __init__(self, library: Library, config: EngineConfig, keep: bool = False):
        self.library = library
        self.keep = keep
        self.config = config.clamped()

    @cached_property
    def enriched(self) -> DataFrame:
        return model.enrich(self.library.tracks)

    @cached_property
    def heard(self) -> DataFrame:
        """Plays with their tracks, for what needs no place in the order of all plays."""
        return self._kept(model.heard(self.library.plays, self.enriched))

    @cached_property
    def ordered(self) -> DataFrame:
        return model.ordered(self.library.plays, self.library.tracks)

    @cached_property
    def log(self) -> DataFrame:
        return self._kept(model.with_tracks(self.ordered, self.enriched))

    def with_annotations(self, annotations: DataFrame) -> Analyses:
        """The same over other counters; what was built before is shared, none of it depends on them."""
        other = copy(self)
        other.library = replace(self.library, annotations=annotations)
        return other

    def _kept(self, df: DataFrame) -> DataFrame:
        return cut(df) if self.keep else df

    @cached_property
    def quality(self) -> DataFrame:
        return quality.metadata_quality(self.library.tracks)

    @cached_property
    def runs(self) -> DataFrame:
        return self._kept(albums.album_runs(self.ordered, self.enriched, self.config.session_gap, self.config.album_complete))

    @cached_property
    def _threads(self) -> tuple[DataFrame, DataFrame]:
        c = self.config
        threads, events = albums.album_threads(self.ordered, self.enriched, self.quality, c.session_gap, c.thread_hours, c.resume_slack, c.album_complete)
        return self._kept(threads), self._kept(events)

    def sessions(self) -> DataFrame:
        return plays.sessions(self.ordered, self.enriched, self.config.session_gap)

    def sessions_by_user(self) -> DataFrame:
        return plays.sessions(self.heard.select("gidx", "at", "user_id", "user_name", "track_id"), self.enriched, self.config.session_gap, scope="user")

    def weekly_obsessions(self) -> DataFrame:
        return plays.weekly_obsessions(self.heard)

    def resurrections(self) -> DataFrame:
        return plays.resurrections(self.heard, self.config.resurrection_days)

    def track_pairs(self) -> DataFrame:
        return plays.track_pairs(self.log, self.enriched, self.config.pair_window)

    def context_jumps(self) -> DataFrame:
        return plays.context_jumps(self.log, self.enriched, self.config.pair_window)

    def discoveries(self) -> DataFrame:
        return plays.discoveries(self.heard)

    def weekly_album_dominance(self) -> DataFrame:
        return plays.weekly_dominance(self.heard, "album")

    def weekly_artist_dominance(self) -> DataFrame:
        return plays.weekly_dominance(self.heard, "artist")

    def album_eras(self) -> DataFrame:
        return plays.dominance_eras(self.weekly_album_dominance(), "album")

    def artist_eras(self) -> DataFrame:
        return plays.dominance_eras(self.weekly_artist_dominance(), "artist")

    def historical_vs_recent_albums(self) -> DataFrame:
        return plays.historical_vs_recent(self.heard, self.enriched, self.library.annotations, self.library.users, "album")

    def historical_vs_recent_artists(self) -> DataFrame:
        return plays.historical_vs_recent(self.heard, self.enriched, self.library.annotations, self.library.users, "artist")

    def artist_depth(self) -> DataFrame:
        return plays.artist_depth(self.heard, self.enriched)

    def top_tracks(self) -> DataFrame:
        return plays.top_tracks(self.heard)

    def monthly(self) -> DataFrame:
        return plays.counts_by(self.heard, month=F.date_format("at", "yyyy-MM"))

    def yearly(self) -> DataFrame:
        return plays.counts_by(self.heard, year=F.year("at"))

    def hourly(self) -> DataFrame:
        return plays.counts_by(self.heard, hour=F.hour("at"))

    def user_counts(self) -> DataFrame:
        return plays.counts_by(self.heard, user=F.col("user_name"))

    def artist_counts(self) -> DataFrame:
        return plays.counts_by(self.heard, artist=F.col("artist"))

    def album_counts(self) -> DataFrame:
        return plays.counts_by(self.heard, artist=F.col("artist"), album=F.col("album"))

    def genre_counts(self) -> DataFrame:
        return plays.genre_counts(self.heard)

    def plays_export(self) -> DataFrame:
        return plays.plays_export(self.heard, self.enriched)

    def library_summary(self) -> DataFrame:
        return plays.library_summary(self.enriched, self.heard)

    def album_catalog(self) -> DataFrame:
        return model.catalogue(self.enriched).drop("added_at")

    def album_library_coverage(self, selected: list[str] | None = None) -> DataFrame:
        return albums.library_coverage(self.heard, self.enriched, self.library.annotations, self.library.users, selected)

    def album_runs(self) -> DataFrame:
        return self.runs

    def album_completion(self) -> DataFrame:
        return albums.album_completion(self.runs)

    def album_resurrections(self) -> DataFrame:
        return albums.album_resurrections(self.runs, self.config.resurrection_days)

    def album_transitions(self) -> DataFrame:
        return albums.album_transitions(self.runs, self.config.transition_window or self.config.session_gap)

    def album_threads(self) -> DataFrame:
        return self._threads[0]

    def album_resume_events(self) -> DataFrame:
        return self._threads[1]

    def album_thread_completion(self) -> DataFrame:
        return albums.thread_completion(self._threads[0])

    def album_thread_resurrections(self) -> DataFrame:
        return albums.thread_resurrections(self._threads[0], self.config.resurrection_days)

    def album_metadata_issues(self) -> DataFrame:
        return quality.duplicate_entities(self.enriched)

    def metadata_issues(self) -> DataFrame:
        return quality.metadata_issues(self.quality)

    def legacy_playcounts(self) -> DataFrame:
        """Accumulated counters alone, for libraries without dated plays."""
        rows = self.library.annotations.join(self.enriched, F.col("track_id") == F.col("id"))
        named = model.labelled(self.library.users, rows.drop("user_name"))
        return named.select("user", "play_count", F.date_format("last_played", "yyyy-MM-dd HH:mm:ss").alias("last_played"), "track_id", "artist", "album", "title", "genre", F.when(F.col("year") != 0, F.col("year")).alias("release_year"))

    def legacy_artist_counts(self) -> DataFrame:
        return self.legacy_playcounts().groupBy("artist").agg(F.sum("play_count").alias("play_count"))

    def legacy_album_counts(self) -> DataFrame:
        return self.legacy_playcounts().groupBy("artist", "album").agg(F.sum("play_count").alias("play_count"))


NAMES = tuple(n for n in vars(Analyses) if not n.startswith("_") and n not in ("enriched", "heard", "log", "ordered", "quality", "runs", "with_annotations"))


def visible(df: DataFrame) -> DataFrame:
    """Without helper columns."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return visible(getattr(Analyses(from_star_schema(spark, sf_dir), STAR_CONFIG), name)())

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in NAMES}

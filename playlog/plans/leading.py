"""The leading rows of every artefact, by place: what the report shows, as one DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playlog.plans.artefacts import order_of, rows_of
from playlog.plans.catalogue import STAR_CONFIG, Analyses
from playlog.sources.tables import from_star_schema

#: The columns that name a row of each artefact.
NAMED: dict[str, str] = {
    "album_completion": "user album_key",
    "album_eras": "user start_week end_week",
    "album_library_coverage": "user album_id",
    "album_metadata_issues": "album_key",
    "album_resume_events": "thread_id from_time to_time",
    "album_resurrections": "user album_key return",
    "album_runs": "run_id",
    "album_thread_completion": "user album_key",
    "album_thread_resurrections": "user album_key return",
    "album_threads": "thread_id",
    "album_transitions": "user from_album_key to_album_key",
    "artist_depth": "artist",
    "artist_eras": "user start_week end_week",
    "context_jumps": "user at from_title to_title",
    "discoveries": "user first_play track_id",
    "historical_vs_recent_albums": "user album_key",
    "historical_vs_recent_artists": "user artist",
    "legacy_playcounts": "user track_id",
    "metadata_issues": "track_id",
    "monthly": "month",
    "plays": "datetime user track_id",
    "resurrections": "user return track_id",
    "sessions": "session_id",
    "top_tracks": "track_id",
    "track_pairs": "user from_track_id to_track_id",
    "weekly_album_dominance": "user year week",
    "weekly_obsessions": "year week user track_id",
}


def leading_rows(analyses: Analyses, top: int | None = None) -> DataFrame:
    """`artefact`, `position` (from 1) and `row`, its naming columns joined by `|`, of the first `top`
    rows (the configuration's, if null) of each artefact in the artefact's order.  An analysis
    without rows gives none.  Each is cut to its leading rows before they're numbered."""

    def leading(name: str) -> DataFrame:
        order = order_of(name)
        few = rows_of(analyses, name).orderBy(*order).limit(top or analyses.config.top)
        place = F.row_number().over(Window.orderBy(*order))
        return few.select(F.lit(name).alias("artefact"), place.alias("position"), F.concat_ws("|", *[F.col(c).cast("string") for c in NAMED[name].split()]).alias("row"))

    return reduce(DataFrame.unionByName, [leading(name) for name in NAMED])


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leading_rows(Analyses(from_star_schema(spark, sf_dir), STAR_CONFIG, keep=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"leading_rows": _query}

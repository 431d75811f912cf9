"""Report artefacts: one CSV file for each result, and a text report of the leading rows.

Files are for reading, so they are written by the driver row by row with the standard csv
module (header, CRLF, blanks for nulls, plain floats); for further processing write the
DataFrames as Parquet instead.
"""

from __future__ import annotations

import csv
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlog.plans.catalogue import Analyses, visible

# Columns of each file, in order.
FIELDS: dict[str, list[str]] = {
    "album_metadata_issues": ["album_key", "album_id", "artist", "album", "year", "track_count", "track_ids", "track_titles", "paths", "related_album_ids", "related_album_keys", "signals"],
    "album_library_coverage": ["user", "album_id", "artist", "album", "added_at", "total_tracks", "tracks_heard", "tracks_unheard", "heard_pct", "play_count", "last_played", "year", "genre"],
    "album_completion": ["user", "album_key", "album_id", "artist", "album", "release_year", "library_tracks", "album_runs", "probable_full_plays", "near_complete_runs", "started_from_beginning", "probable_abandons", "avg_completion_pct", "median_completion_pct", "avg_sequential_pct", "favorite_stop_track", "full_play_rate_pct"],
    "album_eras": ["user", "level", "start_week", "end_week", "weeks", "artist", "album", "dominant_plays", "period_total", "avg_share_pct"],
    "artist_eras": ["user", "level", "start_week", "end_week", "weeks", "artist", "album", "dominant_plays", "period_total", "avg_share_pct"],
    "album_resume_events": ["thread_id", "user", "artist", "album", "pause_hours", "from_time", "to_time", "from_position", "to_position", "from_title", "to_title", "interleaved_scrobbles", "metadata_confidence"],
    "album_resurrections": ["user", "silent_days", "before", "return", "artist", "album", "before_completion_pct", "return_completion_pct", "album_key"],
    "album_runs": ["run_id", "user", "start", "end", "span_minutes", "album_key", "album_id", "artist", "album", "release_year", "library_tracks", "scrobbles", "unique_tracks", "completion_pct", "sequential_pct", "forward_pct", "first_position", "last_position", "starts_at_beginning", "reaches_end", "complete_like", "full_pass", "meaningful", "status", "listening_mode", "stop_track"],
    "album_thread_completion": ["user", "album_key", "album_id", "artist", "album", "release_year", "library_tracks", "logical_threads", "probable_full_plays", "resumed_threads", "probable_abandons_after_window", "avg_coverage_pct", "median_coverage_pct", "avg_ordered_coverage_pct", "avg_coverage_24h_pct", "avg_coverage_48h_pct", "full_play_rate_pct"],
    "album_thread_resurrections": ["user", "silent_days", "before", "return", "artist", "album", "before_coverage_pct", "return_coverage_pct", "album_key"],
    "album_threads": ["thread_id", "user", "start", "end", "span_hours", "album_key", "album_id", "artist", "album", "release_year", "library_tracks", "scrobbles", "unique_tracks", "coverage_pct", "ordered_coverage_pct", "coverage_24h_pct", "ordered_coverage_24h_pct", "coverage_48h_pct", "ordered_coverage_48h_pct", "first_position", "last_position", "starts_at_beginning", "reaches_end", "resume_count", "max_pause_hours", "complete_like", "full_thread", "meaningful", "status", "metadata_confidence"],
    "album_transitions": ["user", "times", "from_artist", "from_album", "to_artist", "to_album", "from_album_key", "to_album_key"],
    "artist_depth": ["artist", "plays", "library_tracks", "heard_tracks", "track_breadth_pct", "library_albums", "heard_albums", "album_breadth_pct", "top_album_share_pct", "top_track_share_pct"],
    "context_jumps": ["user", "at", "score", "confidence", "from_artist", "from_title", "from_genre", "from_year", "to_artist", "to_title", "to_genre", "to_year", "evidence"],
    "discoveries": ["user", "plays", "lifespan_days", "first_play", "last_play", "artist", "title", "album", "track_id"],
    "historical_vs_recent_albums": ["user", "artist", "album", "album_key", "historical_total", "recent_scrobbles", "estimated_before_history", "recent_share_pct", "mismatch_tracks", "profile"],
    "historical_vs_recent_artists": ["user", "artist", "historical_total", "recent_scrobbles", "estimated_before_history", "recent_share_pct", "mismatch_tracks", "profile"],
    "legacy_playcounts": ["user", "play_count", "last_played", "track_id", "artist", "album", "title", "genre", "release_year"],
    "metadata_issues": ["track_id", "artist", "album", "disc_number", "track_number", "path_track_number", "title", "path", "title_path_similarity", "issues", "confidence"],
    "monthly": ["month", "plays"],
    "plays": ["datetime", "date", "year", "month", "weekday", "hour", "user", "track_id", "artist", "album_artist", "album", "album_id", "disc_number", "track_number", "title", "genre", "release_year", "duration", "path", "mbid"],
    "resurrections": ["user", "silent_days", "before", "return", "artist", "title", "album", "track_id"],
    "sessions": ["session_id", "user", "start", "end", "span_minutes", "tracks", "unique_tracks", "estimated_music_minutes", "top_artist", "top_album", "top_genre"],
    "top_tracks": ["plays", "artist", "title", "album", "genre", "release_year", "track_id"],
    "track_pairs": ["user", "times", "from_artist", "from_title", "to_artist", "to_title", "from_track_id", "to_track_id"],
    "weekly_album_dominance": ["user", "year", "week", "week_start", "plays", "week_total", "share_pct", "artist", "album", "entity_key"],
    "weekly_obsessions": ["year", "week", "user", "plays", "week_total", "share", "artist", "title", "album", "track_id"],
}
#: Order of each file's rows: `-` before a column means falling; what was met first goes
#: first among equals.
ORDER: dict[str, str] = {
    "album_metadata_issues": "~artist ~album track_count album_key",
    "album_library_coverage": "~user ~artist ~album album_id",
    "album_completion": "-probable_full_plays -album_runs -avg_completion_pct user album_key",
    "album_eras": "-weeks -dominant_plays -avg_share_pct user start_week",
    "artist_eras": "-weeks -dominant_plays -avg_share_pct user start_week",
    "album_resume_events": "-pause_hours thread_id from_time",
    "album_resurrections": "-silent_days user album_key return",
    "album_runs": "run_id",
    "album_thread_completion": "-probable_full_plays -logical_threads -avg_coverage_pct user album_key",
    "album_thread_resurrections": "-silent_days user album_key return",
    "album_threads": "thread_id",
    "album_transitions": "-times user from_album_key to_album_key",
    "artist_depth": "-plays -track_breadth_pct artist",
    "context_jumps": "-score !confidence _first",
    "discoveries": "-lifespan_days -plays _first",
    "historical_vs_recent_albums": "-historical_total -recent_scrobbles user album_key",
    "historical_vs_recent_artists": "-historical_total -recent_scrobbles user artist",
    "legacy_playcounts": "-play_count user track_id",
    "metadata_issues": "?confidence artist album track_number track_id",
    "monthly": "month",
    "plays": "_first",
    "resurrections": "-silent_days _first",
    "sessions": "session_id",
    "top_tracks": "-plays _first",
    "track_pairs": "-times _first",
    "weekly_album_dominance": "user year week",
    "weekly_obsessions": "-year -week -plays _first",
}
BASE = ("plays", "weekly_obsessions", "resurrections", "track_pairs", "sessions", "discoveries", "context_jumps", "top_tracks", "monthly", "album_runs", "album_completion", "album_resurrections", "album_transitions", "weekly_album_dominance", "album_eras", "artist_eras", "historical_vs_recent_albums", "historical_vs_recent_artists", "artist_depth")
THREADS = ("album_threads", "album_thread_completion", "album_resume_events", "album_thread_resurrections", "metadata_issues")


def order_of(name: str) -> list[Column]:
    keys = []
    for key in ORDER[name].split():
        column = F.col(key.lstrip("-~!?"))
        if key[0] == "-":
            keys.append(column.desc())
        elif key[0] == "~":
            keys.append(F.lower(column))
        elif key[0] == "!":
            keys.append((column == "alta").desc())
        elif key[0] == "?":
            keys.append(F.when(column == "baja", 0).when(column == "media", 1).otherwise(2))
        else:
            keys.append(column)
    return keys


def ordered(name: str, df: DataFrame) -> DataFrame:
    return df.orderBy(*order_of(name))


def rows_of(analyses: Analyses, name: str) -> DataFrame:
    return getattr(analyses, "plays_export" if name == "plays" else name)()


def frame(analyses: Analyses, name: str) -> DataFrame:
    return ordered(name, rows_of(analyses, name)).select(*FIELDS[name])


def write_csv(df: DataFrame, path: Path) -> None:
    with path.open("w", encoding="utf-8", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])


def export(analyses: Analyses, names: tuple[str, ...], folder: Path) -> None:
    for name in names:
        write_csv(frame(analyses, name), folder / f"{name}.csv")


# ---- the text report ----


def thousands(n: int) -> str:
    return f"{n:,}".replace(",", ".")


def percent(part: float, whole: float) -> str:
    return (f"{100 * part / whole:.1f}%" if whole else "0,0%").replace(".", ",")


def length(seconds: float) -> str:
    """Days, hours and minutes; nothing below zero."""
    minutes = max(0, int(seconds or 0)) // 60
    days, hours, minutes = minutes // 1440, minutes // 60 % 24, minutes % 60
    if days:
        return f"{days} d {hours:02d} h {minutes:02d} min"
    return f"{hours} h {minutes:02d} min" if hours else f"{minutes} min"


def bar(n: int, most: int) -> str:
    return "█" * max(1, round(30 * n / most))


class Report:
    def __init__(self) -> None:
        self.lines: list[str] = []

    def title(self, text: str) -> None:
        self.lines += ["", text, "=" * 72]

    def section(self, title: str, rows: list[Any], form: str, none: str = "(nada)") -> None:
        """A heading and a line for each row by its format."""
        self.lines += ["", title, "-" * 72]
        self.lines += [form.format(**{k: ("" if v is None else v) for k, v in r.asDict().items()}) for r in rows] or [none]

    def text(self) -> str:
        return "\n".join(self.lines).lstrip("\n") + "\n"


def history_text(a: Analyses, source: str) -> str:
    """Headline figures and the leading rows of each analysis."""
    c, out = a.config, Report()
    top = c.top
    facts = a.heard.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"), F.count_distinct("track_id").alias("tracks"), F.sum("duration").alias("seconds")).first()
    if not facts["n"]:
        return "No hay reproducciones para lo que se ha pedido.\n"
    sessions = a.sessions().agg(F.count("*").alias("n"), F.median("tracks").alias("median")).first()
    runs = a.runs.where("meaningful = 1").agg(F.count("*").alias("n"), F.coalesce(F.sum("full_pass"), F.lit(0)).alias("full")).first()
    out.title("HISTORIAL DE ESCUCHA")
    out.lines += [
        f"Origen: {source}",
        f"Periodo: {facts['first']:%Y-%m-%d %H:%M} → {facts['last']:%Y-%m-%d %H:%M}",
        f"Reproducciones: {thousands(facts['n'])}; canciones distintas: {thousands(facts['tracks'])}",
        f"Repeticiones: {thousands(facts['n'] - facts['tracks'])} ({percent(facts['n'] - facts['tracks'], facts['n'])})",
        f"Música: {length(facts['seconds'])}",
        f"Sesiones (corte de {c.session_gap} min): {thousands(sessions['n'])}; mediana de canciones: {sessions['median']:g}",
        f"Pasadas de álbum: {thousands(runs['n'])}; completas: {thousands(runs['full'])} ({percent(runs['full'], runs['n'])}), umbral {c.album_complete * 100:.0f}%",
    ]

    def rows(name: str, where: str = "true", order: list | None = None, k: int = top) -> list[Any]:
        df = getattr(a, name)().where(where)
        return (df.orderBy(*order) if order else ordered(name, df)).limit(k).collect()

    def counts(name: str, *keys: str) -> list[Any]:
        return rows(name, order=[F.desc("plays"), *keys])

    users = counts("user_counts", "user")
    if len(users) > 1:
        out.section("USUARIOS", users, "{plays:7d}  {user}")
    album = "{artist} — {album}"
    out.section("ÁLBUMES ESCUCHADOS ENTEROS", rows("album_completion", "probable_full_plays > 0"), "{probable_full_plays:4d} completas | {album_runs:3d} pasadas | {avg_completion_pct:5.1f}% | " + album)
    out.section("ÁLBUMES POR PASADAS", rows("album_completion", order=[F.desc("album_runs"), F.desc("avg_completion_pct"), "user", "album_key"]), "{album_runs:4d} pasadas | {probable_full_plays:3d} completas | {median_completion_pct:5.1f}% | " + album)
    out.section("ÁLBUMES DEJADOS A MEDIAS", rows("album_completion", "probable_abandons > 0", [F.desc("probable_abandons"), F.desc("started_from_beginning"), "user", "album_key"]), "{probable_abandons:3d} de {started_from_beginning:3d} inicios | " + album + " | {favorite_stop_track}")
    out.section("DE UN ÁLBUM A OTRO", rows("album_transitions", "times >= 2"), "{times:3d}x  {from_artist} — {from_album} → {to_artist} — {to_album}")
    out.section(f"ÁLBUMES QUE VUELVEN (≥ {c.resurrection_days} días)", rows("album_resurrections"), "{silent_days:7.1f} días | " + album)
    out.section("ERAS DE ARTISTA", rows("artist_eras", "weeks >= 2"), "{start_week} → {end_week} | {weeks:2d} semanas | {avg_share_pct:5.1f}% | {artist}")
    out.section("ERAS DE ÁLBUM", rows("album_eras", "weeks >= 2"), "{start_week} → {end_week} | {weeks:2d} semanas | {avg_share_pct:5.1f}% | " + album)
    out.section("ANTES Y AHORA", rows("historical_vs_recent_albums"), "{historical_total:5d} en total | {recent_scrobbles:4d} recientes | {recent_share_pct!s:>5}% | {profile:11s} | " + album)
    out.section("CANCIONES", rows("top_tracks"), "{plays:7d}  {artist} — {title}")
    out.section("ARTISTAS", counts("artist_counts", "artist"), "{plays:7d}  {artist}")
    out.section("ÁLBUMES", counts("album_counts", "artist", "album"), "{plays:7d}  " + album)
    out.section("GÉNEROS", counts("genre_counts", "genre"), "{plays:7d}  {genre}")
    out.section("POR AÑO", rows("yearly", order=["year"], k=1000), "{year}: {plays}")
    hours = rows("hourly", order=["hour"], k=24)
    most = max(r["plays"] for r in hours)
    out.lines += ["", "POR HORA", "-" * 72, *[f"{r['hour']:02d}:00  {r['plays']:7d}  {bar(r['plays'], most)}" for r in hours]]
    out.section("OBSESIONES DE LA SEMANA", rows("weekly_obsessions", order=[F.desc("plays"), F.desc("year"), F.desc("week"), "_first"]), "{year}-W{week:02d}  {plays:3d}x ({share}%)  {artist} — {title}")
    out.section(f"CANCIONES QUE VUELVEN (≥ {c.resurrection_days} días)", rows("resurrections"), "{silent_days:7.1f} días | {artist} — {title}")
    out.section(f"PAREJAS (en {c.pair_window} min)", rows("track_pairs"), "{times:4d}x  {from_artist} — {from_title} → {to_artist} — {to_title}")
    out.section("SESIONES MÁS LARGAS", rows("sessions", order=[F.desc("tracks"), "session_id"]), "{tracks:4d} pistas | {span_minutes:7.1f} min | {start:.16} | {top_artist}")
    out.section("DESCUBRIMIENTOS", rows("discoveries"), "{lifespan_days:8.0f} días | {plays:4d}x | {artist} — {title}")
    out.section("SALTOS", rows("context_jumps"), "{score:5.1f} [{confidence}] {from_artist} — {from_title} → {to_artist} — {to_title}")
    return out.text()


def threads_text(a: Analyses) -> str:
    """Albums taken up again: threads, pauses, abandons, and suspicious tags."""
    c, out = a.config, Report()
    top = c.top
    told = a.album_threads().where("meaningful = 1").agg(F.count("*").alias("n"), F.coalesce(F.sum("full_thread"), F.lit(0)).alias("full"), F.count_if(F.col("resume_count") > 0).alias("resumed"), F.count_if(F.col("metadata_confidence") == "baja").alias("low")).first()
    issues = a.metadata_issues()
    out.title("HILOS DE ÁLBUM")
    out.lines += [
        f"Un hilo sigue si se retoma antes de {c.thread_hours:g} h cerca de donde quedó (holgura {c.resume_slack}).",
        f"Hilos: {thousands(told['n'])}; completos: {thousands(told['full'])} ({percent(told['full'], told['n'])}); con pausas: {thousands(told['resumed'])} ({percent(told['resumed'], told['n'])})",
        f"Avisos de etiquetas: {thousands(issues.count())}; hilos de poca confianza: {thousands(told['low'])}",
    ]
    done = a.album_thread_completion()
    album = "{artist} — {album}"
    best = ordered("album_thread_completion", done.where("probable_full_plays > 0")).limit(top).collect()
    out.section("COMPLETOS", best, "{probable_full_plays:4d} completas | {logical_threads:3d} hilos | {resumed_threads:3d} retomados | {avg_coverage_pct:5.1f}% | " + album)
    out.section("PAUSAS", ordered("album_resume_events", a.album_resume_events()).limit(top).collect(), "{pause_hours:6.2f} h | {from_position} → {to_position} | " + album + " | {from_title} → {to_title} | en medio: {interleaved_scrobbles}")
    left = done.where("probable_abandons_after_window > 0").orderBy(F.desc("probable_abandons_after_window"), F.desc("logical_threads"), "user", "album_key").limit(top).collect()
    out.section("ABANDONOS", left, "{probable_abandons_after_window:3d} de {logical_threads:3d} hilos | {median_coverage_pct:5.1f}% | " + album)
    cover = done.orderBy(F.desc("avg_coverage_48h_pct"), F.desc("logical_threads"), "user", "album_key").limit(top).collect()
    out.section("COBERTURA A 24 Y 48 H", cover, "{avg_coverage_24h_pct:5.1f}% / {avg_coverage_48h_pct:5.1f}% | orden {avg_ordered_coverage_pct:5.1f}% | " + album)
    out.section("ETIQUETAS SOSPECHOSAS", ordered("metadata_issues", issues).limit(top).collect(), "[{confidence}] " + album + " — {title} | {issues} | {path}")
    return "\n" + out.text()


def legacy_text(a: Analyses) -> str:
    out, top = Report(), a.config.top
    rows = a.legacy_playcounts()
    told = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("play_count"), F.lit(0)).alias("plays")).first()
    out.title("CONTADORES ACUMULADOS")
    out.lines += ["Sin fechas no hay sesiones, semanas ni secuencias.", f"Reproducciones: {thousands(told['plays'])}; canciones: {thousands(told['n'])}"]
    out.section("CANCIONES", ordered("legacy_playcounts", rows).limit(top).collect(), "{play_count:7d}  {artist} — {title}")
    out.section("ARTISTAS", a.legacy_artist_counts().orderBy(F.desc("play_count"), "artist").limit(top).collect(), "{play_count:7d}  {artist}")
    out.section("ÁLBUMES", a.legacy_album_counts().orderBy(F.desc("play_count"), "artist", "album").limit(top).collect(), "{play_count:7d}  {artist} — {album}")
    return out.text()


def library_text(a: Analyses, with_plays: bool) -> str:
    from playlog.functions.scalars import split_genres

    out = Report()
    totals = a.enriched.agg(F.count("*").alias("n"), F.count_distinct("artist").alias("artists"), F.count_distinct("artist", "album").alias("albums"), F.sum("duration").alias("seconds")).first()
    out.title("BIBLIOTECA")
    out.lines += [f"Canciones: {thousands(totals['n'])}; artistas: {thousands(totals['artists'])}; álbumes: {thousands(totals['albums'])}", f"Duración: {length(totals['seconds'] or 0)}"]
    if with_plays:
        heard = a.heard.agg(F.count_distinct("track_id")).first()[0]
        out.lines.append(f"Escuchadas: {thousands(heard)}; nunca: {thousands(max(0, totals['n'] - heard))} ({percent(max(0, totals['n'] - heard), totals['n'])})")
    genres = a.enriched.select(F.explode(split_genres(F.col("genre"))).alias("genre")).groupBy("genre").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genre").limit(20).collect()
    out.section("GÉNEROS", genres, "{n:7d}  {genre}")
    split = a.album_metadata_issues()
    out.section("ÁLBUMES REPETIDOS O PARTIDOS", ordered("album_metadata_issues", split).limit(20).collect(), "{artist} — {album} [{album_key}] | {track_count} pistas | {signals}")
    return "\n" + out.text()


__all__ = ["BASE", "FIELDS", "ORDER", "THREADS", "export", "frame", "history_text", "legacy_text", "library_text", "threads_text", "visible", "write_csv"]

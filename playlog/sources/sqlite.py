"""A read-only SQLite library: which table is a play log, and the model's inputs from it.

The reader is a Python data source.  Cells come as text; for columns named in `typed`
their storage class comes along, since a number and the same digits as text are different
dates.  Tables are read by ranges of row ids, in parallel; the file must lie where all
executors see it.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from playlog.functions import scalars as S
from playlog.operators.model import UNKNOWN_USER
from playlog.sources.tables import Library

PART_ROWS = 200_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(Path(path).resolve().as_uri() + "?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class _Rows(InputPartition):
    first: int
    last: int


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table = options["path"], options["table"]
        self.columns: list[str] = json.loads(options["columns"])
        self.typed: list[str] = json.loads(options.get("typed", "[]"))

    def partitions(self) -> list[InputPartition]:
        db = _open(self.path)
        try:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a table without row ids is read in one part
            return [_Rows(0, -1)]
        finally:
            db.close()
        if low is None:
            return [_Rows(1, 0)]
        return [_Rows(a, min(a + PART_ROWS - 1, high)) for a in range(low, high + 1, PART_ROWS)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        names = [f"CAST({_quoted(c)} AS TEXT)" for c in self.columns] + [f"typeof({_quoted(c)})" for c in self.typed]
        db = _open(self.path)
        try:
            if partition.last == -1:
                rows = db.execute(f"SELECT {', '.join(names)} FROM {_quoted(self.table)}")
                yield from ((k, *row) for k, row in enumerate(rows))
            else:
                yield from db.execute(f"SELECT rowid, {', '.join(names)} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (partition.first, partition.last))
        finally:
            db.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "playlog_sqlite"

    def schema(self) -> StructType:
        columns = json.loads(self.options["columns"])
        typed = json.loads(self.options.get("typed", "[]"))
        return StructType([StructField("load_seq", LongType()), *[StructField(c, StringType()) for c in columns], *[StructField(f"{c}__type", StringType()) for c in typed]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options))


class Catalog:
    """Tables and columns of a file, by name."""

    def __init__(self, path: str):
        db = _open(path)
        try:
            names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
            self.tables = {t: [r[1] for r in db.execute(f"PRAGMA table_info({_quoted(t)})")] for t in names}
        finally:
            db.close()

    def column(self, table: str, candidates: tuple[str, ...]) -> str | None:
        """The first candidate that the table has, in whatever case, as it is written there."""
        there = {c.lower(): c for c in reversed(self.tables.get(table, []))}
        return next((there[c.lower()] for c in candidates if c.lower() in there), None)

    def text(self) -> str:
        return "\n".join(f"{t}: {', '.join(c)}" for t, c in self.tables.items())


@dataclass(frozen=True)
class PlayLogSource:
    table: str
    media: str
    time: str
    user: str | None
    item_type: str | None


# Names by which a play log and its columns are known, and their weights.
NOT_LOGS = {"annotation", "player", "play_queue", "playlist", "playlist_tracks"}
MEDIA = ("media_file_id", "mediafile_id", "song_id", "track_id", "item_id", "media_id")
TIMES = ("play_date", "played_at", "scrobbled_at", "submission_time", "timestamp", "time_stamp", "played_time", "created_at", "date")
USERS = ("user_id", "userid")
TYPES = ("item_type", "type")
NAME_WEIGHTS = {"scrob": 12, "listen": 10, "history": 8, "play": 5}
SURE_MEDIA, SURE_TIMES = {"media_file_id", "song_id", "track_id"}, {"play_date", "played_at", "scrobbled_at"}
LEAST_SCORE = 7
TRACK_TYPES = ("media_file", "song", "track")
TRACK_COLUMNS = {
    "id": ("id",), "title": ("title", "name"), "artist": ("artist", "artist_name"), "album": ("album", "album_name"), "album_id": ("album_id",), "album_artist": ("album_artist", "albumartist"),
    "genre": ("genre", "genres"), "year": ("year", "release_year", "date"), "duration": ("duration", "length"), "track_number": ("track_number", "track"), "disc_number": ("disc_number", "disc"),
    "path": ("path", "file_path"), "mbid": ("mbz_recording_id", "mbz_track_id", "musicbrainz_id"), "created_at": ("created_at",),
}
NO_TITLE, NO_ARTIST, NO_ALBUM = "(sin título)", "(artista desconocido)", "(álbum desconocido)"


def detect_source(catalog: Catalog) -> PlayLogSource | None:
    """The table that looks most like a play log, the first by name of equals."""
    best: tuple[int, PlayLogSource] | None = None
    for table in catalog.tables:
        low = table.lower()
        media, time = catalog.column(table, MEDIA), catalog.column(table, TIMES)
        if low in NOT_LOGS or not media or not time:
            continue
        user = catalog.column(table, USERS)
        score = sum(w for part, w in NAME_WEIGHTS.items() if part in low) + 4 * (media.lower() in SURE_MEDIA) + 2 * bool(user) + 3 * (time.lower() in SURE_TIMES)
        if score >= LEAST_SCORE and (best is None or score > best[0]):
            best = score, PlayLogSource(table, media, time, user, catalog.column(table, TYPES))
    return best[1] if best else None


class SqliteLibrary:
    """The model's inputs from a file; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, path: str, user: str | None = None):
        spark.dataSource.register(SqliteSource)
        self.spark, self.path, self.catalog = spark, str(path), Catalog(str(path))
        if "media_file" not in self.catalog.tables or not self.catalog.column("media_file", ("id",)):
            raise RuntimeError("the library has no table media_file with a column id")
        self.source = detect_source(self.catalog)
        self.user_names = {r["user_id"]: r["user_name"] for r in self.users().collect()}
        self.selected = self._resolve(user)

    def _read(self, table: str, columns: list[str], typed: list[str] | None = None) -> DataFrame:
        options = {"path": self.path, "table": table, "columns": json.dumps([*dict.fromkeys(columns)]), "typed": json.dumps(typed or [])}
        return self.spark.read.format("playlog_sqlite").options(**options).load()

    def _resolve(self, user: str | None) -> list[str] | None:
        """Ids of the user asked for by id or name; an unknown one is taken for an id."""
        if not user:
            return None
        want = user.casefold()
        return sorted(u for u, n in self.user_names.items() if want in (u.casefold(), n.casefold())) or [user]

    def _chosen(self, user: Column) -> Column:
        return user.isin(self.selected) if self.selected else F.lit(True)

    def users(self) -> DataFrame:
        ident = self.catalog.column("user", ("id",))
        if not ident:
            return self.spark.createDataFrame([], "user_id string, user_name string")
        name = self.catalog.column("user", ("user_name", "username", "name", "email"))
        rows = self._read("user", [ident, *([name] if name else [])])
        key = S.norm(F.col(ident))
        shown = S.norm(F.col(name)) if name else key
        return self._last(rows.select("load_seq", key.alias("user_id"), F.when(shown != "", shown).otherwise(key).alias("user_name")), ["user_id"])

    @staticmethod
    def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Of rows that share a key, the one that was stored last."""
        newest = Window.partitionBy(*keys).orderBy(F.desc("load_seq"))
        return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "load_seq")

    def tracks(self) -> DataFrame:
        names = {k: self.catalog.column("media_file", c) for k, c in TRACK_COLUMNS.items()}
        typed = [names["created_at"]] if names["created_at"] else []
        rows = self._read("media_file", [c for c in names.values() if c], typed)

        def of(k: str) -> Column:
            return F.col(names[k]) if names[k] else F.lit(None).cast("string")

        added = S.parse_dt(of("created_at"), F.col(f"{names['created_at']}__type").isin("integer", "real")) if names["created_at"] else F.lit(None).cast("timestamp")
        out = rows.select(
            "load_seq", S.norm(of("id")).alias("id"), S.blank_as(S.norm(of("title")), NO_TITLE).alias("title"), S.blank_as(S.norm(of("artist")), NO_ARTIST).alias("artist"), S.blank_as(S.norm(of("album")), NO_ALBUM).alias("album"),
            S.norm(of("album_id")).alias("album_id"), S.norm(of("album_artist")).alias("album_artist"), S.norm(of("genre")).alias("genre"), S.first_year(of("year")).alias("year"), F.coalesce(of("duration").try_cast("double"), F.lit(0.0)).alias("duration"),
            S.as_int(of("track_number")).alias("track_number"), F.greatest(F.lit(1), S.as_int(of("disc_number"), 1)).alias("disc_number"), S.norm(of("path")).alias("path"), S.norm(of("mbid")).alias("mbid"), added.alias("added_at"),
        )
        out = self._last(out, ["id"])
        album, made = self.catalog.column("album", ("id",)), self.catalog.column("album", ("created_at",))
        if album and made:
            dates = self._read("album", [album, made], [made]).select("load_seq", S.norm(F.col(album)).alias("album_id"), S.parse_dt(F.col(made), F.col(f"{made}__type").isin("integer", "real")).alias("_made"))
            out = out.join(self._last(dates, ["album_id"]), "album_id", "left").withColumn("added_at", F.coalesce("_made", "added_at")).drop("_made")
        return out

    def _accepted_type(self, table: str, column: str) -> str | None:
        found = [S for (S,) in self._read(table, [column]).select(F.coalesce(F.col(column), F.lit(""))).distinct().collect()]
        return next((v for v in sorted(found) if v.strip().lower() in TRACK_TYPES), None)

    def plays(self) -> DataFrame:
        """Dated plays; rows without a date that can be read are left out."""
        named = self._all_plays().where("at is not null").join(self.users(), "user_id", "left")
        return named.select("seq", "at", "track_id", "user_id", F.coalesce("user_name", F.when(F.col("user_id") != "", F.col("user_id")), F.lit(UNKNOWN_USER)).alias("user_name"))

    def undatable(self) -> int:
        """How many plays have no date that can be read."""
        return self._all_plays().where("at is null").count()

    def _all_plays(self) -> DataFrame:
        s = self.source
        if s is None:
            return self.spark.createDataFrame([], "seq long, at timestamp, track_id string, user_id string")
        rows = self._read(s.table, [c for c in (s.media, s.time, s.user, s.item_type) if c], [s.time])
        if s.item_type and s.media.lower() == "item_id" and (kind := self._accepted_type(s.table, s.item_type)):
            rows = rows.where(F.col(s.item_type) == kind)
        if s.user:
            rows = rows.where(self._chosen(F.col(s.user)))
        at = S.parse_dt(F.col(s.time), F.col(f"{s.time}__type").isin("integer", "real"))
        return rows.select(F.col("load_seq").alias("seq"), at.alias("at"), S.norm(F.col(s.media)).alias("track_id"), (S.norm(F.col(s.user)) if s.user else F.lit("")).alias("user_id"))

    def annotations(self, strict: bool = False) -> DataFrame:
        """Accumulated counters; strict ones need a user column and the type `media_file`."""
        empty = self.spark.createDataFrame([], "user_id string, track_id string, play_count long, last_played timestamp, last_text string")
        col = self.catalog.column
        user, item, kind = col("annotation", ("user_id",)), col("annotation", ("item_id",)), col("annotation", ("item_type",))
        count, when = col("annotation", ("play_count", "playcount")), col("annotation", ("play_date", "last_played", "played_at"))
        if not item or not count or (strict and not user):
            return empty
        rows = self._read("annotation", [c for c in (user, item, kind, count, when) if c], [when] if when else [])
        if kind:
            wanted = "media_file" if strict else self._accepted_type("annotation", kind)
            if wanted:
                rows = rows.where(F.col(kind) == wanted)
        if user:
            rows = rows.where(self._chosen(F.col(user)))
        value = F.col(count).try_cast("double")
        last = S.parse_dt(F.col(when), F.col(f"{when}__type").isin("integer", "real")) if when else F.lit(None).cast("timestamp")
        out = rows.where(value > 0).select("load_seq", (S.norm(F.col(user)) if user else F.lit("")).alias("user_id"), S.norm(F.col(item)).alias("track_id"), F.floor(value).alias("play_count"), last.alias("last_played"), (S.norm(F.col(when)) if when else F.lit("")).alias("last_text"))
        return self._last(out, ["user_id", "track_id"])

    def library(self) -> Library:
        return Library(self.tracks(), self.plays(), self.annotations(), self.users())

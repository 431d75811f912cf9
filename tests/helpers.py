"""Small libraries for tests: five tracks an album, plays by minutes after noon."""

from datetime import datetime, timedelta, timezone

from playlog.config import EngineConfig
from playlog.plans.catalogue import Analyses
from playlog.sources.tables import Library

NOON = datetime(2026, 1, 1, 12, tzinfo=timezone.utc)
TRACKS = "load_seq long, id string, title string, artist string, album string, album_id string, album_artist string, genre string, year int, duration double, track_number int, disc_number int, path string, mbid string, added_at timestamp"
PLAYS = "seq long, at timestamp, track_id string, user_id string, user_name string"
NOTES = "user_id string, track_id string, play_count long, last_played timestamp"


def track(ident, number=1, album="Album A", album_id="A", artist="Artist", **more):
    row = {"load_seq": 0, "id": ident, "title": f"Track {number}", "artist": artist, "album": album, "album_id": album_id, "album_artist": artist, "genre": "Rock", "year": 2020, "duration": 180.0, "track_number": number, "disc_number": 1, "path": f"{number:02d} - Track {number}.flac", "mbid": "", "added_at": None}
    return row | more


def album(letter="a", n=5, **more):
    return [track(f"{letter}{i}", i, album=f"Album {letter.upper()}", album_id=letter.upper(), **more) for i in range(1, n + 1)]


def analyses(spark, tracks, plays, notes=(), users=(("user-1", "Alice"),), **config):
    """plays: (minutes, track id) or (minutes, track id, user id)."""
    names = dict(users)
    rows = []
    for k, (minutes, ident, *user) in enumerate(plays):
        who = user[0] if user else "user-1"
        rows.append((k, NOON + timedelta(minutes=minutes), ident, who, names.get(who, who)))
    tracks = [tuple({**t, "load_seq": k}.values()) for k, t in enumerate(tracks)]
    library = Library(
        spark.createDataFrame(tracks, TRACKS),
        spark.createDataFrame(rows, PLAYS),
        spark.createDataFrame(list(notes), NOTES),
        spark.createDataFrame(list(users), "user_id string, user_name string"),
    )
    return Analyses(library, EngineConfig(**config))


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]

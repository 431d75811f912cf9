import csv
import hashlib
import sqlite3

import pytest

from playlog import cli
from playlog.plans.artefacts import BASE, THREADS
from playlog.sources.sqlite import Catalog, SqliteLibrary, detect_source

MEDIA = "CREATE TABLE media_file (id TEXT PRIMARY KEY, title TEXT, artist TEXT, album TEXT, album_id TEXT, album_artist TEXT, genre TEXT, path TEXT, mbz_recording_id TEXT, year INTEGER, track_number INTEGER, disc_number INTEGER, duration REAL)"


def library(path, *statements):
    db = sqlite3.connect(path)
    for s in statements:
        db.execute(*s) if isinstance(s, tuple) else db.execute(s)
    db.commit()
    db.close()
    return path


def tracks(n):
    return [("INSERT INTO media_file VALUES (?,?,?,?,?,?,?,?,?,?,?,?,?)", (f"t{i}", f"Track {i}", "Band", "Disc", "D", "Band", "Rock; Pop", f"{i:02d} - Track {i}.flac", "", 2020, i, 1, 180.0)) for i in range(1, n + 1)]


USERS = ("CREATE TABLE user (id TEXT PRIMARY KEY, user_name TEXT)", "INSERT INTO user VALUES ('user-1', 'Alice')")


def table(path):
    with path.open(encoding="utf-8", newline="") as f:
        return list(csv.DictReader(f))


def test_temporal_library(spark, tmp_path):
    scrobbles = [("INSERT INTO scrobbles VALUES (?,?,?)", (f"t{i}", "user-1", f"2026-01-01T12:{5 * i:02d}:00Z")) for i in (1, 2, 3)]
    db = library(tmp_path / "a.db", MEDIA, *USERS, *tracks(3), "CREATE TABLE scrobbles (media_file_id TEXT, user_id TEXT, submission_time TEXT)", *scrobbles)
    before = hashlib.sha256(db.read_bytes()).hexdigest()
    out = tmp_path / "out"
    assert cli.run(spark, cli.arguments([str(db), "-o", str(out), "--inspect"])) == 0
    names = {p.name for p in out.iterdir()}
    assert names == {f"{n}.csv" for n in (*BASE, *THREADS, "album_library_coverage", "album_metadata_issues")} | {"report.txt", "schema.txt"}
    assert len(names) == 28
    (row,) = table(out / "album_library_coverage.csv")
    assert (row["tracks_heard"], row["total_tracks"], row["play_count"], row["user"]) == ("3", "3", "3", "Alice")
    assert len(table(out / "plays.csv")) == 3
    assert "HISTORIAL" in (out / "report.txt").read_text(encoding="utf-8")
    assert hashlib.sha256(db.read_bytes()).hexdigest() == before


def test_legacy_library(spark, tmp_path):
    note = "CREATE TABLE annotation (user_id TEXT, item_id TEXT, item_type TEXT, play_date TEXT, play_count INTEGER)"
    db = library(tmp_path / "b.db", MEDIA, *USERS, *tracks(1), note, "INSERT INTO annotation VALUES ('user-1', 't1', 'media_file', '2026-01-01T12:00:00', 7)")
    out = tmp_path / "out"
    assert cli.run(spark, cli.arguments([str(db), "-o", str(out)])) == 0
    assert {p.name for p in out.iterdir()} == {"album_library_coverage.csv", "album_metadata_issues.csv", "legacy_playcounts.csv", "report.txt"}
    (row,) = table(out / "album_library_coverage.csv")
    assert (row["tracks_heard"], row["play_count"]) == ("1", "7")


def test_missing_and_broken_files(spark, tmp_path):
    assert cli.run(spark, cli.arguments([str(tmp_path / "none.db")])) == 2
    (tmp_path / "bad.db").write_bytes(b"not a database at all" * 100)
    assert cli.run(spark, cli.arguments([str(tmp_path / "bad.db"), "-o", str(tmp_path / "o")])) == 3
    with pytest.raises(RuntimeError):
        SqliteLibrary(spark, str(library(tmp_path / "c.db", "CREATE TABLE x (a TEXT)")))


def test_added_at_prefers_the_album(spark, tmp_path):
    db = library(
        tmp_path / "d.db", "CREATE TABLE album (id TEXT PRIMARY KEY, created_at TEXT)", "CREATE TABLE media_file (id TEXT PRIMARY KEY, title TEXT, artist TEXT, album TEXT, album_id TEXT, created_at TEXT)",
        "INSERT INTO album VALUES ('A', '2025-01-02T00:00:00Z'), ('B', NULL), ('C', NULL)", "INSERT INTO media_file VALUES ('a', 'T', 'X', 'A', 'A', '2025-05-05'), ('b', 'T', 'X', 'B', 'B', '2025-06-06'), ('c', 'T', 'X', 'C', 'C', NULL)",
    )
    got = {r["id"]: str(r["added_at"])[:10] for r in SqliteLibrary(spark, str(db)).tracks().collect()}
    assert got == {"a": "2025-01-02", "b": "2025-06-06", "c": "None"}


def test_detection(tmp_path):
    db = library(
        tmp_path / "e.db", "CREATE TABLE playlist (media_file_id TEXT, played_at TEXT)", "CREATE TABLE listens (Track_ID TEXT, user_id TEXT, played_at TEXT)", "CREATE TABLE scrobble_buffer (media_id TEXT, created_at TEXT)", "CREATE TABLE misc (item_id TEXT, date TEXT)",
    )
    found = detect_source(Catalog(str(db)))
    assert (found.table, found.media, found.time, found.user) == ("listens", "Track_ID", "played_at", "user_id")
    assert detect_source(Catalog(str(library(tmp_path / "f.db", "CREATE TABLE misc (item_id TEXT, date TEXT)")))) is None


def test_users_by_name_or_id(spark, tmp_path):
    db = library(tmp_path / "g.db", MEDIA, *USERS, *tracks(1))
    assert SqliteLibrary(spark, str(db), "ALICE").selected == ["user-1"]
    assert SqliteLibrary(spark, str(db), "ghost").selected == ["ghost"]
    assert SqliteLibrary(spark, str(db)).selected is None


LOG = "CREATE TABLE scrobbles (media_file_id TEXT, user_id TEXT, submission_time TEXT)"
NOTES = "CREATE TABLE annotation (user_id TEXT, item_id TEXT, item_type TEXT, play_date TEXT, play_count TEXT)"


def test_what_files_and_report_say(spark, tmp_path, capsys):
    played = [*[(f"t{i}", f"2026-01-01T12:{5 * i:02d}:00Z") for i in (1, 2, 3)], ("t1", "2026-01-05T08:00:00Z"), ("gone", "2026-01-06T08:00:00Z"), ("t2", "who knows")]
    notes = [("INSERT INTO annotation VALUES ('user-1', 't1', 'media_file', '2025-12-01T00:00:00Z', '9')",)]
    db = library(tmp_path / "h.db", MEDIA, *USERS, *tracks(3), LOG, NOTES, *[("INSERT INTO scrobbles VALUES (?, 'user-1', ?)", p) for p in played], *notes)
    out = tmp_path / "out"
    assert cli.run(spark, cli.arguments([str(db), "-o", str(out)])) == 0
    told = capsys.readouterr()
    assert "1 plays of unknown tracks" in told.err
    assert "1 plays without a readable date" in told.err
    assert [(r["datetime"][:16], r["track_id"]) for r in table(out / "plays.csv")] == [("2026-01-01 12:05", "t1"), ("2026-01-01 12:10", "t2"), ("2026-01-01 12:15", "t3"), ("2026-01-05 08:00", "t1")]
    first, second = table(out / "sessions.csv")
    assert (first["tracks"], first["span_minutes"], first["estimated_music_minutes"], first["top_artist"], first["top_album"]) == ("3", "10.0", "9.0", "Band", "Disc")
    assert second["tracks"] == "1"
    assert [(r["status"], r["full_pass"], r["completion_pct"]) for r in table(out / "album_runs.csv")] == [("completo_probable", "1", "100.0"), ("pista_suelta", "0", "33.3")]
    (done,) = table(out / "album_completion.csv")
    assert (done["album_runs"], done["probable_full_plays"], done["full_play_rate_pct"]) == ("1", "1", "100.0")
    assert [(r["track_id"], r["plays"]) for r in table(out / "top_tracks.csv")] == [("t1", "2"), ("t2", "1"), ("t3", "1")]
    assert table(out / "monthly.csv") == [{"month": "2026-01", "plays": "4"}]
    (kept,) = table(out / "historical_vs_recent_albums.csv")
    assert (kept["historical_total"], kept["recent_scrobbles"], kept["estimated_before_history"], kept["mismatch_tracks"]) == ("9", "4", "7", "0")
    text = (out / "report.txt").read_text(encoding="utf-8")
    for line in (
        "Origen: scrobbles.submission_time",
        "Periodo: 2026-01-01 12:05 → 2026-01-05 08:00",
        "Reproducciones: 4; canciones distintas: 3",
        "Repeticiones: 1 (25,0%)",
        "Música: 12 min",
        "Sesiones (corte de 30 min): 2; mediana de canciones: 2",
        "Pasadas de álbum: 1; completas: 1 (100,0%), umbral 80%",
        "   1 completas |   1 pasadas | 100.0% | Band — Disc",
        "      2  Band — Track 1",
        "12:00        3  " + "█" * 30,
        "08:00        1  " + "█" * 10,
        "Escuchadas: 3; nunca: 0 (0,0%)",
    ):
        assert line in text.splitlines(), line


def test_one_user_of_several(spark, tmp_path):
    played = [("t1", "user-1", "2026-01-01T12:00:00Z"), ("t1", "user-2", "2026-01-01T13:00:00Z"), ("t1", "user-3", "2026-01-01T14:00:00Z")]
    db = library(tmp_path / "i.db", MEDIA, *USERS, "INSERT INTO user VALUES ('user-2', '')", *tracks(1), LOG, *[("INSERT INTO scrobbles VALUES (?,?,?)", p) for p in played])
    names = {r["user_id"]: r["user_name"] for r in SqliteLibrary(spark, str(db)).plays().collect()}
    assert names == {"user-1": "Alice", "user-2": "user-2", "user-3": "user-3"}
    assert [r["user_id"] for r in SqliteLibrary(spark, str(db), "alice").plays().collect()] == ["user-1"]


def test_counters_by_type_and_last_stored(spark, tmp_path):
    rows = [("user-1", "t1", "song", "2026-01-01T00:00:00Z", "3"), ("user-1", "t1", "song", "", "5"), ("user-1", "t2", "album", "", "4"), ("user-1", "t3", "song", "", "0"), ("user-1", "t3", "media_file", "", "2")]
    db = library(tmp_path / "j.db", MEDIA, *USERS, *tracks(3), NOTES, *[("INSERT INTO annotation VALUES (?,?,?,?,?)", r) for r in rows])
    source = SqliteLibrary(spark, str(db))
    # of the accepted types the first by name is read; strict ones are `media_file` alone
    assert [(r["track_id"], r["play_count"]) for r in source.annotations().collect()] == [("t3", 2)]
    assert [(r["track_id"], r["play_count"]) for r in source.annotations(strict=True).collect()] == [("t3", 2)]
    songs = library(tmp_path / "k.db", MEDIA, *USERS, *tracks(3), NOTES, *[("INSERT INTO annotation VALUES (?,?,?,?,?)", r) for r in rows[:4]])
    source = SqliteLibrary(spark, str(songs))
    assert [(r["track_id"], r["play_count"], r["last_played"]) for r in source.annotations().collect()] == [("t1", 5, None)]
    assert source.annotations(strict=True).isEmpty()

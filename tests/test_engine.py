import random
from datetime import timedelta

import pytest
from helpers import NOON, album, analyses, rows, track


def test_runs_break_on_gap(spark):
    a = analyses(spark, album(), [(0, "a1"), (5, "a2"), (6, "a2"), (10, "a3"), (60, "a4")])
    first, second = rows(a.album_runs(), "run_id")
    assert (first["scrobbles"], first["unique_tracks"], first["completion_pct"], first["sequential_pct"], first["status"]) == (4, 3, 60.0, 100.0, "parcial_desde_inicio")
    assert second["status"] == "pista_suelta"


def test_runs_break_on_restart(spark):
    a = analyses(spark, album(), [(5 * k, t) for k, t in enumerate(["a1", "a2", "a4", "a1", "a2"])])
    got = rows(a.album_runs(), "run_id")
    assert [(r["scrobbles"], r["first_position"], r["last_position"]) for r in got] == [(3, 1, 4), (2, 1, 2)]


def test_threads_resume_after_other_albums(spark):
    a = analyses(spark, album() + album("b"), [(0, "a1"), (30, "b1"), (120, "a2"), (125, "a3"), (3600, "a4")])
    threads = [r for r in rows(a.album_threads(), "thread_id") if r["album_key"] == "A"]
    assert len(threads) == 2
    assert (threads[0]["unique_tracks"], threads[0]["coverage_pct"], threads[0]["resume_count"], threads[0]["max_pause_hours"]) == (3, 60.0, 1, 2.0)
    (event,) = rows(a.album_resume_events())
    assert (event["from_position"], event["to_position"], event["interleaved_scrobbles"]) == (1, 2, 1)


def test_threads_break_on_restart(spark):
    a = analyses(spark, album(), [(5 * k, t) for k, t in enumerate(["a1", "a2", "a3", "a4", "a1"])])
    first, second = rows(a.album_threads(), "thread_id")
    assert (first["coverage_pct"], first["full_thread"], second["scrobbles"]) == (80.0, 1, 1)


def test_completion(spark):
    plays = [(5 * k, f"a{k + 1}") for k in range(5)] + [(200 + 5 * k, f"a{k + 1}") for k in range(3)] + [(400, "a5")]
    a = analyses(spark, album(), plays)
    assert a.album_runs().count() == 3
    (r,) = rows(a.album_completion())
    assert (r["album_runs"], r["probable_full_plays"], r["near_complete_runs"], r["started_from_beginning"], r["probable_abandons"]) == (2, 1, 1, 2, 1)
    assert (r["avg_completion_pct"], r["median_completion_pct"], r["favorite_stop_track"], r["full_play_rate_pct"]) == (80.0, 80.0, "Track 3", 50.0)


def test_coverage_takes_annotations_before_plays(spark):
    late = NOON + timedelta(days=2)
    a = analyses(spark, album(n=3), [(0, "a1"), (5, "a2"), (10, "a2")], notes=[("user-1", "a1", 5, late)])
    (r,) = rows(a.album_library_coverage())
    assert (r["tracks_heard"], r["total_tracks"], r["heard_pct"], r["play_count"]) == (2, 3, 66.7, 7)
    assert r["last_played"] == "2026-01-03 12:00:00+00:00"


def test_coverage_of_a_user_who_heard_nothing(spark):
    a = analyses(spark, album(n=3), [])
    (r,) = rows(a.album_library_coverage(["nobody"]))
    assert (r["user"], r["tracks_heard"], r["tracks_unheard"], r["play_count"], r["last_played"]) == ("nobody", 0, 3, 0, None)


def test_duplicate_entities(spark):
    tracks = album() + [track("x1", 1, album="Album A", album_id="X")]
    got = {r["album_key"]: r for r in rows(analyses(spark, tracks, []).album_metadata_issues())}
    assert set(got) == {"A", "X"}
    assert "small_fragment" not in got["A"]["signals"] and "small_fragment" in got["X"]["signals"]
    assert got["A"]["related_album_ids"] == "X"


def test_duplicate_entities_by_format_and_alone(spark):
    tracks = album(artist="Big Band") + [track("x1", 1, album="Album A", album_id="X", artist="big-band")] + album("c", 1)
    got = {r["album_key"]: r for r in rows(analyses(spark, tracks, []).album_metadata_issues())}
    assert set(got) == {"A", "X"}
    assert all("album_artist_format_variation" in r["signals"] for r in got.values())


def test_catalogue_orders_tracks_and_makes_a_key(spark):
    tracks = [track("z", 2, album_id="", title="B"), track("y", 1, album_id="", title="A"), track("x", 0, album_id="", title="C")]
    a = analyses(spark, tracks, [])
    assert [r["id"] for r in rows(a.enriched, "position")] == ["y", "z", "x"]
    assert rows(a.album_catalog())[0]["album_key"] == "artist\x1falbum a"


def test_sessions_break_when_another_user_plays(spark):
    plays = [(0, "a1", "u"), (5, "a2", "v"), (10, "a3", "u"), (40, "a4", "u"), (70.5, "a5", "u")]
    a = analyses(spark, album(), plays, users=(("u", "Same"), ("v", "Same")))
    assert [r["tracks"] for r in rows(a.sessions(), "session_id")] == [1, 1, 2, 1]
    assert sorted(r["tracks"] for r in rows(a.sessions_by_user())) == [1, 1, 3]


def test_ties_go_to_what_came_first(spark):
    tracks = [track("p", 1, artist="Z"), track("q", 2, artist="A")]
    a = analyses(spark, tracks, [(0, "p"), (1, "q")])
    assert rows(a.sessions())[0]["top_artist"] == "Z"
    assert rows(a.weekly_artist_dominance())[0]["entity_key"] == "z"


def test_silence_is_inclusive(spark):
    day = 24 * 60
    a = analyses(spark, album(), [(0, "a1"), (180 * day, "a1"), (359 * day, "a1")])
    assert [r["silent_days"] for r in rows(a.resurrections())] == [180.0]


def test_iso_year_boundary(spark):
    a = analyses(spark, album(), [(60 * 24 * 365, "a1"), (60 * 24 * 365 + 1, "a1")])  # 2027-01-01 is in week 53 of 2026
    (r,) = rows(a.weekly_obsessions())
    assert (r["year"], r["week"], r["plays"]) == (2026, 53, 2)


def test_empty_log(spark):
    a = analyses(spark, album(), [])
    for name in ("sessions", "album_runs", "album_threads", "album_eras", "track_pairs", "discoveries", "album_completion", "monthly"):
        assert getattr(a, name)().count() == 0, name


def _runs_by_hand(plays, position, total, gap):
    runs, cur = [], []
    for p in plays:
        if cur:
            q = cur[-1]
            back = position[p[1]] <= 2 and position[q[1]] >= max(3, -(-total * 60 // 100))
            if p[2] != q[2] or p[1][0] != q[1][0] or p[0] - q[0] > gap or back:
                runs.append(cur)
                cur = []
        cur.append(p)
    return runs + [cur]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_against_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    at, plays = 0, []
    for _ in range(300):
        at += rnd.choice([0, 1, 5, 29, 30, 31, 300])
        plays.append((at, rnd.choice("ab") + str(rnd.randint(1, 5)), rnd.choice(["u", "u", "v"])))
    position = {f"{c}{i}": i for c in "ab" for i in range(1, 6)}
    a = analyses(spark, album() + album("b"), plays, users=(("u", "U"), ("v", "V")))
    want = [(len(r), len({p[1] for p in r})) for r in _runs_by_hand(plays, position, 5, 30)]
    assert [(r["scrobbles"], r["unique_tracks"]) for r in rows(a.album_runs(), "run_id")] == want

import difflib
import random
import statistics

from pyspark.sql import functions as F

from playlog.functions import scalars as S
from playlog.functions import text as T
from playlog.plans.artefacts import bar, length, percent, thousands


def test_pyround_is_exact(spark):
    rnd = random.Random(3)
    values = [100 * rnd.randint(0, 400) / rnd.randint(1, 400) for _ in range(4000)] + [0.05, 0.15, 2.675, 0.25, 0.35, 1.005, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", *[S.pyround(F.col("v"), n).alias(f"r{n}") for n in (1, 2, 3)]).collect()
    assert all((r["r1"], r["r2"], r["r3"]) == (round(r["v"], 1), round(r["v"], 2), round(r["v"], 3)) for r in got)


def test_exact_mean(spark):
    rnd = random.Random(4)
    data = [(k, round(rnd.random() * 100, 1)) for k in range(300) for _ in range(rnd.randint(1, 9))]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(data, "k int, v double").groupBy("k").agg(S.pyround(S.exact_mean(F.col("v")), 1).alias("m")).collect()}
    for k in got:
        assert got[k] == round(statistics.mean(v for i, v in data if i == k), 1)


def test_parse_dt(spark):
    cases = {
        "1767268800": "2026-01-01 12:00:00+00:00", "1767268800000": "2026-01-01 12:00:00+00:00", "1767268800000000": "2026-01-01 12:00:00+00:00", "2026-01-01T12:00:00Z": "2026-01-01 12:00:00+00:00", "2026-01-01 12:00:00": "2026-01-01 12:00:00+00:00",
        "2026-01-01T14:00:00.5+02:00": "2026-01-01 12:00:00.500000+00:00", "2026-01-01": "2026-01-01 00:00:00+00:00", "garbage": None, "": None, "-5": None, "2026-13-01": None, " 2026-01-01T12:00 ": "2026-01-01 12:00:00+00:00",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: r["t"] for r in df.select("v", S.iso(S.parse_dt(F.col("v"))).alias("t")).collect()} == cases
    (r,) = spark.createDataFrame([("-5",)], "v string").select(S.iso(S.parse_dt(F.col("v"), F.lit(True))).alias("t")).collect()
    assert r["t"] == "1969-12-31 23:59:55+00:00"


def test_numbers_and_genres(spark):
    df = spark.createDataFrame([("3/12", "1999-05-01", "Rock; Pop/J|Alt"), ("", "x", ""), (None, None, None), ("0", "20", "Ambient, ambient")], "n string, y string, g string")
    got = df.select(S.as_int(F.col("n")).alias("n"), S.as_int(F.col("n"), 1).alias("d"), S.first_year(F.col("y")).alias("y"), S.split_genres(F.col("g")).alias("g")).collect()
    assert [tuple(r) for r in got] == [(3, 3, 1999, ["rock", "pop", "alt"]), (0, 1, None, []), (0, 1, None, []), (0, 1, None, ["ambient"])]


def test_paths(spark):
    df = spark.createDataFrame([("a/b/01 - x.flac",), (".hidden",), ("12.mp3",), ("x/7_y.z.ogg",), ("1234 x.mp3",)], "p string")
    got = df.select(S.path_stem(F.col("p")).alias("s"), S.path_track_number(F.col("p")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("01 - x", 1), (".hidden", 0), ("12", 0), ("x", 0)[:0] or ("7_y.z", 7), ("1234 x", 0)]


def test_text_keys():
    assert T.title_key_of("03 - Canción (Remastered) CD 2.flac") == "cancion"
    assert T.entity_key_of("Beyoncé — Álbum!") == "beyonce album"
    assert T.entity_key_of("日本") == ""
    assert T.longest_rising([3, 1, 2, 0, 2, 5, 4]) == 3


def test_similarity_matches_difflib(spark):
    pairs = [("hello world", "world hello"), ("abc", "abd"), ("", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select(T.similarity("a", "b").alias("r")).collect()
    assert [r["r"] for r in got] == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_report_numbers():
    assert thousands(1234567) == "1.234.567" and percent(1, 3) == "33,3%" and percent(1, 0) == "0,0%"
    assert length(90061) == "1 d 01 h 01 min" and length(-5) == "0 min" and length(3600) == "1 h 00 min"
    assert bar(1, 1000) == "█" and len(bar(10, 10)) == 30


def test_exact_mean_of_many_groups(spark):
    rnd = random.Random(3)
    groups = {g: [float(round(rnd.choice([0, rnd.uniform(0, 100), rnd.randint(0, 3) / 10, 100]), 1)) for _ in range(rnd.choice([1, 2, 3, 7, 40, 900]))] for g in range(300)}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g int, x double")
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(S.exact_mean(F.col("x")).alias("m")).collect()}
    assert got == {g: float(statistics.mean(v)) for g, v in groups.items()}

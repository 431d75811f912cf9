from helpers import NOON, album, analyses, rows

from playlog.functions import scalars as S
from playlog.streaming.sessions import user_sessions
from pyspark.sql import functions as F


def test_stream_equals_batch(spark, tmp_path):
    plays = [(0, "a1", "u"), (5, "a2", "v"), (30, "a3", "u"), (61, "a4", "u"), (300, "a1", "u"), (301, "a1", "v")]
    a = analyses(spark, album(), plays, users=(("u", "U"), ("v", "V")))
    a.library.plays.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.library.plays.schema).parquet(str(tmp_path / "in"))
    query = user_sessions(stream, 30, "1 minute").writeStream.outputMode("complete").format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()

    def told(df):
        return sorted((r["user_id"], r["start"], r["end"], r["tracks"], r["unique_tracks"]) for r in df.collect())

    got = told(spark.table("told"))
    assert got == told(user_sessions(a.library.plays, 30))
    batch = rows(a.sessions_by_user())
    assert sorted((r["tracks"], r["start"]) for r in batch) == sorted((r["tracks"], r["s"]) for r in rows(spark.table("told").select("tracks", S.iso(F.col("start")).alias("s"))))
    assert NOON

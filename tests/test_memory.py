"""A session's memory by hand: late, repeated and missing turns, and the end of idle sessions."""

from pyspark.sql import functions as F

from glimpse.streaming import ingest
from glimpse.streaming.ingest import _remembered


def test_turns_in_any_order_and_twice():
    turns = [(1, "a", ["x", "y"]), (2, "b", ["y"]), (3, "c", None), (4, "d", ["z", "x", "q"]), (6, "f", ["y"])]
    whole = _remembered({}, turns, 2, 3)
    assert whole["n"] == 5 and whole["recent"] == [(3, "c"), (4, "d"), (6, "f")] and whole["upto"] == 4 and whole["ahead"] == [6]
    assert whole["videos"] == {"x": (2, 1, 0), "y": (3, 1, 1), "z": (1, 4, 0)}
    parts = {}
    for i in (4, 2, 0, 4, 1, 3, 0):
        parts = _remembered(parts, [turns[i]], 2, 3)
    assert parts == whole


def test_idle_sessions_end(spark, tmp_path):
    rows = [(0, 1, 1, "old"), (100, 2, 1, "p"), (50_000, 2, 2, "q"), (50_001, 1, 9, "new")]
    for i, (at, session, turn, text) in enumerate(rows):
        df = spark.createDataFrame([(session, turn, text, ["v"])], "session_id long, turn_no long, text string, videos array<string>")
        df.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000 + at))).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    read = spark.readStream.schema("session_id long, turn_no long, text string, videos array<string>, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    ingest.stream_conversation_memory(read.parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", late="10 seconds", expire_ms=3_600_000).awaitTermination()
    got = {r.session_id: (r.n_turns, r.last_queries) for r in ingest.latest_memory(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got[1] == (1, "new") and got[2][0] in (1, 2)  # the old turn is forgotten with its state

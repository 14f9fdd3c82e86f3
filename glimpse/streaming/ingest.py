"""Streams over files as they arrive: speech segments into a clean table, interest in videos over time, and what a session's turns add to its memory."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glimpse.functions.text import doc_key
from glimpse.operators.frames import junk_segment
from glimpse.sources.readers import SPEECH_RECORD, TEXT_RECORD, segments


def stream_ingest_segments(spark: SparkSession, source: str, target: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Write new speech segments below ``source`` to the table ``target``, each video's segment once within ``late`` of its file's time.
    A video is its path: files of one name in two folders are two.

    Noise is left out as in batch. Stops when all that lies there is read; the next start goes on from the checkpoint.
    """
    raw = spark.readStream.schema(SPEECH_RECORD).option("recursiveFileLookup", True).json(source)
    rows = segments(raw, F.col("_metadata.file_modification_time").alias("arrived"), F.col("video_path")).where(~junk_segment(F.col("text"), F.lit(None).cast("double"), F.lit(None).cast("double")))
    once = rows.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["video_path", "segment_id"])
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_ingest_texts(spark: SparkSession, source: str, target: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """As ``stream_ingest_segments`` for on-screen text: key, video_id, frame_id, text, each frame once."""
    raw = spark.readStream.schema(TEXT_RECORD).option("recursiveFileLookup", True).json(source)
    video = F.element_at(F.split("video_id", "/"), -1)
    rows = raw.where("trim(text) != ''").select(doc_key(video, F.col("frame_id")).alias("key"), video.alias("video_id"), "frame_id", F.trim("text").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))
    once = rows.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["video_id", "frame_id"])
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_video_interest(turns: DataFrame, target: str, checkpoint: str, window: str = "10 minutes", late: str = "1 hour") -> StreamingQuery:
    """``turns``: a stream of at, session_id, video_id. Appends each batch's changed counts by window, session and video to ``target``."""
    n = turns.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "session_id", "video_id").count()
    flat = n.select(F.col("w.start").alias("start"), "session_id", "video_id", F.col("count").alias("n"))

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/run={number}")

    return flat.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def latest_counts(saved: DataFrame) -> DataFrame:
    """start, session_id, video_id, n: the last count written for each."""
    w = Window.partitionBy("start", "session_id", "video_id").orderBy(F.desc("batch"))
    return saved.withColumn("r", F.row_number().over(w)).where("r = 1").select("start", "session_id", "video_id", "n")


def _remembered(state: dict, turns: list[tuple], top_videos: int, last: int) -> dict:
    """A session's memory with more turns (turn_no, text, videos): each turn number counts once, in whatever order turns come."""
    upto, ahead = state.get("upto", 0), set(state.get("ahead", []))
    recent, videos = [tuple(x) for x in state.get("recent", [])], state.get("videos", {})
    n = state.get("n", 0)
    for turn, text, seen in sorted(turns, key=lambda x: x[0]):
        if turn in ahead or 0 < turn <= upto:
            continue
        n += 1
        ahead.add(turn)
        while upto + 1 in ahead:  # numbers without a gap are one number
            upto += 1
            ahead.remove(upto)
        recent = sorted([*recent, (turn, text)])[-last:]
        for i, v in enumerate([] if seen is None else list(seen)[:top_videos]):
            count, t, k = videos.get(v, (0, turn, i))
            videos[v] = (count + 1, *min((t, k), (turn, i)))
    return {"n": n, "upto": upto, "ahead": sorted(ahead), "recent": recent, "videos": videos}


def stream_conversation_memory(turns: DataFrame, target: str, checkpoint: str, top_videos: int = 5, last: int = 3, focus: int = 3, late: str = "1 hour", expire_ms: int = 6 * 3_600_000) -> StreamingQuery:
    """``turns``: a stream of at, session_id (long), turn_no, text, videos. Appends to ``target``, batch by batch, the memory of sessions with new turns.

    Columns as of ``conversation_memory`` and batch. State by session: how many turns, counts and first places of videos, the last queries. A turn number counts
    once; turns out of order find their place, those later than ``late`` are lost. A session's state goes when no turn has come for ``expire_ms`` of the stream's time.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def remember(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        for pdf in batches:
            held = _remembered(held, list(zip(pdf["turn_no"].tolist(), pdf["text"].tolist(), pdf["videos"].tolist(), strict=True)), top_videos, last)
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + expire_ms)
        best = sorted(held["videos"].items(), key=lambda x: (-x[1][0], *x[1][1:]))[:focus]
        yield pd.DataFrame([(key[0], held["n"], " // ".join(t for _, t in held["recent"]), ",".join(v for v, _ in best))], columns=["session_id", "n_turns", "last_queries", "focus_videos"])

    out = turns.withWatermark("at", late).groupBy("session_id").applyInPandasWithState(remember, "session_id long, n_turns long, last_queries string, focus_videos string", "memory string", "update", GroupStateTimeout.EventTimeTimeout)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/run={number}")

    return out.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def latest_memory(saved: DataFrame) -> DataFrame:
    """session_id, n_turns, last_queries, focus_videos: the last memory written for each session."""
    return saved.groupBy("session_id").agg(F.max_by(F.struct("n_turns", "last_queries", "focus_videos"), "batch").alias("m")).select("session_id", "m.*")

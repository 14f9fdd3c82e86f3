"""Offline preparation of frames and texts: scenes, sampling, near-duplicate frames, intervals, speech alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimpse.functions.text import canonical_frame_id, frame_order_key, named_frame_id, normalize_text, text_quality, timestamp_from_name


def segment_scenes(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``pred`` (video_id, frame_idx, p) with scene_id from 0: a frame above the threshold begins a scene, but the first never splits."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    cut = F.when((F.col("p") > threshold) & (F.row_number().over(w) > 1), 1).otherwise(0)
    return pred.withColumn("cut", cut).withColumn("scene_id", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")


def scenes(frames: DataFrame) -> DataFrame:
    """One row a scene: video_id, scene_id, first_frame, last_frame, n_frames."""
    return frames.groupBy("video_id", "scene_id").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count("*").alias("n_frames"))


def fast_action(s: DataFrame, fps: float = 25.0, least: int = 15) -> DataFrame:
    """``s`` with ``fast``: a scene below two seconds in a video of more than ``least`` scenes."""
    n = F.count("*").over(Window.partitionBy("video_id"))
    return s.withColumn("fast", (F.col("n_frames") < int(fps * 2)) & (n > least))


def target_frames(s: DataFrame, fps: float = 25.0) -> DataFrame:
    """video_id, scene_id, target_idx: fast scenes each 0.7 s; up to 2 s the middle; up to 5 s at 30 and 70 %; else each 3.5 s from one second on. An empty range: the middle."""
    first, last, n = F.col("first_frame"), F.col("last_frame"), F.col("n_frames")
    step, jump = max(int(fps * 0.7), 1), int(fps * 3.5)

    def every(start, by):
        return F.when(start <= last - 1, F.sequence(start, last - 1, F.lit(by).cast("long"))).otherwise(F.array(first + F.floor(n / 2)))

    targets = (
        F.when(F.col("fast"), every(first + step // 2, step))
        .when(n / fps <= 2.0, F.array(first + F.floor(n / 2)))
        .when(n / fps <= 5.0, F.array(first + F.floor(n * 0.3), first + F.floor(n * 0.7)))
        .otherwise(every(first + int(fps), jump))
    )
    return s.select("video_id", "scene_id", F.explode(targets).alias("target_idx"))


def frame_quality(stats: DataFrame, blur: float = 70, min_lum: float = 20, max_lum: float = 238, flash: float = 0.28, min_std: float = 15, edge: Column | None = None) -> DataFrame:
    """``stats`` with ``valid``. ``edge``: whether the frame is near a scene's ends, where over-exposed ones don't count."""
    edge = F.lit(False) if edge is None else edge
    ok = (F.col("blur") >= blur) & F.col("mean_lum").between(min_lum, max_lum) & ~(edge & (F.col("over_ratio") > flash)) & (F.col("std_lum") >= min_std)
    return stats.withColumn("valid", ok)


def best_frame_in_window(targets: DataFrame, stats: DataFrame, radius: int = 3, sharp: float = 200) -> DataFrame:
    """Per target the best frame at most ``radius`` away within the scene: video_id, scene_id, target_idx, frame_idx, score.

    ``targets`` has first_frame and last_frame, ``stats`` blur and valid. Frames after the first valid one sharper than ``sharp`` don't count;
    then the sharpest valid one, else the sharpest, the earlier of equals.
    """
    near = F.explode(F.sequence(F.greatest(F.col("target_idx") - radius, F.col("first_frame")), F.least(F.col("target_idx") + radius, F.col("last_frame"))))
    t = targets.select("video_id", "scene_id", "target_idx", near.alias("frame_idx"))
    j = t.join(stats.select("video_id", "frame_idx", F.col("blur").alias("score"), "valid"), ["video_id", "frame_idx"])
    key = Window.partitionBy("video_id", "scene_id", "target_idx")
    stop = F.min(F.when(F.col("valid") & (F.col("score") > sharp), F.col("frame_idx"))).over(key)
    j = j.withColumn("stop", stop).where("stop is null or frame_idx <= stop")
    best = F.row_number().over(key.orderBy(F.desc("valid"), F.desc("score"), "frame_idx"))
    return j.withColumn("r", best).where("r = 1").select("video_id", "scene_id", "target_idx", "frame_idx", "score")


def dhash(gray: Column, rows: int = 8, columns: int = 9) -> Column:
    """64 bits of a gray patch (array, row by row): whether each value is above its left neighbour."""
    out = F.lit(0).cast("long")
    for r in range(rows):
        for c in range(columns - 1):
            bit = F.when(gray[r * columns + c + 1] > gray[r * columns + c], 1).otherwise(0).cast("long")
            out = F.shiftleft(out, 1).bitwiseOR(bit)
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def in_order(frames: DataFrame, step, schema: str, rows: int = 2000) -> DataFrame:
    """What ``step(state, row)`` gives for each of ``frames``, video by video in order of frame_idx: a pass over sorted partitions that holds one state at a time.

    ``step`` takes the video's state (None before its first frame) and a row as a tuple of ``frames``' columns, of which the first are video_id
    and frame_idx, and returns the new state and a row or None. A video stays in one task, as each frame depends on those before; its length costs no memory.
    """
    named = [x.strip() for x in schema.split(",")]

    def run(batches):
        import pyarrow as pa

        video, state, out = None, None, []
        fields = [x.split(" ")[0] for x in named]
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != video:
                    video, state = row[0], None
                state, told = step(state, row)
                if told is not None:
                    out.append(told)
            for i in range(0, len(out), rows):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[i : i + rows], strict=True), types(), strict=True)], names=fields)
            out = []

    def types():
        import pyarrow as pa

        kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
        return [kinds[x.split(" ")[1]] for x in named]

    return frames.repartition("video_id").sortWithinPartitions("video_id", "frame_idx").mapInArrow(run, schema)


def drop_near_duplicates(frames: DataFrame, threshold: int = 5, window: int = 4) -> DataFrame:
    """video_id, frame_idx, dhash of the frames kept: in order, one within ``threshold`` bits of any of the last ``window`` kept is dropped."""

    def step(last, row):
        video, frame, bits = row
        last = last or []
        if any(((bits ^ x) & 0xFFFFFFFFFFFFFFFF).bit_count() <= threshold for x in last):
            return last, None
        return [*last, bits][-window:], (video, frame, bits)

    return in_order(frames.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "dhash"), step, "video_id string, frame_idx bigint, dhash bigint")


def build_frame_map(frames: DataFrame, fps: float = 25.0) -> DataFrame:
    """video_id, frame_id (from 1), seconds, timestamp_ms, fps of frames by index from 0."""
    s = F.col("frame_idx") / fps
    return frames.select("video_id", (F.col("frame_idx") + 1).alias("frame_id"), F.round(s, 3).alias("seconds"), F.round(s * 1000).cast("long").alias("timestamp_ms"), F.lit(round(fps, 3)).alias("fps"))


def interval_timestamps(records: DataFrame, decimals: int = 3) -> DataFrame:
    """``records`` (video_id, seconds, ...) with interval_start, interval_end (the next time; null for the last) and midpoint."""
    w = Window.partitionBy("video_id").orderBy(F.col("seconds").asc_nulls_last(), "frame_id")
    nxt = F.lead("seconds").over(w)
    end = F.when(nxt >= F.col("seconds"), nxt)
    r = lambda c: F.round(c, decimals)
    return records.withColumn("interval_end", r(end)).withColumn("interval_start", r(F.col("seconds"))).withColumn("midpoint", r(F.coalesce((F.col("seconds") + F.col("interval_end")) / 2, F.col("seconds"))))


def text_event_id(records: DataFrame, text: str = "text") -> DataFrame:
    """``records`` with event_no, which grows when the text differs from the one before."""
    w = Window.partitionBy("video_id").orderBy("frame_id")
    new = F.when(F.lag(text).over(w).isNull() | (F.lag(text).over(w) != F.col(text)), 1).otherwise(0)
    return records.withColumn("new", new).withColumn("event_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


# Sounds that are no speech, and what channels say at their videos' ends.
FILLERS = ("ừ", "ờ", "à", "uhm", "uh", "ah", "um", "ồ", "ê", "hả", "dạ", "vâng")
CLOSINGS = ("hãy like và subscribe", "đăng ký kênh để", "nhấn chuông thông báo", "phụ đề thực hiện bởi", "phụ đề bởi", "subtitles by", "cảm ơn các bạn đã theo dõi", "hẹn gặp lại trong các video")


def junk_segment(text: Column, no_speech: Column, logprob: Column, fillers: tuple[str, ...] = FILLERS, closings: tuple[str, ...] = CLOSINGS) -> Column:
    """Whether a speech segment is noise: likely silence, unlikely text, hardly any text, a filler, one word four times or more, or a closing phrase among at most twelve words.

    Punctuation doesn't count. A null probability says nothing; null text is empty.
    """
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_\s]", "")))
    words = F.split(t, r"\s+")
    closing = F.exists(F.array(*[F.lit(p) for p in closings]).cast("array<string>"), lambda p: F.contains(t, p)) & (F.size(words) <= 12)
    unsure = F.coalesce(no_speech > 0.65, F.lit(False)) | F.coalesce(logprob < -1.3, F.lit(False))
    return unsure | (F.length(t) < 2) | t.isin(*fillers) | ((F.size(words) >= 4) & (F.size(F.array_distinct(words)) == 1)) | closing


def resolve_timestamp(frames: DataFrame, frame_map: DataFrame, fps: float = 0.0) -> DataFrame:
    """``frames`` (video_id, path) with seconds: of the frame map (video_id, frame_id, seconds) by the name's number, else from the file name, else number / fps, else null."""
    named = named_frame_id(F.col("path"))
    f = frames.withColumn("nth", canonical_frame_id(named).try_cast("bigint")).withColumn("plain", named.rlike("^[0-9]+$"))
    m = frame_map.groupBy(F.col("video_id").alias("m_video"), F.col("frame_id").cast("long").alias("m_frame")).agg(F.min("seconds").alias("m_seconds"))
    j = f.join(m, (F.col("video_id") == F.col("m_video")) & (F.col("nth") == F.col("m_frame")), "left")
    by_rate = F.when(F.col("plain"), F.col("nth") / float(fps)) if fps > 0 else F.lit(None).cast("double")
    return j.withColumn("seconds", F.coalesce("m_seconds", timestamp_from_name(F.col("path")), by_rate)).drop("nth", "plain", "m_video", "m_frame", "m_seconds")


def align_segments(segments: DataFrame, frames: DataFrame, default_len: float = 2.0, sep: str = " | ") -> DataFrame:
    """video_id, frame_id, text: each segment goes to every frame within it, else to the nearest by its middle of the two around its start.

    ``segments``: video_id, segment_id (order of arrival), seg_start, seg_end, text; ``frames``: video_id, frame_id, seconds.
    Distinct texts of a frame are joined in order of arrival. The nearest frame is taken among the last before the start and the first
    from it on; the earlier one wins only if strictly closer. A segment is no video's whole: pairs are bounded by its length. Segments of videos
    without frames go to frame floor(start * 25).
    """
    s = segments.withColumn("seg_end", F.coalesce("seg_end", F.col("seg_start") + default_len))
    s = s.withColumn("span", F.explode(F.sequence(F.floor(F.col("seg_start") / 60), F.floor(F.col("seg_end") / 60))))
    f = frames.select(F.col("video_id").alias("v"), "frame_id", "seconds", F.floor(F.col("seconds") / 60).alias("m"))
    inside = s.join(f, (s["video_id"] == f["v"]) & (s["span"] == f["m"]) & f["seconds"].between(s["seg_start"], s["seg_end"])).select("video_id", "segment_id", "frame_id", "text")
    alone = segments.withColumn("seg_end", F.coalesce("seg_end", F.col("seg_start") + default_len)).join(inside.select("video_id", "segment_id").distinct(), ["video_id", "segment_id"], "left_anti")
    # as-of in both directions: frames and segment starts in one order of time
    both = frames.select("video_id", F.col("seconds").alias("at"), F.lit(1).alias("kind"), F.struct("seconds", "frame_id").alias("frame"), F.lit(None).cast("long").alias("segment_id"), F.lit(None).cast("double").alias("mid"), F.lit(None).cast("string").alias("text"))
    both = both.unionByName(alone.select("video_id", F.col("seg_start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(both.schema["frame"].dataType).alias("frame"), "segment_id", ((F.col("seg_start") + F.col("seg_end")) / 2).alias("mid"), "text"))
    w = Window.partitionBy("video_id").orderBy("at", "kind", F.col("frame.frame_id"))
    both = both.withColumn("left", F.last("frame", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("right", F.first("frame", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    left, right, mid = F.col("left"), F.col("right"), F.col("mid")
    pick = F.when(right.isNull(), left).when(left.isNotNull() & (F.abs(mid - left["seconds"]) < F.abs(right["seconds"] - mid)), left).otherwise(right)
    near = both.where("kind = 0").withColumn("pick", pick).where("pick is not null").select("video_id", "segment_id", F.col("pick.frame_id").alias("frame_id"), "text")
    unmapped = segments.join(frames.select("video_id").distinct(), "video_id", "left_anti")
    unmapped = unmapped.select("video_id", "segment_id", F.floor(F.col("seg_start") * 25).cast(frames.schema["frame_id"].dataType).alias("frame_id"), "text")
    first = inside.unionByName(near).unionByName(unmapped).groupBy("video_id", "frame_id", "text").agg(F.min("segment_id").alias("at"))
    return first.groupBy("video_id", "frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), sep).alias("text"))


def transcript(segments: DataFrame) -> DataFrame:
    """video_id, transcript: its segments' texts in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "text"))), lambda x: x["text"])
    return segments.groupBy("video_id").agg(F.array_join(parts, " ").alias("transcript"))


def explode_detections(frames: DataFrame, least: float = 0.4) -> DataFrame:
    """One row a detection above ``least``: key columns, label, score, x, y, w, h from corner boxes (y1, x1, y2, x2)."""
    z = F.explode(F.arrays_zip("labels", "scores", "boxes"))
    d = frames.select("video_id", "frame_id", z.alias("d")).where(F.col("d.scores") > least)
    b = F.col("d.boxes")
    return d.select("video_id", "frame_id", F.col("d.labels").alias("label"), F.col("d.scores").alias("score"), b[1].alias("x"), b[0].alias("y"), (b[3] - b[1]).alias("w"), (b[2] - b[0]).alias("h"))


def object_count_filter(detections: DataFrame, label: str, least: int) -> DataFrame:
    """video_id, frame_id with at least so many objects of a class."""
    return detections.where(F.col("label") == label).groupBy("video_id", "frame_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def order_frames(frames: DataFrame) -> DataFrame:
    """``frames`` with ``nth`` in the video: by time, id and path if all times are known, else by id and path. Ids are in natural order."""
    missing = F.max(F.col("seconds").isNull()).over(Window.partitionBy("video_id"))
    f = frames.withColumn("missing", missing)
    w = Window.partitionBy("video_id").orderBy(F.when(~F.col("missing"), F.col("seconds")), frame_order_key(F.col("frame_id").cast("string")), "path")
    return f.withColumn("nth", F.row_number().over(w)).drop("missing")


def merge_metadata(ocr: DataFrame, asr: DataFrame) -> DataFrame:
    """video_id, frame_id, ocr_text, asr_text ('' where missing)."""
    o = ocr.select("video_id", "frame_id", F.col("text").alias("ocr_text"))
    a = asr.select("video_id", "frame_id", F.col("text").alias("asr_text"))
    return o.join(a, ["video_id", "frame_id"], "full").na.fill("", ["ocr_text", "asr_text"])


def assemble_lines(lines: DataFrame, min_len: int = 2, min_conf: float = 0.25) -> DataFrame:
    """video_id, frame_id, text, confidence: lines long and sure enough, by height then text, joined; mean confidence."""
    ok = lines.where((F.length("text") >= min_len) & (F.col("conf") >= min_conf))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("y", F.lower("text").alias("k"), "text"))), lambda x: x["text"])
    return ok.groupBy("video_id", "frame_id").agg(F.array_join(parts, " | ").alias("text"), F.round(F.avg("conf"), 3).alias("confidence"))


def align_vectors_by_rank(frames: DataFrame, vectors: DataFrame, readable: str | None = None) -> DataFrame:
    """video_id, frame_id, pos, vec: the i-th vector of a video goes to its i-th frame by name.

    ``readable`` names a boolean column of ``frames``: frames where it isn't true got no vector and are not counted.
    """
    w = Window.partitionBy("video_id").orderBy("name")
    f = (frames.where(F.col(readable)) if readable else frames).withColumn("pos", (F.row_number().over(w) - 1).cast("long")).select("video_id", "frame_id", "pos")
    return f.join(vectors, ["video_id", "pos"])


def neighbour_frames(frames: DataFrame, anchors: DataFrame, radius: int = 1) -> DataFrame:
    """video_id, anchor, frame_id, offset: frames at most ``radius`` places from an anchor in the video's order."""
    w = Window.partitionBy("video_id").orderBy("frame_id")
    n = frames.select("video_id", "frame_id", F.row_number().over(w).alias("nth"))
    a = anchors.join(n, ["video_id", "frame_id"]).select("video_id", F.col("frame_id").alias("anchor"), F.col("nth").alias("at"), F.explode(F.sequence(F.col("nth") - radius, F.col("nth") + radius)).alias("nth"))
    return a.join(n, ["video_id", "nth"]).select("video_id", "anchor", "frame_id", (F.col("nth") - F.col("at")).cast("long").alias("offset"))


def _with(value: Column, then) -> Column:
    """``then(value)``, the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def region_signature(patch: Column) -> Column:
    """A gray patch (array) with mean 0 and deviation 1; a flat one stays."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    centred = _with(total(patch) / F.size(patch), lambda m: F.transform(patch, lambda x: x - m))

    def scaled(c):
        std = F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c))
        return _with(std, lambda s: F.when(s > 1e-3, F.transform(c, lambda x: x / s)).otherwise(patch))

    return _with(centred, scaled)


def region_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference; null where a side is missing or their sizes differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total / F.size(a))


def reuse_duplicate_text(frames: DataFrame, title_below: float = 6.0, ticker_below: float = 8.0) -> DataFrame:
    """video_id, frame_idx, anchor, reused, text: a frame whose title and ticker are near those of the anchor takes the anchor's text.

    ``frames``: video_id, frame_idx, title, ticker (arrays), text. The anchor is the last frame that was not reused; one without text
    is not reused. The pass over a video's frames holds the anchor's patches alone; texts come by a join on the anchor.
    """
    columns = ["video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "title", "ticker", (F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0).alias("full")]

    def step(held, row):
        video, frame, title, ticker, full = row
        title, ticker = (None if x is None else np.array(x, float) for x in (title, ticker))
        if held is not None and held[3] and _mean_difference(held[1], title) < title_below and _mean_difference(held[2], ticker) < ticker_below:
            return held, (video, frame, held[0])
        return (frame, title, ticker, full), (video, frame, frame)

    at = in_order(frames.select(*columns), step, "video_id string, frame_idx bigint, anchor bigint")
    texts = frames.select("video_id", F.col("frame_idx").alias("anchor"), "text")
    return at.join(texts, ["video_id", "anchor"]).select("video_id", "frame_idx", "anchor", (F.col("frame_idx") != F.col("anchor")).alias("reused"), "text")


def _mean_difference(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """As ``region_difference``; nan where it is null, which is below nothing."""
    return float(np.abs(a - b).mean()) if a is not None and b is not None and len(a) == len(b) else float("nan")


def rank_text_candidates(candidates: DataFrame, top: int = 5, window: int = 5) -> DataFrame:
    """video_id, frame_id, text, confidence, score, rank: the readings of a frame, spelled right, equal ones (in any case) taken together.

    ``candidates``: video_id, frame_id, text, confidence, source, recent (the texts of the last frames). Score: 0.55 * confidence + 0.15 *
    sources (2 at most, halved) + 0.10 * quality + 0.20 * share of ``recent`` that agrees.
    """
    t = normalize_text(F.col("text"))
    c = candidates.withColumn("text", t).where(F.length("text") >= 2).withColumn("k", F.lower("text"))
    agree = F.size(F.filter(F.coalesce("recent", F.array().cast("array<string>")), lambda r: F.lower(r) == F.col("k")))
    g = c.withColumn("agree", agree).groupBy("video_id", "frame_id", "k").agg(F.min("text").alias("text"), F.max(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence"))).alias("confidence"), F.countDistinct("source").alias("sources"), F.max("agree").alias("agree"))
    score = 0.55 * F.col("confidence") + 0.15 * F.least(F.lit(1.0), F.col("sources") / 2) + 0.10 * text_quality(F.col("text")) + 0.20 * F.least(F.lit(1.0), F.col("agree") / window)
    w = Window.partitionBy("video_id", "frame_id").orderBy(F.desc("score"), F.desc("confidence"), F.desc(F.length("text")), "k")
    ranked = g.withColumn("score", F.round(score, 4)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("video_id", "frame_id", "text", F.round("confidence", 3).alias("confidence"), "score", "rank")

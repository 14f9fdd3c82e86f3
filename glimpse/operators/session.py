"""Sessions, submissions and scores; work lists and append logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimpse.functions.text import plain_video, strip


def upsert_docs(base: DataFrame, updates: DataFrame) -> DataFrame:
    """video_id, frame_id, text: a key's last text (by seq in ``updates``), else the old one."""
    u = base.select("video_id", "frame_id", "text", F.lit(-1).cast("long").alias("seq")).unionByName(updates.select("video_id", "frame_id", "text", "seq"))
    return u.groupBy("video_id", "frame_id").agg(F.max_by("text", F.struct("seq", "text")).alias("text"))


def pending_work(videos: DataFrame, done: DataFrame) -> DataFrame:
    return videos.join(done.select("video_id"), "video_id", "left_anti")


def latest_complete_block(lines: DataFrame, stretch: int = 100_000) -> DataFrame:
    """line_no, video_id, text of each video's last block that ended with ``done`` and has no bad line.

    ``lines``: log (a file), line_no, video_id (null in bad lines), text, done. A block is a run of lines of one video; it ends at a done line,
    at another video, or at the log's end. A log is looked at in stretches of ``stretch`` line numbers, each with the last line before it and the number
    of blocks begun before it, so that one long log is many tasks' work. A video's last block is the one of the last log by name.
    """
    l = lines.select("log", "line_no", "video_id", "text", F.coalesce("done", F.lit(False)).alias("done")).withColumn("stretch", F.floor(F.col("line_no") / stretch))
    in_log = Window.partitionBy("log").orderBy("stretch")  # of a row a stretch
    inside = Window.partitionBy("log", "stretch").orderBy("line_no")
    ends = l.groupBy("log", "stretch").agg(F.max_by(F.struct("video_id", "done"), "line_no").alias("end"))
    ends = ends.select("log", "stretch", F.lag("end").over(in_log).alias("before"))
    at = l.join(ends, ["log", "stretch"]).withColumn("last", F.coalesce(F.lag(F.struct("video_id", "done")).over(inside), "before"))
    at = at.withColumn("new", F.when(F.col("last").isNull() | ~F.col("video_id").eqNullSafe(F.col("last.video_id")) | F.col("last.done"), 1).otherwise(0))
    begun = at.groupBy("log", "stretch").agg(F.sum("new").alias("n"))
    begun = begun.select("log", "stretch", F.coalesce(F.sum("n").over(in_log.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    b = at.withColumn("nth", F.sum("new").over(inside)).join(begun, ["log", "stretch"]).withColumn("block", F.col("earlier") + F.col("nth"))
    good = b.groupBy("log", "block", "video_id").agg(F.max("done").alias("ok"), F.max("line_no").alias("end")).where("ok and video_id is not null")
    last = good.groupBy("video_id").agg(F.max(F.struct("log", "end", "block")).alias("m")).select("video_id", "m.log", "m.block")
    return b.join(last, ["log", "block", "video_id"]).where("not done").select("video_id", "line_no", "text")


def run_summary(segments: DataFrame) -> DataFrame:
    """Per video: segments, those with text, empty ones, and the last end."""
    full = F.length(F.trim("text")) > 0
    return segments.groupBy("video_id").agg(F.count("*").alias("n_segments"), F.count(F.when(full, 1)).alias("n_ok"), F.count(F.when(~full, 1)).alias("n_empty"), F.max("seg_end").alias("duration"))


def corpus_stats(**tables: DataFrame) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("kind"), "n_rows") for k, t in tables.items()])


def video_counts(turns: DataFrame, top_videos: int = 5) -> DataFrame:
    """session_id, video_id, n, weight: how often a session's turns named a video among their first five, and the sum of 1/turn."""
    t = turns.select("session_id", "turn_no", F.explode(F.slice("videos", 1, top_videos)).alias("video_id"))
    return t.groupBy("session_id", "video_id").agg(F.count("*").alias("n"), F.round(F.sum(1.0 / F.col("turn_no")), 6).alias("weight"))


def conversation_memory(turns: DataFrame, top_videos: int = 5, last: int = 3, focus: int = 3) -> DataFrame:
    """session_id, n_turns, last_queries (oldest first), focus_videos (commonest, ties by first appearance)."""
    q = turns.groupBy("session_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn_no", "text"))).alias("q"))
    q = q.select("session_id", "n_turns", F.transform(F.slice("q", F.greatest(F.size("q") - last + 1, F.lit(1)), F.lit(last)), lambda x: x["text"]).alias("last_queries"))
    v = turns.select("session_id", "turn_no", F.posexplode(F.slice("videos", 1, top_videos)).alias("i", "video_id"))
    v = v.groupBy("session_id", "video_id").agg(F.count("*").alias("n"), F.min(F.struct("turn_no", "i")).alias("first"))
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "first"))
    v = v.withColumn("r", r).where(F.col("r") <= focus).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("r", "video_id"))).alias("v"))
    return q.join(v, "session_id", "left").select("session_id", "n_turns", F.array_join("last_queries", " // ").alias("last_queries"), F.array_join(F.transform("v", lambda x: x["video_id"]), ",").alias("focus_videos"))


def query_history(log: DataFrame, cap: int = 60) -> DataFrame:
    """user, query, place: a user's queries, newest first, each once, so many."""
    once = log.groupBy("user", "query").agg(F.max("at").alias("at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("at"), "query"))).where(F.col("place") <= cap).select("user", "query", "place")


def keep_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("r = 1").drop("r")


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with videos' names without .mp4, and ``same``, by which names are compared."""
    return rows.withColumn("video_id", plain_video(F.col("video_id"))).withColumn("same", F.lower("video_id"))


def _candidate(rows: DataFrame) -> Column:
    """A row's candidate, the first where there is none."""
    return F.coalesce(F.col("candidate"), F.lit(1)).cast("long") if "candidate" in rows.columns else F.lit(1).cast("long")


def selection_tray(events: DataFrame, cap: int = 10) -> DataFrame:
    """query_id, task, video_id, frame_id, place: frames added in order, each once; ten at most unless the task is trake.

    Names of videos are the same in any case and with .mp4 or without. In trake a frame may be in several candidates (column candidate, 1 where missing).
    """
    e = _named(events).withColumn("in", F.when(F.col("task") == "trake", _candidate(events)).otherwise(F.lit(0).cast("long")))
    once = keep_first(e, ["query_id", "in", "same", "frame_id"], "seq")
    p = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("seq")))
    return p.where((F.col("task") == "trake") | (F.col("place") <= cap)).select("query_id", "task", "video_id", "frame_id", "place")


def kis_rows(selection: DataFrame) -> DataFrame:
    """query_id, line_no, line: video,frame lines, each once (names in any case, without .mp4), in order of selection."""
    once = keep_first(_named(selection), ["query_id", "same", "frame_id"], "seq")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("seq"))
    return once.select("query_id", n.alias("line_no"), F.concat_ws(",", "video_id", F.col("frame_id").cast("string")).alias("line"))


def _answers(selection: DataFrame) -> Column:
    """The answers of a frame, else the common ones: texts cut at bars, semicolons and line feeds, blank ones left out."""
    cut = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"[|;\n]"), strip), lambda a: a != "")
    return F.when(F.size(cut("answers")) > 0, cut("answers")).otherwise(cut("common") if "common" in selection.columns else F.array().cast("array<string>"))


def qa_rows(selection: DataFrame, longest: int = 100) -> DataFrame:
    """query_id, line_no, line: video,frame,"answer" for every answer of a frame (else the common ones, else 0).

    Of lines with the same video, frame and answer, in any case, the first stays.
    """
    own = _answers(selection)
    s = _named(selection).select("query_id", "seq", "video_id", "same", "frame_id", F.posexplode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("0")))).alias("i", "answer"))
    s = s.withColumn("answer", F.substring("answer", 1, longest))
    line = F.concat(F.col("video_id"), F.lit(","), F.col("frame_id").cast("string"), F.lit(',"'), F.replace("answer", F.lit('"'), F.lit('""')), F.lit('"'))
    s = s.withColumn("line", line).groupBy("query_id", "same", "frame_id", F.lower("answer").alias("a")).agg(F.min(F.struct("seq", "i", "line")).alias("o"))
    return s.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("o")).alias("line_no"), F.col("o.line").alias("line"))


def qa_payload(selection: DataFrame, fps: float = 25.0) -> DataFrame:
    """query_id, place, text: answer-video-milliseconds for every answer of every frame, as a contest takes questions; a query without frames gives its answers alone.

    ``selection``: query_id, seq, video_id (null: no frame), frame_id, timestamp_ms, seconds, answers, common. A frame's time is its timestamp, else its seconds above 0, else its number by rate.
    """
    ms = F.coalesce(F.col("timestamp_ms").cast("long"), F.when(F.col("seconds") > 0, F.floor(F.col("seconds") * 1000 + 0.5)), F.floor(F.col("frame_id") * (1000.0 / fps) + 0.5))
    s = _named(selection.withColumn("video_id", F.element_at(F.split("video_id", "/"), -1)))
    s = s.select("query_id", "seq", "video_id", ms.alias("ms"), F.posexplode(_answers(selection)).alias("i", "answer"))
    text = F.when(F.col("video_id").isNull(), F.col("answer")).otherwise(F.concat_ws("-", "answer", "video_id", F.col("ms").cast("string")))
    return s.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("seq", "i")).alias("place"), text.alias("text"))


def trake_rows(selection: DataFrame) -> DataFrame:
    """query_id, line_no, line: per candidate its first frame's video and its distinct frames above 0, ascending; the lines of ``kis_rows`` for a query where no candidate has such a frame."""
    s = _named(selection).withColumn("candidate", _candidate(selection))
    g = s.groupBy("query_id", "candidate").agg(F.min_by("video_id", "seq").alias("video"), F.array_sort(F.collect_set(F.when(F.col("frame_id") > 0, F.col("frame_id")))).alias("f")).where(F.size("f") > 0)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("candidate"))
    chains = g.select("query_id", n.alias("line_no"), F.concat_ws(",", "video", F.array_join(F.transform("f", lambda x: x.cast("string")), ",")).alias("line"))
    some = selection.groupBy("query_id").agg(F.max(F.coalesce(F.col("frame_id") > 0, F.lit(False))).alias("some")).where("not some").select("query_id")
    return chains.unionByName(kis_rows(selection.join(some, "query_id", "left_semi")))


def renumber(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("candidate", F.dense_rank().over(Window.partitionBy("query_id").orderBy("candidate")))


def task_type(name: Column) -> Column:
    n = F.lower(name)
    return F.when(F.contains(n, F.lit("-trake")), "trake").when(F.contains(n, F.lit("-qa")) | F.contains(n, F.lit("-vqa")), "qa").otherwise("kis")


def submission_window(selection: DataFrame, pad_ms: int = 2500) -> DataFrame:
    """``selection`` with start_ms and end_ms around timestamp_ms."""
    return selection.withColumn("start_ms", F.greatest(F.col("timestamp_ms") - pad_ms, F.lit(0).cast("long"))).withColumn("end_ms", F.col("timestamp_ms") + pad_ms)


def submission_status(lines: DataFrame) -> DataFrame:
    return lines.groupBy("query_id").agg(F.count("*").alias("n_lines"))


def reciprocal_ranks(hits: DataFrame, judged: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, rr: 1 / rank of the first relevant hit, 0 without one. ``judged`` (video_id, frame_id) holds for all queries, or for one each with query_id.

    Queries without hits count where they are named: those of ``queries``, else those of ``judged``.
    """
    key = ["video_id", "frame_id", *(["query_id"] if "query_id" in judged.columns else [])]
    j = hits.join(judged.select(*key).distinct().withColumn("good", F.lit(1)), key, "left")
    found = j.groupBy("query_id").agg(F.coalesce(F.round(1.0 / F.min(F.when(F.col("good") == 1, F.col("rank"))), 6), F.lit(0.0)).alias("rr"))
    asked = queries if queries is not None else judged if "query_id" in judged.columns else None
    return found if asked is None else asked.select("query_id").distinct().join(found, "query_id", "left").na.fill(0.0, ["rr"])


def mean_reciprocal_rank(ranks: DataFrame) -> DataFrame:
    """One row: mrr, n_queries."""
    return ranks.agg(F.coalesce(F.round(F.avg("rr"), 6), F.lit(0.0)).alias("mrr"), F.count("*").alias("n_queries"))


def contest_score(t: Column, limit: Column, wrong: Column) -> Column:
    """max(0, 50 + 50 * (1 - t / limit) - 10 * wrong)."""
    return F.greatest(F.lit(0.0), 50 + 50 * (1 - t / limit) - 10 * wrong)


def write_submission(lines: DataFrame, path: str, most: int = 100) -> None:
    """One text file a query under path/query_id=..., ``most`` lines at most, in order."""
    lines.where(F.col("line_no") <= most).repartition("query_id").sortWithinPartitions("query_id", "line_no").select("query_id", F.col("line").alias("value")).write.partitionBy("query_id").text(path)


def validate_submission(lines: DataFrame, most: int = 100) -> DataFrame:
    """file, line_no, line, problem: the lines of submissions as they are sent; ``problem`` names why a line is left out (header, repeated).

    ``lines``: file, line_no, line. Blank lines don't count; ``most`` lines are looked at, a header among them. A video loses its .mp4.
    In files of questions the answer loses outer quotes, is cut at 100 characters and quoted anew. Of lines with the same video (in any
    case), frame and, for questions, answer, the first stays.
    """
    w = Window.partitionBy("file").orderBy("line_no")
    q = lines.withColumn("line", F.trim("line")).where("line != ''").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    qa = F.contains(F.lower("file"), F.lit("qa"))
    head = (F.col("n") == 1) & F.lower("line").rlike("video|frame|answer|mediaitem|time")
    parts = F.transform(F.split("line", ","), lambda p: F.trim(p))
    q = q.withColumn("p", parts).withColumn("v", F.trim(F.regexp_replace(F.col("p")[0], r"(?i)\.mp4$", "")))
    rest = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    answer = F.trim(F.array_join(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0))), ","))
    bare = F.when(answer.rlike(r"""(?s)^(".*"|'.*')$""") & (F.length(answer) >= 2), F.trim(F.substring(answer, F.lit(2), F.length(answer) - 2))).otherwise(answer)
    quoted = F.concat(F.col("v"), F.lit(","), F.col("p")[1], F.lit(',"'), F.replace(F.substring(bare, 1, 100), F.lit('"'), F.lit('""')), F.lit('"'))
    asks = qa & (F.size("p") >= 3)
    q = q.withColumn("clean", F.when(asks, quoted).otherwise(F.concat_ws(",", F.array("v"), rest))).withColumn("header", head)
    key = F.when(asks, F.lower("clean")).when(F.size("p") >= 2, F.concat_ws("_", F.lower("v"), F.col("p")[1])).otherwise(F.lower("clean"))
    again = F.row_number().over(Window.partitionBy("file", "header", "key").orderBy("n")) > 1
    q = q.withColumn("key", key).withColumn("again", again)
    return q.select("file", "line_no", F.col("clean").alias("line"), F.when(F.col("header"), "header").when(F.col("again"), "repeated").alias("problem"))


def submission_errors(lines: DataFrame, most: int = 100) -> DataFrame:
    """file, row, line, warnings, errors: the lines of submissions as a checker at the desk rewrites them, each with what is odd or wrong.

    ``lines``: file, line_no, line. Blank lines don't count; ``most`` lines are looked at, then a header is left out; ``row`` counts from
    what follows it. The kind of a file is kis, qa or trake, whichever its name holds first in this order; other files only lose .mp4.
    Frames are digits, 38 at most. Trake frames become distinct and ascending. Nothing is left out as repeated. A null line is blank.
    """
    w = Window.partitionBy("file").orderBy("line_no")
    q = lines.withColumn("line", F.trim("line", F.lit(" \t\r"))).where("line != ''").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    q = q.withColumn("head", ((F.col("n") == 1) & F.lower("line").rlike("video|frame|answer|mediaitem")).cast("int"))
    q = q.withColumn("row", F.col("n") - F.max("head").over(Window.partitionBy("file"))).where("head = 0")
    name, number = F.lower("file"), r"^[0-9]{1,38}$"
    kind = F.when(F.contains(name, F.lit("kis")), "kis").when(F.contains(name, F.lit("qa")), "qa").when(F.contains(name, F.lit("trake")), "trake").otherwise("")
    q = q.withColumn("kind", kind).withColumn("p", F.transform(F.split("line", ","), lambda p: F.trim(p, F.lit(" \t\r")))).withColumn("size", F.size("p"))
    q = q.withColumn("v", F.regexp_replace(F.col("p")[0], r"(?i)\.mp4$", "")).withColumn("rest", F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))))
    said = F.trim(F.array_join(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0))), ","))
    bare = F.when(said.rlike(r"""(?s)^(".*"|'.*'|"|')$"""), F.trim(F.substring(said, F.lit(2), F.greatest(F.length(said) - 2, F.lit(0))))).otherwise(said)
    q = q.withColumn("answer", bare).withColumn("frames", F.filter("rest", lambda x: x.rlike(number)))
    k, size = F.col("kind"), F.col("size")
    warnings = F.array(
        F.when(F.col("v") != F.col("p")[0], "mp4"),
        F.when((k == "qa") & (size < 3), "no answer").when((k == "qa") & (F.length("answer") > 100), "long answer"),
        F.when((k == "trake") & (F.size("frames") < F.size("rest")), "frame is no number"),
    )
    errors = F.when(k.isin("kis", "trake") & (size < 2), "no frame").when((k == "kis") & ~F.get("p", F.lit(1)).rlike(number), "frame is no number").when((k == "trake") & (F.size("frames") == 0), "no frame")
    quoted = F.concat(F.lit('"'), F.replace(F.substring("answer", 1, 100), F.lit('"'), F.lit('""')), F.lit('"'))
    chain = F.transform(F.array_sort(F.array_distinct(F.transform("frames", lambda x: x.cast("decimal(38,0)")))), lambda x: x.cast("string"))
    kept = F.when((k == "qa") & (size >= 3), F.array(F.get("rest", F.lit(0)), quoted)).when((k == "trake") & (F.size("frames") > 0), chain).otherwise(F.col("rest"))
    said_warnings = F.array_join(F.filter(warnings, lambda x: x.isNotNull()), "; ")
    return q.select("file", "row", F.concat_ws(",", F.array("v"), kept).alias("line"), said_warnings.alias("warnings"), F.coalesce(errors, F.lit("")).alias("errors"))


def selection_band(tray: DataFrame) -> DataFrame:
    """query_id, n_frames, band: how a tray of that many frames is rated: best (1), fine (2, 3), many (4, 5), too many; none for trake."""
    n = F.col("n_frames")
    band = F.when(F.col("trake"), None).when(n == 1, "best").when(n <= 3, "fine").when(n <= 5, "many").otherwise("too many")
    return tray.groupBy("query_id").agg(F.count("*").alias("n_frames"), F.max(F.col("task") == "trake").alias("trake")).select("query_id", "n_frames", band.alias("band"))

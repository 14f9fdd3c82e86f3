"""Readers of the files that extraction jobs leave behind. Lines that can't be read stay aside in ``_corrupt_record``; nothing is inferred."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimpse.functions.text import doc_key, key_frame, key_video

TEXT_RECORD = "video_id string, frame_id long, text string, confidence double, reused boolean, timestamp_sec double, interval_start_sec double, interval_end_sec double, event_id long, video_done boolean, _corrupt_record string"
SPEECH_RECORD = "video_path string, segment_id long, start double, `end` double, language string, text string, asr_text string, status string, _corrupt_record string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: below ``spark.checkpoint.dir``, or in local mode a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='glimpse-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/glimpse/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again, for tables that several parts of a job need."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: str, name: str, rows: int = 1_000_000) -> DataFrame:
    """``df`` with each row's place by ``order``, from 0, as column ``name``: ranges of about ``rows`` are sorted apart and counted, so that no task sorts all."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    s = staged(df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_range", F.shiftright("_at", 33))
    per = s.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.join(F.broadcast(per.withColumn("_before", before)), "_range").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).select(*df.columns, name)


def unreadable_lines(spark: SparkSession, path: str, record: str = TEXT_RECORD) -> DataFrame:
    """file, line: the lines of JSON files below ``path`` that aren't records, which the readers leave out. Blank lines are none."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).where("trim(value) != ''")
    parsed = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.from_json("value", record, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.where("r._corrupt_record is not null").select("file", "line")


def read_frame_map(spark: SparkSession, path: str) -> DataFrame:
    """batch, video_id, frame_id, seconds, timestamp_ms, fps of every ``*_map.csv`` below ``path``.

    The video is in the file's name, the batch in its folder's. Files have a header and two columns (frame, seconds) or four and more;
    with fewer, timestamp_ms comes from the seconds. Rows without a frame from 1 or with negative time are dropped.
    """
    raw = spark.read.schema("f string, s string, v string, ms string, fps string").option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_map.csv").csv(path)
    file = F.col("_metadata.file_path")
    rows = raw.select(
        F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("batch"), F.regexp_extract(file, r"([^/]+)_map\.csv$", 1).alias("video_id"),
        F.expr("try_cast(f as double)").cast("long").alias("frame_id"), F.expr("try_cast(s as double)").alias("seconds"), F.expr("try_cast(ms as double)").alias("ms"), F.expr("try_cast(fps as double)").alias("fps"),
    )
    return rows.where("frame_id >= 1 and seconds >= 0").select("batch", "video_id", "frame_id", "seconds", F.coalesce("ms", F.col("seconds") * 1000).cast("long").alias("timestamp_ms"), "fps")


def read_ocr_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """key, video_id, frame_id, text, ... of on-screen text; blank texts and closing records are left out. A video's name is its last path element."""
    raw = spark.read.schema(TEXT_RECORD).option("recursiveFileLookup", True).json(path)
    video = F.element_at(F.split("video_id", "/"), -1)
    return raw.where("trim(text) != ''").select(doc_key(video, F.col("frame_id")).alias("key"), video.alias("video_id"), "frame_id", F.trim("text").alias("text"), "confidence", "timestamp_sec", "interval_start_sec", "interval_end_sec", "event_id")


def read_asr_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """video_id, segment_id, seg_start, seg_end, text of speech segments; records without text, as the summaries, are left out."""
    raw = spark.read.schema(SPEECH_RECORD).option("recursiveFileLookup", True).json(path)
    return segments(raw)


def segments(raw: DataFrame, *more: Column) -> DataFrame:
    """Speech records as segments, with ``more`` columns of the records."""
    text = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.nullif(F.trim("asr_text"), F.lit("")))
    video = F.regexp_replace(F.element_at(F.split("video_path", "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return raw.select(video.alias("video_id"), "segment_id", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), text.alias("text"), *more).where("text is not null")


def read_metadata_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """kind (ocr, asr), key, video_id, frame_id, text of merged metadata files: one object of two maps each, or one a line."""
    m = spark.read.schema("ocr map<string,string>, asr map<string,string>").option("multiLine", multi_line).json(path)
    one = lambda kind: m.select(F.lit(kind).alias("kind"), F.explode(kind).alias("key", "text"))
    k = F.col("key")
    return one("ocr").unionByName(one("asr")).select("kind", "key", key_video(k).alias("video_id"), key_frame(k).alias("frame_id"), "text")


def list_media(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("mp4", "mkv", "avi", "mov", "webp", "jpg", "png")) -> DataFrame:
    """path, length, modified of media files below ``path``; their bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions)).select("path", "length", F.col("modificationTime").alias("modified")).distinct()

"""Queries over files that Spark writes from the test tables and reads again, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimpse.functions import text as tx
from glimpse.operators import session as ss
from glimpse.plans import fixtures as fx
from glimpse.plans.catalog import ORACLES, _turns, query
from glimpse.plans.fixtures import ctes
from glimpse.sources import readers as rd
from glimpse.streaming import ingest


@query(ctes("kf") + " select 'V'||cast(event_id % 8 as varchar) as video_id, frame_id, seconds, case when event_id % 8 < 4 then trunc(seconds*1000)::bigint else event_id end as timestamp_ms from kf where seconds >= 0 and frame_id >= 1")
def read_frame_map(spark, d):
    """Each of eight videos is a file; four have two columns, four have all."""
    path = rd.scratch(spark, "maps")
    k = fx.keyframes(spark, d).withColumn("n", F.col("event_id") % 8)
    full = F.col("n") >= 4
    rows = k.select("n", F.col("frame_id").alias("FrameID"), F.col("seconds").alias("Seconds"), F.when(full, "x").alias("VideoID"), F.when(full, F.col("event_id").cast("double")).alias("Timestamp_ms"), F.when(full, 25.0).alias("FPS"))
    rows.repartition(8, "n").write.partitionBy("n").option("header", True).csv(f"{path}/raw")
    _as_maps(spark, f"{path}/raw", f"{path}/maps")
    return rd.read_frame_map(spark, f"{path}/maps").select("video_id", "frame_id", "seconds", "timestamp_ms")


def _renamed(spark, source, target, column, names):
    """Give each folder's one file its name in ``target``, by the file system's own API."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(target))
    for value, name in names.items():
        for f in fs.globStatus(path(f"{source}/{column}={value}/part-*")) or []:
            fs.rename(f.getPath(), path(f"{target}/{name}"))


def _as_maps(spark, source, target):
    """Give every written file a video's name, by the file system's own API."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(source)
    fs = root.getFileSystem(conf)
    for n in range(8):
        parts = [f.getPath() for f in (fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{source}/n={n}/part-*")) or [])]
        for i, p in enumerate(parts):
            to = jvm.org.apache.hadoop.fs.Path(f"{target}/b{i}/V{n}_map.csv")
            fs.mkdirs(to.getParent())
            fs.rename(p, to)


@query("select source||'/keyframes/keyframe_'||cast(doc_id+1 as varchar)||'.webp' as key, source as video_id, doc_id+1 as frame_id, trim(text, ' ') as text from documents where trim(text, ' ') <> ''")
def read_ocr_jsonl(spark, d):
    path = rd.scratch(spark, "ocr")
    fx.docs(spark, d).select(F.concat(F.lit("l1/"), "video_id").alias("video_id"), "frame_id", "text").write.json(path)
    return rd.read_ocr_jsonl(spark, path).select("key", "video_id", "frame_id", "text")


def _speech(spark, d):
    """Each conversation has a folder, as names of videos are cut and may repeat."""
    path = rd.scratch(spark, "asr")
    s = fx.segments(spark, d, "conv_id")
    s.select(F.concat(F.lit("/in/"), F.col("conv_id").cast("string"), F.lit("/"), "video_id", F.lit(".mp4")).alias("video_path"), "segment_id", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), F.when(F.col("segment_id") % 2 == 0, F.col("text")).alias("text"), F.col("text").alias("asr_text")).write.json(path)
    return path


_SEG = " select video_id, segment_id, seg_start, seg_end, trim(text, ' ') as text from sx where trim(text, ' ') <> ''"


@query(ctes("sx") + _SEG)
def read_asr_jsonl(spark, d):
    return rd.read_asr_jsonl(spark, _speech(spark, d))


@query("select 'ocr' as kind, source||'/keyframes/keyframe_'||cast(doc_id+1 as varchar)||'.webp' as key, source as video_id, doc_id+1 as frame_id, text from documents where text is not null")
def read_metadata_json(spark, d):
    path = rd.scratch(spark, "metadata")
    x = fx.docs(spark, d).where("text is not null")
    m = F.create_map(tx.doc_key(F.col("video_id"), F.col("frame_id")), F.col("text"))
    x.select(m.alias("ocr")).write.json(path)
    return rd.read_metadata_json(spark, path, multi_line=False)


@query("select 'V'||source||'.TXT' as name, sum(strlen(doc_id::varchar) + 1)::bigint as length from documents where source <> 'src0' group by source")
def list_media(spark, d):
    """A file a source, with a line a document; those of another kind aren't listed."""
    path = rd.scratch(spark, "media")
    fx.docs(spark, d).repartition(8, "video_id").select("video_id", F.col("doc_id").cast("string").alias("value")).write.partitionBy("video_id").text(f"{path}/raw")
    names = {r[0]: f"V{r[0]}.{'TXT' if r[0] != 'src0' else 'log'}" for r in fx.docs(spark, d).select("video_id").distinct().collect()}  # a file each
    _renamed(spark, f"{path}/raw", f"{path}/media", "video_id", names)
    return rd.list_media(spark, f"{path}/media", ("txt",)).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").cast("long").alias("length"))


@query(ctes("kf") + ", s as (select event_id % 20 as query_id, event_id as seq, video_id, frame_id % 5 as frame_id from kf), o as (select query_id, video_id, frame_id, min(seq) as seq from s group by all), n as (select query_id, row_number() over (partition by query_id order by seq) as line_no, video_id||','||cast(frame_id as varchar) as line from o) select query_id, line from n where line_no <= 100")
def write_submission(spark, d):
    path = rd.scratch(spark, "submission")
    k = fx.keyframes(spark, d).select((F.col("event_id") % 20).alias("query_id"), F.col("event_id").alias("seq"), "video_id", (F.col("frame_id") % 5).alias("frame_id"))
    ss.write_submission(ss.kis_rows(k), path)
    return spark.read.text(path).select(F.col("query_id").cast("long").alias("query_id"), F.col("value").alias("line"))


@query("select doc_id, '{not json '||cast(doc_id as varchar) as line from documents")
def unreadable_lines(spark, d):
    """Every document gives one good line and one bad one."""
    path = rd.scratch(spark, "bad")
    x = fx.docs(spark, d)
    good = x.select(F.to_json(F.struct("video_id", "frame_id", F.coalesce("text", F.lit("")).alias("text"))).alias("value"))
    good.unionByName(x.select(F.concat(F.lit("{not json "), F.col("doc_id").cast("string")).alias("value"))).write.text(path)
    return rd.unreadable_lines(spark, path).select(F.regexp_extract("line", "([0-9]+)$", 1).cast("long").alias("doc_id"), "line")


@query("select source||'/keyframes/keyframe_'||cast(doc_id+1 as varchar)||'.webp' as key, source as video_id, doc_id+1 as frame_id, trim(text, ' ') as text from documents where trim(text, ' ') <> ''")
def stream_ingest_texts(spark, d):
    path = rd.scratch(spark, "ingest")
    fx.docs(spark, d).select(F.concat(F.lit("l1/"), "video_id").alias("video_id"), "frame_id", "text").write.json(f"{path}/in")
    ingest.stream_ingest_texts(spark, f"{path}/in", f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("key", "video_id", "frame_id", "text")


@query(ctes("sx") + _SEG + """ and length(lower(trim(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', '', 'g')))) >= 2 and not (len(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g')), '\\s+')) >= 4 and len(list_distinct(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g')), '\\s+'))) = 1)""")
def stream_ingest_segments(spark, d):
    path = rd.scratch(spark, "ingest")
    ingest.stream_ingest_segments(spark, _speech(spark, d), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("video_id", "segment_id", "seg_start", "seg_end", "text")


@query("select time_bucket(interval '10 minutes', ts) as start, user_id::bigint as session_id, event_type as video_id, count(*) as n from events group by all")
def stream_video_interest(spark, d):
    path = rd.scratch(spark, "interest")
    e = fx.table(spark, d, "events")
    e.select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("long").alias("session_id"), F.col("event_type").alias("video_id")).write.parquet(f"{path}/in")
    turns = spark.readStream.schema("at timestamp, session_id long, video_id string").parquet(f"{path}/in")
    ingest.stream_video_interest(turns, f"{path}/out", f"{path}/state").awaitTermination()
    return ingest.latest_counts(spark.read.parquet(f"{path}/out")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(ORACLES["conversation_memory"])
def stream_conversation_memory(spark, d):
    """Turns in three deliveries, later turns first, every seventh session's twice; equal to the memory in batch."""
    path = rd.scratch(spark, "memory")
    t = _turns(spark, d).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn_no")))
    t = t.unionByName(t.where("session_id % 7 = 0"))
    for i in range(3):
        t.where((F.col("turn_no") + i) % 3 == 0).coalesce(1).write.mode("append").parquet(f"{path}/in")
    turns = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    ingest.stream_conversation_memory(turns, f"{path}/out", f"{path}/state").awaitTermination()
    return ingest.latest_memory(spark.read.parquet(f"{path}/out"))

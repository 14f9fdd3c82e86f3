"""Views of the driver's tables that play the engine's inputs: frames, on-screen text, speech, vectors, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyframes(spark, d) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    e = table(spark, d, "events").withColumn("us", us)
    return e.select(F.concat(F.lit("V"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("video_id"), (F.floor(F.col("us") / 40000.0) + 1).cast("long").alias("frame_id"), (F.col("us") / 1000000.0).alias("seconds"), "event_type", F.col("value").cast("double").alias("value"), F.col("event_id").cast("long").alias("event_id"))


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("video_id"), (F.col("doc_id") + 1).alias("frame_id"), "doc_id", "text", "lang")


def vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    s = table(spark, d, "documents").select("doc_id", "source")
    return e.join(s, e["vec_id"] == s["doc_id"]).select(F.col("source").alias("video_id"), (F.col("vec_id") + 1).alias("frame_id"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def segments(spark, d, *more: str) -> DataFrame:
    start = F.col("turn") * 20.0
    return table(spark, d, "conversations").select(F.concat(F.lit("C"), F.lpad(F.col("conv_id").cast("string"), 4, "0")).alias("video_id"), F.col("turn").cast("long").alias("segment_id"), start.alias("seg_start"), (start + F.least(F.length("text") / 15.0, F.lit(45.0))).alias("seg_end"), "text", "role", *more)


def queries(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text")


def query_vectors(spark, d) -> DataFrame:
    return vectors(spark, d).where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))


def stage_hits(spark, d) -> DataFrame:
    stage = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 3).cast("long")
    return keyframes(spark, d).select(F.lit(1).cast("long").alias("query_id"), stage.alias("stage"), "video_id", "frame_id", (F.col("value") / 500.0).alias("score")).where("stage is not null")


def frame_predictions(spark, d) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("seconds", "event_id")
    return keyframes(spark, d).select("video_id", (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), F.when(F.col("value") > 200, 0.9).otherwise(0.1).alias("p"), "value", "event_id", "seconds")


def frame_statistics(spark, d) -> DataFrame:
    e = F.col("event_id")
    return frame_predictions(spark, d).select("video_id", "frame_idx", "event_id", F.col("value").alias("blur"), (e * 37 % 256).cast("double").alias("mean_lum"), (e * 13 % 60).cast("double").alias("std_lum"), (e * 7 % 100 / 100.0).alias("over_ratio"))


def frame_hashes(spark, d) -> DataFrame:
    e = F.col("event_id")
    return frame_predictions(spark, d).select("video_id", "frame_idx", (e * 7919 % 4096).cast("long").alias("dhash"))


#: The same views for DuckDB, as common table expressions.
SQL = {
    "kf": "kf as (select 'V'||lpad(cast(user_id as varchar),4,'0') as video_id, cast(floor((epoch_us(ts)-1704067200000000)/40000.0) as bigint)+1 as frame_id, ((epoch_us(ts)-1704067200000000)/1000000.0)::double as seconds, event_type, value::double as value, event_id::bigint as event_id from events)",
    "dx": "dx as (select source as video_id, doc_id+1 as frame_id, doc_id, text, lang from documents)",
    "vx": "vx as (select source as video_id, vec_id+1 as frame_id, vec_id, label, embedding::double[] as vec from embeddings join documents on vec_id = doc_id)",
    "sx": "sx as (select 'C'||lpad(cast(conv_id as varchar),4,'0') as video_id, turn::bigint as segment_id, turn*20.0::double as seg_start, turn*20.0::double+least(length(text)/15.0::double,45.0::double) as seg_end, text, role from conversations)",
    "qx": "qx as (select item_id::bigint as query_id, text from benchmark)",
    "qv": "qv as (select vec_id as query_id, vec as qvec from vx where vec_id % 25 = 0)",
    "sh": "sh as (select 1::bigint as query_id, (case event_type when 'click' then 1 when 'view' then 2 else 3 end)::bigint as stage, video_id, frame_id, value/500.0::double as score from kf where event_type in ('click','view','purchase'))",
    "fp": "fp as (select video_id, row_number() over (partition by video_id order by seconds, event_id) - 1 as frame_idx, case when value > 200 then 0.9::double else 0.1::double end as p, value, event_id, seconds from kf)",
    "fs": "fs as (select video_id, frame_idx, event_id, value as blur, (event_id*37%256)::double as mean_lum, (event_id*13%60)::double as std_lum, (event_id*7%100)/100.0::double as over_ratio from fp)",
    "fh": "fh as (select video_id, frame_idx, (event_id*7919%4096)::bigint as dhash from fp)",
}


def ctes(*names: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names)

"""The corpus pipeline: each stage works on all that its predecessor kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimpse.llm import decontaminate, jaccard, langid, mixing, tokens
from glimpse.llm.common import stage


def language(spark, docs, sf_dir):
    return langid.keep_known(docs)


def near_duplicates(spark, docs, sf_dir):
    return jaccard.one_of_each(docs)


def benchmark(spark, docs, sf_dir):
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark, docs, sf_dir):
    return mixing.mixed_texts(docs)


def token_shards(spark, docs, sf_dir):
    m = tokens.materialise(docs)
    return m.select("slot", "shard", "offset", "sequence", F.sha2("tokens", 256).alias("sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("token_shards", token_shards)]

#: The stages learn, link and tokenise; SQL can't express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs

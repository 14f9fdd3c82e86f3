"""Mixing sources to target weights, with DataFrame functions alone.

Every source is one stream of words, cut into blocks of fixed length. The output is a row of slots, one block each, in
shards of equal size; each shard draws how many blocks it takes of each source from a multinomial, by drawing a source for
every slot. Draws beyond a source's quota go to sources below theirs, so totals come out as asked. A source's n-th draw is
mapped to a block by a pseudorandom permutation of the block numbers, another one for each pass, and joined by that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimpse.llm.common import stage

#: Words, as the size of a text counts them.
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; 0 for null), with a row for each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: its size in words and its target.

    Sources by code point, null last, weigh ``weights`` in turn. They share ``share`` times all words by weight, none more
    than ``most`` times its size; what is above is shared again by weight. That is the level at which min(most * size, level * weight)
    sums up to the whole: with sources by ratio of cap to weight, the first level that lies below its source's ratio.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # of one row per source
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = by_source.withColumn("weight", weigh).withColumn("cap", F.col("source_size") * float(most))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("level", (float(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("nth", F.row_number().over(up))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(everything)["level"])
    return s.select("source", "source_size", "n_docs", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def permuted(index: Column, n: Column, key: Column, rounds: int = 20) -> Column:
    """A pseudorandom permutation of 0..n-1 for each key: swap-or-not, which needs no power of two and no walking of cycles."""

    def swap(x, r):
        mirror = F.pmod(F.xxhash64(key, r) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, mirror)) >= 0, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), swap)


def laid_out(sizes: DataFrame, bucket_rows: int = 8192) -> DataFrame:
    """``sizes`` with ``at``, the place of each document's first word in its source's stream.

    Places come from sums per bucket of ids and sums within a bucket, so that a hot source is no single task's work.
    """
    n = max(1, -(-sizes.count() // bucket_rows))
    b = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    per = b.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    per = per.withColumn("base", F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    per = per.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce("base", F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return b.join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).withColumn("at", F.col("at") + F.col("base")).drop("_s", "_b", "base", "bucket")


def slots(plan: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """The output's slots: slot, shard, source number, pass, block. ``plan``: one row per source with no, source, source_size, n_blocks, quota (blocks)."""
    spark = plan.sparkSession
    total = plan.agg(F.sum("quota")).first()[0] or 0
    # Each of so many cells of the unit interval lists the sources that share it: a slot's number picks a cell, then a source.
    p = plan.where("quota > 0").select("no", "quota")
    upto = F.sum("quota").over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("quota"))
    cells = 4096
    width = F.lit(max(1, -(-total // cells)))
    guide = p.select("no", "lo", "hi", F.explode(F.sequence((F.col("lo") / width).cast("long"), ((F.col("hi") - 1) / width).cast("long"))).alias("cell"))
    parts = max(1, -(-total // (8 * shard_slots)))
    s = spark.range(0, total, 1, parts).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"))
    s = s.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "slot"), F.lit(max(1, total))))  # uniform over the quotas' sum
    s = s.withColumn("cell", F.floor(F.col("u") / width))
    s = s.join(guide, ["cell"]).where("u >= lo and u < hi").select("slot", "shard", "no")
    # The draw's number within its source: draws of earlier shards, then those before it in its own.
    counts = s.groupBy("no", "shard").agg(F.count("*").alias("n"))
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("no", "shard").orderBy("slot")) - 1
    s = s.withColumn("i", within).join(counts.drop("n"), ["no", "shard"]).withColumn("draw", F.col("base") + F.col("i")).drop("i", "base")
    drawn = counts.groupBy("no").agg(F.sum("n").alias("drawn"))
    state = plan.select("no", "source", "n_blocks", "quota").join(drawn, "no", "left").na.fill(0, ["drawn"])
    over = F.sum(F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    under = F.sum(F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))).over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    state = state.withColumn("over", F.coalesce(over, F.lit(0))).withColumn("under", F.coalesce(under, F.lit(0)))
    s = s.join(state.select("no", "quota", "over"), "no")
    within_quota = s.where("draw < quota").select("slot", "shard", "no", "draw")
    surplus = s.where("draw >= quota").select("slot", "shard", (F.col("over") + F.col("draw") - F.col("quota")).alias("k"))
    missing = state.where("quota > drawn").select("no", F.posexplode(F.sequence(F.col("drawn"), F.col("quota") - 1)).alias("p", "draw"), "under")
    moved = surplus.join(missing.select("no", "draw", (F.col("under") + F.col("p")).alias("k")), "k").select("slot", "shard", "no", "draw")
    s = within_quota.unionByName(moved).join(plan.select("no", "n_blocks"), "no")
    turn = F.floor(F.col("draw") / F.col("n_blocks"))
    key = F.xxhash64(F.lit(seed), "no", turn)
    return s.select("slot", "shard", "no", turn.alias("turn"), permuted(F.col("draw") % F.col("n_blocks"), F.col("n_blocks"), key).alias("block"))


def mix(docs: DataFrame, block: int = 64, shard_slots: int = 8192, seed: int = 1, **aims) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, text, source): (documents, sources, slots).

    documents: doc_id, source, size, at, no, pieces by block; sources: targets and quotas; slots: what each output slot holds.
    A source's blocks are each taken once in a pass and quotas stop at two passes, so no document is taken more than twice.
    Empty and null texts take no part; a null source is a source; equal rows are taken as separate documents.
    """
    sizes = stage(sized(docs), "mix-sizes")
    per = targets(sizes, **aims)
    n_blocks = F.ceil(F.col("source_size") / block)
    passes = F.floor(F.col("target") / F.col("source_size"))
    rest = F.round((F.col("target") - passes * F.col("source_size")) / block)
    most = F.ceil(F.col("target") / F.col("source_size")) * n_blocks
    quota = F.when(F.col("source_size") > 0, F.least(passes * n_blocks + rest, most)).otherwise(0).cast("long")
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
    plan = stage(per.withColumn("n_blocks", n_blocks).withColumn("quota", quota).withColumn("no", no), "mix-plan")
    laid = laid_out(sizes).join(plan.select(F.col("source").alias("_s"), "no", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return laid, plan, slots(plan, block, shard_slots, seed)


def cut(laid: DataFrame, block: int) -> DataFrame:
    """Documents as pieces of blocks: no, block, doc_id, at, size, part from, words."""
    p = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("at"), F.col("block") * block)
    hi = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    return p.withColumn("skip", lo - F.col("at")).withColumn("words", hi - lo)


def taken(docs: DataFrame, block: int = 64, **how) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (of its source), taken (words that the mix takes, repeats counted)."""
    laid, _, slot = mix(docs, block=block, **how)
    laid = stage(laid, "mix-laid")
    times = slot.groupBy("no", "block").agg(F.count("*").alias("times"))
    got = cut(laid, block).join(times, ["no", "block"]).groupBy("no", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = laid.where("size > 0").join(got, ["no", "at"], "left").unionByName(laid.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_texts(docs: DataFrame, block: int = 64, **how) -> DataFrame:
    """``docs`` as the mix takes them: a row for each document and pass that takes words of it, its text cut to the words taken.

    A document taken whole keeps its text as it is; of others, the taken pieces' words are joined by spaces. Rows equal in id,
    source and size share the text of one of them. All columns of ``docs`` are kept; n_chars, where present, follows the text.
    """
    laid, _, slot = mix(docs, block=block, **how)
    got = cut(stage(laid, "mix-laid"), block).join(slot.select("no", "block", "turn"), ["no", "block"])
    got = got.groupBy("no", "at", "doc_id", "source", "size", "turn").agg(F.sum("words").alias("_n"), F.array_sort(F.collect_list(F.struct("skip", "words"))).alias("_parts"))
    copy = F.row_number().over(Window.partitionBy("no", "doc_id", "size", "turn").orderBy("at"))
    got = got.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), copy.alias("m_copy"), F.col("_n").alias("m_words"), F.col("_parts").alias("m_parts"))
    # Whole rows go in a struct, so that no column of theirs meets one of ours.
    d = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = d.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).where("size > 0")
    d = d.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("text"))))
    j = d.join(got, F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("size") == F.col("m_size")) & (F.col("copy") == F.col("m_copy")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut_text = F.array_join(F.flatten(F.transform("m_parts", lambda p: F.slice(words, (p["skip"] + 1).cast("int"), p["words"].cast("int")))), " ")
    j = j.withColumn("text", F.when(F.col("m_words") == F.col("size"), F.col("text")).otherwise(cut_text))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return j.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])

"""Dictionaries as tables: which of many phrases a text holds, met by one automaton a task, and what users make of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimpse.functions.text import strip_accents, word_tokens


def matches(texts: DataFrame, keys: DataFrame, at_once: int = 200_000) -> DataFrame:
    """id, key: which ``keys`` (key) are part of which ``texts`` (id, text), each once. Null and empty keys and texts match nothing; case counts.

    A task reads its texts once through an automaton of all keys, which cost no more than one would. ``at_once`` keys go to the tasks at a
    time; a larger dictionary takes as many passes over the texts.
    """
    k = keys.select("key").where("key != ''").distinct()
    passes = max(1, -(-k.count() // at_once))
    kind = texts.schema["id"].dataType.simpleString()
    out = None
    for i in range(passes):
        some = [r[0] for r in k.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == i).collect()]  # about at_once of them

        def run(batches, some=some):
            import ahocorasick
            import pyarrow as pa

            automaton = ahocorasick.Automaton()
            for x in some:
                automaton.add_word(x, x)
            automaton.make_automaton()
            for b in batches:
                ids, found = [], []
                for row, text in enumerate(b.column("text").to_pylist() if some else []):
                    got = {x for _, x in automaton.iter(text)} if text else ()
                    ids += [row] * len(got)
                    found += got
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ids, pa.int64())), pa.array(found, pa.string())], names=["id", "key"])

        part = texts.select("id", "text").mapInArrow(run, f"id {kind}, key string")
        out = part if out is None else out.unionByName(part)
    return out


def _found(texts: DataFrame, dictionary: DataFrame, text) -> DataFrame:
    """id, key and the dictionary's other columns for the keys that ``text`` holds."""
    return matches(texts.select("id", text.alias("text")), dictionary).join(dictionary, "key")


def entities(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """id, entities: the keys of ``dictionary`` (key, place) that are part of the text (id, text) in lower case, in their places' order; [] if none is."""
    got = _found(texts, dictionary, F.lower("text")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("e"))
    got = got.select("id", F.transform("e", lambda x: x["key"]).alias("entities"))
    return texts.select("id").join(got, "id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def visual_english(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """id, english: "A video scene of" the values of ``dictionary`` (key, value, place) whose keys the text holds, longest key first, each once; '' if none."""
    got = _found(texts, dictionary, F.lower("text")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.length("key")).alias("n"), "place", "value"))).alias("e"))
    english = F.concat(F.lit("A video scene of "), F.array_join(F.array_distinct(F.transform("e", lambda x: x["value"])), ", "))
    return texts.select("id").join(got.select("id", english.alias("english")), "id", "left").na.fill("", ["english"])


def expanded_tokens(texts: DataFrame, dictionary: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """id, token, each once: a text's words without stop words (all, if nothing is left), and those of the values of ``dictionary`` (key, value) whose keys, without accents, it holds."""
    stop = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    all_words = word_tokens(F.col("text"))
    own = F.when(F.size(F.array_except(all_words, stop)) > 0, F.array_except(all_words, stop)).otherwise(all_words)
    bare = dictionary.select(strip_accents(F.col("key")).alias("key"), "value").distinct()
    more = _found(texts, bare, strip_accents(F.col("text"))).select("id", F.explode(F.array_except(word_tokens(F.col("value")), stop)).alias("token"))
    return texts.select("id", F.explode(own).alias("token")).unionByName(more).distinct()

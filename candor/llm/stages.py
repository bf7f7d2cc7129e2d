"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, each by one operator.

All but the last return the columns of ``docs``, whatever further columns those are.  Null ids and repeated rows pass
like others unless a stage says so; empty tables stay empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from candor.llm import language, mixing, packing, pii, simhash
from candor.llm.common import WORD, bound_batches, crc_mod

LEAST_SCORE = 0.35  # of the best language; even odds of four languages are 0.25


def _hidden(docs: DataFrame) -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with at least LEAST_SCORE; without labelled rows nothing can be told, and all pass
    that have a letter."""
    net = language.train_on(docs, crc_mod("doc_id", 3) != 1)

    bound_batches(spark)

    @pandas_udf("boolean")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = language.predictor(net)
        for texts in batches:
            if net is None:
                yield texts.map(lambda t: bool(t and language._LETTER.search(t))).astype(bool)
            else:
                yield pd.Series([label != language.UNKNOWN and score >= LEAST_SCORE for label, score in run([t or None for t in texts])], dtype=bool)

    return docs.filter(told("text"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, once even if its row is repeated.

    An id on rows of different fingerprints stays once for each of these that its groups name it for.  Rows without an
    id stay if no row with an id is in their group, one for each fingerprint.
    """
    groups = simhash.near_duplicates(docs.select("doc_id", "text"))
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    prints = first.groupBy("doc_id").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high"))
    once = prints.filter("doc_id IS NOT NULL AND low = high").select("doc_id")
    rows = docs.join(once, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    several = prints.filter("doc_id IS NULL OR low < high").select(key.alias("_key"))
    if several.isEmpty():
        return rows
    print_of = pandas_udf(lambda texts: texts.map(lambda t: f"{simhash.fingerprint(t):016x}"), "string")
    named = first.select(key.alias("_key"), F.col("fingerprint").alias("_print")).join(several, "_key", "left_semi").distinct()
    # Only rows of these ids are fingerprinted again.
    some = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key")).join(several, "_key", "left_semi")
    some = some.withColumn("_print", print_of("_row.text")).dropDuplicates(["_key", "_print"]).join(named, ["_key", "_print"], "left_semi")
    return rows.unionByName(some.select("_row.*"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span replaced by its kind in brackets; n_chars follows where the table has it."""
    bound_batches(spark)
    masked = pandas_udf(lambda texts: texts.map(pii.redact), "string")
    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _first_words(text: Column, words: Column) -> Column:
    """The text up to its ``words``-th word."""
    spaced = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(spaced, F.lit(1), words.cast("int")), "")


def in_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in order of training position; the one document of a source at which the
    target is reached is cut to the words taken.  Rows without words take no place in the mix."""
    row = _hidden(docs)
    mixed = mixing.mix(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias(row)), keep=[row])
    order = mixing.schedule(mixed, keep=[row])
    text = F.when(F.col("words") < F.col("size"), _first_words(F.col(f"{row}.text"), F.col("words"))).otherwise(F.col(f"{row}.text"))
    columns = {c: F.col(f"{row}.{c}") for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("words") < F.col("size"), F.length(text)).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return order.select(*[c.alias(name) for name, c in columns.items()])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs.select("doc_id", "text"))

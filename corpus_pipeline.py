"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, mixing, packing.

Every stage takes documents with at least doc_id and text (mixing also reads ``labels``) and all but the last
return the columns that they got, whatever these are called besides. Cases that hold for all stages: rows
without id are left out, as no later stage could name them; an empty table gives an empty one; very long
texts are taken whole. What a stage does with null texts, repeated rows and ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import langid, minhash, mixing, packing, suffixes
from gridspark.llm.storage import discard, mark, materialize, release

#: Texts whose expected share of words in the predicted language is lower are rejected, as are those without a letter.
LEAST_SHARE = 0.4


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, longer by underscores if ``docs`` has a column of that name."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _keep(docs: DataFrame, decided: DataFrame, hash_: str) -> DataFrame:
    """Rows of ``docs`` whose id and text hash are in ``decided`` (doc_id, ``hash_``)."""
    return docs.withColumn(hash_, F.xxhash64("text")).join(decided, ["doc_id", hash_], "left_semi").select(_columns(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a clear language. The model learns from the labelled documents of the stage's input; without
    labels, or a column ``lang``, every text is undetermined and goes. A null text goes. Each row is judged by its own text, so repeated rows
    stay or go together."""
    h = _fresh(docs, "text_hash")
    rows = docs.filter("doc_id is not null").select(F.struct("doc_id", F.xxhash64("text").alias(h)).alias("doc_id"), "text", (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang"))
    found = langid.predict(rows, langid.fit(rows))
    kept = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select("doc_id.*").distinct()
    return _keep(docs, kept, h)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id. An id names one document: of several rows of
    it one of those with the least text hash stays. Null and blank texts are near to nothing and stay."""
    h = _fresh(docs, "text_hash")
    kept = minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    first = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias(h)).join(kept, "doc_id")
    return _keep(docs, first, h).dropDuplicates(["doc_id"])


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; ``n_chars`` follows the text. A text that loses
    every word goes; null, blank and short texts stay as they are. Rows equal in id and text stay or lose together."""
    cut = suffixes.deduplicate(docs, with_rest=True)
    changed = F.size("removed") > 0

    def column(name: str) -> Column:
        if name in ("doc_id", "text"):
            return F.col(name).cast(docs.schema[name].dataType)
        own = F.col("rest").getField(name)
        return (F.when(changed, F.length("text").cast(docs.schema[name].dataType)).otherwise(own) if name == "n_chars" else own).alias(name)

    return cut.filter(~(changed & (F.trim("text") == ""))).select([column(c) for c in docs.columns])


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, which comes from its own text; null and blank texts have no tokens and stay
    as they are. Rows equal in id and text have the same rate."""
    h, copies, again = _fresh(docs, "text_hash"), _fresh(docs, "copies"), _fresh(docs, "again")
    labels = mixing.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mixing.mix(docs, labels).filter("copies > 0 and doc_id is not null")
    rates = mixed.select("doc_id", F.col("text_hash").alias(h), F.col("copies").alias(copies)).dropDuplicates(["doc_id", h])
    rows = docs.withColumn(h, F.xxhash64("text")).join(rates, ["doc_id", h])
    return rows.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; repeated rows are packed as often as they occur,
    and a text without words is a piece of length 0."""
    return packing.best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("domain_mixing", mix_domains),
    ("best_fit_packing", pack_sequences),
]

#: Trained and sorted stages lie outside SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written and read again by the next; what a stage wrote
    on its way goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, old = mark(), docs
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(before, docs)
        discard(old)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes the result of each stage as a scratch table and
hands it to the next one.

Edge cases: a null text passes every filter; null ids and repeated rows are kept as the
operators' docstrings say; columns beyond those of ``documents`` pass through unchanged. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import linededup, mixing, packing, simhash, toxicity
from graphloom.llm.common import drop_scratch, free_name, materialize
from graphloom.plans.scratch import spread

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not call toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.score_column(spark, model, F.col("text")) < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or place has; documents that lose all their lines go."""
    counts = free_name(docs, "n_lines"), free_name(docs, "n_kept")
    out = linededup.dedup_lines(docs, count_cols=counts).filter((F.col(counts[1]) > 0) | (F.col(counts[0]) == 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in docs.schema))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the one with the smallest id.

    Of rows that share that id one stays, of those without an id in a group without ids too.
    """
    return simhash.drop_similar(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.resample(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 4096. Its workers serve other stages before and after, so they remember less."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.digest(packing.pack(docs, path, cache_chunks=100_000, batch_chars=1_000_000, keep=False))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after another."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_scratch(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

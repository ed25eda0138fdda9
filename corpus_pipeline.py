"""A training corpus from raw documents, in five written stages.

Each stage takes all that its predecessor kept and returns the columns of
``documents`` (the last: one row per packed piece). A stage's rows are written
and read for the next stage; ``run`` writes them below ``spark.checkpoint.dir``.
When a stage begins, the rows of the one before it are written, so it removes what
that one wrote besides; at no time more than one stage's working tables are there.

Null texts are empty in every stage; rows with a null identifier go through like
any other; an empty table gives an empty result. Further columns go through all
stages but the last; their names may not start with an underscore.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import decontaminate, packing, quality, repeats, simhash
from cloakframe.llm.common import materialize, text_key
from cloakframe.llm.quality import KEEP_SCORE, held_out
from cloakframe.runtime import discard, discard_paths, written

#: Words of a passage that is removed wherever it repeats.
REPEAT_WORDS = 50
#: Tokens of a packed sequence.
CAPACITY = 1024


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at KEEP_SCORE or more; the others go."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    weights = quality.fit(quality.training_rows(source, labels), "text", "y", "at")
    scored = quality.score(docs, weights, name="_quality")
    return scored.where(F.col("_quality") >= KEEP_SCORE).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: texts whose SimHash fingerprints link
    and what an exact search finds besides (five-word shingles, 0.8 or more)."""
    return simhash.first_of_each_class(docs, width=5, min_similarity=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of REPEAT_WORDS words that stand elsewhere as well.

    ``n_chars`` follows the text. A document of which nothing is left stays, empty.
    """
    found = repeats.remove_repeats(docs, length=REPEAT_WORDS, units="words").where("n_removed > 0")
    found = found.select(F.col("key").alias("_key"), F.col("kept").cast("string").alias("_kept"))
    cut = docs.withColumn("_key", text_key("text")).join(found, "_key", "left")
    changed = F.col("_kept").isNotNull()
    return cut.withColumns(
        {
            "text": F.when(changed, F.col("_kept")).otherwise(F.col("text")),
            "n_chars": F.when(changed, F.char_length("_kept").cast("long")).otherwise(F.col("n_chars")),
        }
    ).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    counted = decontaminate.with_item_count(docs, items, "_items")
    return counted.where("_items = 0").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    return packing.pack_documents(docs, keep=["doc_id"], capacity=CAPACITY)


#: Working tables of the stage that ran last.
_working: set[str] = set()


def _after_the_last(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, removing the working tables of the one that ran before it."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_paths(spark, _working)
        there = written(spark)
        made = stage(spark, docs, sf_dir)
        _working.clear()
        _working.update(written(spark) - there)
        return made

    return run_stage


STAGES = [
    ("quality_classifier", _after_the_last(good_quality)),
    ("simhash_near_dedup", _after_the_last(one_of_near_copies)),
    ("suffix_array_dedup", _after_the_last(without_repeats)),
    ("benchmark_decontamination", _after_the_last(uncontaminated)),
    ("best_fit_packing", _after_the_last(packed)),
]

#: Training, components and packing are not SQL; tests/llm holds the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

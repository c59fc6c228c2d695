"""The corpus pipeline: documents to packed training sequences, a stage of arborq.llm after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm import lang, lines, mixing, near, packing
from arborq.llm.common import stored, table

#: Documents of less than this share of n-grams known to any language are rejected, as are those without letters.
MIN_SCORE = 0.2
#: Tokens wanted of each domain, in times of what there is: most of all of what is good, nothing toxic. Rates
#: of documents that aren't toxic are then 1 and more, so that none of them goes by chance.
FACTORS = {"good": 1.25, "plain": 1.1, "toxic": 0.0}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no language that the labelled ones teach. `lang` stays as it is given."""
    filters = lang.train(docs)
    told = lang.predict(docs.withColumnsRenamed({c: f"__{c}" for c in docs.columns if c != "text"}), filters)
    kept = told.where((F.col("lang_pred") != lang.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return kept.select(*[F.col(c if c == "text" else f"__{c}").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in ten different texts or more; n_chars follows the text. Copies of a text count as one: what they share isn't boilerplate, and the next stage keeps one of them. A text of common lines only is left with its blank ones."""
    names = docs.columns
    own = docs.withColumnsRenamed({c: f"own_{c}" for c in names if c not in ("doc_id", "text")})
    out = lines.drop_common_lines(own, copies_once=True)
    return out.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c if c in ("doc_id", "text") else f"own_{c}").alias(c) for c in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by rates that bring each domain to its target."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), FACTORS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row for each piece."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]
#: SQL can't express language ID, near copies, rates or the packing's cuts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

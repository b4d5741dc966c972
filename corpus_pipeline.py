"""The training-data pipeline: documents in, packed training sequences out.

Every stage but the last returns whole rows of its input, with all their columns,
whatever those are called (names that begin with two underscores are taken).  Null
and blank texts have no language and go in the first stage; given to a later stage they
are kept there, as one row by exact dedup.  Rows without an identifier, or that share
one, are told apart by their text.  Of equal rows exact dedup keeps one.  Ties go to the
smallest identifier.  Texts are read whole, whatever their length.  An empty table gives
an empty one in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicforms.llm import exact_dedup, langid, ngram_join, packing, toxicity
from civicforms.llm.common import Workspace, read
from civicforms.session import ship_package

#: A document stays if its language is predicted with at least this posterior.
LANGUAGE_POSTERIOR = 0.5


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter and those whose language stays open."""
    ship_package(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    model = langid.fit(langid.trainable(docs), path)
    done = langid.predict(docs, model, path, keep=tuple(docs.columns), out=("__lang_pred", "__posterior"))
    return done.where((F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__posterior") >= LANGUAGE_POSTERIOR)).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that score as toxic."""
    ship_package(spark)
    model = toxicity.fit(docs, toxicity.trainable(read(spark, sf_dir, "labels")))
    done = toxicity.score(docs, model, keep=tuple(docs.columns), out="__toxicity")
    return done.where(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts that are equal but for white space."""
    return exact_dedup.drop_exact_duplicates(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near duplicates."""
    ship_package(spark)
    return ngram_join.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("packing", packing_stage),
]

#: Trained models decide two of the stages; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read(spark, sf_dir, "documents")
    space = Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = space.write(docs, f"{k}-{name}")
    return docs


"""Corpus pipeline: toxicity, near-duplicates, PII, mixing and piece sampling over ``documents``.

Each stage works on all that its predecessor kept. All but the last return the columns of ``documents``, extra ones
too. Null and empty texts stay: they are not toxic, are no copies, and have no entities and no pieces. Rows with a null
doc_id stay. Rows that repeat a doc_id are judged each by its own text by the first and the third stage; the second
takes the texts of a doc_id as one document, so that its rows stay or go together; the fourth repeats them alike. An
empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinkline.llm.common import table
from brinkline.llm.mixing import mix_to_targets, repeated
from brinkline.llm.ngram_join import ngram_jaccard_join
from brinkline.llm.pieces import sample_segmentations
from brinkline.llm.pii import surrogate_pii
from brinkline.llm.queries import PIECE_MODEL, PII_KEY
from brinkline.llm.toxicity import toxicity
from brinkline.plans.shared import materialize, shared_root

BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; trained on labelled rows that are still there. Without toxic labels all stay."""
    scored = toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.where("predicted = 0").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 over five-word shingles those of the smallest doc_id stay, repeated rows too."""
    found = ngram_jaccard_join(docs.select("doc_id", "text"), width=5, num=80, den=100)
    gone = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), shared_root(spark), "gone")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities replaced by surrogates; n_chars follows the text."""
    done = surrogate_pii(docs, PII_KEY).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages evened out: documents are repeated by their rates, which are one at least, so none goes. Without labels each occurs as before."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    labelled = docs.select("doc_id", "lang").join(labels, "doc_id").select("doc_id", F.concat_ws("/", "lang", "quality").alias("domain"))
    rates = mix_to_targets(docs.select("doc_id", "text"), labelled, low_share=1.0, least_rate=1.0)
    return repeated(docs, rates).select(*docs.columns)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two different sampled segmentations of each document (one where there is no other), as packed piece numbers."""
    return sample_segmentations(docs.select("doc_id", "text"), PIECE_MODEL, k=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("pii", replace_pii),
    ("mixing", mix_domains),
    ("sentencepiece", sample_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    root = shared_root(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), root, name)
    return STAGES[-1][1](spark, docs, sf_dir)

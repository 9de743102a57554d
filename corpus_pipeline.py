"""Corpus pipeline: language ID, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. A stage works on all
rows its predecessor kept, and an empty table passes through all of them. Columns
of ``documents`` other than id and text pass through to the packed pieces;
duplicates are told by row, so that a repeated or null id neither saves a copy
nor takes another row with it. Rows that are alike in everything are judged
alike by the first two stages; of duplicates one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import langid, njaccard, packing, toxicity
from graphloom.llm.common import materialize, new_path
from graphloom.llm.queries import TOKENIZERS
from graphloom.plans import lineage

#: Languages to keep; all that are told from ``und``, unless named.
LANGUAGES: tuple[str, ...] | None = None
#: Near duplicates: words in a shingle, and similarity in hundredths.
WORDS, SIMILARITY = 5, 80
#: What packing adds; document columns of these names are kept under ``document_`` and their name.
PACKED = ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "_row", "_bucket", "_rank")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told (null text, or no letter in it), or none of ``LANGUAGES``, go; a missing ``lang`` becomes the one predicted. Ties go to the name that sorts first."""
    return langid.with_language(docs, wanted=LANGUAGES)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; a score of exactly one half counts as toxic."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row with the smallest id stays, null ids last; of equal ids the first row written."""
    row = next(x for x in ("_row", *(f"_row{k}" for k in range(1000))) if x.lower() not in map(str.lower, docs.columns))
    # written before use: the rows' keys must be the same in every later read
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    joined = materialize(njaccard.ngram_jaccard(keyed, n=WORDS, num=SIMILARITY, den=100, id_col=row), "duplicates")
    others = joined.select(F.col(row).alias("r"), F.col("component_id").alias("c")).where("c <> r")
    ids = keyed.select(F.col(row).alias("r"), F.col("doc_id").alias("d"))
    group = others.union(others.select("c", "c").distinct()).join(ids, "r")
    stays = group.groupBy("c").agg(F.min_by("r", F.struct(F.col("d").isNull(), "d", "r")).alias("stays"))
    gone = materialize(group.join(stays, "c").where("r <> stays").select(F.col("r").alias(row)), "gone")
    # counted first: up to a bound the keys are broadcast, so that texts stay where they are; beyond it both sides are shuffled
    few = gone.count() <= njaccard.MOST_BROADCAST
    return keyed.join(F.broadcast(gone) if few else gone, row, "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens, each with its token ids, place and the document's other columns."""
    clash = [c for c in docs.columns if c.lower() in PACKED]
    renamed = docs.withColumnsRenamed({c: f"document_{c}" for c in clash})
    keep = [c for c in renamed.columns if c not in ("doc_id", "text")]
    return packing.pack(renamed, f"{TOKENIZERS}/byte_bpe_50k.json", tokens=True, keep=keep)


STAGES = [("language_id", language_stage), ("toxicity", toxicity_stage), ("ngram_jaccard", duplicates_stage), ("packing", packing_stage)]

#: The stages are trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next; what a stage needed meanwhile, and the stage before, is then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path, since = new_path(spark, name), lineage.mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        lineage.clear(spark, since)
        if before:
            lineage.delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

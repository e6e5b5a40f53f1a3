"""The corpus pipeline: five stages over the table documents, each a filter or a rewrite of what the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentra.llm import bpe, decontam, langid, linededup, nearcopies, queries
from momentra.llm.common import cut, fresh_dir, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: Jaccard similarity of 0.8 or more of the sets of 5-word shingles.
SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter (und), or whose language is a near tie that the codewords can't settle."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.select("text", "lang"))
    judged = docs.withColumn("_p", langid.identifier(model, spark)(F.col("text")))
    return judged.where("_p.lang_pred != 'und' and not (_p.ambiguous and _p.score < 0.4)").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all but the largest doc_id; every document stays, n_chars follows the text."""
    kept = linededup.line_dedup(docs.select(*COLUMNS))
    gone = F.col("n_dropped") > 0
    return kept.withColumns(
        {
            "text": F.when(gone, F.col("kept_text")).otherwise(F.col("text")),
            "n_chars": F.when(gone, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")),
        }
    ).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By SimHash, each near pair checked exactly: one row of each group of near copies stays, that of the least doc_id; a
    row without an id only if no other has one."""
    row = {"_z": F.col("doc_id").isNull(), "_i": F.coalesce("doc_id", F.lit(0)), "_t": F.col("text_hash")}
    keep = nearcopies.survivors(docs, SHINGLE).withColumns(row).select(*row)
    keyed = docs.select(*COLUMNS).withColumns({**row, "_t": F.xxhash64("text")})
    return keyed.join(keep, list(row), "left_semi").dropDuplicates(list(row)).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    windows = cut(decontam.window_table(read_table(spark, sf_dir, "benchmark")))
    return decontam.scanned(docs.select(*COLUMNS), windows).where(F.size("found.spans") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs.select("doc_id", "text"), public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = fresh_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

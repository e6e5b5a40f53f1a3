"""Line dedup with DataFrame functions only.

Hashes of line keys are range-partitioned by (hash, document) and sorted by document, largest id first, and position,
so a key that a third of all lines share spreads over many tasks. Each task streams its sorted run and takes the first
occurrence of each hash in each document; these are counted and their first document found by hash, partially
aggregated before they are shuffled. What comes back are compressed bitmaps of the lines to keep, 64 lines a word and
only the words that lose a line, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentra.llm.common import ascii_lower, cut, shuffle_parts

#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def text_lines(text: Column) -> Column:
    """The text's lines; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text_hash, pos, h1, h2): 128 bits of each key of min_chars code points or more."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2"))


def first_occurrences(hashes: DataFrame) -> DataFrame:
    """line_hashes -> (h1, h2, doc_id, pos): the first place of each hash in each document.

    The window needs no shuffle and no sort of its own: the range partitioning and the sort within partitions are what
    it asks for.
    """
    back = F.expr("~doc_id")  # falling ids, without overflow
    runs = hashes.withColumns({"no_id": F.col("doc_id").isNull(), "back": back})
    run = ["h1", "h2", "no_id", "back"]
    runs = runs.repartitionByRange(shuffle_parts(hashes.sparkSession), *run).sortWithinPartitions(*run, "pos")
    place = F.row_number().over(Window.partitionBy(*run).orderBy("pos"))
    return runs.withColumn("place", place).where("place = 1").select("h1", "h2", "doc_id", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text_hash, keep_bitmap map<int, long>, n_dropped), documents that lose a line only.

    Bit i % 64 of word i div 64 tells whether line i stays; words that are not in the map keep all their lines. A key of
    min_chars or more in min_docs or more documents goes from all but the largest doc_id that holds it, which keeps
    every line of it. Rows that share a doc_id are one document; text_hash tells their texts apart. A null id is one
    document, below all others.
    """
    found = cut(line_hashes(docs.select(F.col("doc_id").cast("long"), "text"), min_chars))
    firsts = first_occurrences(found)
    holders = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder")).where(F.col("n_docs") >= min_docs)
    holders = cut(holders.select("h1", "h2", "holder"))  # apart from its aggregate the join can split a hash that many lines share
    dropped = found.join(holders, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = dropped.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("gone"))
    entry = F.struct("word", F.expr("~gone").alias("keep"))
    return words.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(entry)).alias("keep_bitmap"), F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"))


NEW = ("keep_bitmap", "n_dropped", "kept_text")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with keep_bitmap, n_dropped and kept_text; the other columns stay, and a null text is kept as the empty one."""
    d, b = docs.drop(*NEW).alias("d"), bitmaps.alias("b")
    joined = d.join(b, F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.text_hash")), "left")
    stays = F.expr("array_join(filter(split(d.text, '\\n'), (x, i) -> (shiftright(coalesce(b.keep_bitmap[i div 64], -1L), i % 64) & 1L) = 1L), '\\n')")
    kept = F.when(F.col("b.keep_bitmap").isNull(), F.coalesce("d.text", F.lit(""))).otherwise(stays)
    return joined.select("d.*", "b.keep_bitmap", F.coalesce("b.n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept_text"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs (doc_id, text, ...) -> the same rows with keep_bitmap (null: all lines stay), n_dropped and kept_text.

    Empty tables give empty ones; further columns stay as they are, except that those which bear one of the three new
    names are replaced.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))

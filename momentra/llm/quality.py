"""Quality rules: text statistics, and lines that too many documents of a host share.

Normalised lines are hashed and the distinct documents that hold each are counted per host, where documents with one
text are one. Lines above the limits are removed; a document that has lost too many of its words with them is depleted
and goes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentra.llm.common import ascii_lower, cut
from momentra.llm.linededup import BLANKS, text_lines

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: A line is removed where over MAX_SHARE of the host's documents, and over MAX_DOCS of them, hold it, and where over
#: MOST_DOCS of them do, whatever the host's size.
MAX_SHARE, MAX_DOCS, MOST_DOCS = 0.05, 20, 10_000
#: Common lines that are broadcast at most; more are joined.
BROADCAST_LINES = 200_000
#: A document is depleted if fewer than MIN_WORDS words, or less than MIN_LEFT of its words, remain.
MIN_WORDS, MIN_LEFT = 20, 0.3


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Positions inside windows that occur twice or more. ids: a number for each word."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        z = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        h = np.zeros(n, np.uint64)
        for j in range(window):
            h = h * np.uint64(0x94D049BB133111EB) + z[j : j + n]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(h, twice)
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null: zeros."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()
    chars = len(text) - (len(raw) - sum(map(len, found)))  # all blanks take one byte
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    return len(found), chars, symbols, len(lines) - len(set(lines)), repeat_words(ids)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: Column) -> Column:
    """The statistics of a text column as a struct."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_statistics(t) for t in texts], columns=list(STATS), dtype="int64")

    return F.pandas_udf(run, ", ".join(f"{c} long" for c in STATS))(text)


def host_of() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def hash_of_text() -> Column:
    """Tells texts apart; null is the empty text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def host_lines(docs: DataFrame) -> DataFrame:
    """docs (text, source) -> (host, text_hash, line, words, n): each distinct normalised line of each text of a host, its
    words and how often it stands in all rows of that text.

    Normalised: stripped, A-Z lower-cased, each run of digits as 0. line: the first 60 bits of its MD5.
    """
    lines = docs.select(host_of().alias("host"), hash_of_text().alias("text_hash"), F.explode(text_lines(F.col("text"))).alias("x"))
    norm = F.regexp_replace(ascii_lower(F.trim("x", F.lit(BLANKS))), "[0-9]+", "0")
    keyed = lines.select("host", "text_hash", norm.alias("k")).where("k != ''")
    words = F.size(F.split("k", r"[ \t-\r]+"))
    line = F.conv(F.substring(F.md5("k"), 1, 15), 16, 10).cast("long").alias("line")
    return keyed.select("host", "text_hash", line, words.alias("words")).groupBy("host", "text_hash", "line").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"))


def common_lines(lines: DataFrame, sizes: DataFrame, max_share: float, max_docs: int, most_docs: int) -> DataFrame:
    """host_lines, sizes (host, docs) -> (host, line) of the lines that too many distinct documents of their host hold."""
    held = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("held"))
    over = (F.col("held") > max_docs) & (F.col("held") > max_share * F.col("docs")) | (F.col("held") > most_docs)
    common = cut(held.where(F.col("held") > max_docs).join(sizes, "host").where(over).select("host", "line"))
    return F.broadcast(common) if common.count() <= BROADCAST_LINES else common


def removed_words(docs: DataFrame, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, most_docs: int = MOST_DOCS) -> DataFrame:
    """docs (text, source) -> (host, text_hash, removed_words), texts that lose a line only."""
    lines = cut(host_lines(docs))
    sizes = cut(docs.groupBy(host_of().alias("host"), hash_of_text().alias("text_hash")).agg(F.count(F.lit(1)).alias("copies")))
    common = common_lines(lines, sizes.groupBy("host").agg(F.count(F.lit(1)).alias("docs")), max_share, max_docs, most_docs)
    gone = lines.join(common, ["host", "line"]).groupBy("host", "text_hash").agg(F.sum(F.col("words") * F.col("n")).alias("w"))
    return gone.join(sizes, ["host", "text_hash"]).select("host", "text_hash", F.expr("w div copies").alias("removed_words"))


def judge_quality(docs: DataFrame, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, most_docs: int = MOST_DOCS) -> DataFrame:
    """docs (doc_id, text, source) -> (doc_id, the statistics, removed_words, base_failed, kept), one row a row of docs.

    Null text has no words and fails; a null source is a host of its own; rows of a host with one text are one document
    for all counts.
    """
    stats = docs.select("doc_id", host_of().alias("host"), hash_of_text().alias("text_hash"), statistics(F.col("text").cast("string")).alias("s")).alias("s")
    gone = removed_words(docs, max_share, max_docs, most_docs).alias("g")
    joined = stats.join(gone, (F.col("s.host") == F.col("g.host")) & (F.col("s.text_hash") == F.col("g.text_hash")), "left")
    joined = joined.select("doc_id", "s.s.*", F.coalesce("g.removed_words", F.lit(0).cast("long")).alias("removed_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < MIN_WORDS) | (left < MIN_LEFT * F.col("n_words")))
    return joined.select("doc_id", *STATS, "removed_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))

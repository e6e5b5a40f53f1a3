"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test texts scans every document once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentra.llm.common import cut

#: Bytes outside words become blanks, A-Z become a-z; bytes from 0x80 on belong to words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Characters of patterns that one automaton holds. A larger benchmark is dealt over several, with a scan each.
AUTOMATON_CHARS = 32 << 20
#: An automaton is kept between the tasks of a Python worker.
_built: dict[str, ahocorasick.Automaton] = {}


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def item_windows(text: str | None, n: int) -> set[str]:
    """The n-word windows of an item; an item of fewer words, but not none, is one window."""
    w = words_of(text)
    return {b" ".join(w[i : i + n]).decode("utf-8", "surrogatepass") for i in range(max(1, len(w) - n + 1))} if w else set()


def window_table(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """benchmark (item_id, text) -> (window, key, item_id): the distinct windows of each item; key is the window's hash."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(item_windows(t, n)) for t in texts])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = F.pandas_udf(run, "array<string>")(F.col("text"))
    return rows.select("item_id", F.explode(windows).alias("window")).select("window", F.xxhash64("window").alias("key"), "item_id").distinct()


def build(windows: list[tuple[str, int]]) -> ahocorasick.Automaton:
    """windows: (window, key)."""
    a = ahocorasick.Automaton()
    for window, key in windows:
        a.add_word(f" {window} ", (window.count(" ") + 1, key))
    if windows:
        a.make_automaton()
    return a


def automaton_of(name: str, windows: list[tuple[str, int]]) -> ahocorasick.Automaton:
    """The automaton of this name; a worker builds it once and keeps the last one."""
    if name not in _built:
        _built.clear()
        _built[name] = build(windows)
    return _built[name]


def scan(a: ahocorasick.Automaton, text: str | None) -> tuple[int, list[tuple[int, int, int]]]:
    """The number of words, and (first word, last word + 1, key) of each occurrence of a window."""
    w = words_of(text)
    if not w or not len(a):
        return len(w), []
    found = list(a.iter(f" {b' '.join(w).decode('utf-8', 'surrogatepass')} "))
    if not found:
        return len(w), []
    ends = np.cumsum([len(x.decode("utf-8", "surrogatepass")) + 1 for x in w])
    out = []
    for end, (n, key) in found:
        last = int(np.searchsorted(ends, end)) + 1  # the match ends with the blank after its last word
        out.append((last - n, last, key))
    return len(w), out


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as spans of code points of the text itself."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


FOUND = "n_words long, spans array<struct<begin: int, end: int>>, keys array<long>, offsets array<struct<begin: int, end: int>>"


def _pairs(spans: Iterable[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"begin": a, "end": b} for a, b in spans]


def scanner(windows: list[tuple[str, int]], spark: SparkSession) -> Callable[[Column], Column]:
    """A column function text -> struct of FOUND."""
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, windows))

    def run(texts: pd.Series) -> pd.DataFrame:
        a = automaton_of(*shared.value)
        rows = []
        for text in texts:
            n, found = scan(a, text)
            spans = merged((x, y) for x, y, _ in found)
            rows.append((n, _pairs(spans), sorted({k for *_, k in found}), _pairs(original_offsets(text, spans)) if spans else []))
        return pd.DataFrame(rows, columns=["n_words", "spans", "keys", "offsets"])

    return F.pandas_udf(run, FOUND)


def _joined(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Two scans of the same texts as one."""
    spans = lambda x, y, c: _pairs(merged((int(s["begin"]), int(s["end"])) for z in (x, y) for s in z[c]))
    rows = [(x["n_words"], spans(x, y, "spans"), sorted({int(k) for z in (x, y) for k in z["keys"]}), spans(x, y, "offsets")) for x, y in zip(a.to_dict("records"), b.to_dict("records"))]
    return pd.DataFrame(rows, columns=["n_words", "spans", "keys", "offsets"])


def scanned(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """docs with found, a struct of FOUND, by one scan; windows as in window_table.

    The windows reach the tasks as one broadcast list of AUTOMATON_CHARS characters or less (the size is checked). A
    larger benchmark is dealt over several such lists; each scans the texts in turn and the hits are merged row by row.
    """
    distinct = windows.groupBy("window").agg(F.first("key").alias("key"))
    chars = distinct.agg(F.sum(F.length("window") + 2)).first()[0] or 0
    slices = int(chars // AUTOMATON_CHARS) + 1
    out = docs
    for k in range(slices):
        part = distinct if slices == 1 else distinct.where(F.pmod("key", F.lit(slices)) == k)
        hits = scanner([(r["window"], r["key"]) for r in part.collect()], docs.sparkSession)(F.col("text"))
        if not k:
            out = out.withColumn("found", hits)
        else:
            out = cut(out.withColumn("_more", hits))  # one automaton a worker at a time
            out = out.withColumn("found", F.pandas_udf(_joined, FOUND)("found", "_more")).drop("_more")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> one row a row of docs.

    (doc_id, text_hash, n_words, spans, items, offsets): spans are merged runs of hit words, [begin, end); items the ids
    of items with an occurring window, sorted as strings; offsets the spans in code points of the original text.
    Null and wordless texts have no words and no hits; an item without words has no window; items with the same window
    are all named. Item ids don't travel with the automaton: the windows that a document holds are joined with the
    items that have them, so a window of very many items is nowhere one row.
    """
    windows = cut(window_table(benchmark, n))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    hits = cut(scanned(rows, windows).select("doc_id", "text_hash", "found.*").withColumn("row", F.monotonically_increasing_id()))
    held = hits.where(F.size("keys") > 0).select("row", F.explode("keys").alias("key"))
    items = held.join(windows.select("key", "item_id"), "key").select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    named = hits.join(items, "row", "left")
    return named.select("doc_id", "text_hash", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "offsets")


def n_hit(c: str = "spans"):
    return F.aggregate(c, F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["begin"]))

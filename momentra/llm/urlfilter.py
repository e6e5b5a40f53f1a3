"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for what no rule decides."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentra.llm import url_labels
from momentra.llm.common import ascii_lower

#: (verdict, host, path): fixed by the policy that is asked for.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
FEATURES, GRAMS = 4096, (3, 4, 5)
#: Rows of the labelled table that train, at most a verdict: those with the least hash. The fit is bounded by this.
SAMPLE = 1000
#: URLs beyond this probability are blocked.
LIMIT = 0.5


def url_host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits host (itself or a parent domain) and the path's beginning; else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(host: str, path: str) -> np.ndarray:
    """Slots of the character n-grams of host and path, each with its own mark; repeats once."""
    out = set()
    for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            out.update(zlib.crc32(f"{mark}{s[i:i + n]}".encode("utf-8", "surrogatepass")) % FEATURES for i in range(max(1, len(s) - n + 1)))
    return np.fromiter(sorted(out), np.int64)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def block_probability(self, host: str, path: str) -> float:
        slots = features(host, path)
        z = self.bias + float(self.weights[slots].sum()) / np.sqrt(len(slots))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(labelled: DataFrame, sample: int = SAMPLE, rounds: int = 200, rate: float = 4.0, decay: float = 1e-4) -> UrlModel:
    """Learn from labelled (url, verdict): at most `sample` distinct URLs a verdict, by least hash, reach the driver.

    With one verdict only, or no row, the model gives that verdict (none: allow) for everything.
    """
    urls = labelled.where("url is not null and verdict in ('allow', 'block')").groupBy("url").agg(F.max("verdict").alias("verdict"))
    rows = []
    for verdict in ("allow", "block"):
        rows += urls.where(F.col("verdict") == verdict).orderBy(F.xxhash64("url"), "url").limit(sample).select(
            url_host(F.col("url")).alias("h"), url_path(F.col("url")).alias("p"), "verdict"
        ).collect()
    y = np.array([r["verdict"] == "block" for r in rows], np.float64)
    if not len(y) or y.all() or not y.any():
        return UrlModel(np.zeros(FEATURES), 30.0 if len(y) and y.all() else -30.0)
    slots = [features(r["h"], r["p"]) for r in rows]
    row = np.repeat(np.arange(len(y)), [len(s) for s in slots])
    col = np.concatenate(slots)
    value = 1 / np.sqrt(np.array([len(s) for s in slots]))[row]
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # verdicts weigh the same
    w, bias = np.zeros(FEATURES), 0.0
    for _ in range(rounds):
        z = np.bincount(row, w[col] * value, len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        w -= rate * (np.bincount(col, error[row] * value, FEATURES) + decay * w)
        bias -= rate * error.sum()
    return UrlModel(w, bias)


def scorer(model: UrlModel, spark: SparkSession):
    """A column function (host, path) -> probability that the URL is to be blocked."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([shared.value.block_probability(h, p) for h, p in zip(host, path)], dtype="float64")

    return probability


def labelled_table(spark: SparkSession) -> DataFrame:
    """The hand-labelled URLs of url_labels: (url, verdict)."""
    return spark.createDataFrame([(u, "allow") for u in url_labels.ALLOW] + [(u, "block") for u in url_labels.BLOCK], "url string, verdict string")


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple = RULES, limit: float = LIMIT) -> DataFrame:
    """pages (page_id, url) -> (page_id, host, path, rule, verdict, block_probability), one row a row of pages.

    The model learns from labelled (url, verdict), the table of url_labels unless another is given, and never from the
    rules. A rule's verdict holds; else the model's. Null URLs have an empty host and path, which the model judges as
    any other.
    """
    split = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select(
        "page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    )
    judged = split.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    model = fit(labelled_table(pages.sparkSession) if labelled is None else labelled)
    scored = judged.withColumn("block_probability", scorer(model, pages.sparkSession)("host", "path"))
    return scored.select(
        "page_id", "host", "path", F.col("_r.rule").alias("rule"),
        F.coalesce("_r.verdict", F.when(F.col("block_probability") > limit, "block").otherwise("allow")).alias("verdict"), "block_probability"
    )

"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier a bit, a logistic regression on hashed byte n-grams, predicts that
bit. Decoding sums each bit's loss, so sure bits weigh more, takes the codeword of least loss and flags near ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentra.llm.common import crc_mod, cut

#: Hashed n-gram features, and the n-gram lengths.
FEATURES, GRAMS = 4096, (1, 2, 3, 4)
#: Training texts a language at most, distinct, the ones of the least hash. The fit is bounded by this parameter.
SAMPLE = 300
#: Tables of one row a language are broadcast up to so many languages.
MOST_LANGUAGES = 10_000
#: A decision whose probability is less is flagged as ambiguous.
SURE = 0.55
#: ASCII letters in lower case and bytes of longer characters; all else is a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Hashed counts of the text's byte n-grams, damped by the square root, of length one."""
    b = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(FEATURES, np.float32)
    code = np.zeros(len(b), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(b) < n:
            break
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] if n > 1 else b.copy()
        if n in GRAMS:
            slot = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)
            counts += np.bincount(slot, minlength=FEATURES)
    root = np.sqrt(counts)
    return root / max(float(np.linalg.norm(root)), 1e-9)


def codewords(classes: int) -> np.ndarray:
    """A +-1 matrix (classes, bits): every split into two for up to 5 classes, else the best of 64 seeded random codes."""
    if classes <= 5:
        rows = [[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for b in range(2 ** (classes - 1) - 1)] for i in range(classes)]
        return np.array(rows, np.int8).reshape(classes, -1)
    bits = 10 * math.ceil(math.log2(classes))
    best, far = None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (classes, bits))
        dist = min(int((code[i] != code[j]).sum()) for i in range(classes) for j in range(i))
        varied = (np.abs(code.sum(0)) < classes).all()
        if varied and dist > far:
            best, far = code, dist
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, ambiguous); und for a text that is null or has no letter, or where nothing was learned."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = self.weights @ features(text) + self.bias
        loss = np.logaddexp(0, -self.code * margin).sum(axis=1)
        best = int(np.argmin(loss))
        p = np.exp(loss.min() - loss)
        p = float(p[best] / p.sum())
        return self.languages[best], p, p < SURE


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (text, lang) -> (text, lang, h): up to `sample` distinct texts a language, those of the least hash.

    Rows without lang or text never train. Hashes go first: a language's `sample` least are found on distinct (lang,
    hash) rows, and only texts up to the greatest of them are brought together. Repeats count once, so a language
    that has `sample` distinct texts trains on so many.
    """
    keyed = docs.where("lang is not null and text is not null and text != ''").select("lang", "text", F.xxhash64("text").alias("h"))
    pairs = cut(keyed.select("lang", "h").distinct())
    size = cut(pairs.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n")))
    size = F.broadcast(size) if size.count() <= MOST_LANGUAGES else size
    # hashes are even, so about 4 * sample of a language lie below this bound: a window needs no more of them
    place = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    low = pairs.join(size, F.col("lang") == F.col("_lang")).where(place * F.col("_n") < 4 * sample)
    first = low.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= sample)
    last = cut(first.groupBy(F.col("lang").alias("_lang")).agg(F.max("h").alias("_last")))
    last = F.broadcast(last) if last.count() <= MOST_LANGUAGES else last
    few = keyed.join(last, (F.col("lang") == F.col("_lang")) & (F.col("h") <= F.col("_last")))
    return few.groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang", "h")


def fit(docs: DataFrame, sample: int = SAMPLE, rounds: int = 300, rate: float = 20.0, decay: float = 1e-5) -> LanguageModel:
    """Learn from docs (text, lang). At most `sample` texts a language reach the driver, as features."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[has_letter(t) for t in b["text"]]]
            yield pd.DataFrame({"lang": b["lang"], "h": b["h"], "x": [features(t).astype(np.float16).tobytes() for t in b["text"]]})

    rows = training_rows(docs, sample).repartition(8, "h").mapInPandas(run, "lang string, h long, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["h"], bytes(r["x"])))
    languages = tuple(sorted({r["lang"] for r in rows}))
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((len(languages), 0)), np.zeros((0, FEATURES), np.float32), np.zeros(0, np.float32))
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float16) for r in rows]).astype(np.float32)
    y = np.array([languages.index(r["lang"]) for r in rows])
    code = codewords(len(languages))
    target = (code[y] > 0).astype(np.float32)
    share = 1 / np.bincount(y)[y]
    share = (share / share.sum()).astype(np.float32)[:, None]  # languages weigh the same
    w, bias = np.zeros((code.shape[1], FEATURES), np.float32), np.zeros(code.shape[1], np.float32)
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ w.T + bias, -30, 30))) - target) * share
        w -= rate * (error.T @ x + decay * w)
        bias -= rate * error.sum(axis=0)
    return LanguageModel(languages, code.astype(np.float32), w, bias)


def identifier(model: LanguageModel, spark: SparkSession):
    """A column function text -> struct(lang_pred, score, ambiguous); it sees the text alone."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predicted(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score", "ambiguous"])

    return predicted


def split_rows(docs: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """docs with held_out: crc32 of the id's text modulo `parts` is `held`."""
    return docs.withColumn("held_out", crc_mod(F.col("doc_id"), parts) == held)

"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from momentra.llm import queries as Q
from momentra.llm import spelling

SF = "/root/testdata/sf0.001"


def near_set(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return (out | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}) - {w}


def brute(n):
    letters, out = sorted({c for w in n for c in w}), {}
    for w in n:
        close = [x for x in near_set(w, letters) if x in n]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        best = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (len(close), best)

    def root(w):
        return w if out[w][1] is None else root(out[w][1])

    return {(w, n[w], k, f, n[f] if f else None, root(w)) for w, (k, f) in out.items()}


def rows(df):
    return [(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()]


def test_op13(spark, docs):
    n = Counter()
    for r in docs.collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    got = rows(Q.op13_spelling(spark, SF))
    want = brute({w: c for w, c in n.items() if len(w) >= 5 and c >= 3})
    assert len(got) == len(want) and set(got) == want and any(r[3] for r in got)


@pytest.mark.parametrize("lane_rows", [2048, 7])
def test_variants_of_crowded_vectors(spark, monkeypatch, lane_rows):
    monkeypatch.setattr(spelling, "LANE_ROWS", lane_rows)
    rng = random.Random(3)
    n = Counter()
    for _ in range(1500):
        w = "".join(rng.choices("abqé", k=rng.randint(5, 7)))
        n[w] = rng.randint(3, 40)
    occurrences = spark.createDataFrame([(w,) for w, c in n.items() for _ in range(c)] + [(None,), ("",), ("rare",), ("seldom",)], "word string")
    got = rows(spelling.variants(occurrences.selectExpr("word", "1 as n", "2 as root")))
    assert len(got) == len(n) and set(got) == brute(n)


def test_chains_lead_to_the_last_form(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96}
    got = {r[0]: r[5] for r in rows(spelling.variants(spark.createDataFrame([(w,) for w, c in n.items() for _ in range(c)], "word string")))}
    assert set(got.values()) == {"bbbbb"} and len(got) == 6


def test_odd_words(spark):
    empty = spark.createDataFrame([], "word string")
    assert spelling.variants(empty).count() == 0
    long = "a" * 100_000
    words = spark.createDataFrame([(long,)] * 3 + [(long + "b",)] * 6, "word string")
    got = {r[1]: r for r in rows(spelling.variants(words))}
    assert got[3][2] == 1 and got[3][3] == long + "b" and got[6][3] is None


def test_null_texts_and_ids(spark, tmp_path):
    spark.createDataFrame([(None, "abcdef abcdef"), (None, "ABCDEF"), (1, None), (2, ""), (3, "a1b2")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(Q.op13_spelling(spark, str(tmp_path)))
    assert got == [("abcdef", 3, 0, None, None, "abcdef")]

"""Near copies of the pipeline against brute force, with odd ids."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from momentra.llm import nearcopies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts(rng):
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    notice = [word() for _ in range(40)]
    texts = []
    for i in range(60):
        base = [word() for _ in range(rng.randint(30, 120))] + (notice if i % 3 == 0 else [])
        texts.append(base)
        for edits in (1, 2, 3, 4, 5):
            t = list(base)
            for at in rng.sample(range(len(t)), edits):
                t[at] = word()
            texts.append(t)
    for _ in range(80):  # one large group
        t = list(texts[0])
        t[rng.randrange(len(t))] = word()
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("block_rows", [20_000, 32])
def test_near_copies_against_brute_force(spark, monkeypatch, block_rows):
    import corpus_pipeline as c

    monkeypatch.setattr(simhash, "BLOCK_ROWS", block_rows)
    texts = _texts(random.Random(5))
    sets = [nearcopies.shingle_set(t, 5) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8 and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(r["doc_id"] for r in c.near_copies(spark, docs, "").collect())
    assert got == sorted(set(root))


def test_rows_without_an_id_and_with_a_shared_id_stay(spark):
    import corpus_pipeline as c

    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(50))
    a, b, d, e, f = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, d), (1, e), (2, f), (2, f), (None, f), (2**60 + 1, text()), (3, None), (4, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in c.near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(0, a), (0, b), (1, d), (1, e), (2, f), (2**60 + 1, rows[8][1]), (3, None)], key=str)
    assert c.near_copies(spark, docs.where("false"), "").count() == 0


def _prefix(s):
    return s[: nearcopies.prefix_size(len(s))]  # sets are sorted, one order as good as another


def test_bounds_pass_every_similar_pair_at_its_first_shared_key_and_few_others():
    rng = np.random.default_rng(8)
    similar = others = passed = 0
    for n in (3, 9, 40, 146, 600, 5000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        sets = [np.unique(base)]
        for share in np.linspace(0, 0.35, 30):
            s = base.copy()
            at = rng.choice(n, int(n * share), replace=False)
            s[at] = rng.integers(0, 2**63, len(at)).astype(np.uint64)
            sets.append(np.unique(s[: n - rng.integers(0, n // 8 + 1)]))
        for a in range(len(sets)):
            for b in range(a):
                both = np.intersect1d(_prefix(sets[a]), _prefix(sets[b]))
                good = nearcopies.similar(sets[a], sets[b])
                assert len(both) or not good
                if not len(both):
                    continue
                x = pd.DataFrame([{"n": len(s), "pos": int(np.searchsorted(s, both[0])), **{f"p{i}": v for i, v in enumerate(nearcopies.parities(s))}} for s in (sets[a], sets[b])])
                i, j = np.array([0]), np.array([1])
                found = all(t(i, j)[0] for t in nearcopies.bounds(x))
                assert found or not good
                if n == 146:
                    similar, others, passed = similar + good, others + (not good), passed + (found and not good)
    assert similar > 20 and others > 200 and passed < others / 3


def test_a_large_group_below_the_similarity_gives_few_links(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base, texts = [word() for _ in range(150)], []
    for _ in range(200):
        t = list(base)
        for at in rng.sample(range(150), 6):
            t[at] = word()
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [nearcopies.shingle_set(t, 5) for t in texts]
    good = sum(nearcopies.similar(sets[a], sets[b]) for a in range(200) for b in range(a))
    rows = nearcopies.prefixes(docs, 5)
    rows = nearcopies.shared_keys(rows).join(rows.select("id", "n", *nearcopies.SIGNATURE), "id").withColumn("comp", F.col("id"))
    found = nearcopies.near(rows, every=True).select("a", "b").distinct().count()
    assert good <= found <= good + 199 * 200 / 2 * 0.1

"""Periodic runs against brute force."""

import hashlib
import random
import time
import zlib

import pytest

from momentra.llm import periodic
from momentra.llm import queries as Q

SF = "/root/testdata/sf0.001"


def brute(words):
    """Every stretch of every period, the least period of each."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sample(rng):
    letters, out = "abcdefghijklmnopqrst"[: rng.choice([1, 2, 3, 5, 20])], []
    for _ in range(rng.randint(0, 6)):
        part = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
        out += part * rng.choice([1, 1, 2, 4, 5, 9]) + part[: rng.choice([0, 0, rng.randint(0, len(part))])]
    return out


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(400):
        texts = [sample(rng) for _ in range(rng.randint(1, 6))]
        got = [list(map(tuple, r.tolist())) for r in periodic.runs_of([[w.encode() for w in t] for t in texts])]
        assert got == [brute(t) for t in texts]


def test_op11(spark, docs):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op11_periodic(spark, SF).collect()}
    rows, n_found = docs.where("length(text) < 6000").collect(), 0
    for r in rows:
        w = [x for x in (r["text"] or "").encode().split()]
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        w = [x.decode() for x in w]
        runs = brute(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        n_found += bool(best)
        want = (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept(w, runs)))
        assert got[r["doc_id"]] == want
    assert n_found > 5 and len(got) == docs.count()


@pytest.mark.parametrize("chunk", [periodic.CHUNK_WORDS, 10])
def test_odd_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(periodic, "CHUNK_WORDS", chunk)
    rows = [(1, None), (2, ""), (None, "a b " * 4), (None, "a b " * 4), (3, " \t\n"), (4, "x " * 5), (5, "x\x0bx\x0cx\rx\nx\tx"), (6, "x x " * 6)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, runs int")
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(docs).collect()), key=str)
    assert got == sorted([(1, 0, [], ""), (2, 0, [], ""), (None, 8, [(0, 8, 2)], "a b"), (None, 8, [(0, 8, 2)], "a b"), (3, 0, [], ""), (4, 5, [], "x x x x x"), (5, 6, [(0, 6, 1)], "x"), (6, 6, [(0, 6, 1)], "x x")], key=str)
    assert periodic.find_runs(docs.where("false")).count() == 0


def test_long_texts_end_soon():
    rng, began = random.Random(2), time.time()
    assert periodic.runs_of([[b"a"] * 400_000])[0].tolist() == [[0, 400_000, 1]]
    cycle = [b"%d" % i for i in range(50_000)]
    assert periodic.runs_of([cycle * 5])[0].tolist() == [[0, 250_000, 50_000]]
    mixed = [w for _ in range(8_000) for w in [b"a"] * rng.randint(1, 30) + [b"b"]]
    assert len(periodic.runs_of([mixed])[0]) > 1000
    assert time.time() - began < 60

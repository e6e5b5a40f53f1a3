"""The registered queries: against SQL where there is such, else against brute force in plain Python over the whole table."""

import base64
import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from momentra.llm import queries as Q

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def lower(s):
    return (s or "").translate({i: i + 32 for i in range(65, 91)})


def words(s):
    return [w for w in re.split(f"[{BLANK}]+", lower(s)) if w]


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, name):
    import compare

    assert compare.differences(spark, compare.connect(SF), SF, Q.QUERIES[name], Q.ORACLE[name]) == []


def test_op1(spark, rows):
    def fingerprint(text):
        w = words(text)
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.op1_simhash(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def test_op3(spark, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(Q.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op3_bpe(spark, SF).collect()}
    for r in rows:
        ids = enc.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())


def test_op5(spark, rows):
    got = {r["doc_id"]: r for r in Q.op5_langid(spark, SF).collect()}
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert right >= 0.9 * len(held) and all(0 <= r["score"] <= 1 for r in got.values())


def test_op8(spark, rows):
    got = Q.op8_sharding(spark, SF).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for r in rows:
        raw = (r["text"] or "").encode()
        assert (by[r["doc_id"]]["size"], by[r["doc_id"]]["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    load, slots = Counter(), {}
    for r in got:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(40))
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in got)


def test_op9_base(spark, rows):
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    c = Counter(w for r in train for w in words(r["text"]))
    c[" "] = len(train)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in Q.op9_lm(spark, SF).collect()}
    for r in rows:
        t = [*words(r["text"]), " "]
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    held = [r for r in rows if got[r["doc_id"]]["held_out"] and r["text"]]
    size = sum(len(r["text"].encode()) + 1 for r in held)
    bits = -sum(got[r["doc_id"]]["score"] for r in held) / math.log10(2) / size
    for order in (0, 2):  # held-out bits a byte against a plain model of the last bytes
        seen, of = Counter(), Counter()
        for t in train:
            b = b"\0\0" + lower(t["text"]).encode()
            seen.update((b[i - order : i], b[i]) for i in range(2, len(b)))
            of.update(b[i - order : i] for i in range(2, len(b)))
        plain = 0.0
        for t in held:
            b = b"\0\0" + lower(t["text"]).encode()
            plain -= sum(math.log2((seen[b[i - order : i], b[i]] + 1) / (of[b[i - order : i]] + 256)) for i in range(2, len(b)))
        assert bits < plain / size * (0.6 if order == 0 else 0.85)


def test_op10(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in Q.op10_url_filter(spark, SF).collect()}
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    for p in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p["url"])
        host, path = lower(m[1]), m[2]
        fit = [(len(h + q), h + q, v) for v, h, q in rules if (host == h or host.endswith("." + h)) and path.startswith(q)]
        g = got[p["page_id"]]
        assert (g["host"], g["path"], g["rule"]) == (host, path, max(fit)[1] if fit else None)
        assert g["verdict"] == max(fit)[2] if fit else g["verdict"] in ("allow", "block")


def test_pipeline(spark, rows):
    import corpus_pipeline as c

    docs, kept = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), None
    for name, stage in c.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), "doc_id long, text string, lang string, source string, n_chars long")
        kept = kept or {}
        kept[name] = docs.count()
    got = {r["doc_id"]: r["decoded_sha256"] for r in c.run(spark, SF).collect()}
    assert got == {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect()}
    assert kept["language"] >= kept["lines"] >= kept["near_copies"] >= kept["benchmark"] > 0.5 * len(rows)

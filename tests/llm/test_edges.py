"""Nulls, empty and very long texts, ties, repeated rows, empty tables, further columns with clashing names; parts by themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from momentra.llm import bpe, components, decontam, langid, linededup, lm, quality, sharding, simhash, url_labels, urlfilter, warc
from momentra.llm.queries import RANKS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, n_dropped string, held_out string, size string, key string, w string, n string, row string"
LINE = "a line of well over twenty letters"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "fr", None, None, *["x"] * 8) for i, t in pairs], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 70_000), (5, f"{LINE}\nB"), (6, f"{LINE.upper()} \n{LINE}"), (7, f" {LINE}"), (7, f" {LINE}"), (None, LINE), (8, "1234 !!! 5678"), (9, "é日本🎉 " * 50), (10, "word " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, []).where("false")


def test_simhash(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["w0"] for i in (1, 2, 3)} == {0} and {by[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert by[7]["component_id"] == 7 == by[None]["component_id"]
    assert simhash.near_duplicates(none).count() == 0


def test_spanning_links_against_brute_force():
    rng = np.random.default_rng(1)
    for radius, words in ((3, 1), (48, 4), (0, 1)):
        fp = rng.integers(0, 2**63, (150, words), np.int64).view(np.uint64)
        fp[75:] = fp[:75] ^ (np.uint64(1) << rng.integers(0, 63, (75, words)).astype(np.uint64))
        key = np.sort(rng.integers(0, 4, 150))
        i, j = simhash.spanning_links(key, fp, radius)
        near = lambda a, b: key[a] == key[b] and int(np.bitwise_count(fp[a] ^ fp[b]).sum()) <= radius
        assert all(near(a, b) for a, b in zip(i, j))

        def classes(pairs):
            root = list(range(150))
            for a, b in pairs:
                x, y = root[a], root[b]
                root = [x if r == y else r for r in root]
            return [root.index(r) for r in root]

        assert classes(zip(i, j)) == classes((a, b) for a in range(150) for b in range(a) if near(a, b))


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 32)
    reps = spark.range(400).select("id", (F.col("id") % 7).alias("w0")).unionByName(spark.range(400, 500).select("id", (F.col("id") * 104729 * 7919).alias("w0"))).groupBy("w0").agg(F.min("id").alias("id"))
    one = [[0]]  # a mask of no bit: all rows have one key
    links = [(r["a"], r["b"]) for r in simhash.near_links(spark.createDataFrame(reps.collect()), 1, 64, one).collect()]
    seen = {0}
    for _ in range(20):
        seen |= {x for p in links for x in p if seen & set(p)}
    assert len(seen) == reps.count()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/ b\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "u", None), (4, "u", ""), (5, "u", "ü" * 100_000), (None, "u", "<p>same</p>"), (6, "u", "z"), (6, "u", "z")]
    x = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.write_index(warc.write_warc(warc.plan_records(x), f"file://{tmp_path}"), f"file://{tmp_path}")
    got = warc.read_warc(index, f"file://{tmp_path}").collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["record_type"], by[1]["refers_to"], by[2]["record_type"]) == ("revisit", 2, "response")
    assert (by[3]["refers_to"], by[4]["payload_bytes"], by[6]["record_type"], by[None]["refers_to"]) == (4, 0, "response", 2)
    assert bytes(by[5]["payload"]).decode() == "ü" * 100_000 and by[3]["payload_digest"] == warc.payload_digest(b"")
    assert warc.read_warc(index.where("page_id = 2"), f"file://{tmp_path}").first()["payload"] == b"<p>same</p>"
    assert warc.plan_records(x, 50).where("page_id = 1").first()["record_type"] == "response"
    assert warc.archive_pages(x.where("false")).count() == 0


def test_bpe_round_trip(spark, odd, none):
    path = public_tokenizers.path(RANKS)
    e = bpe.encode(odd, path, public_tokenizers.PATTERN)
    got = sorted((bytes(r["decoded"]).decode() for r in bpe.decode(e, path).collect()))
    assert got == sorted(t or "" for _, t in ODD)
    assert bpe.encode_digests(none, path, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [999_999])], "doc_id long, ids array<int>"), path).collect()


def test_words_of_any_length_equal_the_library():
    rng = random.Random(3)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(RANKS)), special_tokens={})
    texts = [" ".join("".join(rng.choice(al) for _ in range(n)) for _ in range(1 + 20_000 // n)) for al in ("ACGT", "abcdeéstüñ", "ab", "x日") for n in (2, 30, 64, 65, 150, 500, 40_000)]
    codec = bpe.Codec(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    for text, parts in zip(texts, codec.documents(texts), strict=True):
        assert [int(i) for _, ids, _ in parts for i in ids.split(",")] == enc.encode_ordinary(text)


def test_bpe_by_segments_and_forgetful(monkeypatch):
    texts = ["", " a  b\n\n c's " * 40, "one two three " * 50, "", "é 日本 " * 60]
    whole = lambda c: [([i for _, x, _ in p if x for i in x.split(",")], b"".join(r for *_, r in p)) for p in c.documents(texts)]
    make = lambda: bpe.Codec(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    want = whole(make())
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    monkeypatch.setattr(bpe, "PIECES", 3)
    assert whole(make()) == want


def test_quality(spark, odd, none):
    got = {r["doc_id"]: r for r in quality.judge_quality(odd).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[6]["n_dup_lines"] == 0 and got[10]["n_repeat_words"] == 30_000
    assert quality.judge_quality(odd).count() == len(ODD) and quality.judge_quality(none).count() == 0
    notice = "please accept all the cookies of this site now"
    body = lambda i, n: " ".join("".join(random.Random(i * 1000 + j).choices("abcdefgh", k=8)) for j in range(n))
    data = [(i, f"{notice}\n{body(i, 40)}") for i in range(30)] + [(100 + i, f"{notice}\n" * 9 + body(i, 5)) for i in range(3)]
    copies = [(200 + i, f"{body(999, 30)}\n{body(998, 30)}") for i in range(30)]
    got = {r["doc_id"]: r for r in quality.judge_quality(frame(spark, data + copies), max_share=0.2).collect()}
    assert all(got[i]["kept"] and got[i]["removed_words"] == 9 for i in range(30) if i % 2)
    assert all(got[200 + i]["kept"] and not got[200 + i]["removed_words"] for i in range(30))


def test_every_notice_on_all_documents_goes(spark):
    data = [(i, f"first notice of the site itself\nsecond notice of the same site\nown text number {chr(97 + i % 26) * 3} {'xyz'[i % 3]} " + "w " * (i // 78) + chr(97 + i // 26 % 3) + " word" * 25) for i in range(1000)]
    x = frame(spark, data).withColumn("source", F.lit("one"))
    copied = x.unionByName(x.withColumn("doc_id", F.col("doc_id") + 5000))  # exact copies count once
    for rows in (x, copied):
        assert {r["removed_words"] for r in quality.judge_quality(rows).collect()} == {12}
    few = x.where("doc_id < 18").unionByName(x.where("doc_id < 18").withColumn("doc_id", F.col("doc_id") + 5000))
    assert {r["removed_words"] for r in quality.judge_quality(few).collect()} == {0}
    assert {r["removed_words"] for r in quality.judge_quality(x, max_share=2.0, most_docs=900).collect()} == {12}


def test_langid(spark, odd, none):
    data = [(i, f"the quick words of {i} and the other", "en") for i in range(20)] + [(i, f"les mots de {i} et une autre élan", "fr") for i in range(20, 40)] + [(40, "der die und das ist ein", "de")] * 9 + [(41, "el la los una por qué", "es")] * 9 + [(50, None, "en"), (51, "text", None)]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model.languages == ("de", "en", "es", "fr")
    assert [model.predict(t)[0] for t in ("the other words", "une autre élan", None, "", "12 !?", "der und")] == ["en", "fr", "und", "und", "und", "de"]
    same = [(i, text, lang) for lang, text in (("de", "der die und das"), ("en", "the of and"), ("es", "el la por qué"), ("fr", "les une et élan")) for i in range(2000)]
    many = [(9000 + i, f"the words {i}", "en") for i in range(900)]
    rows = langid.training_rows(spark.createDataFrame(same + many, "doc_id long, text string, lang string"), 300).collect()
    assert Counter(r["lang"] for r in rows) == {"de": 1, "en": 300, "es": 1, "fr": 1}
    got = odd.select("doc_id", langid.identifier(model, spark)(F.col("text")).alias("p")).collect()
    assert len(got) == len(ODD)
    empty = langid.fit(none)
    assert empty.predict("words") == ("und", 0.0, False)
    for n in (2, 3, 5, 9):
        code = langid.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= max(1, code.shape[1] // 4)


def test_decontaminate(spark, odd, none, monkeypatch):
    items = spark.createDataFrame([(1, "Alpha-beta gamma"), (2, "alpha BETA  gamma"), (3, ""), (4, None), (5, " ".join(f"q{i}" for i in range(14)))], "item_id long, text string")
    docs = frame(spark, [(1, "x Alpha, beta! gamma y"), (2, "alphabeta gamma"), (3, " ".join(f"q{i}" for i in range(1, 14))), (4, " ".join(f"q{i}" for i in range(9))), (5, None), (1, "x Alpha, beta! gamma y")])
    for size in (decontam.AUTOMATON_CHARS, 100):  # one automaton, several
        monkeypatch.setattr(decontam, "AUTOMATON_CHARS", size)
        got = sorted((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"], [tuple(s) for s in r["offsets"]]) for r in decontam.contamination(docs, items).collect())
        hit = (1, 5, [(1, 4)], ["1", "2"], [(2, 20)])
        assert got == [hit, hit, (2, 2, [], [], []), (3, 13, [(0, 13)], ["5"], [(0, 42)]), (4, 9, [], [], []), (5, 0, [], [], [])]
    assert decontam.contamination(odd, items.where("false")).where(F.size("spans") > 0).count() == 0
    assert decontam.contamination(none, items).count() == 0


def test_line_dedup(spark, odd, none):
    got = linededup.line_dedup(odd).collect()
    assert len(got) == len(ODD)
    kept = {(r["doc_id"], r["kept_text"]) for r in got if r["doc_id"] in (5, 6, 7, None)}
    assert kept == {(5, "B"), (6, ""), (7, f" {LINE}"), (None, "")}
    assert linededup.line_dedup(none).count() == 0
    far = "\n".join(["short"] * 130 + [LINE])
    x = frame(spark, [(1, far), (2, far), (3, far)])
    by = {r["doc_id"]: r for r in linededup.line_dedup(x).collect()}
    assert by[1]["keep_bitmap"] == {2: ~(1 << 2)} and by[1]["n_dropped"] == 1 and by[3]["keep_bitmap"] is None
    clash = x.selectExpr("doc_id", "text", "1 as _n", "2 as h1", "3 as text_hash", "4 as keep_bitmap", "5 as pos", "6 as holder")
    got = linededup.line_dedup(clash)
    assert got.columns == ["doc_id", "text", "_n", "h1", "text_hash", "pos", "holder", "keep_bitmap", "n_dropped", "kept_text"] and got.where("n_dropped = 1 and h1 = 2").count() == 2


def test_line_dedup_streams_a_sorted_run(spark, odd):
    """The window over (hash, document) rests on the range partitioning and the secondary sort alone."""
    hashes = linededup.line_hashes(odd).checkpoint()
    plan = linededup.first_occurrences(hashes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(h1") == 1 and plan.count("Exchange") == 1 and "Window" in plan
    assert re.search(r"Sort \[h1#\d+L ASC NULLS FIRST, h2#\d+L ASC NULLS FIRST, no_id#\d+ ASC NULLS FIRST, back#\d+L ASC NULLS FIRST, pos#\d+ ASC", plan) and plan.count("Sort [") == 1


def test_sharding(spark, odd, none):
    got = sharding.shard_documents(odd, 4).collect()
    assert len(got) == len(ODD) and sharding.shard_documents(none, 4).count() == 0
    sizes = {s: (100 + s % 7, 1) for s in range(1000)}
    first = sharding.first_map(4, 1000)
    one = sharding.rebalance(first, sizes, 4)
    load = [sum(sizes[s][0] for s in one if one[s] == k) for k in range(4)]
    assert max(load) - min(load) <= 100 and sharding.rebalance(one, sizes, 4) == one
    skew = {s: (10**6 if s == 4 else 50 * (s % 4), 1) for s in range(1000)}
    load = [sum(skew[s][0] for s, k in sharding.rebalance(first, skew, 4).items() if k == t) for t in range(4)]
    assert sorted(load)[-1] == 10**6 and sorted(load)[2] - sorted(load)[0] <= 150
    two = sharding.grow_map(one, sizes, 5)
    assert all(two[s] in (one[s], 4) for s in one)
    load = [sum(sizes[s][0] for s in two if two[s] == k) for k in range(5)]
    assert max(load) - min(load) <= 0.05 * sum(load) / 5
    path = sharding.store_map(spark, one, 1)
    sharding.store_map(spark, two, 2, path)
    assert {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, path, 2).collect()} == two


def test_lm(spark, odd, none):
    every = F.lit(True)
    got = {r["doc_id"]: r for r in lm.score_documents(odd, every).collect()}
    assert len(lm.score_documents(odd, every).collect()) == len(ODD)
    assert got[1]["n_tokens"] == 1 and got[1]["score"] <= 0
    assert lm.score_documents(none, every).count() == 0
    bare = lm.score_documents(odd, F.lit(None).cast("boolean")).where("doc_id = 2").first()
    assert bare["train_tokens"] == 0 and bare["n_known"] == 0 and bare["score"] == pytest.approx(8 * np.log10(0.5), rel=1e-5)


BLANKS = b" \t\n\x0b\x0c\r"


def symbols(text):
    """(context path, symbol, ending) of each byte by the definition: the path is the nodes below the root."""
    raw = [*lm.lowered(text), lm.END]
    out, run, seq = [], b"", [0, 0]
    for b in raw:
        blank = b in BLANKS or b == lm.END
        ends = blank and run != b""
        s = 32 if ends else b
        path = [("1", seq[-1]), ("2", seq[-1], seq[-2])]
        path.append(("word", run) if len(run) >= 3 and (ends or not blank) else ("none", seq[-1], seq[-2]))
        out.append((path, s, b if ends else None))
        seq.append(s)
        run = b"" if blank else run + bytes([b])
    return out


def direct_scores(training, texts):
    """The context-tree model by plain recursion over dictionaries."""
    count, children, endings = {}, {}, Counter()
    for t in training:
        for path, s, e in symbols(t):
            endings[e] += e is not None
            parent = ("root",)
            for node in [("root",), *path]:
                if node != ("root",):
                    children.setdefault(parent, set()).add(node)
                parent = node
                for k in range(8):
                    v, bit = 1 << k | s >> 8 - k, s >> 7 - k & 1
                    count.setdefault((node, v), [0, 0])[bit] += 1
    seen = {n for n, _ in count}

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(node, v):
        if (node, v) not in memo:
            own = log_kt(*count.get((node, v), (0, 0)))
            if node[0] in ("word", "none"):
                memo[node, v] = own, 1.0
            else:
                deeper = sum(weighted(c, v)[0] for c in children.get(node, ()))
                total = np.logaddexp(own, deeper) - math.log(2)
                memo[node, v] = total, math.exp(own - math.log(2) - total)
        return memo[node, v]

    kt = lambda node, v: (count.get((node, v), (0, 0))[1] + 0.5) / (sum(count.get((node, v), (0, 0))) + 1)

    def one(path, v):
        nodes, out, left = [("root",), *path], 0.0, 1.0
        for node, deeper in zip(nodes, [*nodes[1:], None]):
            leaf = deeper is None or (deeper not in seen if deeper[0] in "12" else deeper[0] == "word" and (deeper, v) not in count or deeper[0] == "none" and node not in seen)
            stay = 1.0 if leaf else weighted(node, v)[1]
            out += left * stay * kt(node, v)
            left *= 1 - stay
            if leaf:
                return out
        return out

    total = sum(n for e, n in endings.items() if e is not None)
    for t in texts:
        score = 0.0
        for path, s, e in symbols(t):
            for k in range(8):
                p = one(path, 1 << k | s >> 8 - k)
                score += math.log10(p if s >> 7 - k & 1 else 1 - p)
            if e is not None:
                score += math.log10((endings[e] + 0.5) / (total + 3.5))
        yield score


@pytest.mark.parametrize(("head", "split", "words"), [(1_000_000, 1_000_000, 100_000), (5, 5, 7)])
def test_lm_against_direct_recursion(spark, monkeypatch, head, split, words):
    for name, value in (("HEAD", head), ("SPLIT_WORDS", split), ("WORDS", words)):
        monkeypatch.setattr(lm, name, value)
    train = ["The theme there, then they thaw.\n\nThermal x", "a bb ccc dddd theorem theory\tthe the", "", "élan élans éland naïve", "thereabouts thereafter there"]
    other = ["The theories of therapy", "zebra qqq\r\n élan", " \n ", "theoremtheoremtheorem"]
    x = spark.createDataFrame([(i, t, i < len(train)) for i, t in enumerate(train + other)], "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(x, F.col("learn")).collect()}
    for i, want in enumerate(direct_scores(train, train + other)):
        assert got[i] == pytest.approx(want, rel=2e-6), i


def test_lm_scores_are_finite_after_many_letters(spark):
    big = spark.range(8).selectExpr("id as doc_id", "repeat('the thing then ', 300000) as text", "true as learn")
    odd = ["a_b the_n", "then_ [x]", "the@n ~", "th\x7fing thing\x7f thing\u00ff", "the thing"]
    x = big.unionAll(spark.createDataFrame([(100 + i, t, False) for i, t in enumerate(odd)], big.schema))
    got = [r["score"] for r in lm.score_documents(x, F.col("learn")).collect()]
    assert len(got) == 8 + len(odd) and all(math.isfinite(s) and s < 0 for s in got)
    counts = [(0, 97 << 16 | 32 << 8 | 98, None, 10**11), (0, 98 << 16 | 97 << 8 | 32, None, 10**11), (1, lm.token_hash(b"ab" * 9), b"ab" * 9, 10**11), (1, 1, b"abb", 0), (1, 2, b"ab" * 9 + b"c_", 0)]
    counts = spark.createDataFrame(counts, "kind int, key long, word binary, n long")
    tables = lm.context_tables(counts)
    assert np.isfinite(tables.shallow).all() and all((x[..., 1:] > 0).all() for x in (tables.stay + tables.go, tables.leaf))
    assert all(math.isfinite(r["s"]) for r in lm.code_lengths(counts, tables).collect())


def test_lm_is_a_distribution():
    counts = np.random.default_rng(2).integers(0, 9, (5, 256)).astype(float)
    zeros, ones = lm._bit_counts(counts)
    assert np.power(10, lm.byte_log10(lm._kt(zeros, ones))).sum(axis=-1) == pytest.approx(np.ones(5))


def test_urls(spark):
    data = [(1, "https://EN.example.COM/en/7x?q"), (2, "http://com/en/"), (3, "http://xcom/en/"), (4, None), (5, "no scheme"), (6, "a://b.net/de/8#f"), (7, "x://h?y/en/"), (8, "http://a.com/EN/")]
    x = spark.createDataFrame(data, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urlfilter.judge_urls(x).collect()}
    assert got == {1: ("en.example.com", "/en/7x", "example.com/en/7"), 2: ("com", "/en/", "com/en/"), 3: ("xcom", "/en/", None), 4: ("", "", None), 5: ("", "", None), 6: ("b.net", "/de/8", "net/de/"), 7: ("h", "", None), 8: ("a.com", "/EN/", None)}
    assert urlfilter.judge_urls(x.where("false")).count() == 0
    lab = spark.createDataFrame([(f"http://casino{i}.biz/win", "block") for i in range(20)] + [(f"http://school{i}.edu/read", "allow") for i in range(20)], "url string, verdict string")
    m = urlfilter.fit(lab)
    every = [(u, v) for v, urls in (("allow", url_labels.ALLOW), ("block", url_labels.BLOCK)) for u in urls]
    train = urlfilter.fit(spark.createDataFrame([r for i, r in enumerate(every) if i % 4], "url string, verdict string"))
    held = spark.createDataFrame([r for i, r in enumerate(every) if not i % 4], "url string, verdict string").select("verdict", urlfilter.url_host(F.col("url")).alias("h"), urlfilter.url_path(F.col("url")).alias("p")).collect()
    assert sum((train.block_probability(r["h"], r["p"]) > 0.5) == (r["verdict"] == "block") for r in held) >= 0.9 * len(held)
    assert m.block_probability("casino99.biz", "/win") > 0.8 > 0.2 > m.block_probability("school77.edu", "/read")


def test_url_rules_are_those_of_the_contract(spark):
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/6": ("com/en/", "block"), "http://m.example.com/en/71": ("example.com/en/7", "allow"),
        "http://a.net/de/1": ("net/de/", "allow"), "http://xexample.net/de/8": ("net/de/", "allow"), "http://m.example.net/de/7": ("net/de/", "allow"),
        "http://m.example.net/de/81": ("example.net/de/8", "block"), "http://a.org/es/1": ("org/es/", "block"),
    }
    x = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(x).collect()}
    assert got == dict(enumerate(want.values()))


def test_bpe_merge_table_is_built_once_a_worker():
    path = public_tokenizers.path(RANKS)
    one, two = (bpe.Codec(path, public_tokenizers.PATTERN) for _ in range(2))
    assert bpe.merge_table(path) is bpe.merge_table(path) and one.run(["naïve thththe"]) == two.run(["naïve thththe"])


BIG = [2**53 + 1, 2**53 + 3, 2**53 + 5, 2**63 - 1, None]


def test_ids_stay_exact_beside_nulls(spark):
    x = spark.createDataFrame([(i, f"text of {i} words", "one two three") for i in BIG], "doc_id long, text string, item string").coalesce(1)
    items = x.selectExpr("doc_id as item_id", "item as text")
    path = public_tokenizers.path(RANKS)
    for found in (simhash.near_duplicates(x), bpe.encode_digests(x, path, public_tokenizers.PATTERN), bpe.encode(x, path, public_tokenizers.PATTERN), decontam.contamination(x, items), lm.score_documents(x, F.lit(True)), quality.judge_quality(x.withColumn("source", F.lit("s"))), linededup.line_dedup(x), sharding.shard_documents(x, 2)):
        assert sorted((r["doc_id"] for r in found.collect()), key=lambda i: i or 0) == [None, *BIG[:-1]]
    pages = spark.createDataFrame([(i, "http://u/", "same" if k % 2 else "own") for k, i in enumerate(BIG)], "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r["refers_to"] for r in warc.archive_pages(pages).collect()}
    assert got == {BIG[0]: BIG[2], BIG[1]: BIG[3], BIG[2]: None, BIG[3]: None, None: BIG[2]}
    near = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f g"), (2**53 + 1, "a b c d e f g"), (None, "x y z")], "doc_id long, text string")).collect()
    assert sorted((r["component_id"] or 0) for r in near) == [0, 2**53 + 1, 2**53 + 1]


def test_payload_of_very_many_pages(spark, tmp_path, monkeypatch):
    """Beyond the broadcast limit the repeated payloads are joined: the same plan of records."""
    pages = spark.range(300).selectExpr("id as page_id", "'u' as url", "case when id % 3 = 0 then 'same' else cast(id div 2 as string) end as html")
    want = sorted(map(tuple, warc.plan_records(pages).select("page_id", "record_type", "refers_to", "html").collect()))
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", 0)
    assert sorted(map(tuple, warc.plan_records(pages).select("page_id", "record_type", "refers_to", "html").collect())) == want


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    import corpus_pipeline as c

    stages = dict(c.STAGES)
    sf = "/root/testdata/sf0.001"
    rows = sorted((i or 0) for i, _ in ODD)
    got = {n: stages[n](spark, odd, sf) for n in stages}
    ids = {n: sorted((r["doc_id"] or 0) for r in x.collect()) for n, x in got.items()}
    assert ids["language"] == [0, 4, 5, 6, 7, 7, 9, 10]  # what has no letter goes
    assert ids["lines"] == ids["benchmark"] == ids["tokens"] == rows
    assert ids["near_copies"] == [1, 4, 5, 6, 7, 8, 9, 10]  # texts without a word are one group
    assert all(x.columns == c.COLUMNS for n, x in got.items() if n != "tokens")
    assert all(stages[n](spark, none, sf).count() == 0 for n in stages)


def test_pipeline_drops_planted_passages_only(spark, tmp_path):
    import corpus_pipeline as c

    items = [(1, " ".join(f"q{i}" for i in range(14))), (2, "short one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, [(1, "x " + " ".join(f"Q{i}," for i in range(2, 12))), (2, " ".join(f"q{i}" for i in range(9))), (None, "a SHORT-one b"), (3, None)])
    assert sorted(r["doc_id"] for r in c.benchmark(spark, docs, str(tmp_path)).collect()) == [2, 3]

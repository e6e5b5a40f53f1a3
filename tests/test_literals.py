"""Large dictionaries against brute force, and equal to the small form."""

import random
import re

import pytest

from momentra.functions import literals
from momentra.operators import scalars as S


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("abcd", ["abcd"]), ("ab|cde", ["ab", "cde"]), ("ab*cd", ["cd"]), ("abc?d+e", ["ab"]), (r"\bred\s+fox\b", ["red"]), ("[abc]xyz[0-9]{2}q", ["xyz"]),
        ("(foo|bar)bazz", ["bazz"]), (r"a\.bc", ["a.bc"]), (r"\x41bc", [None]), ("[0-9]+", [None]), ("a|[0-9]", ["a", None]), ("(?i)ABC", ["abc"]), ("(?i)É", [None]),
        ("ab{2}cd", ["cd"]), (r"[]x]yz", ["yz"]), (r"(a(b)c)de", ["de"]), ("", [None]), (r"\Qa.b\E", [None]), ("ab.cde$", ["cde"]), (r"[\]a]bcd", ["bcd"]),
    ],
)
def test_what_a_match_must_hold(pattern, want):
    assert literals._alternatives(pattern) == want


def test_dictionary_of_50000_patterns(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    shapes = (lambda: word(5), lambda: rf"\b{word(3)}[0-9]", lambda: f"{word(4)}|{word(6)}", lambda: f"{word(2)}.?{word(4)}", lambda: word(2), lambda: f"({word(3)}|{word(4)}){word(4)}")
    patterns = [(f"t{i % 30_000}", shapes[i % 300 if i % 300 in (1, 4) else rng.choice((0, 2, 3, 5))]()) for i in range(49_990)]
    patterns += [("any", "[0-9]{3}"), ("start", "^a"), (None, "a"), ("x", None)]
    texts = [" ".join(word(rng.randint(1, 9)) + rng.choice(["", "1", "234"]) for _ in range(rng.randint(0, 12))).upper() for _ in range(60)] + [None, "", texts_twice := "ABCDE 123"] + [texts_twice]
    compiled = [(t, re.compile(p)) for t, p in patterns if t and p]
    want = sorted((i, sorted({t for t, p in compiled if x is not None and p.search(x.lower())})) for i, x in enumerate(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    given = spark.createDataFrame(patterns, "tag string, pattern string")
    got = S.dictionary_tags(df, "t", given, "id")
    assert sorted((r["id"], r["tags"]) for r in got.collect()) == want
    assert sum(len(tags) for _, tags in want) > 500


def test_small_and_large_forms_are_equal(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abc", k=n))
    paths = spark.createDataFrame([(i % 50, None if i == 3 else word(rng.randint(0, 9)).upper()) for i in range(80)], "id long, p string")
    entries = spark.createDataFrame([(rng.choice([None, *range(20)]), f"s{i}", None if i == 5 else word(rng.randint(1, 6))) for i in range(60)], "ord int, source string, needle string")
    tags = entries.selectExpr("source as tag", "concat(needle, '[ab]?') as pattern")
    one = lambda df, c: sorted(((r["id"], str(r[c])) for r in df.collect()))
    small = one(S.source_detect(paths, "p", entries, "id"), "source"), one(S.dictionary_tags(paths, "p", tags, "id"), "tags")
    monkeypatch.setattr(S, "FEW", 3)
    large = S.source_detect(paths, "p", entries, "id")
    assert (one(large, "source"), one(S.dictionary_tags(paths, "p", tags, "id"), "tags")) == small
    assert "NestedLoop" not in large.drop("x").select("id")._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    everywhere = entries.unionByName(spark.createDataFrame([(7, "all", "")], entries.schema))
    got = one(S.source_detect(paths, "p", everywhere, "id"), "source")
    monkeypatch.setattr(S, "FEW", 200)
    assert got == one(S.source_detect(paths, "p", everywhere, "id"), "source")


def test_thousands_of_needles(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefghijkl/", k=n))
    needles = [(i, f"s{i}", word(rng.choice([2, 4, 5, 8]))) for i in range(6_000)]
    paths = [word(rng.randint(0, 60)) for _ in range(200)]
    want = [(i, next((s for _, s, n in needles if n in p), None)) for i, p in enumerate(paths)]
    got = S.source_detect(spark.createDataFrame(list(enumerate(paths)), "id long, p string"), "p", spark.createDataFrame(needles, "ord int, source string, needle string"), "id")
    assert sorted((r["id"], r["source"]) for r in got.collect()) == want


def test_many_bucket_rules_equal_few(spark, monkeypatch):
    rng = random.Random(5)
    pick = lambda xs: rng.choice([None, *xs])
    rules = spark.createDataFrame([(rng.randrange(30), pick("AB"), pick("xy"), pick("pqr"), pick([0.3, 0.6, 0.9]), f"b{i}") for i in range(150)], "priority int, tier string, type string, label string, min_confidence double, bucket string")
    df = spark.createDataFrame([(i, pick("ABC"), pick("xyz"), pick("pq"), pick([0.1, 0.5, 0.7, 1.0])) for i in range(400)], "id long, tier string, type string, label string, label_confidence double")
    told = lambda: sorted((r["id"], r["bucket"]) for r in S.quota_bucket(df, rules).collect())
    few = told()
    monkeypatch.setattr(S, "FEW", 100)
    assert told() == few and len({b for _, b in few}) > 10


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("abc", [("abc", ())]), ("[ .,]abc", [("abc", ((-3, " .,"),))]), ("abc[x-z]", [("abc", ((1, "xyz"),))]), ("a[bc]def|gh", [("def", ((-4, "a"), (-3, "bc"))), ("gh", ())]),
        ("[ab]", None), ("a.c", None), (r"a\.c", None), ("[^a]bc", None), ("[a&&b]bc", None), ("[z-a]bc", None), ("(a)bc", None), ("ab|", None), ("", None),
    ],
)
def test_what_stands_beside_a_text(pattern, want):
    assert literals._fixed(pattern) == want


@pytest.mark.parametrize("chars", [40, 1 << 20])
def test_large_dictionary_is_one_scan(spark, monkeypatch, chars):
    """No row is shuffled, however many slices the dictionary has; classes hold at the texts' ends too."""
    monkeypatch.setattr(literals, "SLICE_CHARS", chars)
    monkeypatch.setattr(S, "FEW", 5)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abc", k=n))
    shapes = (lambda: f"[ .,]{word(3)}", lambda: f"{word(3)}[a-b]", lambda: f"{word(4)}", lambda: rf"\b{word(3)}", lambda: f"{word(2)}[bc]{word(2)}|[a ]{word(4)}", lambda: f"{word(2)}.{word(2)}", lambda: "[ab]{3} ")
    patterns = sorted({(f"t{i % 12}", shapes[i % 7]()) for i in range(40)})
    texts = ["".join(rng.choices("abc .", k=rng.randint(0, 25))).upper() for _ in range(150)] + [None]
    want = [(i, sorted({t for t, p in patterns if x is not None and re.search(p, x.lower())})) for i, x in enumerate(texts)]
    got = S.dictionary_tags(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "t", spark.createDataFrame(patterns, "tag string, pattern string"), "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["tags"]) for r in got.collect()) == want
    assert "Exchange" not in plan.replace("BroadcastExchange", "")


@pytest.mark.parametrize("chars", [30, 1 << 20])
def test_many_needles_are_one_scan(spark, monkeypatch, chars):
    """The first entry held, whatever slice its needle lies in; no row is shuffled."""
    monkeypatch.setattr(literals, "SLICE_CHARS", chars)
    monkeypatch.setattr(S, "FEW", 5)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcd", k=n))
    entries = [(rng.choice([None, *range(9)]), f"s{i % 25}", word(rng.randint(1, 5)).upper()) for i in range(40)]
    texts = [word(rng.randint(0, 9)).upper() for _ in range(120)] + [None]
    order = sorted(entries, key=lambda e: (e[0] is None, e[0] or 0, e[1]))
    want = [(i, next((s for _, s, n in order if x is not None and n in x), None)) for i, x in enumerate(texts)]
    got = S.source_detect(spark.createDataFrame(list(enumerate(texts)), "id long, p string"), "p", spark.createDataFrame(entries, "ord int, source string, needle string"), "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["source"]) for r in got.collect()) == want
    assert "id#" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan

"""Literal cases and invariants of the greedy selections."""

import difflib
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from momentra.operators import selection as P
from momentra.operators import similarity as D

OBS = "scene_id string, obs_id long, timestamp_sec double, score double, sharpness double"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_gap_keeps_the_best_apart(spark):
    x = spark.createDataFrame([("s", 1, 10.0, 95.0, 1.0), ("s", 2, 12.0, 94.0, 1.0), ("s", 3, 40.0, 80.0, 1.0)], OBS)
    assert {r[0] for r in rows(P.min_gap_select(x, "score", 2, 15.0), "timestamp_sec")} == {10.0, 40.0}


def test_top_off_ignores_the_gap(spark):
    x = spark.createDataFrame([("s", 1, 10.0, 95.0, 1.0), ("s", 2, 11.0, 80.0, 1.0)], OBS)
    assert rows(P.min_gap_select(x, "score", 2, 15.0), "timestamp_sec", "relaxed") == [(10.0, False), (11.0, True)]
    assert P.min_gap_select(x, "score", 2, 15.0, top_off=False).count() == 1


def test_gate(spark):
    x = spark.createDataFrame([("s", 1, 0.0, 95.0, 120.0), ("s", 2, 1.0, 78.0, 900.0)], OBS)
    assert rows(P.sharp_gate(x, 1, 50.0), "obs_id", "gate_relaxed") == [(2, False)]
    y = spark.createDataFrame([("s", i, float(i), 80.0 - i, 200.0 + i) for i in range(5)], OBS)
    got = P.sharp_gate(y, 3, 80.0)
    assert got.count() >= 3 and got.select(F.bool_and("gate_relaxed")).first()[0]


def test_equal_sharpness_all_pass(spark):
    x = spark.createDataFrame([("s", i, float(i), 50.0, 150.0) for i in range(4)], OBS)
    assert P.sharp_gate(x, 2).count() == 4


def test_gap_invariant_and_repartitioning(spark):
    rng = random.Random(3)
    data = [(f"s{i % 5}", i, round(rng.random() * 900, 3), round(rng.random() * 100, 2), 100.0) for i in range(600)]
    x = spark.createDataFrame(data, OBS)
    a = P.min_gap_select(x, "score", 10, 40.0, top_off=False)
    for s in range(5):
        t = [r[0] for r in rows(a.where(F.col("scene_id") == f"s{s}"), "timestamp_sec")]
        assert all(b - c >= 40 for c, b in itertools.pairwise(t))
    b = P.min_gap_select(x.repartition(7, "obs_id"), "score", 10, 40.0, top_off=False)
    assert rows(a, "scene_id", "obs_id", "rank") == rows(b, "scene_id", "obs_id", "rank")


def quota_obs(spark):
    at = [("A", 0, 92), ("A", 10, 91), ("A", 22, 90), ("B", 180, 89), ("B", 190, 88), ("B", 205, 87), ("A", 400, 86), ("A", 410, 85), ("A", 425, 84)]
    x = [("s", i, float(t), lab, 0.9, "other", float(s), 1.0) for i, (lab, t, s) in enumerate(at)]
    return spark.createDataFrame(x, "scene_id string, obs_id long, timestamp_sec double, label string, label_confidence double, bucket string, score double, motion double")


def test_quota_fill_covers_runs(spark):
    picks, stats = P.quota_fill(quota_obs(spark), {}, max_total=6, min_total=0)
    got = rows(picks, "run_label", "obs_id")
    assert len(got) == 9 and {r for r, _ in got} == {"A_01", "B_01", "A_02"}
    assert tuple(stats.select("runs", "effective_max", "picks").first()) == (3, 9, 9)


def plain_fill(
    x: pd.DataFrame, spec: dict[str, int], per_label: int, per_run: int, gap: float, tight: float, run_gap: float, max_total: int, min_total: int,
    cap: int
) -> tuple[list, dict]:
    """One scene, rows in time order. Every pick counts for the gap of the later ones."""
    rows = x.sort_values(["timestamp_sec", "obs_id"]).to_dict("records")
    runs: list[list[dict]] = []
    seen: dict[str, int] = {}
    for r in rows:
        if not runs or runs[-1][-1]["label"] != r["label"] or r["timestamp_sec"] - runs[-1][-1]["timestamp_sec"] > run_gap:
            runs.append([])
            seen[r["label"]] = seen.get(r["label"], 0) + 1
        r["run_label"] = f"{r['label']}_{seen[r['label']]:02d}"
        runs[-1].append(r)
    best = lambda rs: sorted(rs, key=lambda r: (-r["score"], -r["label_confidence"], -r["motion"], r["timestamp_sec"], r["obs_id"]))
    total = min(cap, max(max_total, per_run * len(runs)))
    picked: list[tuple[dict, int]] = []
    taken: set[int] = set()

    def take(pool: list[dict], want: int, apart: float, number: int) -> int:
        got = 0
        for r in best(pool):
            if got >= want or len(picked) >= total:
                break
            if r["obs_id"] not in taken and all(abs(r["timestamp_sec"] - p["timestamp_sec"]) >= apart for p, _ in picked):
                picked.append((r, number))
                taken.add(r["obs_id"])
                got += 1
        return got

    for run in runs:
        got = take(run, per_run, gap, 0)
        if got < per_run:
            take(run, per_run - got, tight, 0)
    for bucket, want in spec.items():
        take([r for r in rows if r["bucket"] == bucket], want - sum(p["bucket"] == bucket for p, _ in picked), gap, 1)
    for label in sorted(seen):
        take([r for r in rows if r["label"] == label], per_label - sum(p["label"] == label for p, _ in picked), gap, 1)
    for number, apart in ((2, gap), (3, 0.0)):
        if len(picked) < min_total:
            take(rows, min_total - len(picked), apart, number)
    return picked, {"eligible": len(rows), "runs": len(runs), "effective_max": total, "picks": len(picked)}


@pytest.mark.parametrize(
    ("spec", "max_total", "min_total", "more"),
    [({}, 6, 0, {}), ({"best": 4, "wide": 3}, 12, 8, {"per_label": 2, "per_run": 1}), ({"wide": 9}, 30, 40, {"per_run": 2, "cap": 20}), ({"best": 2}, 5, 5, {"per_run": 0, "per_label": 3, "run_gap": 15.0}), ({}, 0, 0, {"per_run": 0})],
)
def test_quota_fill_equals_the_plain_loop(spark, spec, max_total, min_total, more):
    rng = random.Random(6)
    cols = "scene_id string, obs_id long, timestamp_sec double, label string, label_confidence double, bucket string, score double, motion double"
    data = [(None if s == 0 else f"s{s}", 1000 * s + i, float(rng.randrange(600)), rng.choice("ABC"), rng.randrange(3) / 2, rng.choice(["best", "wide", "other"]), float(rng.randrange(8)), float(rng.randrange(2))) for s in range(9) for i in range(rng.choice([1, 5, 60, 200]))]
    args = {"per_label": 0, "per_run": 3, "gap_sec": 20.0, "tight_sec": 8.0, "run_gap": 120.0, "cap": 36} | more
    picks, stats = P.quota_fill(spark.createDataFrame(data, cols), spec, max_total, min_total, **args)
    want_picks, want_stats = [], []
    for scene in {r[0] for r in data}:
        x = pd.DataFrame([r for r in data if r[0] == scene], columns=[c.split()[0] for c in cols.split(", ")])
        found, told = plain_fill(x, spec, args["per_label"], args["per_run"], args["gap_sec"], args["tight_sec"], args["run_gap"], max_total, min_total, args["cap"])
        want_picks += [(str(scene), i, p["obs_id"], p["run_label"], n, p["bucket"], p["score"]) for i, (p, n) in enumerate(found, 1)]
        want_stats.append((str(scene), *told.values()))
    got = [(str(r["scene_id"]), r["rank"], r["obs_id"], r["run_label"], r["pick_pass"], r["bucket"], r["score"]) for r in picks.collect()]
    assert sorted(got) == sorted(want_picks)
    assert sorted((str(r["scene_id"]), *tuple(r)[1:]) for r in stats.collect()) == sorted(want_stats)


def test_quota_fill_empty(spark):
    picks, stats = P.quota_fill(quota_obs(spark).where("false"), {}, 6, 0)
    assert picks.count() == 0 and stats.count() == 0


HASHED = "scene_id string, obs_id long, timestamp_sec double, phash long, sharpness double"


def test_keep_first(spark):
    x = spark.createDataFrame([("s", 0, 0.0, 5, 1.0), ("s", 1, 1.0, 5, 2.0), ("s", 2, 2.0, 9, 1.0), ("s", 3, 3.0, None, 1.0), ("s", 4, 4.0, None, 1.0)], HASHED)
    assert rows(P.near_dup_keep_first(x, "phash", 0), "obs_id") == [(0,), (2,), (3,), (4,)]


def test_kept_hashes_are_apart(spark):
    rng = random.Random(1)
    x = spark.createDataFrame([("s", i, float(i), rng.getrandbits(12), 1.0) for i in range(300)], HASHED)
    kept = [r[0] for r in rows(P.near_dup_keep_first(x, "phash", 2), "phash")]
    assert all((a ^ b).bit_count() > 2 for a, b in itertools.combinations(kept, 2))


def test_clusters(spark):
    x = spark.createDataFrame([("s", 0, 0.0, 0, 1.0), ("s", 1, 1.0, 1, 9.0), ("s", 2, 2.0, 3, 1.0), ("s", 3, 3.0, None, 1.0)], HASHED)
    assert rows(D.near_dup_clusters(x, "phash", 1), "obs_id", "cluster_id", "is_best") == [(0, 0, False), (1, 0, True), (2, 2, True), (3, 3, True)]


def test_pairs_find_all(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(40)]
    vals = base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base]
    x = spark.createDataFrame(list(enumerate(vals)), "id long, h long")
    first = {}
    for i, v in enumerate(vals):
        first.setdefault(v, i)
    want = sorted((min(first[a], first[b]), max(first[a], first[b]), (a ^ b).bit_count()) for a, b in itertools.combinations(first, 2) if (a ^ b).bit_count() <= 3)
    assert rows(D.near_dup_pairs(x, "h", 3), "a", "b", "distance") == want


def test_floor_cascade_fills_in_order(spark):
    x = spark.createDataFrame([("s", i, float(i), float(i * 5), float(i)) for i in range(20)], OBS)
    got = P.floor_cascade(x.where("score >= 90"), x.where("score < 60"), x, target=8, overshoot=2)
    stages = [r["stage"] for r in got.orderBy("rank").collect()]
    assert stages[:2] == ["P", "P"] and stages[2:6] == ["A"] * 4 and set(stages[6:]) == {"C"}
    assert len(stages) <= 10 and got.select("obs_id").distinct().count() == len(stages)


def test_retrieval_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    pick = lambda n: rng.sample(words, n)
    data = [(i, f"src{i % 3}", pick(3), pick(2), pick(3), [f"c{i % 4}"], [], (i % 10) / 10, (i % 3) / 10) for i in range(40)]
    b = spark.createDataFrame(data, "id long, source string, tags array<string>, labels array<string>, title_tokens array<string>, contributors array<string>, categories array<string>, acceptance double, reject_rate double")
    got = {(r["query_id"], r["id"]): r["signal"] for r in P.retrieve_topk(b.where("id < 5"), b, k=4).collect()}
    w = list(P.RETRIEVAL.values())
    for q in data[:5]:
        best = []
        for x in data:
            if x[0] == q[0] or not any(set(q[c]) & set(x[c]) for c in range(2, 7)):
                continue
            near = sum(k * (len(set(q[c]) & set(x[c])) / len(set(q[c]) | set(x[c])) if q[c] or x[c] else 0) for k, c in zip(w, range(2, 7)))
            best.append((-round(min(1, max(0, near + 0.08 * x[7] - 0.04 * x[8] + (0.22 if q[1] == x[1] else 0))), 6), x[0]))
        assert sorted(s for (a, _), s in got.items() if a == q[0]) == pytest.approx(sorted(-s for s, _ in sorted(best)[:4]), abs=2e-6)


def test_text_near_dup(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank today"
    data = [(1, base, 5.0), (2, base.upper(), 5.0), (3, base.replace("today", "tonight"), 5.0), (4, "nothing like it at all in any of its many words", 5.0), (5, base, 1.0), (6, None, 5.0)]
    x = spark.createDataFrame(data, "id long, t string, q double")
    got = {r["id"]: (r["reason"], r["dup_of"]) for r in D.text_near_dup(x, "id", "t", "q").collect()}
    assert got == {1: (None, None), 2: ("exact", 1), 3: ("near", 1), 4: (None, None), 5: ("low_quality", None), 6: (None, None)}


@pytest.mark.parametrize(("a", "b", "want"), [(None, "", 0.0), ("Abc  d", "abc d", 0.0), ("abcd", "bcde", 0.25)])
def test_edit_distance(spark, a, b, want):
    x = spark.createDataFrame([(a, b)], "a string, b string")
    assert D.edit_distance(x, "a", "b").first()["edit_distance"] == want


def test_score_with(spark):
    from momentra.operators.scoring import score_with

    got = score_with(spark.range(10), lambda x: pd.DataFrame({"y": x["id"] * 2}), "y long", batch_rows=3)
    assert sorted(r[0] for r in got.collect()) == list(range(0, 20, 2))


def big_scene(spark, n=5000):
    """One scene of n rows with copies across row 2000."""
    rng = random.Random(9)
    base = [rng.getrandbits(62) for _ in range(n // 2)]
    data = [("s", i, float(i) * 0.5, float(rng.randrange(100)), 100.0, base[i % (n // 2)] ^ (i // (n // 2))) for i in range(n)]
    return data, spark.createDataFrame(data, OBS + ", phash long")


def test_scenes_of_any_size(spark):
    data, x = big_scene(spark)
    best = sorted(data, key=lambda r: (-r[3], r[2], r[1]))
    kept = []
    for r in best:
        if len(kept) < 60 and all(abs(r[2] - y[2]) >= 40 for y in kept):
            kept.append(r)
    want = [(r[1], False) for r in kept] + [(r[1], True) for r in best if r not in kept][: 60 - len(kept)]
    got = P.min_gap_select(x, "score", 60, 40.0).orderBy("rank").collect()
    assert [(r["obs_id"], r["relaxed"]) for r in got] == want and len(kept) > 30
    windows = []
    for r in best:
        if all(abs(r[2] - y[2]) >= 3 for y in windows):
            windows.append(r)
    assert rows(P.interval_consolidate(x.withColumn("window_sec", F.lit(1.5))), "obs_id") == sorted((r[1],) for r in windows)
    assert rows(P.near_dup_keep_first(x, "phash", 1), "obs_id") == [(i,) for i in range(2500)]
    got = D.near_dup_clusters(x, "phash", 1).collect()
    assert {(r["obs_id"], r["cluster_id"]) for r in got} == {(i, i % 2500) for i in range(5000)}


def test_keep_first_forgets_beyond_the_horizon(spark):
    x = spark.createDataFrame([("s", i, float(i), h, 1.0) for i, h in enumerate((0, 255, 255 << 8, 0, 255 << 8))], HASHED)
    assert rows(P.near_dup_keep_first(x, "phash", 1, horizon=2), "obs_id") == [(0,), (1,), (2,), (3,)]


def test_quota_fill_sees_the_whole_scene(spark):
    x = [("s", i, float(i), "ABC"[i // 500 % 3], 0.9, "other", float(i % 97), 1.0) for i in range(3000)]
    picks, stats = P.quota_fill(spark.createDataFrame(x, "scene_id string, obs_id long, timestamp_sec double, label string, label_confidence double, bucket string, score double, motion double"), {}, 6, 0)
    assert tuple(stats.select("eligible", "runs", "effective_max", "picks").first()) == (3000, 6, 18, 18)
    assert picks.where("score = 96").count() == 18


def test_retrieval_by_common_tokens_is_exact(spark):
    rng = random.Random(4)
    data = [(i, f"src{i % 2}", rng.sample("abc", 2), [], rng.sample([f"r{j}" for j in range(40)], 1), [], [], rng.randrange(10) / 10, rng.randrange(10) / 10) for i in range(120)]
    b = spark.createDataFrame(data, "id long, source string, tags array<string>, labels array<string>, title_tokens array<string>, contributors array<string>, categories array<string>, acceptance double, reject_rate double")
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["signal"], 6)) for r in df.collect())
    assert key(P.retrieve_topk(b.where("id < 30"), b, k=4, max_df=5)) == key(P.retrieve_topk(b.where("id < 30"), b, k=4))


def greedy_texts(texts, limit=0.86):
    """The plain loop: (near id, of the accepted the most alike) of every text."""
    accepted, out = [], []
    for t in texts:
        near = [(-r, i) for i in accepted if (r := D.difflib.SequenceMatcher(None, t, texts[i]).ratio()) >= limit]
        out.append(min(near)[1] if near else None)
        if not near:
            accepted.append(len(out) - 1)
    return out


def edited(rng, text, n):
    t = list(text)
    for at in rng.sample(range(len(t)), n):
        t[at] = rng.choice("abcdefghijklmnopqrstuvwxyz")
    return "".join(t)


def chains(rng):
    """Texts of 100 characters, each 9 of them off the one before."""
    texts = []
    for _ in range(60):
        texts.append("".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=100)).replace("  ", "ab").strip() + "z")
        texts.extend(texts[-1:])
        for _ in range(4):
            texts.append(edited(rng, texts[-1], 9))
    return texts


def hot(rng):
    """Texts that share most of their characters, so that they meet in the same buckets, near and far."""
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=120))
    return [base + edited(rng, base, 40) if rng.random() < 0.5 else base + "".join(rng.choices("abcdefgh", k=rng.randint(10, 60))) for _ in range(150)]


@pytest.mark.parametrize("block", [10_000, 16])
@pytest.mark.parametrize("make", [chains, hot])
def test_text_near_dup_is_the_greedy_loop(spark, monkeypatch, make, block):
    monkeypatch.setattr(D, "BLOCK_ROWS", block)
    rng = random.Random(8)
    texts = make(rng)
    if make is chains:
        rng.shuffle(texts)
    firsts = {}
    for i, t in enumerate(texts):
        firsts.setdefault(t, i)
    once = [t for i, t in enumerate(texts) if firsts[t] == i]
    near = {t: None if d is None else firsts[once[d]] for t, d in zip(once, greedy_texts(once))}
    want = [("near", near[t]) if near[t] is not None else ("exact", firsts[t]) if firsts[t] != i else (None, None) for i, t in enumerate(texts)]
    x = spark.createDataFrame([(i, t, 5.0) for i, t in enumerate(texts)], "id long, t string, q double")
    got = {r["id"]: (r["reason"], r["dup_of"]) for r in D.text_near_dup(x, "id", "t", "q").collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {d for r, d in want if r} <= {i for i, w in enumerate(want) if w[0] is None}
    assert len({r for r, _ in want}) > 1


def test_text_near_dup_of_odd_rows(spark):
    x = spark.createDataFrame([(1, None, 5.0), (2, "  ", 5.0), (3, "a", None), (4, "a", 5.0), (5, "A ", 5.0)], "id long, t string, q double")
    got = {r["id"]: (r["reason"], r["dup_of"]) for r in D.text_near_dup(x, "id", "t", "q").collect()}
    assert got == {1: (None, None), 2: ("exact", 1), 3: ("low_quality", None), 4: (None, None), 5: ("exact", 4)}
    assert D.text_near_dup(x.where("false"), "id", "t", "q").count() == 0


def test_hot_keys_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ROWS", 16)
    x = spark.createDataFrame([(i, (1 << 40) + (1 << i % 12) + (i << 50)) for i in range(120)], "id long, h long")
    vals = [r["h"] for r in x.orderBy("id").collect()]
    want = sorted((a, b, (vals[a] ^ vals[b]).bit_count()) for a, b in itertools.combinations(range(120), 2) if (vals[a] ^ vals[b]).bit_count() <= 3)
    assert rows(D.near_dup_pairs(x, "h", 3), "a", "b", "distance") == want


def test_rows_without_a_scene_are_one_scene(spark):
    x = spark.createDataFrame([(None, 0, 0.0, 7, 1.0), (None, 1, 1.0, 7, 1.0), ("s", 2, 2.0, 7, 1.0)], HASHED)
    assert rows(P.near_dup_keep_first(x, "phash", 0), "obs_id") == [(0,), (2,)]
    assert rows(D.near_dup_clusters(x.where("scene_id is not null"), "phash", 0), "obs_id", "cluster_id") == [(2, 2)]


@pytest.mark.parametrize(("few", "horizon", "threshold", "spread"), [(10, None, 5, 64), (10, 40, 5, 64), (10, None, 3, 20), (10, 25, 0, 4), (2048, 30, 2, 12)])
def test_hashes_equal_the_scan(monkeypatch, few, horizon, threshold, spread):
    from momentra.functions import streams

    monkeypatch.setattr(streams, "FEW_HASHES", few)
    rng = random.Random(11)
    table, held = streams.Hashes(threshold, horizon), []
    centres = [rng.getrandbits(spread) - (1 << 63 if spread == 64 else 0) for _ in range(40)]
    for _ in range(1200):
        h = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            h ^= 1 << rng.randrange(min(spread, 62))
        begin = 0 if horizon is None else max(0, len(held) - horizon)
        want = next((i for i in range(begin, len(held)) if ((held[i] ^ h) & (2**64 - 1)).bit_count() <= threshold), None)
        assert table.first_near(h) == want
        if want is None or rng.random() < 0.3:
            table.add(h)
            held.append(h)


def test_bounds_before_difflib_lose_no_pair(monkeypatch):
    """Near texts, moved halves and unrelated texts of the same syllables: all near pairs are found, and hardly another is compared."""
    rng = random.Random(4)
    syllables = ["th", "er", "ing", "on", "ea", "an", "st", "he", "nd", "ou", "ly", "tion", "re", "ha", "wh", " ", ". ", ", "]
    text = lambda n: "".join(rng.choices(syllables, k=n))

    def changed(t):
        x = list(t)
        for _ in range(int(rng.choice([0.01, 0.02, 0.04, 0.06, 0.1]) * len(x))):
            at = rng.randrange(len(x))
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "z", "th"])
        return "".join(x[len(x) // 2 :] + x[: len(x) // 2]) if rng.random() < 0.2 else "".join(x)

    base = [text(n) for n in (30, 60, 100, 101, 150, 250)]
    texts = base + [changed(t) for t in base for _ in range(5)] + ["", "a", "ab", "a" * 300, "ab" * 200]
    for limit in (0.86, 0.7):
        want = {(i, j): r for j, b in enumerate(texts) for i, a in enumerate(texts) if i > j and (r := difflib.SequenceMatcher(None, a, b).ratio()) >= limit}
        held, got = D.Held(limit), {}
        for i, t in enumerate(texts):
            got |= {(i, at): r for at, r in held.near(t)}
            held.add(i, t)
        assert got == want and len(want) >= 20
    compared = []
    monkeypatch.setattr(D, "_remembered", type("Counted", (), {"__call__": lambda _, a, b: compared.append(a) or 0.0, "__wrapped__": staticmethod(lambda a, b: compared.append(a) or 0.0)})())
    held = D.Held(0.86)
    for i in range(60):
        t = text(300)
        list(held.near(t))
        held.add(i, t)
    assert len(compared) < 20


def test_texts_wait_only_for_near_ones():
    """A near pair makes its second text wait, not the rest of the bucket."""
    state = D.Round(0.86)
    texts = ["the red fox jumps over it", "the red fox jumps over it.", "a wholly other sentence", "1234567890 and more"]
    assert [state.feed((0, i, t, False))[0][1] for i, t in enumerate(texts)] == [D.FREE, D.WAITS, D.FREE, D.FREE]


def test_retrieval_compares_alike_rows_once(spark):
    """Ties within rounding fall to the least id, whatever the noise of their sums; queries that are alike share candidates."""
    data = [(i, "a", ["x"], [], ["y", f"z{i // 2}"], [None], [], 0.2 + (i >= 20) * 1e-7, 0.1) for i in range(40)]
    b = spark.createDataFrame(data, "id long, source string, tags array<string>, labels array<string>, title_tokens array<string>, contributors array<string>, categories array<string>, acceptance double, reject_rate double")
    got = {}
    for r in P.retrieve_topk(b.where("id >= 30"), b, max_df=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    assert got == {i: {1: i ^ 1, 2: 0, 3: 1} for i in range(30, 40)}

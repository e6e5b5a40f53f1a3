"""Literal cases of scalars, joins, aggregates, merges and sources."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from momentra.operators import aggregates as A
from momentra.operators import joins as J
from momentra.operators import merges as M
from momentra.operators import scalars as S
from momentra.operators import similarity as D
from momentra.operators import windows as W
from momentra.sources import files


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_band_gap_gives_zero(spark):
    w = spark.createDataFrame([(80.0, 100.0, 30.0, 5.0), (50.0, 79.99, 20.0, 10.0)], "lo double, hi double, window_sec double, step_sec double")
    x = spark.createDataFrame([(79.995,), (80.0,), (79.99,), (10.0,)], "score double")
    assert rows(S.score_window(x, w), "score", "window_sec") == [(10.0, 0.0), (79.99, 20.0), (79.995, 0.0), (80.0, 30.0)]


def test_zero_duration_has_no_zone(spark):
    x = spark.createDataFrame([(5.0, 0.0), (80.0, 100.0), (25.0, 100.0), (50.0, 100.0)], "timestamp_sec double, duration_sec double")
    assert [r[0] for r in S.zone_tags(x).select("zone_tags").collect()] == [[], ["late"], ["build"], ["build"]]


def test_phase_thresholds(spark):
    data = [("a", {"scan": 110.0, "cluster": 40.0, "output": 20.0}), ("b", {"scan": 160.0, "cluster": 60.0, "output": 30.0}), ("c", {"scan": 220.0, "cluster": 80.0, "output": 50.0})]
    x = A.phase_thresholds(spark.createDataFrame(data, "job_id string, phases map<string, double>"), 3)
    assert tuple(x.where("phase = 'scan'").select("n", "p50", "p75", "p90", "max_sec").first()) == (3, 160.0, 190.0, 208.0, 220.0)


def test_decision_mix(spark):
    x = spark.createDataFrame([("s", "keep", 88.0, 70.0), ("s", "reject", 42.0, 52.0)], "scene_id string, decision string, score_100 double, model_score double")
    assert tuple(A.decision_mix(x).select("rows", "pairs_possible", "mae").first()) == (2, 1, 14.0)


def test_preference_pairs_cap(spark):
    x = spark.createDataFrame([("s", i, 2 if i % 2 else 0, 50.0) for i in range(6)], "scene_id string, idx long, rank int, score double")
    assert J.preference_pairs(x).count() == 9
    assert J.preference_pairs(x, 3).count() == 3


def test_latest_status(spark):
    data = [("e1", "s", "Alpha", "submitted", dt.datetime(2024, 1, 1)), ("e2", "s", "alpha ", "published", dt.datetime(2024, 1, 2))]
    x = spark.createDataFrame(data, "event_id string, scene_id string, channel string, status string, ts timestamp")
    assert rows(W.latest_status(x), "scene_id", "channel", "status", "events") == [("s", "alpha", "published", 2)]


CHANNELS = "channel string, title_min int, title_max int, desc_min int, desc_max int, min_tags int, max_tags int, min_categories int, max_categories int, banned_terms array<string>, requires_identity_record boolean, requires_individual_releases boolean, min_width int, min_height int"


def test_channel_validate_ready_with_a_warning(spark):
    rules = spark.createDataFrame([("alpha", 20, 90, 0, 900, 5, 20, 1, 8, ["nope"], True, True, 0, 0)], CHANNELS)
    meta = spark.createDataFrame([("s", "A title of over twenty letters", "text", [f"t{i}" for i in range(12)], [f"c{i}" for i in range(5)], ["f"], True, 1280, 720, 18), ("u", "A title of over twenty letters", "text", [f"t{i}" for i in range(12)], ["c"], [], None, 1280, 720, 18)], "scene_id string, title string, description string, tags array<string>, categories array<string>, flags array<string>, records_ok boolean, width int, height int, picks int")
    got = {r["scene_id"]: r for r in J.channel_validate(meta, rules).collect()}
    assert got["s"]["ready"] and got["s"]["overall_ready"] and got["s"]["warnings"] == ["flagged"]
    assert not got["u"]["ready"] and got["u"]["blockers"] == ["no_records"]


def test_records_fail_closed(spark):
    rules = spark.createDataFrame([("alpha", True, True)], "channel string, requires_identity_record boolean, requires_individual_releases boolean")
    d = dt.date
    docs = [("a", "release", "p", [], d(2030, 1, 1)), ("a", "identity", "q", [], d(2030, 1, 1)), ("b", "release", "p", ["alpha"], d(2020, 1, 1)), ("b", "identity", "q", [], d(2030, 1, 1)), ("c", "release", "p", [], None)]
    docs = spark.createDataFrame(docs, "contributor_key string, document_type string, path string, channels array<string>, expiry_date date")
    scenes = spark.createDataFrame([("ok", ["a"]), ("expired", ["b"]), ("one_missing", ["a", "x"]), ("undated", ["c"]), ("nobody", [])], "scene_id string, contributor_keys array<string>")
    strict = dict(rows(J.records_ready(scenes, docs, rules, "2025-01-01"), "scene_id", "ready"))
    assert strict == {"ok": True, "expired": False, "one_missing": False, "undated": False, "nobody": False}
    loose = dict(rows(J.records_ready(scenes, docs, rules, "2025-01-01", mode="reference"), "scene_id", "ready"))
    assert loose["one_missing"] and not loose["expired"]


def test_record_presence_blocks(spark):
    x = spark.createDataFrame([("/a/identity_record.pdf",), ("/b/Identity_Record.PDF",), ("/c/my-identity-record-2.pdf",), ("/d/clip.mp4",)], "path string")
    assert rows(files.record_presence(x), "folder", "found", "blocked") == [("/a", "exact", False), ("/b", "case", False), ("/c", "pattern", False), ("/d", "none", True)]


def test_unparsed_times(spark):
    x = spark.createDataFrame([("2024-01-09T00:00:00Z",), ("2023-01-01",), ("soon",), (None,)], "t string")
    assert S.time_window_filter(x, "t", 30, "2024-01-10", True).count() == 3
    assert S.time_window_filter(x, "t", 30, "2024-01-10", False).count() == 1


def test_parse_response(spark):
    x = spark.createDataFrame([("s", 1, True, "SCORE: 88\nLABEL: wide-shot\nCONFIDENCE: 1.7\nBONUS: b1, B1, b2"), ("s", 2, True, "FAIL: blocked"), ("s", 3, False, "SCORE: 3"), ("s", 4, True, None)], "scene_id string, obs_id long, ok boolean, raw_text string")
    got = {r["obs_id"]: r for r in S.parse_response(x, ["BLOCKED"]).collect()}
    assert (got[1]["score"], got[1]["label"], got[1]["label_confidence"], got[1]["bonus_codes"]) == (88.0, "WIDE_SHOT", 1.0, ["B1", "B2"])
    assert (got[2]["score"], got[2]["parse_succeeded"], got[2]["gate_pass"]) == (0.0, True, False)
    assert not got[3]["parse_succeeded"] and not got[4]["parse_succeeded"] and got[4]["label"] == "OTHER"


def test_tokens_first_spelling_wins(spark):
    x = spark.createDataFrame([("Red , red; BLUE\nred|Blue  Sky",), (None,)], "t string")
    assert [r[0] for r in S.parse_tokens(x, "t").select("tokens").collect()] == [["Red", "BLUE", "Blue Sky"], []]


def test_norm_score_quirk(spark):
    x = spark.createDataFrame([(8.0,), (55.0,), (101.0,), (-1.0,), (None,)], "v double")
    assert [r[0] for r in S.norm_score(x, "v").select("score_100").collect()] == [80.0, 55.0, None, None, None]
    assert S.norm_score(x, "v", False).first()["score_100"] == 8.0


def test_bank_refresh_and_acceptance(spark):
    x = spark.createDataFrame([("edited", True, 0)], "acceptance_label string, ready boolean, blockers int")
    assert S.acceptance_score(x).first()["acceptance"] == 0.75
    cols = "id long, is_seed boolean, title string, description string, category string, acceptance double, reject_rate double"
    bank = spark.createDataFrame([(1, True, "", "", "", 0.0, 0.0)], cols)
    new = spark.createDataFrame([(2, False, "t", "d", "c", 0.75, 0.0), (3, False, "t", " ", "c", 0.75, 0.0), (4, False, "t", "d", "c", 0.1, 0.0)], cols)
    assert rows(M.bank_refresh(bank, new), "id") == [(1,), (2,)]


def test_rule_kpis_cohorts(spark):
    x = spark.createDataFrame([("candidate", "a", 0.1, None, True, True, 1, 3, 0.5), ("baseline", "b", 3.0, 0.2, False, True, 0, 3, 0.5)], "cohort string, scene_id string, title_edit double, description_edit double, accepted boolean, ready boolean, severity int, n_titles int, title_diversity double")
    got = {r["cohort"]: r for r in A.rule_kpis(x).collect()}
    assert got["candidate"]["scene_count"] == 1 and got["candidate"]["median_description_edit"] == 0.25 and got["baseline"]["median_title_edit"] == 1.0


def test_pointer_moves_only_when_gates_pass(spark):
    p = spark.createDataFrame([(dt.datetime(2024, 1, 1), "k1", "canary_5", True)], "updated_at timestamp, rule_pack_id string, stage string, enabled boolean")
    run = lambda ok: spark.createDataFrame([(dt.datetime(2024, 1, 2), 1, "k1", ok)], "created_at timestamp, run_id long, rule_pack_id string, gates_pass boolean")
    assert M.pointer_update(p, run(False), "promote", "2024-02-01").count() == 1
    assert ("canary_25", True) in rows(M.pointer_update(p, run(True), "promote", "2024-02-01"), "stage", "enabled")
    assert ("off", False) in rows(M.pointer_update(p, run(True), "rollback", "2024-02-01"), "stage", "enabled")


def test_splits_are_disjoint_by_scene(spark):
    x = spark.createDataFrame([(f"s{i % 50}", f"f{i}", f"x{i}") for i in range(500)], "scene_id string, filename string, sample_id string")
    s = D.hash_split(x)
    assert s.select("scene_id", "split").distinct().count() == 50
    assert D.split_of(F.lit("a")) is not None


def test_pass_streak(spark):
    x = spark.createDataFrame([("a", 1, 1, False), ("a", 2, 2, True), ("a", 3, 3, True), ("b", 1, 1, True), ("c", 1, 1, False)], "pack_id string, created_at long, run_id long, gates_pass boolean")
    assert rows(W.pass_streak(x), "pack_id", "streak") == [("a", 2), ("b", 1), ("c", 0)]


def test_drop_counters_add_up(spark):
    x = spark.createDataFrame([("s", i, (i % 7) / 10, float(i * 9), float(i % 6), float(i), i // 20 * 4095 if i != 59 else None) for i in range(60)], "scene_id string, obs_id long, brightness double, sharpness double, motion double, timestamp_sec double, phash long").withColumn("floor", F.lit(100.0))
    got = {r["drop_reason"]: r["n"] for r in S.sieve_counts(S.obs_sieve(x), []).collect()}
    assert sum(got.values()) == 60 and set(got) == {"dark", "below_floor", "high_motion", "duplicate", "passed"} and got["passed"] <= 4


def test_call_percentiles_round_half_even(spark):
    x = spark.createDataFrame([("m", float(v)) for v in (10, 20, 30, 40, 50, 60)], "mode string, ms double")
    assert tuple(A.call_percentiles(x).select("p50", "p95").first()) == (30.0, 60.0)  # index round(2.5) = 2


def test_ledger_skips_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"event_id": "1", "n": 2}\n\n{broken\n{"event_id": "2", "n": 3}\n')
    assert rows(files.read_ledger(spark, str(tmp_path), "event_id string, n long"), "event_id", "n") == [("1", 2), ("2", 3)]


def test_label_csv_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Scene ID,Score,Verdict,Tag\ns1,88,Keep,\"a, b\"\n")
    x = files.read_label_csv(spark, str(tmp_path))
    assert rows(x, "scene_id", "operator_score", "decision", "tags") == [("s1", "88", "Keep", "a, b")]
    got = D.import_labels(x.withColumn("filename", F.lit("f")), 0.0).first()
    assert (got["decision"], got["score_100"], got["tags_list"]) == ("keep", 88.0, ["a", "b"])


def test_inventory_and_sums(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x" * 2000)
    (tmp_path / "b.mp4").write_bytes(b"x")
    (tmp_path / "_work").mkdir()
    (tmp_path / "_work" / "c.mp4").write_bytes(b"x" * 2000)
    assert files.asset_inventory(spark, str(tmp_path), min_bytes=1000).count() == 1
    assert files.checksum_manifest(spark, str(tmp_path)).where("length = 1").first()["sha256"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_canary_takes_the_latest_pointer(spark):
    rows = [("2024-02-01", True, "full", "new", 0.0), ("2024-01-01", True, "full", "old", 0.0)]
    p = spark.createDataFrame(rows, "updated_at string, enabled boolean, mode string, rule_pack_id string, canary_pct double")
    scenes = spark.createDataFrame([("a",), ("b",)], "scene_id string")
    assert {r["applied_pack"] for r in J.canary_assign(scenes, p.repartition(2)).collect()} == {"new"}
    assert {r["applied_pack"] for r in J.canary_assign(scenes, p.where("false")).collect()} == {None}


def test_few_reviews_give_the_default(spark):
    x = spark.createDataFrame([("a title", ["t"])], "title string, tags array<string>")
    assert [tuple(r) for r in A.phrase_mining(x).collect()] == [("default", "", 1, 1)]


def test_ranks_of_a_key_over_many_tasks(spark):
    """One key lies over all tasks, several lie in one; the ranks equal those of the sorted values."""
    rng = random.Random(4)
    data = [("hot", rng.randrange(5_000) / 8) for _ in range(20_000)] + [(k, float(rng.randrange(50))) for k in ("a", "b", None) for _ in range(rng.randint(1, 300))] + [("hot", None), ("none", None)]
    x = spark.createDataFrame(data, "k string, v double").repartition(7)
    ranks = {"first": lambda n: F.lit(0), "mid": lambda n: F.floor((n - 1) / 2), "last": lambda n: n - 1, "late": lambda n: F.floor((n - 1) * 0.9)}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r["k"]: tuple(r)[1:] for r in A.values_at(x, "k", "v", ranks).collect()}
        counts = x.where("v is not null").groupBy("k", "v").count()
        spread = counts.repartitionByRange(16, "k", "v").where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for k in {k for k, v in data if v is not None}:
        v = sorted(v for key, v in data if key == k and v is not None)
        want[k] = (len(v), v[0], v[-1], v[0], v[(len(v) - 1) // 2], v[-1], v[int((len(v) - 1) * 0.9)])
    assert got == want and spread > 8


def test_capped_pairs_are_drawn_not_made(spark):
    """Up to four pairs a pair wanted: the ones of least hash of all. Beyond, a million points make no quadratic join."""
    data = [(f"s{s}", i, i % 3 if i % 4 else None, float(i % 5)) for s, n in enumerate((1, 2, 7, 12)) for i in range(n)]
    x = spark.createDataFrame(data, "scene_id string, idx long, rank int, score double")
    w = Window.partitionBy("scene_id").orderBy(F.xxhash64("scene_id", "better", "worse"), "better", "worse")
    least = J.preference_pairs(x).withColumn("n", F.row_number().over(w)).where("n <= 20").drop("n")
    assert rows(J.preference_pairs(x, 20), "scene_id", "better", "worse", "by") == rows(least, "scene_id", "better", "worse", "by")
    big = spark.range(1_000_000).select(F.lit("s").alias("scene_id"), F.col("id").alias("idx"), F.lit(None).cast("int").alias("rank"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("score"))
    got = J.preference_pairs(big, 1000)
    found = got.join(big.select(F.col("idx").alias("better"), F.col("score").alias("x")), "better").join(big.select(F.col("idx").alias("worse"), F.col("score").alias("y")), "worse")
    assert got.count() == 1000 and found.where("x > y").count() == 1000 and got.distinct().count() == 1000
    assert got.select(F.max("better")).first()[0] > 900_000 and got.select(F.min("better")).first()[0] < 100_000


def test_offsets_round_halves_upwards_below_zero(spark):
    """9.5 - 10 is the second 0, as 0.4 is; the second before it holds nothing."""
    data = [("s", 1, 9.5, 10.0), ("s", 2, 0.4, 300.0), ("t", 3, 4.5, 10.0), ("t", 4, 0.0, 400.0), ("u", 5, 9.4, 10.0), ("u", 6, 0.0, 500.0)]
    x = spark.createDataFrame(data, "scene_id string, obs_id long, timestamp_sec double, sharpness double")
    picks = x.where("sharpness < 100")
    assert rows(J.nearest_clearing_floor(picks, x, [-10.0, -5.0], 200.0), "obs_id", "near_id", "dt") == [(1, 2, -10.0), (3, 4, -5.0), (5, None, None)]
    assert rows(J.nearest_better(picks, x, [-10.0, -5.0]), "obs_id", "better_id") == [(1, 2), (3, 4), (5, None)]


def test_documents_are_written_in_tasks(spark, tmp_path):
    """Every document is a file of its own in its folder; broken ones are skipped and the compact form has few files."""
    docs = spark.range(1500).selectExpr("concat('d-', id div 500) as folder", "concat(id, '.json') as name", "if(id % 5 = 0, '{', concat('{\\n\"scene_id\": \"', id, '\"\\n}')) as value")
    path = f"file://{tmp_path}/docs"
    assert files.write_docs(docs, path) == 1500 and len(list((tmp_path / "docs").glob("d-*/*.json"))) == 1500
    got = files.read_scene_docs(spark, f"{path}/d-*", "scene_id string", f"file://{tmp_path}/compact")
    assert sorted(int(r["scene_id"]) for r in got.collect()) == [i for i in range(1500) if i % 5]
    assert files.write_docs(docs.limit(0), f"file://{tmp_path}/none") == 0

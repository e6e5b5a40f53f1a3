"""Streams give what the batch forms give on ordered input; repeated and late rows are told apart."""

import json
import os
import random

from pyspark.sql import functions as F

from momentra.streaming import feeds
from momentra.streaming.run import run_available

EVENTS = "event_id string, scene_id string, channel string, status string, ts timestamp"


def stream(spark, path, schema):
    return spark.readStream.schema(schema).json(str(path))


def test_status_counts_an_event_once(spark, tmp_path):
    one = {"event_id": "e1", "scene_id": "s", "channel": "A", "status": "submitted", "ts": "2024-01-01T00:00:00Z"}
    two = {**one, "event_id": "e2", "status": "published", "ts": "2024-01-01T01:00:00Z"}
    (tmp_path / "a.json").write_text("\n".join(json.dumps(x) for x in (one, two, one)))
    got = run_available(feeds.stream_status(stream(spark, tmp_path, EVENTS)), "complete").collect()
    assert [(r["status"], r["events"]) for r in got] == [("published", 2)]


OBS = "scene_id string, obs_id long, timestamp_sec double, sharpness double, brightness double, motion double, phash long"


def test_sieve_stream_equals_batch(spark, tmp_path):
    data = [{"scene_id": f"s{i % 2}", "obs_id": i, "timestamp_sec": float(i), "sharpness": 40.0 + (i * 37 % 100), "brightness": 0.05 if i % 11 == 0 else 0.5, "motion": 1.0, "phash": (i * 2654435761) % 2**31} for i in range(150)]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, data)))
    s = run_available(feeds.stream_sieve(stream(spark, tmp_path, OBS)))
    b = feeds.stream_sieve(spark.read.schema(OBS).json(str(tmp_path)))
    key = lambda df: sorted((r["obs_id"], r["verdict"], r["floor"]) for r in df.collect())
    assert key(s) == key(b)
    assert {r["verdict"] for r in b.collect()} >= {"dark", "below_floor", "kept"}


def test_sieve_goes_on_after_a_stop(spark, tmp_path):
    """Many micro-batches, a stop and a restart from the checkpoint, lists cut several times: equal to the batch form."""
    rng = random.Random(3)
    row = lambda i: json.dumps({"scene_id": f"s{i % 3}", "obs_id": i, "timestamp_sec": float(i // 2), "sharpness": rng.choice([30.0, 60.0, 80.0, 90.0]) + rng.random(), "brightness": 0.05 if i % 11 == 0 else 0.5, "motion": 5.0 if i % 13 == 0 else 1.0, "phash": rng.randrange(40) * 2**30 + rng.randrange(2)})
    parts = [[row(i) for i in range(at, at + 60)] for at in range(0, 720, 60)]
    inbox = tmp_path / "in"
    inbox.mkdir()
    x = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).json(str(inbox))
    sieve = lambda df: feeds.stream_sieve(df, state_rows=40, state_hashes=9)
    for run, batches in enumerate((parts[:7], parts[7:])):
        for i, lines in enumerate(batches):
            (inbox / f"{run}{i:02}.json").write_text("\n".join(lines))
            os.utime(inbox / f"{run}{i:02}.json", (1_000_000_000 + 1000 * run + 10 * i,) * 2)
        got = run_available(sieve(x), base=f"file://{tmp_path}/base")
    key = lambda df: sorted((r["obs_id"], r["verdict"], r["floor"]) for r in df.collect())
    want = key(sieve(spark.read.schema(OBS).json(str(inbox))))
    assert key(got) == want and len(want) == 720
    assert {v for _, v, _ in want} == {"dark", "below_floor", "high_motion", "duplicate", "kept"}


def test_sieve_forgets_idle_scenes(spark, tmp_path):
    row = lambda i, scene, day: json.dumps({"scene_id": scene, "obs_id": i, "timestamp_sec": 1.0, "sharpness": 90.0, "brightness": 0.5, "motion": 1.0, "phash": 7, "at": f"2024-01-{day:02}T00:00:00Z"})
    x = spark.readStream.schema(OBS + ", at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    for n, (scene, day) in enumerate([("a", 1), ("a", 1), ("b", 5), ("b", 6), ("a", 7)]):
        (tmp_path / f"{n}.json").write_text(row(n, scene, day))
        os.utime(tmp_path / f"{n}.json", (1_000_000_000 + n,) * 2)
    got = {r["obs_id"]: r["verdict"] for r in run_available(feeds.stream_sieve(x, event_time="at")).collect()}
    assert got == {0: "kept", 1: "duplicate", 2: "kept", 3: "duplicate", 4: "kept"}


def test_sieve_with_a_time_to_live_and_odd_rows(spark, tmp_path):
    rows = [{"scene_id": None, "obs_id": 1, "timestamp_sec": 1.0, "sharpness": 90.0, "phash": 5}, {"scene_id": None, "obs_id": 2, "timestamp_sec": 1.0, "sharpness": 90.0, "phash": 5}, {"scene_id": "s", "obs_id": 3, "timestamp_sec": 1.0, "phash": 5}, {"scene_id": "s", "obs_id": 4, "sharpness": 90.0, "phash": 5}, {"scene_id": "s", "obs_id": 5}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    s = run_available(feeds.stream_sieve(stream(spark, tmp_path, OBS), ttl_ms=60_000), no_data=False)
    b = feeds.stream_sieve(spark.read.schema(OBS).json(str(tmp_path)))
    assert [{r["obs_id"]: r["verdict"] for r in df.collect()} for df in (s, b)] == [{1: "kept", 2: "duplicate"}] * 2


def test_sieve_flags_late_rows(spark, tmp_path):
    row = lambda i, t: json.dumps({"scene_id": "s", "obs_id": i, "timestamp_sec": t, "sharpness": 90.0, "brightness": 0.5, "motion": 1.0, "phash": i * 1023})
    (tmp_path / "a.json").write_text(row(1, 10.0))
    (tmp_path / "b.json").write_text(row(2, 5.0))
    x = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    got = {r["obs_id"]: r["verdict"] for r in run_available(feeds.stream_sieve(x)).collect()}
    assert sorted(got.values()) == ["kept", "late"]


def test_sieve_with_event_time_ends(spark, tmp_path):
    row = lambda i: json.dumps({"scene_id": "s", "obs_id": i, "timestamp_sec": float(i), "sharpness": 90.0, "brightness": 0.5, "motion": 1.0, "phash": i * 1023, "at": f"2024-01-0{i}T00:00:00Z"})
    (tmp_path / "a.json").write_text("\n".join(map(row, (1, 2, 3))))
    x = spark.readStream.schema(OBS + ", at timestamp").json(str(tmp_path))
    assert run_available(feeds.stream_sieve(x, event_time="at")).count() == 3


def test_feedback_mix(spark):
    x = spark.createDataFrame([("s", "KEEP"), ("s", "keep "), ("s", "odd"), ("s", None)], "scene_id string, decision string")
    assert {(r["decision"], r["n"]) for r in feeds.stream_feedback_mix(x).collect()} == {("keep", 2), ("other", 2)}


def test_windows_drop_nothing_in_batch(spark):
    x = spark.createDataFrame([("2024-01-01 00:10:00", "a", 2.0), ("2024-01-01 00:50:00", "a", 4.0), ("2024-01-01 01:10:00", "a", 0.0)], "t string, phase string, sec double").withColumn("ts", F.col("t").cast("timestamp"))
    assert [(r["n"], r["avg_sec"]) for r in feeds.stream_phase_windows(x).collect()] == [(2, 3.0)]

"""Window operators: runs, sections, rolling floors, streaks and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY_TIME = ("timestamp_sec", "obs_id")


def _scene(*order) -> Window:
    return Window.partitionBy("scene_id").orderBy(*(order or BY_TIME))


def _with_run(obs: DataFrame, gap_sec: float) -> DataFrame:
    """obs with run, counted up where the label changes or the time since the last row is over gap_sec."""
    w = _scene()
    new = F.lag("label").over(w).isNull() | (F.lag("label").over(w) != F.col("label")) | (F.col("timestamp_sec") - F.lag("timestamp_sec").over(w) > gap_sec)
    return obs.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("run", F.sum("_new").over(w)).drop("_new")


def label_runs(obs: DataFrame, gap_sec: float = 120.0, min_conf: float = 0.45) -> DataFrame:
    """Runs of one label: rows under min_conf go first, then a new run begins on a new label or a gap over gap_sec.

    -> (scene_id, run, label, label_run, start_sec, end_sec, n): label_run numbers a label's runs.
    """
    x = _with_run(obs.where(F.col("label_confidence") >= min_conf), gap_sec)
    runs = x.groupBy("scene_id", "run", "label").agg(F.min("timestamp_sec").alias("start_sec"), F.max("timestamp_sec").alias("end_sec"), F.count(F.lit(1)).alias("n"))
    return runs.withColumn("label_run", F.dense_rank().over(Window.partitionBy("scene_id", "label").orderBy("run")))


def semantic_sections(obs: DataFrame, gap_sec: float = 75.0, pad: float = 2.0, top: int = 80) -> DataFrame:
    """Sections of one label, padded (start at 0 at least, a second long at least), the first `top` a scene."""
    x = _with_run(obs, gap_sec)
    s = x.groupBy("scene_id", "run", "label").agg(
        F.min("timestamp_sec").alias("t0"), F.max("timestamp_sec").alias("t1"), F.count(F.lit(1)).alias("n"), F.avg("score").alias("s"), F.round(F.avg("motion"), 5).alias("avg_motion"), F.avg("label_confidence").alias("c"),
        F.max_by("timestamp_sec", F.struct("score", -F.col("timestamp_sec"), -F.col("obs_id"))).alias("thumb_sec"),
    )
    start = F.greatest(F.lit(0.0), F.col("t0") - pad)
    end = F.greatest(start + 1, F.col("t1") + pad)
    out = s.select(
        "scene_id", "label", F.round(start, 3).alias("start_sec"), F.round(end, 3).alias("end_sec"), "n", F.round("s", 4).alias("avg_score"),
        "avg_motion", F.round(F.greatest("c", F.col("s") / 100), 6).alias("confidence"), "thumb_sec", "run"
    )
    return out.withColumn("section", F.row_number().over(Window.partitionBy("scene_id").orderBy("run"))).where(F.col("section") <= top).drop("run")


def rolling_floor(obs: DataFrame, rows: int = 200, pct: float = 0.1, min_rows: int = 30, bootstrap: float = 25.0, minimum: float = 50.0, dark: float = 0.1) -> DataFrame:
    """floor: the linear percentile of the last `rows` values that are not dark, once there are min_rows (else bootstrap), at least minimum."""
    x = obs.where(F.col("brightness") >= dark)
    w = _scene().rowsBetween(1 - rows, 0)
    floor = F.when(F.count("sharpness").over(w) >= min_rows, F.percentile("sharpness", pct).over(w)).otherwise(bootstrap)
    return x.withColumn("floor", F.round(F.greatest(F.lit(minimum), floor), 4))


def motion_delta(obs: DataFrame, vec_col: str, keep: Column, scale: float = 32.0) -> DataFrame:
    """Kept rows with motion: the mean absolute difference of their vector to the last kept row's, over scale; null at the first."""
    x = obs.where(keep).withColumn("_last", F.lag(vec_col).over(_scene()))
    total = F.aggregate(F.zip_with(vec_col, "_last", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return x.withColumn("motion", total / F.size(vec_col) / scale).drop("_last")


def signature(df: DataFrame, vec_col: str, bits: int = 63) -> DataFrame:
    """hash: bit i is whether element i + 1 is larger than element i."""
    at = F.sequence(F.lit(1), F.least(F.lit(bits), F.size(vec_col) - 1))
    fold = F.aggregate(
        at, F.lit(0).cast("long"),
        lambda h, i: F.when(
            F.element_at(vec_col, i + 1) > F.element_at(vec_col, i), h.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i - 1))
        ).otherwise(h)
    )
    return df.withColumn("hash", fold)


def chapters(items: DataFrame) -> DataFrame:
    """items (group_id, position, duration_sec) with start_sec, the sum of the durations before."""
    w = Window.partitionBy("group_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("start_sec", F.round(F.coalesce(F.sum("duration_sec").over(w), F.lit(0.0)), 3))


def spec_compat(items: DataFrame, fps_tol: float = 0.1) -> DataFrame:
    """items (group_id, position, fps, resolution, codec) with issues against the group's first item."""
    w = Window.partitionBy("group_id").orderBy("position")
    first = lambda c: F.first(c).over(w)
    issues = F.array(
        F.when(F.abs(F.col("fps") - first("fps")) > fps_tol, F.lit("fps")), F.when(F.col("resolution") != first("resolution"), F.lit("resolution")),
        F.when(F.col("codec") != first("codec"), F.lit("codec"))
    )
    return items.withColumn("issues", F.filter(issues, lambda x: x.isNotNull()))


def trend_verdict(batches: DataFrame, n: int = 5) -> DataFrame:
    """batches (lane, batch_id, avg_sec) with the mean of the n before, the change in percent and a verdict."""
    w = Window.partitionBy("lane").orderBy("batch_id").rowsBetween(-n, -1)
    x = batches.withColumns({"_n": F.count("batch_id").over(w), "baseline": F.avg("avg_sec").over(w)})
    pct = F.when(F.col("baseline") > 0, (F.col("avg_sec") - F.col("baseline")) / F.col("baseline") * 100)
    verdict = F.when(F.col("_n") == 0, "first").when(F.col("pct").isNull(), "no_baseline").when(F.col("pct") < -10, "faster").when(F.col("pct") > 25, "much_slower").when(F.col("pct") > 10, "slower").otherwise("stable")
    return x.withColumn("pct", pct).withColumn("verdict", verdict).withColumns({"baseline": F.round("baseline", 4), "pct": F.round("pct", 2)}).drop("_n")


def trend_split(batches: DataFrame, n: int = 5) -> DataFrame:
    """Means of the latest n batches of each lane and of the n before."""
    x = batches.withColumn("_n", F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("batch_id")))).where(F.col("_n") <= 2 * n)
    mean = lambda c: F.round(F.avg(F.when(c, F.col("avg_sec"))), 4)
    return x.groupBy("lane").agg(mean(F.col("_n") <= n).alias("recent"), mean(F.col("_n") > n).alias("previous"), F.count(F.lit(1)).alias("batches"))


def pass_streak(runs: DataFrame) -> DataFrame:
    """runs (pack_id, created_at, run_id, gates_pass) -> per pack the passing runs in a row, newest first."""
    x = runs.withColumn("_n", F.row_number().over(Window.partitionBy("pack_id").orderBy(F.desc("created_at"), F.desc("run_id"))))
    return x.groupBy("pack_id").agg((F.coalesce(F.min(F.when(~F.col("gates_pass"), F.col("_n"))), F.count(F.lit(1)) + 1) - 1).alias("streak"))


def latest_status(events: DataFrame) -> DataFrame:
    """events (scene_id, channel, status, ts, event_id) -> the last status of each scene and channel, and its events."""
    last = F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id"))
    x = events.groupBy("scene_id", F.lower(F.trim("channel")).alias("channel")).agg(last.alias("l"), F.count(F.lit(1)).alias("events"))
    return x.select("scene_id", "channel", "l.status", "l.ts", "events")


def even_samples(scenes: DataFrame, n: int, max_duration: float | None = None) -> DataFrame:
    """scenes (scene_id, duration_sec) -> n evenly spaced timestamps, the middles of n equal parts."""
    d = F.col("duration_sec") if max_duration is None else F.least("duration_sec", F.lit(float(max_duration)))
    return scenes.where("duration_sec > 0").select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), d.alias("_d")).select(
        "scene_id", "i", F.round((F.col("i") + 0.5) * F.col("_d") / n, 3).alias("timestamp_sec")
    )


def segments(obs: DataFrame, scenes: DataFrame, k: int, min_duration: float = 1800.0) -> DataFrame:
    """obs with segment_idx of k equal parts of its scene (k at most 16; one part for short scenes)."""
    parts = F.when(F.col("duration_sec") >= min_duration, F.lit(min(k, 16))).otherwise(1)
    at = F.floor(F.col("timestamp_sec") / (F.col("duration_sec") / parts))
    x = obs.join(scenes.select("scene_id", "duration_sec"), "scene_id")
    return x.withColumn("segment_idx", F.when(F.col("duration_sec") > 0, F.least(parts - 1, at)).otherwise(0).cast("int")).drop("duration_sec")


def activity_curve(obs: DataFrame, limit: int = 1200) -> DataFrame:
    return obs.withColumn("point", F.row_number().over(_scene())).where(F.col("point") <= limit).select("scene_id", "point", "timestamp_sec", "score", "motion")

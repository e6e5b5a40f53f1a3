"""Aggregations: rollups, rates, gates and the three percentile definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentra.functions import columns as C
from momentra.functions.shared import cut


def _share(hit: Column, of: Column, places: int = 1) -> Column:
    """100 * hits / cases, 0 without a case."""
    n = F.count_if(of)
    return F.round(F.when(n > 0, F.count_if(of & hit) * 100.0 / n).otherwise(0.0), places)


def log_rollup(logs: DataFrame, min_picks: int = 10) -> DataFrame:
    """logs (source, picks, top_score, duration_sec, error_codes) -> one row a source and one for all (source null)."""
    out = logs.rollup("source").agg(
        F.grouping("source").cast("int").alias("is_total"), F.count(F.lit(1)).alias("scenes"), F.sum("picks").alias("picks"),
        F.round(F.avg(F.when(F.col("top_score") > 0, F.col("top_score"))), 2).alias("avg_score"), F.round(F.avg("duration_sec"), 2).alias("avg_duration"),
        _share(F.col("picks") >= min_picks, F.lit(True)).alias("pct_enough"), F.count_if(F.exists("error_codes", lambda e: F.contains(e, F.lit("TIMEOUT")))).alias("timeouts"),
    )
    return out


def _frequency(logs: DataFrame, col: str, name: str) -> DataFrame:
    return logs.select(F.explode(col).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)


def error_frequency(logs: DataFrame) -> DataFrame:
    return _frequency(logs, "error_codes", "code")


def fallback_usage(logs: DataFrame) -> DataFrame:
    return _frequency(logs, "fallbacks", "fallback")


def values_at(df: DataFrame, key: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(key, n, least, most, and for each name the value at a rank from 0 that is a function of n), over values that aren't null.

    Exact selection without a key's values in one task: rows are counted by value, the counts range-partitioned by
    (key, value), so that a key of many values lies over many tasks; each task's sum for each of its keys, a row a task and
    key, gives the offset at which the key goes on in the next task, and ranks are picked from offset and running sum.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(counts.repartitionByRange(parts, key, "_v").withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part", key).agg(F.sum("_c").alias("_s"))
    of_key = Window.partitionBy(key)
    before = F.coalesce(F.sum("_s").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(sums.select("_part", F.col(key).alias("_k"), before.alias("_before"), F.sum("_s").over(of_key).alias("_n")))
    here = F.sum("_c").over(Window.partitionBy("_part", key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    x = placed.join(offsets.withColumnRenamed("_part", "_p"), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    x = x.withColumn("_upto", F.col("_before") + here)
    first = lambda rank: (F.col("_upto") > rank(F.col("_n"))) & (F.col("_upto") - F.col("_c") <= rank(F.col("_n")))
    at = [F.min(F.when(first(rank), F.col("_v"))).alias(name) for name, rank in ranks.items()]
    return x.groupBy(key).agg(F.first("_n").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), *at)


def _around(shares: dict[str, float]) -> dict[str, Callable[[Column], Column]]:
    """Ranks of linear percentiles: the two values around place (n - 1) * share."""
    place = lambda p: lambda n: (n - 1) * F.lit(p)
    below = {f"{a}_low": lambda n, p=p: F.floor(place(p)(n)) for a, p in shares.items()}
    return {**below, **{f"{a}_high": lambda n, p=p: F.ceil(place(p)(n)) for a, p in shares.items()}}


def _linear(name: str, share: float) -> Column:
    part = (F.col("n") - 1) * F.lit(share) - F.floor((F.col("n") - 1) * F.lit(share))
    return F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * part


def phase_thresholds(timings: DataFrame, min_samples: int = 5) -> DataFrame:
    """timings (phases map) -> per phase of min_samples positive times: n, p50, p75, p90 (linear), max; slowest p75 first."""
    x = timings.select(F.explode("phases").alias("phase", "sec")).where("sec > 0")
    pcts = {"p50": 0.5, "p75": 0.75, "p90": 0.9}
    out = values_at(x, "phase", "sec", _around(pcts)).where(F.col("n") >= min_samples)
    return out.select("phase", "n", *[F.round(_linear(a, p), 1).alias(a) for a, p in pcts.items()], F.round("most", 1).alias("max_sec")).orderBy(F.desc("p75"), "phase")


def slowest_phases(timings: DataFrame, top_n: int = 5) -> DataFrame:
    x = timings.select(F.explode("phases").alias("phase", "sec")).where("sec > 0")
    return x.groupBy("phase").agg(
        F.round(F.avg("sec"), 2).alias("avg_sec"), F.max("sec").alias("max_sec"), F.count(F.lit(1)).alias("n")
    ).orderBy(F.desc("avg_sec"), "phase").limit(top_n)


def calibrate_scene(obs: DataFrame, pcts: tuple[int, int, int] = (75, 50, 25), hard_floors: tuple[float, ...] = (100.0, 50.0, 25.0)) -> DataFrame:
    """Per scene three sharpness floors: nearest ranks at int(n * p / 100), each at least its hard floor.

    no_variation: max - min under 50; all_blurry: the first rank under the first hard floor. Scenes without a value
    have the first hard floor three times.
    """
    floor_rank = lambda p: lambda n: F.least(n - 1, F.floor(n * F.lit(p / 100)))
    at = values_at(obs, "scene_id", "sharpness", {f"r{i}": floor_rank(p) for i, p in enumerate(pcts)})
    x = obs.select("scene_id").distinct().join(at, "scene_id", "left")
    none = F.col("n").isNull()
    floors = [F.when(none, F.lit(hard_floors[0])).otherwise(F.greatest(F.col(f"r{i}"), F.lit(h))).alias(f"floor_{i + 1}") for i, h in enumerate(hard_floors)]
    return x.select(
        "scene_id", F.coalesce("n", F.lit(0)).cast("int").alias("n"), *floors, (none | (F.col("most") - F.col("least") < 50)).alias("no_variation"),
        (none | (F.col("r0") < hard_floors[0])).alias("all_blurry")
    )


def calibrate_source(logs: DataFrame, old: DataFrame | None = None, min_scenes: int = 5, keep: int = 50, mode: str = "batch", tolerance: float = 5.0) -> DataFrame:
    """Per source of min_scenes scores: n, avg_score, values at n // 4 and 3n // 4, and against old (source, avg_score) the change
    in percent, 1 place, and a verdict.

    verdict: shifted beyond `tolerance` percent, else stable; a source without an old average has delta 0 and is stable.
    batch keeps the `keep` largest scores, online the last `keep` by time.
    """
    order = [F.desc("top_score"), "scene_id"] if mode == "batch" else [F.desc("processed_at"), F.desc("scene_id")]
    n = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    kept = logs.where("top_score > 0").withColumn("_n", n).where(F.col("_n") <= keep)
    x = kept.groupBy("source").agg(F.sort_array(F.collect_list("top_score")).alias("v"))
    size = F.size("v")
    at = lambda i: F.element_at("v", i.cast("int") + 1)
    avg = F.aggregate("v", F.lit(0.0), lambda a, b: a + b) / size
    x = x.where(size >= min_scenes).select("source", size.alias("n"), avg.alias("_avg"), at(F.floor(size / 4)).alias("p25"), at(F.floor(size * 3 / 4)).alias("p75"))
    before = old.select("source", F.col("avg_score").cast("double").alias("_old")) if old is not None else x.select("source", F.lit(None).cast("double").alias("_old"))
    delta = F.coalesce(F.when(F.col("_old") != 0, (F.col("_avg") - F.col("_old")) / F.col("_old") * 100), F.lit(0.0))
    x = x.join(before, "source", "left").withColumn("_delta", delta)
    return x.select(
        "source", "n", F.round("_avg", 2).alias("avg_score"), "p25", "p75", F.round("_delta", 1).alias("delta_pct"),
        F.when(F.abs("_delta") > tolerance, "shifted").otherwise("stable").alias("verdict")
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """results (batch_id, outcome, duration_sec) -> counts by outcome, success rate, min, avg and max of positive durations."""
    d = F.when(F.col("duration_sec") > 0, F.col("duration_sec"))
    count = lambda o: F.count_if(F.col("outcome") == o)
    return results.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("attempted"), count("completed").alias("completed"), count("warning").alias("warnings"),
        count("aborted").alias("aborted"), F.round(count("completed") * 100.0 / F.count(F.lit(1)), 1).alias("success_rate"),
        F.min(d).alias("min_sec"), F.round(F.avg(d), 2).alias("avg_sec"), F.max(d).alias("max_sec")
    )


def feedback_agreement(feedback: DataFrame) -> DataFrame:
    """feedback (model_label, operator_label, model_score, operator_score) -> one row of match rates and score errors."""
    labelled = F.col("operator_label").isNotNull() & F.col("model_label").isNotNull()
    both = F.col("operator_score").isNotNull() & F.col("model_score").isNotNull()
    err = F.abs(F.col("operator_score") - F.col("model_score"))
    return feedback.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(labelled).alias("labelled"),
        _share(F.col("operator_label") == F.col("model_label"), labelled).alias("label_match_pct"), F.count_if(both).alias("scored"),
        F.round(F.avg(F.when(both, err)), 2).alias("mae"), _share(err <= 5, both).alias("within_5_pct")
    )


def decision_mix(train: DataFrame) -> DataFrame:
    """train (scene_id, decision, score_100, model_score) -> per scene the mix, the pairs possible and the error."""
    is_ = lambda d: F.count_if(F.col("decision") == d)
    x = train.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("rows"), is_("keep").alias("keep"), is_("maybe").alias("maybe"), is_("reject").alias("reject"),
        F.round(F.avg(F.abs(F.col("score_100") - F.col("model_score"))), 2).alias("mae")
    )
    return x.withColumn("pairs_possible", F.col("keep") * F.col("reject") + F.col("keep") * F.col("maybe") + F.col("maybe") * F.col("reject"))


def text_completeness(train: DataFrame) -> DataFrame:
    """train (title, description, name) -> presence rates, the share of distinct lower-cased titles, the name in the title."""
    has = lambda c: C.truthy(F.col(c)).isNotNull()
    named = has("name") & has("title")
    titles = F.count_if(has("title"))
    return train.agg(
        F.count(F.lit(1)).alias("rows"), _share(has("title"), F.lit(True)).alias("title_pct"),
        _share(has("description"), F.lit(True)).alias("description_pct"),
        F.round(F.when(titles > 0, F.countDistinct(F.lower(C.truthy(F.col("title")))) / titles).otherwise(0.0), 4).alias("distinct_title_ratio"),
        _share(F.contains(F.lower("title"), F.lower("name")), named).alias("name_in_title_pct")
    )


def rule_kpis(reviews: DataFrame, cohort_col: str = "cohort") -> DataFrame:
    """reviews (cohort, scene_id, title_edit, description_edit, accepted, ready, severity, n_titles, title_diversity) -> KPIs a cohort.

    Denominators are distinct scenes; edit distances are clamped to 0..1 and .25 where missing; medians are linear, over
    reviews. Rows are reduced to one a scene first, so no row is expanded for a distinct count, and the scenes are counted
    in parts before their cohort meets.
    """
    edit = lambda c: F.coalesce(C.clamp(F.col(c), 0, 1), F.lit(0.25))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    reviews = reviews.withColumns({"title_edit": edit("title_edit"), "description_edit": edit("description_edit")})
    scene = reviews.groupBy(cohort_col, "scene_id").agg(
        any_of(F.col("accepted")).alias("accepted"), any_of(F.col("ready")).alias("ready"), any_of(F.col("title_edit") <= 0.1).alias("light"), any_of(F.col("severity") >= 2).alias("severe"), F.sum("severity").alias("severity"),
        F.sum("n_titles").alias("titles"), F.count("n_titles").alias("titled"), F.sum("title_diversity").alias("diversity"), F.count("title_diversity").alias("diverse"),
    )
    known = F.col("scene_id").isNotNull()
    scenes = F.count_if(known)
    of = lambda c: F.round(F.count_if(F.col(c) & known) / scenes, 4)
    counted = scene.groupBy(cohort_col).agg(
        scenes.alias("scene_count"), of("accepted").alias("accept_rate"), of("ready").alias("ready_rate"), of("light").alias("light_edit_rate"), F.round(F.sum("severity") / scenes, 4).alias("severity_per_scene"), of("severe").alias("severe_rate"),
        F.round(F.sum("titles") / F.sum("titled"), 2).alias("avg_titles"), F.round(F.sum("diversity") / F.sum("diverse"), 4).alias("title_diversity"),
    )
    both = reviews.select(cohort_col, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in ("title_edit", "description_edit")])).alias("e"))
    middle = values_at(both.select(F.struct(cohort_col, "e.c").alias("k"), F.col("e.v").alias("v")), "k", "v", _around({"m": 0.5}))
    median = lambda c: F.round(F.max(F.when(F.col("k.c") == c, _linear("m", 0.5))), 4).alias(f"median_{c}")
    medians = middle.groupBy(F.col(f"k.{cohort_col}").alias(cohort_col)).agg(median("title_edit"), median("description_edit"))
    out = [
        cohort_col, "scene_count", "accept_rate", "ready_rate", "median_title_edit", "median_description_edit", "light_edit_rate",
        "severity_per_scene", "severe_rate", "avg_titles", "title_diversity",
    ]
    a, m = counted.alias("a"), medians.alias("m")
    return a.join(m, F.col(f"a.{cohort_col}").eqNullSafe(F.col(f"m.{cohort_col}"))).select(F.col(f"a.{cohort_col}"), *out[1:])


#: (name, KPI, at least, at most): a candidate's checks; the numbers are defaults that a caller may replace.
PROMOTION_CHECKS = (
    ("too_few_scenes", "scene_count", 20, None), ("accept_rate", "accept_rate", 0.5, None), ("ready_rate", "ready_rate", 0.5, None),
    ("title_edits", "median_title_edit", None, 0.35), ("description_edits", "median_description_edit", None, 0.35),
    ("light_edits", "light_edit_rate", 0.2, None), ("severity", "severity_per_scene", None, 1.0), ("severe_share", "severe_rate", None, 0.2),
    ("diversity", "title_diversity", 0.2, None)
)


def gates(df: DataFrame, checks: tuple) -> DataFrame:
    """df with blocked_reasons, the checks that fail (a null value fails), and gates_pass."""
    bad = []
    for name, col, low, high in checks:
        ok = F.lit(True)
        if low is not None:
            ok = ok & (F.col(col) >= low)
        if high is not None:
            ok = ok & (F.col(col) <= high)
        bad.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)))
    reasons = F.filter(F.array(*bad), lambda x: x.isNotNull())
    return df.withColumn("blocked_reasons", reasons).withColumn("gates_pass", F.size("blocked_reasons") == 0)


def promotion_gates(kpis: DataFrame, checks: tuple = PROMOTION_CHECKS, streak_col: str | None = None, windows: int = 2) -> DataFrame:
    """kpis -> blocked_reasons, gates_pass; streak_col (passing runs in a row) must reach `windows`."""
    return gates(kpis, (*checks, *([("windows", streak_col, windows, None)] if streak_col else [])))


def retrain_gates(metrics: DataFrame, minimums: dict[str, int], max_mae: float = 18.0) -> DataFrame:
    """metrics with blocked_reasons and gates_pass: minimum counts and an error of at most max_mae; a missing error blocks."""
    return gates(metrics, (*[(f"few_{c}", c, n, None) for c, n in minimums.items()], ("mae", "mae", None, max_mae)))


NO_PHRASES = "array<struct<kind:string,phrase:string>>"


def _phrases(kind: str, values: Column) -> Column:
    return F.coalesce(F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("phrase"))), F.array().cast(NO_PHRASES))


def phrase_mining(reviews: DataFrame, min_rows: int = 10, top: int = 5) -> DataFrame:
    """reviews (title, tags; optionally description, categories, tone) -> (kind, phrase, n, rank), the `top` of each kind.

    Kinds: first_two and last_two words and tokens (3 letters or more) of the title, sentence (the description's first
    three of 12 to 72 characters), tag, category (each word's first letter large), tone. Equal counts are ranked by phrase. Under min_rows titled rows
    there is one row, kind 'default', with their number.
    """
    w = F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")
    strings = lambda c: F.col(c) if c in reviews.columns else F.array().cast("array<string>")
    text = lambda c: F.col(c) if c in reviews.columns else F.lit(None).cast("string")
    sentences = F.filter(
        F.transform(F.split(F.coalesce(text("description"), F.lit("")), r"[.!?]+"), lambda s: F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))),
        lambda s: F.length(s).between(12, 72)
    )
    x = reviews.where(C.truthy(F.col("title")).isNotNull()).select(
        w.alias("w"), "tags", F.slice(sentences, 1, 3).alias("sentences"), strings("categories").alias("categories"),
        F.lower(C.truthy(text("tone"))).alias("tone")
    )
    two = F.size("w") >= 2
    named = lambda values: F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    pairs = F.concat(
        _phrases("first_two", F.when(two, F.array(F.array_join(F.slice("w", 1, 2), " ")))), _phrases("last_two", F.when(two, F.array(F.array_join(F.slice("w", -2, 2), " ")))),
        _phrases("token", F.filter("w", lambda t: F.length(t) >= 3)), _phrases("sentence", F.col("sentences")), _phrases("tag", F.transform(named(F.col("tags")), F.lower)),
        _phrases("category", F.transform(named(F.col("categories")), F.initcap)), _phrases("tone", F.when(F.col("tone").isNotNull(), F.array("tone"))),
    )
    counts = x.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.phrase").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "phrase"))).where(F.col("rank") <= top)
    rows = x.agg(F.count(F.lit(1)).alias("rows"))
    enough = ranked.crossJoin(F.broadcast(rows)).where(F.col("rows") >= min_rows).select("kind", "phrase", "n", "rank")
    few = rows.where(F.col("rows") < min_rows).select(F.lit("default").alias("kind"), F.lit("").alias("phrase"), F.col("rows").alias("n"), F.lit(1).alias("rank"))
    return enough.unionByName(few)


def flag_summary(obs: DataFrame, min_conf: float = 0.5, evidence: int = 12) -> DataFrame:
    """obs (scene_id, obs_id, timestamp_sec, flags, flag_confidence) -> per scene and flag: n, max confidence, first evidence ids."""
    x = obs.where(F.col("flag_confidence") >= min_conf).select("scene_id", "obs_id", "timestamp_sec", "flag_confidence", F.explode(F.array_distinct("flags")).alias("flag"))
    n = F.row_number().over(Window.partitionBy("scene_id", "flag").orderBy("timestamp_sec", "obs_id"))
    ids = F.array_sort(F.collect_list(F.when(F.col("_n") <= evidence, F.struct("_n", "obs_id"))))
    return x.withColumn("_n", n).groupBy("scene_id", "flag").agg(
        F.count(F.lit(1)).alias("n"), F.max("flag_confidence").alias("max_conf"), F.transform(ids, lambda e: e["obs_id"]).alias("evidence")
    )


def validation_summary(validated: DataFrame) -> DataFrame:
    """validated (eligible, reject_codes, warnings) -> (kind, code, n): totals and counts by code."""
    total = validated.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("rejected"),
        F.count_if(F.col("eligible") & (F.size("warnings") > 0)).alias("suspicious")
    )
    totals = total.select(F.explode(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(c).alias("code"), F.col(c).alias("n")) for c in total.columns])).alias("x")).select("x.*")
    codes = validated.select(
        F.explode(
            F.concat(
                F.transform("reject_codes", lambda c: F.struct(F.lit("reject").alias("kind"), c.alias("code"))),
                F.transform("warnings", lambda c: F.struct(F.lit("warning").alias("kind"), c.alias("code")))
            )
        ).alias("x")
    )
    return totals.unionByName(codes.groupBy("x.kind", "x.code").agg(F.count(F.lit(1)).alias("n")))


def _top(df: DataFrame, key: str, order: list, top: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= top)


def tag_rollup(obs: DataFrame, picks: DataFrame, top: int = 80) -> DataFrame:
    """Labels of obs and picks (scene_id, label, label_confidence) -> per scene: n, max confidence, rank up to top."""
    cols = ["scene_id", "label", "label_confidence"]
    both = obs.select(*cols).unionByName(picks.select(*cols)).where("label is not null and label != ''")
    return _top(both.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("label_confidence").alias("max_conf")), "scene_id", [F.desc("n"), "label"], top)


def weighted_signals(tags: DataFrame, top: int = 80) -> DataFrame:
    """tags (scene_id, label, confidence, source) -> weight = max confidence + min(.25, .025 n), the sources, ranked by weight, n, label."""
    x = tags.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("c"), F.array_sort(F.collect_set("source")).alias("sources"))
    x = x.withColumn("weight", F.round(F.col("c") + F.least(F.lit(0.25), F.col("n") * 0.025), 4)).drop("c")
    return _top(x, "scene_id", [F.desc("weight"), F.desc("n"), "label"], top)


SCORE_BANDS = ((95, None), (90, 95), (85, 90), (80, 85), (70, 80), (50, 70), (None, 50))


def score_buckets(picks: DataFrame) -> DataFrame:
    """picks (scene_id, score) -> per scene the counts in seven fixed bands."""
    name = lambda lo, hi: f"b_{'lt' if lo is None else lo}_{'up' if hi is None else hi}"
    inside = lambda lo, hi: (F.lit(True) if lo is None else F.col("score") >= lo) & (F.lit(True) if hi is None else F.col("score") < hi)
    return picks.groupBy("scene_id").agg(*[F.count_if(inside(lo, hi)).alias(name(lo, hi)) for lo, hi in SCORE_BANDS])


def resource_totals(logs: DataFrame) -> DataFrame:
    """logs (scene_id, phases map<string, struct<frames_scored, candidates_found, duration_sec>>) -> sums; frames fall back to candidates."""
    x = logs.select("scene_id", F.explode("phases").alias("phase", "p"))
    return x.groupBy("scene_id").agg(
        F.sum(F.coalesce("p.frames_scored", "p.candidates_found", F.lit(0))).alias("frames"), F.round(F.sum("p.duration_sec"), 2).alias("seconds"),
        F.count(F.lit(1)).alias("phases")
    )


def recent_latency(timings: DataFrame, limit: int, key: str = "mode") -> DataFrame:
    """timings (key, ts, job_id, latency_ms) -> the mean of each key's last `limit` positive samples."""
    x = timings.where("latency_ms > 0").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("job_id"))))
    return x.where(F.col("_n") <= limit).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 2).alias("avg_ms"))


def status_mix(jobs: DataFrame, max_active: int) -> DataFrame:
    """jobs (status) -> counts by status and utilisation min(1, (active + .25 queued) / max_active)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return jobs.agg(
        *[n(s).alias(s) for s in ("queued", "active", "done", "failed")],
        F.round(F.least(F.lit(1.0), (n("active") + n("queued") * 0.25) / max_active), 4).alias("utilisation")
    )


def artifact_latest(registry: DataFrame) -> DataFrame:
    """registry (type, created_at, artifact_id) -> per type the count and the latest row."""
    last = F.max_by("artifact_id", F.struct("created_at", "artifact_id"))
    return registry.groupBy("type").agg(F.count(F.lit(1)).alias("n"), last.alias("latest_id"), F.max("created_at").alias("latest_at"))


def feedback_pivot(feedback: DataFrame) -> DataFrame:
    """feedback (scene_id, decision) -> counts of keep, reject, maybe and other."""
    d = F.lower(F.trim("decision"))
    kind = F.when(d.isin("keep", "reject", "maybe"), d).otherwise("other")
    return feedback.withColumn("_d", kind).groupBy("scene_id").pivot("_d", ["keep", "reject", "maybe", "other"]).count().na.fill(0)


def label_rollup(rows: DataFrame, top: int = 6) -> DataFrame:
    """rows (scene_id, labels_a, labels_b) -> the top labels of both arrays a scene, by count, then label."""
    x = rows.select(
        "scene_id",
        F.explode(
            F.concat(F.coalesce("labels_a", F.array().cast("array<string>")), F.coalesce("labels_b", F.array().cast("array<string>")))
        ).alias("label")
    ).where("label != ''")
    return _top(x.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n")), "scene_id", [F.desc("n"), "label"], top)


def quota_progress(obs: DataFrame, spec: dict[str, int]) -> DataFrame:
    """obs (scene_id, bucket) -> per scene the counts of the buckets of spec and whether all are filled."""
    n = {b: F.count_if(F.col("bucket") == b) for b in spec}
    done = F.lit(True)
    for b, want in spec.items():
        done = done & (n[b] >= want)
    return obs.groupBy("scene_id").agg(*[c.alias(f"n_{b}") for b, c in n.items()], done.alias("satisfied"))


def failure_profile(obs: DataFrame, floor: float) -> DataFrame:
    """obs (scene_id, parse_succeeded, score) -> scored, over the floor, the share of zeros, failures."""
    zero = F.col("parse_succeeded") & (F.col("score") == 0)
    return obs.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("parse_succeeded") & (F.col("score") >= floor)).alias("over_floor"),
        F.round(F.count_if(zero) / F.count(F.lit(1)), 4).alias("zero_share"), F.count_if(~F.col("parse_succeeded")).alias("failures")
    )


def cohort_timing(logs: DataFrame, predicate: Column, stages: list[str]) -> DataFrame:
    """Mean stage times of the logs that meet the predicate (candidate) and of the others (baseline)."""
    return logs.withColumn("cohort", F.when(predicate, "candidate").otherwise("baseline")).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(s), 3).alias(f"avg_{s}") for s in stages]
    )


def call_percentiles(calls: DataFrame, pcts: tuple[int, ...] = (50, 95), key: str = "mode") -> DataFrame:
    """calls (key, ms) -> percentiles by the rounded nearest rank, round((n - 1) * p / 100) with halves to even.

    Null times are no calls.
    """
    ranks = {f"p{p}": lambda n, p=p: F.bround((n - 1) * F.lit(p / 100), 0) for p in pcts}
    return values_at(calls, key, "ms", ranks).select(key, F.col("n").cast("int").alias("n"), *ranks)


def library_facets(summaries: DataFrame) -> DataFrame:
    """Counts by source, by status and by both, with the grand total."""
    return summaries.cube("source", "status").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))

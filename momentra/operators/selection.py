"""Greedy selection, cascades and top-k."""

from __future__ import annotations

import bisect
import functools
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentra.functions import columns as C
from momentra.functions import streams
from momentra.functions.shared import cut


def _ranked(df: DataFrame, order: list, name: str = "_n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("scene_id").orderBy(*order)))


PICKED = "scene_id string, obs_id long, timestamp_sec double, score double, rank int, relaxed boolean"


def min_gap_select(df: DataFrame, score_col: str, k: int | Column, gap_sec: float, top_off: bool = True) -> DataFrame:
    """Per scene, best score first: rows at least gap_sec from all accepted, up to k; then, with top_off, the best others up to k.

    -> (scene_id, obs_id, timestamp_sec, score, rank, relaxed). Ties go to the earlier time, then the lesser id. k may be
    a column; a scene's greatest counts.
    """
    most = F.max(k).over(Window.partitionBy("scene_id")) if isinstance(k, Column) else F.lit(k)
    x = df.select("scene_id", "obs_id", "timestamp_sec", F.col(score_col).cast("double").alias("score"), most.cast("int").alias("k"))
    return streams.sorted_pass(x, [F.desc("score"), "timestamp_sec", "obs_id"], PICKED, lambda: streams.Apart(gap_sec, top_off))


def sharp_gate(df: DataFrame, k: int, pct: float = 25.0, relaxed: float = 10.0, hard_floor: float = 100.0, relaxed_floor: float = 50.0) -> DataFrame:
    """Rows at or over their scene's sharpness floor max(percentile, hard_floor); where fewer than k qualify, over the
    relaxed floor. gate_relaxed tells which."""
    w = Window.partitionBy("scene_id")
    x = df.withColumn("_p", F.percentile("sharpness", F.array(F.lit(pct / 100), F.lit(relaxed / 100))).over(w))
    x = x.withColumns({"_hi": F.greatest(F.lit(hard_floor), F.col("_p")[0]), "_lo": F.greatest(F.lit(relaxed_floor), F.col("_p")[1])})
    x = x.withColumn("gate_relaxed", F.count_if(F.col("sharpness") >= F.col("_hi")).over(w) < k)
    return x.where(F.col("sharpness") >= F.when(F.col("gate_relaxed"), F.col("_lo")).otherwise(F.col("_hi"))).drop("_p", "_hi", "_lo")


def live_select(obs: DataFrame, k: int, gap_sec: float = 20.0) -> DataFrame:
    """fused_score, sharp_gate and min_gap_select: obs with zone_tags in, picks out."""
    from momentra.operators.scalars import fused_score

    return min_gap_select(sharp_gate(fused_score(obs), k), "fused", k, gap_sec)


def interval_consolidate(seeds: DataFrame) -> DataFrame:
    """seeds (scene_id, obs_id, timestamp_sec, score, window_sec) -> windows kept, best score first, that overlap none kept before."""
    t, w = F.col("timestamp_sec"), F.col("window_sec")
    x = seeds.where("window_sec > 0 and timestamp_sec is not null").select(
        "scene_id", "obs_id", (t - w).alias("lo"), (t + w).alias("hi"), F.col("score").cast("double").alias("score"), "timestamp_sec"
    )
    kept = streams.sorted_pass(x, [F.desc("score"), "timestamp_sec", "obs_id"], "scene_id string, obs_id long, lo double, hi double, score double", streams.Disjoint)
    return kept.select("scene_id", "obs_id", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), "score")


def window_expand(seeds: DataFrame, seen: DataFrame) -> DataFrame:
    """seeds (scene_id, obs_id, timestamp_sec, score, window_sec, step_sec, duration_sec) -> sample times in each window and
    in [0, duration]; a time (1 place) goes to the best seed that claims it, and none that was seen comes back."""
    steps = F.floor(F.col("window_sec") / F.col("step_sec")).cast("int")
    x = seeds.where("step_sec > 0 and window_sec > 0").select(
        "scene_id", "obs_id", "score", "duration_sec", "timestamp_sec", "step_sec", F.explode(F.sequence(-steps, steps)).alias("i")
    )
    x = x.withColumn("t", F.floor((F.col("timestamp_sec") + F.col("i") * F.col("step_sec")) * 10 + 0.5) / 10).where((F.col("t") >= 0) & (F.col("t") <= F.col("duration_sec")))
    first = x.groupBy("scene_id", "t").agg(F.max_by("obs_id", F.struct("score", -F.col("obs_id"))).alias("seed_id"))
    s = seen.select(F.col("scene_id").alias("_s"), (F.floor(F.col("timestamp_sec") * 10 + 0.5) / 10).alias("_t"))
    return first.join(s, (F.col("scene_id") == F.col("_s")) & (F.col("t") == F.col("_t")), "left_anti")


def near_dup_keep_first(obs: DataFrame, hash_col: str, threshold: int = 5, horizon: int | None = None) -> DataFrame:
    """Rows in time order, each kept if over threshold bits from all kept before it (the last `horizon`); a null hash is kept."""
    x = obs.select("scene_id", "obs_id", F.col(hash_col).cast("long").alias("h"), "timestamp_sec")
    kept = streams.sorted_pass(x, ["timestamp_sec", "obs_id"], "scene_id string, obs_id long", lambda: streams.UnlikeBits(threshold, horizon))
    kept = kept.select(F.col("scene_id").alias("_s"), F.col("obs_id").alias("_o"))
    return obs.join(kept, F.col("scene_id").eqNullSafe(F.col("_s")) & F.col("obs_id").eqNullSafe(F.col("_o")), "left_semi")


def zone_topn(obs: DataFrame, zone: str, n: int, dup_threshold: int = 2, min_score: float = 70.0, floor: float = 50.0) -> DataFrame:
    """The zone's rows over the sharpness floor, without near copies, the n sharpest of each scene, of them those of min_score."""
    z = near_dup_keep_first(obs.where(F.array_contains("zone_tags", zone) & (F.col("sharpness") >= floor)), "phash", dup_threshold)
    return _ranked(z, [F.desc("sharpness"), "obs_id"]).where((F.col("_n") <= n) & (F.col("score") >= min_score)).drop("_n")


def queue_cap(obs: DataFrame, max_per_scene: int) -> DataFrame:
    """obs (priority) with queue_rank and skipped for those beyond the scene's cap."""
    return _ranked(obs, [F.desc("priority"), "obs_id"], "queue_rank").withColumn("skipped", F.col("queue_rank") > max_per_scene)


def tier_escalate(obs: DataFrame, floors: tuple[float, float, float] = (80, 70, 50), need: int = 3) -> DataFrame:
    """Rows of tier 1 where `need` of them reach the first floor; else of tiers 1 and 2 that reach the second where `need`
    do; else of all tiers that reach the third."""
    w = Window.partitionBy("scene_id")
    t = F.col("tier")
    one = (t == "TIER_1") & (F.col("score") >= floors[0])
    two = t.isin("TIER_1", "TIER_2") & (F.col("score") >= floors[1])
    level = F.when(F.count_if(one).over(w) >= need, 1).when(F.count_if(two).over(w) >= need, 2).otherwise(3)
    x = obs.where(t.isNotNull()).withColumn("level", level)
    return x.where(F.when(F.col("level") == 1, one).when(F.col("level") == 2, two).otherwise(F.col("score") >= floors[2]))


def floor_cascade(picks: DataFrame, scored: DataFrame, metric_obs: DataFrame, target: int = 15, overshoot: int = 5) -> DataFrame:
    """picks filled up to target a scene from the stages A (scores 30 to under 50, best first), C (other scores over 0, by
    hash) and D (sharpest), each row once. A stage runs while its scene is short, and may overshoot by `overshoot`.

    -> (scene_id, obs_id, stage, rank); stage P are the picks.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "scene_id", "obs_id").cast("binary")), 1, 13), 16, 10)
    pool = (
        picks.select("scene_id", "obs_id", F.lit("P").alias("stage"), F.lit(0).alias("o"), (-F.col("score")).alias("k"))
        .unionByName(scored.where("score >= 30 and score < 50").select("scene_id", "obs_id", F.lit("A").alias("stage"), F.lit(1).alias("o"), (-F.col("score")).alias("k")))
        .unionByName(scored.where("score > 0").select("scene_id", "obs_id", F.lit("C").alias("stage"), F.lit(2).alias("o"), h.cast("double").alias("k")))
        .unionByName(metric_obs.select("scene_id", "obs_id", F.lit("D").alias("stage"), F.lit(3).alias("o"), (-F.col("sharpness")).alias("k")))
    )
    once = pool.groupBy("scene_id", "obs_id").agg(F.min_by(F.struct("stage", "o", "k"), F.struct("o", "k")).alias("b")).select("scene_id", "obs_id", "b.*")
    w = Window.partitionBy("scene_id").orderBy("o", "k", "obs_id")
    x = once.withColumn("rank", F.row_number().over(w))
    start = F.min("rank").over(Window.partitionBy("scene_id", "o")) - 1  # rows of the stages before
    short = (F.col("_start") < target) & (F.col("rank") <= target + overshoot)
    return x.withColumn("_start", start).where((F.col("o") == 0) | short).select("scene_id", "obs_id", "stage", "rank")


def recheck_queue(picks: DataFrame, results: DataFrame, n: int = 8) -> DataFrame:
    """The first n picks (by rank) of each scene that are eligible and need a recheck, with the verdict of results if there is one."""
    q = _ranked(picks.where("eligible and needs_recheck"), ["rank", "obs_id"], "queue_rank").where(F.col("queue_rank") <= n)
    x = q.join(results.select("scene_id", "obs_id", "verdict"), ["scene_id", "obs_id"], "left")
    return x.select(
        "scene_id", "obs_id", "queue_rank", F.coalesce("verdict", F.lit("pending")).alias("verdict"),
        (F.coalesce("verdict", F.lit("")) != "reject").alias("still_eligible")
    )


def recheck_rounds(candidates: DataFrame, results: DataFrame, select: Callable[[DataFrame], DataFrame], n: int = 8, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Select, recheck and select again: (picks, queue), `rounds` times at most.

    select gives picks (scene_id, obs_id, rank) of candidates (scene_id, obs_id, eligible, needs_recheck). The first n of
    each scene that need it are rechecked against results, the outcome of the external check. A rejected one is no
    candidate any more, and its scene is selected anew; what a first round has passed is not checked again. queue: the
    rows of recheck_queue with their round. The rounds are a fixed number, so this is one plan.
    """
    flags = candidates.select("scene_id", "obs_id", "eligible", "needs_recheck")
    left, queues = candidates.where("eligible"), []
    for turn in range(1, rounds + 1):
        picked = select(left).select("scene_id", "obs_id", "rank").join(flags, ["scene_id", "obs_id"])
        for q in queues:
            picked = picked.join(q.select("scene_id", "obs_id"), ["scene_id", "obs_id"], "left_anti")
        q = recheck_queue(picked, results, n).withColumn("round", F.lit(turn))
        queues.append(q)
        left = left.join(q.where("not still_eligible"), ["scene_id", "obs_id"], "left_anti")
    return select(left), functools.reduce(DataFrame.unionByName, queues)


#: Weights of the five token sets of retrieve_topk, and the terms beside them.
RETRIEVAL = {"tags": 0.30, "labels": 0.22, "title_tokens": 0.24, "contributors": 0.14, "categories": 0.10}


#: Common tokens up to which a row's are told by one expression, and tokens of the queries up to which others are passed by.
COMMON, HELD = 2_000, 1_000_000


def _token_sets(sets: list[str]) -> list[Column]:
    return [F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))).alias(c) for c in sets]


def _tokens(df: DataFrame, sets: list[str]) -> DataFrame:
    """(id, s, t): each token of each set, s the set's name."""
    marked = lambda c: F.transform(c, lambda t: F.struct(F.lit(c).alias("s"), t.alias("t")))
    return df.select("id", F.explode(F.concat(*[marked(c) for c in sets])).alias("x")).select("id", "x.s", "x.t")


def _often(df: DataFrame, tokens: DataFrame, sets: list[str], common: DataFrame, few: dict[str, list[str]] | None) -> DataFrame:
    """df with often, its (s, t) that are common, of rows that have any, and two hashes of what makes rows alike: these
    tokens, the sets' sizes and the source. few: the common tokens by set, where they are few."""
    if few is not None:
        of = lambda c: F.transform(F.array_sort(F.filter(c, lambda t: t.isin(few[c]))), lambda t: F.struct(F.lit(c).alias("s"), t.alias("t")))
        x = df.withColumn("often", F.concat(*[of(c) for c in sets if c in few])) if few else df.withColumn("often", F.array(F.struct(F.lit("").alias("s"), F.lit("").alias("t")))).limit(0)
    else:
        x = df.join(tokens.join(common, ["s", "t"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s", "t"))).alias("often")), "id")
    what = [F.col("often"), F.col("source").isNull(), F.lower("source"), *[F.size(c) for c in sets]]
    return x.where(F.size("often") > 0).withColumns({"h1": F.xxhash64(*what), "h2": F.xxhash64(F.lit(1), *what)})


def _near(both: dict[str, Column], a: dict[str, Column], b: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted Jaccard similarities of the sets, of the sizes of what both have, a and b."""
    one = lambda c: F.when(a[c] + b[c] - both[c] > 0, both[c] / (a[c] + b[c] - both[c])).otherwise(F.lit(0.0))
    return sum((one(c) * w for c, w in weights.items()), F.lit(0.0))


def _total(near: Column, extra: Column, a: str, b: str) -> Column:
    return F.round(near + extra + F.when(F.col(a) == F.col(b), 0.22).otherwise(0.0), 6)


def _class_candidates(qs: DataFrame, bs: DataFrame, sets: list[str], weights: dict[str, float], k: int) -> DataFrame:
    """(q, id): for each query of qs the k + 1 rows of bs that are best by their common tokens alone. qs, bs as _often
    gives them.

    Queries and rows that are alike are compared once. Of alike rows only those can be among the best that are among the
    k + 1 of least id with their extra, and whose extra is within rounding of the (k + 1)th greatest of these.
    """
    near_tie = 2e-6  # sums are rounded to 6 places, and of equal ones the least id is the best
    each, rows = Window.partitionBy("h1", "h2", "extra").orderBy("id"), Window.partitionBy("h1", "h2").orderBy(F.desc("extra"), "id")
    x = bs.where("extra is not null").select("h1", "h2", "extra", "id").withColumn("n", F.row_number().over(each)).where(F.col("n") <= k + 1)
    last = F.nth_value("extra", k + 1).over(rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = x.withColumn("last", last).where(F.col("last").isNull() | (F.col("extra") >= F.col("last") - near_tie))
    classes = x.groupBy("h1", "h2").agg(F.min("id").alias("g"), F.max("extra").alias("most"))
    members = cut(x.join(classes, ["h1", "h2"]).select("g", "id", "extra", "most"))
    asked = cut(qs.select("id", "h1", "h2").withColumn("c", F.min("id").over(Window.partitionBy("h1", "h2"))).select("id", "c"))
    sized = [F.lower("source").alias("source"), *[F.size(c).alias(c) for c in sets]]
    one = lambda df, heads, p: cut(df.join(C.small(heads), "id").select(F.col("id").alias(p), "often", F.struct(*sized).alias(f"{p}_is")))
    q = one(qs, asked.where("id = c").select("id"), "c")
    b = one(bs, members.where("id = g").select("id"), "g")
    shared = q.select("c", F.explode("often").alias("x")).join(b.select("g", F.explode("often").alias("x")), "x")
    shared = shared.groupBy("c", "g").agg(*[F.count_if(F.col("x.s") == c).alias(c) for c in sets])
    heads = members.where("id = g").select("g", "most")
    x = shared.join(q.drop("often"), "c").join(b.drop("often"), "g").join(heads, "g")
    side = lambda p: {c: F.col(f"{p}_is.{c}") for c in sets}
    x = x.withColumn("near", _near({c: F.col(c) for c in sets}, side("c"), side("g"), weights)).withColumn("best", _total(F.col("near"), F.col("most"), "c_is.source", "g_is.source"))
    x = x.withColumn("n", F.rank().over(Window.partitionBy("c").orderBy(F.desc("best")))).where(F.col("n") <= k + 1)
    x = x.select("c", "g", "near", F.col("c_is.source").alias("a"), F.col("g_is.source").alias("b")).join(members, "g").withColumn("total", _total(F.col("near"), F.col("extra"), "a", "b"))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("total"), "id"))).where(F.col("n") <= k + 1)
    return asked.withColumnRenamed("id", "q").join(x.select("c", "id"), "c").select("q", "id")


def retrieve_topk(queries: DataFrame, bank: DataFrame, weights: dict[str, float] = RETRIEVAL, k: int = 3, max_df: int = 10_000) -> DataFrame:
    """queries, bank (id, source, one array a set; bank also acceptance, reject_rate) -> (query_id, id, signal, rank).

    Weighted Jaccard of the sets, +.08 acceptance, -.04 reject rate, +.22 for one source, clamped to 0..1; only rows
    over 0 and with a token in common are ranked, by signal, the sum before clamping, and id. Nulls are no tokens.

    Rows that share a token of up to max_df bank rows with a query are candidates one by one. A row that shares commoner
    tokens only has just the sum that these give; to any other row they give no more than it has. So of all rows the k + 1
    best by common tokens alone, one of which may be the query itself, hold those of the k best that share no other token.
    These are found once for all queries that are alike in their common tokens, sizes and source, among rows that are
    alike (_class_candidates). Every pair with a token in common is so ranked as if it were compared; max_df moves cost,
    not the result.
    """
    sets = list(weights)
    q0 = queries.select("id", "source", *_token_sets(sets))
    extra = F.col("acceptance") * 0.08 - F.col("reject_rate") * 0.04
    b0 = bank.select("id", "source", extra.alias("extra"), *_token_sets(sets))
    q = _tokens(q0, sets).withColumnRenamed("id", "q")
    token = F.xxhash64("s", "t").alias("h")
    asked = C.small(cut(q.select(token).distinct()), HELD)
    b = _tokens(b0, sets).withColumn("h", token).join(asked, "h", "left_semi").drop("h")
    common = cut(b.groupBy("s", "t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_df).select("s", "t"))
    told = common.limit(COMMON + 1).collect()
    few = None if len(told) > COMMON else {c: [r["t"] for r in told if r["s"] == c] for c in sorted({r["s"] for r in told})}
    small = C.small(common)
    rare = q.join(b.join(small, ["s", "t"], "left_anti"), ["s", "t"]).select("q", "id")
    often = lambda df: _often(df, _tokens(df, sets), sets, small, few)
    pairs = rare.unionAll(_class_candidates(often(q0), often(b0), sets, weights, k)).where("q != id").distinct()
    named = lambda df, p, *more: df.select(F.col("id").alias(p), F.lower("source").alias(f"{p}_source"), *[F.col(c).alias(f"{p}_{c}") for c in sets], *more)
    x = pairs.join(named(q0, "q"), "q").join(named(b0, "id", "extra"), "id")
    both = {c: F.size(F.array_intersect(f"q_{c}", f"id_{c}")) for c in sets}
    near = _near(both, {c: F.size(f"q_{c}") for c in sets}, {c: F.size(f"id_{c}") for c in sets}, weights)
    total = _total(near, F.col("extra"), "q_source", "id_source")
    x = x.select(F.col("q").alias("query_id"), "id", total.alias("total"), C.clamp(total, 0, 1).alias("signal")).where("signal > 0")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("total"), "id"))
    return x.withColumn("rank", n).where(F.col("rank") <= k).drop("total")


def external_accept(scored: DataFrame, n: int, min_score: float = 80.0) -> DataFrame:
    """scored (scene_id, obs_id, parse_succeeded, score, slots_left) with reason and accepted, the best n within the slots left."""
    reason = F.when(~F.col("parse_succeeded"), "unparsed").when(F.col("score") < min_score, "low_score")
    x = scored.withColumn("reason", reason)
    rank = F.row_number().over(Window.partitionBy("scene_id", F.col("reason").isNull()).orderBy(F.desc("score"), "obs_id"))
    cap = F.least(F.lit(n), F.col("slots_left"))
    x = x.withColumn("_r", rank)
    return x.withColumn("reason", F.coalesce("reason", F.when(F.col("_r") > cap, "over_cap"))).withColumn("accepted", F.col("reason").isNull()).drop("_r")


def title_sanitize(titles: DataFrame, jaccard: float = 0.72, low: int = 18, high: int = 110) -> DataFrame:
    """titles (scene_id, ord, text) -> those kept, in order: no repeat, 18..110 characters, few repeated words, no word four
    times running, first four words new, and tokens unlike all kept before."""
    w = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: t != "")
    n = F.size("w")
    run = F.exists(
        F.sequence(F.lit(1), F.greatest(F.lit(1), n - 3)),
        lambda i: (n >= 4) & (
            F.try_element_at("w", i) == F.try_element_at("w", i + 1)
        ) & (F.try_element_at("w", i) == F.try_element_at("w", i + 2)) & (F.try_element_at("w", i) == F.try_element_at("w", i + 3))
    )
    x = titles.where(F.length("text").between(low, high)).withColumn("w", w).where((F.size(F.array_distinct("w")) / n >= 0.5) & ~F.coalesce(run, F.lit(False)))
    x = x.withColumn("head", F.array_join(F.slice("w", 1, 4), " "))
    first = lambda *k: F.row_number().over(Window.partitionBy("scene_id", *k).orderBy("ord"))
    x = x.withColumn("_a", first(F.lower("text"))).where("_a = 1").withColumn("_b", first("head")).where("_b = 1")
    x = x.select("scene_id", "ord", "text", F.array_distinct("w").alias("tokens"))
    return streams.sorted_pass(x, ["ord"], "scene_id string, ord long, text string, place int", lambda: streams.UnlikeTokens(jaccard)).drop("place")


def title_balance(titles: DataFrame, lead: str, hints: list[str], n: int, jaccard: float = 0.68) -> DataFrame:
    """titles (scene_id, ord, text) -> n a scene: by points (lead term 3, each hint 1, length 40..80 1), unlike those taken
    before; then the best others fill up. -> (scene_id, ord, points, place)."""
    low = F.lower("text")
    points = F.when(F.contains(low, F.lit(lead.lower())), 3).otherwise(0) + sum(
        (F.when(F.contains(low, F.lit(h.lower())), 1).otherwise(0) for h in hints), F.lit(0)
    ) + F.when(F.length("text").between(40, 80), 1).otherwise(0)
    x = titles.select("scene_id", "ord", points.cast("int").alias("points"), C.token_set(F.col("text")).alias("tokens"))
    return streams.sorted_pass(x, [F.desc("points"), "ord"], "scene_id string, ord long, points int, place int", lambda: streams.UnlikeTokens(jaccard, n))


def disagreements(feedback: DataFrame, limit: int = 120, only_errors: bool = True) -> DataFrame:
    """The last `limit` rows of feedback (feedback_id, ts, model_*, operator_*), one row a compared field: label, visible, score.

    verdict: ok, warn (scores within 10), err.
    """
    last = feedback.orderBy(F.desc("ts"), F.desc("feedback_id")).limit(limit)
    fields = [F.struct(F.lit(f).alias("field"), F.col(f"model_{f}").cast("string").alias("model"), F.col(f"operator_{f}").cast("string").alias("operator")) for f in ("label", "visible", "score")]
    x = last.select("feedback_id", "ts", F.explode(F.array(*fields)).alias("x")).select("feedback_id", "ts", "x.*").where("model is not null and operator is not null")
    gap = F.abs(F.col("model").try_cast("double") - F.col("operator").try_cast("double"))
    verdict = F.when(F.col("model") == F.col("operator"), "ok").when((F.col("field") == "score") & (gap == 0), "ok").when(
        (F.col("field") == "score") & (gap <= 10), "warn"
    ).otherwise("err")
    x = x.withColumn("verdict", verdict)
    return x.where("verdict != 'ok'") if only_errors else x


def repair_fill(meta: DataFrame, want: int) -> DataFrame:
    """meta (scene_id, have, candidates) with repaired: have, then the candidates not yet there, `want` at least if there are so many."""
    more = F.array_except("candidates", "have")
    return meta.withColumn("repaired", F.slice(F.concat("have", more), F.lit(1), F.greatest(F.size("have"), F.lit(want))))


def coverage_ready(obs: DataFrame, picks: DataFrame, target: int, segments: int = 1, span: float = 0.8, span_in_segments: float = 0.65) -> DataFrame:
    """(scene_id, enough, labels_missing, span_share, segments_covered, ready): picks enough, each label seen is picked, they span
    the scene, and they lie in enough of its equal segments.

    With one segment the span is `span` of the scene and no segment is asked for; with more it is span_in_segments, and
    all segments but one (two at least) have to be covered.
    """
    t = F.col("timestamp_sec")
    o = obs.groupBy("scene_id").agg(F.collect_set("label").alias("seen"), F.min("timestamp_sec").alias("start"), (F.max("timestamp_sec") - F.min("timestamp_sec")).alias("len"))
    length = o.select("scene_id", "start", "len")
    segment = F.least(F.lit(segments - 1), F.floor(F.when(F.col("len") > 0, (t - F.col("start")) / F.col("len") * segments).otherwise(0.0)))
    p = picks.join(length, "scene_id").groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("label").alias("picked"), (F.max("timestamp_sec") - F.min("timestamp_sec")).alias("plen"),
        F.countDistinct(segment).alias("covered")
    )
    x = o.join(p, "scene_id", "left")
    missing = F.array_sort(F.array_except("seen", F.coalesce("picked", F.array().cast("array<string>"))))
    share = F.round(F.when(F.col("len") > 0, F.coalesce("plen", F.lit(0.0)) / F.col("len")).otherwise(1.0), 4)
    enough = F.coalesce("n", F.lit(0)) >= target
    covered = F.coalesce("covered", F.lit(0)).cast("int")
    wide = (share >= (span_in_segments if segments > 1 else span)) & (covered >= (min(segments, max(2, segments - 1)) if segments > 1 else 0))
    return x.select(
        "scene_id", enough.alias("enough"), missing.alias("labels_missing"), share.alias("span_share"), covered.alias("segments_covered"),
        (enough & (F.size(missing) == 0) & wide).alias("ready")
    )


def failure_stop(scored: DataFrame, min_completed: int = 12, rate: float = 0.75) -> DataFrame:
    """(scene_id, stop_at): the first row, in order, by which min_completed are done, none is usable and `rate` or more failed."""
    w = Window.partitionBy("scene_id").orderBy("timestamp_sec", "obs_id").rowsBetween(Window.unboundedPreceding, 0)
    x = scored.withColumns(
        {
            "_n": F.count(F.lit(1)).over(w), "_ok": F.count_if(F.col("parse_succeeded") & (F.col("score") > 0)).over(w),
            "_bad": F.count_if(~F.col("parse_succeeded")).over(w),
        }
    )
    hit = (F.col("_n") >= min_completed) & (F.col("_ok") == 0) & (F.col("_bad") >= rate * F.col("_n"))
    return x.groupBy("scene_id").agg(F.min(F.when(hit, F.col("_n"))).alias("stop_at"))


# quota fill -----------------------------------------------------------------------------------------------------

PICKS = "scene_id string, obs_id long, timestamp_sec double, label string, bucket string, run_label string, score double, pick_pass int, rank int"
STATS = "eligible int, runs int, effective_max int, picks int"


#: The passes in order: each run with the gap, the run with the tight gap, buckets, labels, the best with the gap, the best.
RUN, TIGHT, BUCKET, LABEL, GAP, ANY = range(6)
#: pick_pass of each.
NUMBER = (0, 0, 1, 1, 2, 3)


class Quota(streams.Greedy):
    """One scene's visits (scene_id, step, pass, obs_id, timestamp_sec, label, bucket, run, run_label, score, eligible, runs)
    in order -> picks as they are made, in the end the stats as the row of rank 0. Holds the picks only."""

    def __init__(self, spec: dict[str, int], per_label: int, per_run: int, gap: float, tight: float, max_total: int, min_total: int, cap: int) -> None:
        self.spec, self.per_label, self.per_run, self.min_total = spec, per_label, per_run, min_total
        self.apart = (gap, tight, gap, gap, gap, 0.0)
        self.most = lambda runs: min(cap, max(max_total, per_run * runs))
        self.ids: set[int] = set()
        self.times: list[float] = []
        self.runs, self.buckets, self.labels = Counter(), Counter(), Counter()
        self.stats: tuple = ()

    def wanted(self, step: int, label: str | None, bucket: str | None, run: int) -> bool:
        if step <= TIGHT:
            return self.runs[run] < self.per_run
        if step == BUCKET:
            return self.buckets[bucket] < self.spec[bucket]
        if step == LABEL:
            return self.labels[label] < self.per_label
        return len(self.ids) < self.min_total

    def far(self, t: float, apart: float) -> bool:
        at = bisect.bisect_left(self.times, t)
        return all(abs(t - x) >= apart for x in self.times[max(0, at - 1) : at + 1])

    def feed(self, row: tuple) -> Iterable[tuple]:
        scene, step, i, t, label, bucket, run, run_label, score, eligible, runs = row
        self.stats = (scene, eligible, runs, self.most(runs))
        if len(self.ids) >= self.stats[-1] or i in self.ids or not self.wanted(step, label, bucket, run) or not self.far(t, self.apart[step]):
            return ()
        self.ids.add(i)
        bisect.insort(self.times, t)
        self.buckets[bucket] += 1
        self.labels[label] += 1
        if step <= TIGHT:
            self.runs[run] += 1
        return ((scene, i, t, label, bucket, run_label, score, NUMBER[step], len(self.ids), None, None, None, None),)

    def close(self) -> Iterable[tuple]:
        scene, *counts = self.stats
        return ((scene, *[None] * 7, 0, *counts, len(self.ids)),)


def quota_fill(
    obs: DataFrame, spec: dict[str, int], max_total: int, min_total: int, per_label: int = 0, per_run: int = 3, gap_sec: float = 20.0,
    tight_sec: float = 8.0, run_gap: float = 120.0, cap: int = 36
) -> tuple[DataFrame, DataFrame]:
    """obs (scene_id, obs_id, timestamp_sec, label, label_confidence, bucket, score, motion) -> (picks, stats).

    Pass 0 covers each run of a label, pass 1 fills buckets and labels with the gap, 2 tops off with the gap to min_total, 3
    without; every pick counts for the gap of the later ones. The total grows with the runs, up to cap. Runs are found by
    windows; then a row visits its scene once a pass that may take it, in the passes' order, and the visits stream past the
    picks, of which there are cap at most. One shuffle gives picks and stats, which are cut. Null labels are a label of
    their own; rows without a time are left out; a scene without rows has neither picks nor stats.
    """
    x = obs.select("scene_id", "obs_id", "timestamp_sec", "label", "label_confidence", "bucket", "score", "motion").where("timestamp_sec is not null").repartition("scene_id")
    time = Window.partitionBy("scene_id").orderBy("timestamp_sec", "obs_id")
    new = F.lag("obs_id").over(time).isNull() | ~F.col("label").eqNullSafe(F.lag("label").over(time)) | (F.col("timestamp_sec") - F.lag("timestamp_sec").over(time) > run_gap)
    upto = lambda w: F.sum(F.col("_new").cast("int")).over(w.orderBy("timestamp_sec", "obs_id").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    scene = Window.partitionBy("scene_id")
    x = x.withColumn("_new", new).withColumns({"run": upto(scene), "_nth": upto(Window.partitionBy("scene_id", "label"))})
    name = F.concat(F.coalesce("label", F.lit("")), F.lit("_"), F.lpad(F.col("_nth").cast("string"), F.greatest(F.lit(2), F.length(F.col("_nth").cast("string"))), F.lit("0")))
    x = x.withColumns({"run_label": name, "eligible": F.count(F.lit(1)).over(scene).cast("int"), "runs": F.max("run").over(scene)})
    place = F.coalesce(*[F.when(F.col("bucket") == b, i) for i, b in enumerate(spec)], F.lit(-1)) if spec else F.lit(-1)
    go = lambda when, step, group, name=F.lit(None).cast("string"): F.when(when, F.struct(F.lit(step).alias("step"), group.alias("g"), name.alias("name")))
    none = F.lit(0)
    visits = [go(F.lit(per_run > 0), RUN, 2 * F.col("run")), go(F.lit(per_run > 0), TIGHT, 2 * F.col("run") + 1), go(place >= 0, BUCKET, place), go(F.lit(per_label > 0), LABEL, none, F.col("label"))]
    visits += [go(F.lit(min_total > 0), GAP, none), go(F.lit(min_total > 0), ANY, none)]
    # a row visits its scene at least once, so that the scene has its stats
    visits = F.filter(F.array(*visits, go(F.lit(per_run <= 0), RUN, none)), lambda v: v.isNotNull())
    rows = x.select("*", F.explode(visits).alias("v")).select(
        "scene_id", F.col("v.step").alias("step"), "obs_id", "timestamp_sec", "label", "bucket", "run", "run_label", "score", "eligible", "runs",
        F.greatest(F.lit(TIGHT), F.col("v.step")).alias("_o1"), F.col("v.g").alias("_o2"), F.col("v.name").alias("_o3"), (-F.col("score")).alias("_o4"), (-F.col("label_confidence")).alias("_o5"), (-F.col("motion")).alias("_o6"),
    )
    args = (spec, per_label, per_run, gap_sec, tight_sec, max_total, min_total, cap)
    order = [f"_o{i}" for i in range(1, 7)]
    rows = rows.sortWithinPartitions("scene_id", *order[:3], *map(F.asc_nulls_last, order[3:]), "timestamp_sec", "obs_id").drop(*order)
    both = cut(streams.passed(rows, f"{PICKS}, {STATS}", lambda: Quota(*args)))
    stats = [c.split()[0] for c in STATS.split(", ")]
    return both.where("rank > 0").drop(*stats), both.where("rank = 0").select("scene_id", *stats)

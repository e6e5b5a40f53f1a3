"""Joins: enrichment, semi and anti forms, range and nearest joins, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentra.functions import columns as C


def feedback_by_source(feedback: DataFrame, logs: DataFrame, source: str) -> DataFrame:
    """Feedback rows of the scenes of one source, whatever its case."""
    return feedback.join(logs.where(F.lower("source") == source.lower()).select("scene_id", "source"), "scene_id")


def review_enriched(reviews: DataFrame, logs: DataFrame, insight: DataFrame) -> DataFrame:
    return reviews.join(logs, "scene_id", "left").join(insight, "scene_id", "left")


def library_find(
    logs: DataFrame, reviews: DataFrame, ready: DataFrame | None = None, *, source: str | None = None, text: str | None = None,
    min_score: float | None = None, min_picks: int | None = None, since: str | None = None, has_errors: bool | None = None,
    flagged: bool | None = None, reviewed: bool | None = None, channel: str | None = None, limit: int = 100
) -> DataFrame:
    """logs that meet every given predicate, best score first, then newest. reviewed: True semi, False anti; channel: ready there."""
    out = logs
    for given, cond in (
        (source, lambda: F.lower("source") == source.lower()), (
            text, lambda: F.contains(F.lower("title"), F.lit(text.lower()))
        ), (min_score, lambda: F.col("top_score") >= min_score), (min_picks, lambda: F.col("picks") >= min_picks),
        (
            since, lambda: F.col("processed_at") >= F.lit(since).cast("timestamp")
        ), (has_errors, lambda: (F.size("error_codes") > 0) == has_errors), (flagged, lambda: F.col("flagged") == flagged),
    ):
        if given is not None:
            out = out.where(cond())
    if reviewed is not None:
        out = out.join(reviews.select("scene_id"), "scene_id", "left_semi" if reviewed else "left_anti")
    if channel is not None:
        out = out.join(ready.where((F.col("channel") == channel) & F.col("ready")).select("scene_id"), "scene_id", "left_semi")
    return out.orderBy(F.desc("top_score"), F.desc("processed_at"), "scene_id").limit(limit)


def library_page(summaries: DataFrame, q: str | None = None, source: str | None = None, status: str | None = None, sort: str = "newest", limit: int = 24) -> DataFrame:
    """One page of summaries (scene_id, source, title, status, top_score, processed_at), with its place."""
    x = summaries
    if q:
        x = x.where(F.contains(F.lower(F.concat_ws(" ", "scene_id", "source", "title")), F.lit(q.lower())))
    if source:
        x = x.where(F.col("source") == source)
    if status:
        x = x.where(F.col("status") == status)
    rank = F.when(F.col("status") == "REVIEW", 0).when(F.col("status") == "DRAFT", 1).when(F.col("status") == "REVIEWED", 2).otherwise(3)
    order = {"newest": [F.desc("processed_at")], "oldest": [F.asc("processed_at")], "score": [F.desc("top_score")], "status": [rank, F.desc("processed_at")]}[sort]
    top = x.orderBy(*order, "scene_id").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order, "scene_id")))  # over one page only


def exclude_seen(df: DataFrame, seen: DataFrame, digits: int = 1) -> DataFrame:
    """Rows whose time, rounded, was not seen in their scene."""
    s = seen.select(F.col("scene_id").alias("_s"), F.round("timestamp_sec", digits).alias("_t"))
    return df.join(s, (F.col("scene_id") == F.col("_s")) & (F.round("timestamp_sec", digits) == F.col("_t")), "left_anti")


def exclude_near(df: DataFrame, excluded: DataFrame, tol_sec: float) -> DataFrame:
    """Rows with no excluded time within tol_sec in their scene: an equi join on time buckets, each excluded row in three."""
    bucket = lambda c: F.floor(c / tol_sec)
    e = excluded.select(F.col("scene_id").alias("_s"), F.col("timestamp_sec").alias("_t")).withColumn("_b", F.explode(F.array(*[bucket(F.col("_t")) + i for i in (-1, 0, 1)])))
    on = (F.col("scene_id") == F.col("_s")) & (bucket(F.col("timestamp_sec")) == F.col("_b")) & (F.abs(F.col("timestamp_sec") - F.col("_t")) <= tol_sec)
    return df.join(e, on, "left_anti")


def _half_up(c: Column, digits: int) -> Column:
    """c at so many digits, halves upwards below zero too, where round() takes them away from zero. NaN stays."""
    x = c * float(10**digits) + 0.5
    return F.when(F.isnan(x), x).otherwise(F.floor(x).cast("double"))


def _around(picks: DataFrame, obs: DataFrame, offsets: list[float], digits: int) -> DataFrame:
    """picks (scene_id, obs_id, timestamp_sec, sharpness) joined to the observations at each offset, by rounded time."""
    at = picks.select(
        "scene_id", "obs_id", "timestamp_sec", "sharpness", F.explode(F.array(*map(F.lit, offsets))).alias("dt")
    ).withColumn("_t", _half_up(F.col("timestamp_sec") + F.col("dt"), digits))
    o = obs.select(F.col("scene_id").alias("_s"), _half_up(F.col("timestamp_sec"), digits).alias("_u"), F.col("obs_id").alias("near_id"), F.col("sharpness").alias("near_sharpness"))
    return at.join(o, (F.col("scene_id") == F.col("_s")) & (F.col("_t") == F.col("_u")))


def nearest_better(picks: DataFrame, obs: DataFrame, offsets: list[float], min_gain: float = 35.0, min_pct: float = 0.12, digits: int = 0) -> DataFrame:
    """picks with the sharpest observation at an offset, where it gains min_gain and min_pct; else null."""
    x = _around(picks, obs, offsets, digits)
    best = x.groupBy("scene_id", "obs_id").agg(F.max_by(F.struct("near_id", "near_sharpness"), F.struct("near_sharpness", -F.abs("dt"), "dt", -F.col("near_id"))).alias("b"))
    out = picks.select("scene_id", "obs_id", "sharpness").join(best, ["scene_id", "obs_id"], "left")
    gain = F.col("b.near_sharpness") - F.col("sharpness")
    ok = (gain >= min_gain) & (gain >= min_pct * F.col("sharpness"))
    return out.select("scene_id", "obs_id", F.when(ok, F.col("b.near_id")).alias("better_id"), F.when(ok, F.round(gain, 2)).alias("gain"))


def nearest_clearing_floor(picks: DataFrame, obs: DataFrame, offsets: list[float], floor: float, digits: int = 0) -> DataFrame:
    """picks with the observation at the least offset (of equal ones the later) whose sharpness clears the floor; else null."""
    x = _around(picks, obs, offsets, digits).where(F.col("near_sharpness") >= floor)
    best = x.groupBy("scene_id", "obs_id").agg(F.min_by(F.struct("near_id", "dt"), F.struct(F.abs("dt"), F.col("dt") < 0, "near_id")).alias("b"))
    return picks.select("scene_id", "obs_id").join(best, ["scene_id", "obs_id"], "left").select(
        "scene_id", "obs_id", F.col("b.near_id").alias("near_id"), F.col("b.dt").alias("dt")
    )


def temporal_support(df: DataFrame, window_sec: float = 45.0, strong: float = 0.85, min_conf: float = 0.60) -> DataFrame:
    """supported: sure by itself, or another row of the label with min_conf within window_sec; a range frame, no join."""
    ms = F.round(F.col("timestamp_sec") * 1000).cast("long")  # range frames take whole numbers
    w = Window.partitionBy("scene_id", "label").orderBy(ms).rangeBetween(-round(window_sec * 1000), round(window_sec * 1000))
    sure = F.col("label_confidence") >= min_conf
    others = F.sum(F.when(sure, 1).otherwise(0)).over(w) - F.when(sure, 1).otherwise(0)
    return df.withColumn("supported", (F.col("label_confidence") >= strong) | (others > 0))


#: Pairs that are drawn for each pair wanted, as some are ties.
DRAWS = 4


def _drawn(points: DataFrame, most: int) -> DataFrame:
    """(scene_id, a_idx, a_rank, ..., b_score), a_idx < b_idx: all pairs of a scene that has DRAWS * most at most, else so many
    drawn from its pair numbers 0 .. n(n-1)/2 - 1 by hash; a number is turned into its two places, so nothing else is paired."""
    at = points.withColumn("_at", F.row_number().over(Window.partitionBy("scene_id").orderBy("idx")).cast("long") - 1)
    scenes = points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.expr("_n * (_n - 1) div 2")).where("_all > 0")
    k = scenes.select("scene_id", "_all", F.explode(F.sequence(F.lit(0).cast("long"), F.least("_all", F.lit(DRAWS * most)) - 1)).alias("_k"))
    number = F.when(F.col("_all") <= DRAWS * most, F.col("_k")).otherwise(F.pmod(F.xxhash64("scene_id", "_k"), F.col("_all")))
    x = k.select("scene_id", number.alias("_r")).distinct().withColumn("_j", F.floor((1 + F.sqrt(1 + 8 * F.col("_r").cast("double"))) / 2).cast("long"))
    before = lambda j: F.expr(f"{j} * ({j} - 1) div 2")  # noqa: E731  the pairs whose greater place is below j
    x = x.withColumn("_j", F.when(before("_j") > F.col("_r"), F.col("_j") - 1).when(before("(_j + 1)") <= F.col("_r"), F.col("_j") + 1).otherwise(F.col("_j")))
    x = x.withColumn("_i", F.col("_r") - before("_j"))
    side = lambda p, place: at.select(F.col("scene_id").alias(f"_{p}"), F.col("_at").alias(place), *[F.col(c).alias(f"{p}_{c}") for c in ("idx", "rank", "score")])
    x = x.join(side("a", "_pa"), (F.col("scene_id") == F.col("_a")) & (F.col("_i") == F.col("_pa")))
    return x.join(side("b", "_pb"), (F.col("scene_id") == F.col("_b")) & (F.col("_j") == F.col("_pb")))


def preference_pairs(points: DataFrame, max_per_scene: int | None = None) -> DataFrame:
    """points (scene_id, idx, rank, score) -> (scene_id, better, worse, by): higher rank wins, else higher score; ties give none.

    Without max_per_scene all pairs of a scene are the result, so it grows with the square of a scene's points. With it, the
    pairs of least hash are taken: of all pairs where a scene has DRAWS * max_per_scene at most, else of so many pairs drawn
    by hash, so that the work is bounded too; where most pairs are ties it may then be fewer than max_per_scene. idx tells a
    scene's points apart; points without a scene make no pairs.
    """
    if max_per_scene is None:
        a, b = (points.select("scene_id", *[F.col(c).alias(f"{p}_{c}") for c in ("idx", "rank", "score")]) for p in "ab")
        pair = a.join(b, "scene_id").where("a_idx < b_idx")
    else:
        pair = _drawn(points.where("scene_id is not null").select("scene_id", "idx", "rank", "score"), max_per_scene)
    key = lambda c: F.coalesce(F.col(c), F.lit(-1.0))
    by_rank = F.col("a_rank").isNotNull() & F.col("b_rank").isNotNull() & (F.col("a_rank") != F.col("b_rank"))
    first = F.when(by_rank, F.col("a_rank") > F.col("b_rank")).when(key("a_score") != key("b_score"), key("a_score") > key("b_score"))
    out = pair.withColumn("_f", first).where("_f is not null").select(
        "scene_id", F.when(F.col("_f"), F.col("a_idx")).otherwise(F.col("b_idx")).alias("better"),
        F.when(F.col("_f"), F.col("b_idx")).otherwise(F.col("a_idx")).alias("worse"), F.when(by_rank, "rank").otherwise("score").alias("by")
    )
    if max_per_scene is None:
        return out
    n = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.xxhash64("scene_id", "better", "worse"), "better", "worse"))
    return out.withColumn("_n", n).where(F.col("_n") <= max_per_scene).drop("_n")


def channel_validate(meta: DataFrame, rules: DataFrame, metadata_only: bool = False) -> DataFrame:
    """meta (scene_id, title, description, tags, categories, flags, records_ok, width, height, picks) x channel rules.

    -> (scene_id, channel, blockers, warnings, ready, overall_ready): overall means ready somewhere and no blocker of
    the scene itself (no pick). Missing records block where a channel asks for them; a flag warns.
    """
    fields = (
        "channel", "title_min", "title_max", "desc_min", "desc_max", "min_tags", "max_tags", "min_categories", "max_categories", "banned_terms",
        "requires_identity_record", "min_width", "min_height"
    )
    given = rules.agg(F.collect_list(F.struct(*fields)).alias("_rules"))  # one row; each scene is tested against every channel
    n = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    title, text = F.length(F.coalesce("title", F.lit(""))), F.length(F.coalesce("description", F.lit("")))
    said = F.lower(F.concat_ws(" ", "title", "description"))
    listed = lambda xs: F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in xs]), lambda x: x.isNotNull())

    def judged(r: Column) -> Column:
        banned = F.exists(F.coalesce(r["banned_terms"], F.array().cast("array<string>")), lambda t: F.contains(said, F.lower(t)))
        tests = [
            ("title_short", title < r["title_min"]), ("title_long", title > r["title_max"]), (
                "description_short", text < r["desc_min"]
            ), ("description_long", text > r["desc_max"]),
            ("few_tags", n("tags") < r["min_tags"]), ("few_categories", n("categories") < r["min_categories"]), ("banned_term", banned),
        ]
        if not metadata_only:
            small = (F.coalesce("width", F.lit(0)) < r["min_width"]) | (F.coalesce("height", F.lit(0)) < r["min_height"])
            tests += [("no_records", r["requires_identity_record"] & ~F.coalesce("records_ok", F.lit(False))), ("low_resolution", small)]
        warn = [("many_tags", n("tags") > r["max_tags"]), ("many_categories", n("categories") > r["max_categories"]), ("flagged", n("flags") > 0)]
        return F.struct(r["channel"].alias("channel"), listed(tests).alias("blockers"), listed(warn).alias("warnings"))

    x = meta.crossJoin(F.broadcast(given)).select("scene_id", (F.col("picks") > 0).alias("_scene_ok"), F.transform("_rules", lambda r: judged(r)).alias("_c"))
    x = x.withColumn("_any", F.exists("_c", lambda c: F.size(c["blockers"]) == 0)).select("scene_id", "_scene_ok", "_any", F.explode("_c").alias("c"))
    return x.select("scene_id", "c.channel", "c.blockers", "c.warnings", (F.size("c.blockers") == 0).alias("ready"), (F.col("_any") & F.col("_scene_ok")).alias("overall_ready"))


def records_ready(scenes: DataFrame, docs: DataFrame, rules: DataFrame, as_of: str, mode: str = "strict") -> DataFrame:
    """scenes (scene_id, contributor_keys) x channel rules against the document registry -> (scene_id, channel, problems, ready).

    A contributor needs a release that names the channel (or none in particular) and, where the channel asks for it, an
    identity record; expired or undated records do not count. strict: every contributor must be covered, and a scene
    without contributors is blocked; reference: one covered contributor is enough.
    """
    r = C.small(rules.select("channel", "requires_identity_record", "requires_individual_releases"))
    valid = docs.where(F.col("expiry_date") >= F.lit(as_of).cast("date"))
    kinds = valid.groupBy("contributor_key").agg(
        F.bool_or(F.col("document_type") == "identity").alias("identity"), F.bool_or((F.col("document_type") == "release") & (F.size("channels") == 0)).alias("release_any"),
        F.collect_set(F.when(F.col("document_type") == "release", F.col("channels"))).alias("_lists"),
    ).withColumn("release_for", F.array_distinct(F.flatten("_lists"))).drop("_lists")
    people = scenes.select("scene_id", F.explode_outer("contributor_keys").alias("contributor_key")).join(kinds, "contributor_key", "left").crossJoin(r)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    release = F.coalesce("release_any", F.lit(False)) | F.coalesce(F.array_contains("release_for", F.col("channel")), F.lit(False))
    lacks = [
        ("missing_release", F.col("requires_individual_releases") & ~release),
        ("missing_identity", F.col("requires_identity_record") & no("identity")), ("no_contributor", F.col("contributor_key").isNull()),
    ]
    problems = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in lacks]), lambda x: x.isNotNull())
    each = people.select("scene_id", "channel", problems.alias("p"))
    ready = F.bool_and(F.size("p") == 0) if mode == "strict" else F.bool_or(F.size("p") == 0)
    return each.groupBy("scene_id", "channel").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("p")))).alias("problems"), ready.alias("ready"))


def package_eligible(logs: DataFrame, reviews: DataFrame, readiness: DataFrame) -> DataFrame:
    """(scene_id, channel, reasons, eligible): ready there, reviewed, finalised, and at least one pick."""
    x = logs.select("scene_id", "picks").join(readiness.select("scene_id", "channel", "ready"), "scene_id").join(
        reviews.select("scene_id", "finalized").withColumn("_r", F.lit(True)), "scene_id", "left"
    )
    no = [("not_ready", ~F.col("ready")), ("not_reviewed", F.col("_r").isNull()), ("not_final", ~F.coalesce("finalized", F.lit(False))), ("no_pick", F.col("picks") == 0)]
    reasons = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in no]), lambda x: x.isNotNull())
    return x.select("scene_id", "channel", reasons.alias("reasons"), (F.size(reasons) == 0).alias("eligible"))


def taxonomy_lookup(signals: DataFrame, mapping: DataFrame) -> DataFrame:
    """signals (label...) with the category of least priority that mapping (label, category, priority) gives it."""
    best = mapping.groupBy(F.upper("label").alias("_label")).agg(F.min_by("category", F.struct("priority", "category")).alias("category"))
    return signals.join(C.small(best), F.upper("label") == F.col("_label"), "left").drop("_label")


def flagged_sections(sections: DataFrame, flags: DataFrame) -> DataFrame:
    """Sections (scene_id, evidence ids) that share an id with a flag of the scene."""
    f = flags.select(F.col("scene_id").alias("_s"), F.explode("evidence").alias("_e")).distinct()
    key = sections.select("scene_id", "section", F.explode("evidence").alias("_x")).join(
        f, (F.col("scene_id") == F.col("_s")) & (F.col("_x") == F.col("_e")), "left_semi"
    ).select("scene_id", "section").distinct()
    return sections.join(key, ["scene_id", "section"], "left_semi")


def cohort_delta(kpis: DataFrame, names: list[str], cohort_col: str = "cohort") -> DataFrame:
    """One row: candidate less baseline of each KPI; null where either is missing."""
    of = lambda c, who: F.max(F.when(F.col(cohort_col) == who, F.col(c)))
    return kpis.agg(*[F.round(of(c, "candidate") - of(c, "baseline"), 4).alias(f"delta_{c}") for c in names])


def canary_assign(scenes: DataFrame, pointer: DataFrame) -> DataFrame:
    """scenes with applied_pack: the pointer's pack where it is on in full, or as a canary for the scene's hash bucket.

    The pointer is its latest row, by updated_at and rule_pack_id; without a row no scene has a pack.
    """
    fields = ("enabled", "mode", "rule_pack_id", "canary_pct")
    last = pointer.agg(F.max_by(F.struct(*fields), F.struct("updated_at", "rule_pack_id")).alias("p"))  # one row
    p = F.broadcast(last.select(*[F.col(f"p.{c}") for c in fields]))
    bucket = C.hash_fraction(F.col("scene_id"), 10_000) / 100
    on = F.col("enabled") & ((F.col("mode") == "full") | ((F.col("mode") == "canary") & (bucket < F.col("canary_pct"))))
    x = scenes.crossJoin(p)
    return x.withColumns({"bucket": bucket, "applied_pack": F.when(on, F.col("rule_pack_id"))}).drop("enabled", "mode", "rule_pack_id", "canary_pct")



"""Scalar operators and lookups: a frame in, the same rows with new columns out."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from momentra.functions import columns as C
from momentra.functions import literals, streams
from momentra.functions.folds import first_by_key
from momentra.functions.shared import cut


def _band(df: DataFrame, value: str, bands: DataFrame, *cols: str) -> DataFrame:
    """df with the columns of the band lo <= value < hi (null hi: no end); null outside all bands."""
    b = C.small(bands.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), *[F.col(c).alias(f"_{c}") for c in cols]))
    inside = (F.col(value) >= F.col("_lo")) & (F.col("_hi").isNull() | (F.col(value) < F.col("_hi")))
    return df.join(b, inside, "left").drop("_lo", "_hi")


def zone_tags(df: DataFrame, late: float = 0.80, build: tuple[float, float] = (0.25, 0.50)) -> DataFrame:
    """zone_tags: late from `late` of the duration on, build between both ends of `build`; none if the duration is not positive."""
    part = F.col("timestamp_sec") / F.col("duration_sec")
    ok = F.col("duration_sec") > 0
    tags = F.array(F.when(ok & (part >= late), F.lit("late")), F.when(ok & (part >= build[0]) & (part <= build[1]), F.lit("build")))
    return df.withColumn("zone_tags", F.filter(tags, lambda x: x.isNotNull()))


def adaptive_interval(df: DataFrame, base: float, scales: DataFrame, max_interval: float | None = None) -> DataFrame:
    """interval_sec: base times the duration's scale, at most max_interval, never below base, 3 places."""
    x = _band(df, "duration_sec", scales, "scale")
    want = F.lit(base) * F.coalesce("_scale", F.lit(1.0))
    want = want if max_interval is None else F.least(want, F.lit(float(max_interval)))
    return x.withColumn("interval_sec", F.round(F.greatest(F.lit(float(base)), want), 3)).drop("_scale")


def duration_cap(df: DataFrame, caps: DataFrame, default: int = 15) -> DataFrame:
    return _band(df, "duration_sec", caps, "cap").withColumn("cap", F.coalesce("_cap", F.lit(default))).drop("_cap")


def score_window(df: DataFrame, windows: DataFrame) -> DataFrame:
    """window_sec, step_sec of the closed band lo <= score <= hi; scores in a gap between bands have 0, 0."""
    w = C.small(windows.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("window_sec").alias("_w"), F.col("step_sec").alias("_s")))
    x = df.join(w, (F.col("score") >= F.col("_lo")) & (F.col("score") <= F.col("_hi")), "left")
    return x.withColumns({"window_sec": F.coalesce("_w", F.lit(0.0)), "step_sec": F.coalesce("_s", F.lit(0.0))}).drop("_lo", "_hi", "_w", "_s")


def tier_assign(df: DataFrame, floors: dict[str, float], motion_caps: dict[str, float]) -> DataFrame:
    """tier: the first of floors whose sharpness floor is met and whose motion cap is not passed; null motion passes."""
    out = F.lit(None).cast("string")
    for tier in reversed(list(floors)):
        still = F.col("motion").isNull() | (F.col("motion") <= motion_caps[tier])
        out = F.when((F.col("sharpness") >= floors[tier]) & still, F.lit(tier)).otherwise(out)
    return df.withColumn("tier", out)


def obs_sieve(df: DataFrame, motion_cap: float = 4.5, dark: float = 0.1, dup_threshold: int = 5, horizon: int = 600) -> DataFrame:
    """drop_reason in the order dark, below_floor, high_motion, duplicate; null for what passes. df has floor, the sharpness floor.

    A duplicate is within dup_threshold bits of one of the scene's last `horizon` rows that passed, in time order; a null
    hash is none.
    """
    reason = F.when(F.col("brightness") < dark, "dark").when(F.col("sharpness") < F.col("floor"), "below_floor").when(F.col("motion") > motion_cap, "high_motion")
    x = df.withColumn("drop_reason", reason)
    fit = x.where("drop_reason is null").select("scene_id", "obs_id", F.col("phash").cast("long").alias("h"), "timestamp_sec")
    kept = streams.sorted_pass(fit, ["timestamp_sec", "obs_id"], "scene_id string, obs_id long", lambda: streams.UnlikeBits(dup_threshold, horizon))
    kept = kept.select(F.col("scene_id").alias("_s"), F.col("obs_id").alias("_o"), F.lit(True).alias("_kept"))
    joined = x.join(kept, F.col("scene_id").eqNullSafe(F.col("_s")) & F.col("obs_id").eqNullSafe(F.col("_o")), "left").drop("_s", "_o")
    return joined.withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("_kept").isNull(), "duplicate"))).drop("_kept")


def sieve_counts(sieved: DataFrame, by: list[str | Column], reason: str = "drop_reason") -> DataFrame:
    """Counters of a sieve: rows by reason, 'passed' for none, and by the columns given (scene, segment)."""
    return sieved.groupBy(*by, F.coalesce(reason, F.lit("passed")).alias(reason)).agg(F.count(F.lit(1)).alias("n"))


def candidate_priority(df: DataFrame) -> DataFrame:
    late, build = F.array_contains("zone_tags", "late"), F.array_contains("zone_tags", "build")
    penalty = F.least(F.lit(50.0), F.greatest(F.lit(0.0), (F.coalesce("motion", F.lit(0.0)) - 1) * 10))
    return df.withColumn("priority", F.col("sharpness") - penalty + F.when(late, 200).otherwise(0) + F.when(build, 120).otherwise(0))


def reservoir_priority(df: DataFrame) -> DataFrame:
    tier = F.when(F.col("tier") == "TIER_1", 300).when(F.col("tier") == "TIER_2", 200).otherwise(100)
    zone = F.when(F.array_contains("zone_tags", "late"), 45).otherwise(0) + F.when(F.array_contains("zone_tags", "build"), 30).otherwise(0)
    return df.withColumn("priority", tier + zone + F.least(F.col("sharpness") / 20, F.lit(50.0)))


def fused_score(df: DataFrame, w_score: float = 0.7, w_sharp: float = 0.3, norm: float = 10.0, late: float = 5.0, build: float = 3.0) -> DataFrame:
    """Rows that parsed with a positive score, with fused: the score, the scaled sharpness and the zones' bonuses."""
    bonus = F.when(F.array_contains("zone_tags", "late"), late).otherwise(0.0) + F.when(F.array_contains("zone_tags", "build"), build).otherwise(0.0)
    return df.where("parse_succeeded and score > 0").withColumn("fused", F.col("score") * w_score + C.clamp(F.col("sharpness") / norm, 0, 100) * w_sharp + bonus)


def quality_adjust(df: DataFrame, bands: DataFrame) -> DataFrame:
    """adjusted: the score plus its sharpness band's adjustment, a bounded confidence term and a bounded raw-score term."""
    x = _band(df, "sharpness", bands, "adj")
    sure = C.clamp((F.col("label_confidence") - 0.5) * 4, -2, 2)
    raw = C.clamp((F.col("model_score_raw") - F.col("score")) * 0.1, -2, 2)
    total = F.col("score") + F.coalesce("_adj", F.lit(0.0)) + F.coalesce(sure, F.lit(0.0)) + F.coalesce(raw, F.lit(0.0))
    return x.withColumn("adjusted", F.round(C.clamp(total, 0, 100), 1)).drop("_adj")


def parse_response(responses: DataFrame, fail_codes: list[str]) -> DataFrame:
    """raw_text of KEY: value lines -> typed columns.

    A known fail code gives score 0 and counts as parsed; confidences are clamped to 0..1; what is missing has its
    default (score null and not parsed, empty code arrays, label OTHER). ok false never parses.
    """
    field = lambda k: F.trim(F.regexp_extract(F.coalesce("raw_text", F.lit("")), rf"(?im)^\s*{k}\s*:\s*(.*)$", 1))
    codes = lambda k: F.array_distinct(F.filter(F.transform(F.split(F.upper(field(k)), r"[,;\s]+"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "NONE")))
    number = lambda k: F.nullif(F.regexp_extract(field(k), r"^-?\d+(\.\d+)?", 0), F.lit("")).cast("double")
    fail = F.nullif(F.upper(field("FAIL")), F.lit(""))
    failed = F.coalesce(fail.isin(fail_codes), F.lit(False))
    score = F.when(failed, F.lit(0.0)).otherwise(C.clamp(number("SCORE"), 0, 100))
    ok = F.coalesce("ok", F.lit(False))
    return responses.select(
        "scene_id", "obs_id", F.when(ok, score).alias("score"), (ok & score.isNotNull()).alias("parse_succeeded"), F.when(failed, fail).alias("fail_code"), (ok & ~failed).alias("gate_pass"),
        codes("BONUS").alias("bonus_codes"), codes("PENALTY").alias("penalty_codes"), F.coalesce(
            F.nullif(C.slug_label(field("LABEL")), F.lit("")), F.lit("OTHER")
        ).alias("label"), F.coalesce(C.clamp(number("CONFIDENCE"), 0, 1), F.lit(0.0)).alias("label_confidence"),
    )


def rubric_score(df: DataFrame, weights: DataFrame, base: float, ceilings: list[tuple[int, float]], key: str = "obs_id") -> DataFrame:
    """df (key, codes) -> (key, rubric): base plus the weights of distinct codes (penalties negative), null without a code.

    ceilings: (bonus codes at least, ceiling), the last that holds; below all of them the first.
    """
    codes = df.select(key, F.explode(F.array_distinct("codes")).alias("code"))
    sums = codes.join(C.small(weights.select("code", "weight")), "code", "left").groupBy(key).agg(
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("_w"), F.count_if(F.col("weight") > 0).alias("_n")
    )
    top = F.lit(ceilings[0][1])
    for least, ceiling in ceilings:
        top = F.when(F.col("_n") >= least, F.lit(ceiling)).otherwise(top)
    scored = sums.select(key, F.greatest(F.lit(0.0), F.least(top, F.lit(base) + F.col("_w"))).alias("rubric"))
    return df.select(key).join(scored, key, "left")


def normalize_label(df: DataFrame, col: str, aliases: DataFrame, allowed: list[str], default: str) -> DataFrame:
    """label_norm: slug form, alias replaced, and the default for what is not allowed."""
    a = C.small(aliases.select(F.col("raw").alias("_raw"), F.col("canonical").alias("_canon")))
    x = df.withColumn("_slug", C.slug_label(F.col(col))).join(a, F.col("_slug") == F.col("_raw"), "left")
    name = F.coalesce("_canon", "_slug")
    return x.withColumn("label_norm", F.when(name.isin(allowed), name).otherwise(default)).drop("_slug", "_raw", "_canon")


def clean_label(df: DataFrame, col: str, blank_none: bool = True) -> DataFrame:
    out = F.regexp_replace(C.slug_label(F.coalesce(F.col(col), F.lit(""))), "[^A-Z0-9_]", "")
    return df.withColumn("label_clean", F.when(out.isin("NONE", "NULL"), "").otherwise(out) if blank_none else out)


def tokens_of(c: Column, seps: str = ",;\n|", case: str | None = None) -> Column:
    """The distinct tokens of a separated string in order; the first spelling of those that differ in case only stays."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), f"[{seps}]"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), "^ | $", ""))
    parts = F.filter(parts, lambda x: x != "")
    if case:
        parts = F.transform(parts, F.lower if case == "lower" else F.upper)
    return first_by_key(parts, F.lower)


def parse_tokens(df: DataFrame, col: str, seps: str = ",;\n|", case: str | None = None) -> DataFrame:
    return df.withColumn("tokens", tokens_of(F.col(col), seps, case))


def reason_codes(df: DataFrame, col: str, cap: int = 12) -> DataFrame:
    """codes: slugs of the array's strings, distinct, at most cap."""
    slugs = F.transform(F.col(col), lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    return df.withColumn("codes", F.slice(F.array_distinct(F.filter(slugs, lambda x: x != "")), 1, cap))


def norm_score(df: DataFrame, col: str, rescale_0_10: bool = True) -> DataFrame:
    """score_100: null outside 0..100, 0..10 as tenths where rescale_0_10 (so a true 8 of 100 becomes 80), 1 place."""
    v = F.col(col)
    v = F.when((v >= 0) & (v <= 10), v * 10).otherwise(v) if rescale_0_10 else v
    return df.withColumn("score_100", F.when((v >= 0) & (v <= 100), F.round(v, 1)))


def decision_rank(df: DataFrame, col: str) -> DataFrame:
    d = F.lower(F.trim(F.col(col)))
    return df.withColumn("rank", F.when(d == "keep", 2).when(d == "maybe", 1).when(d == "reject", 0))


def dominant_label(df: DataFrame) -> DataFrame:
    """dominant: hint, a label other than OTHER, the first tag of three arrays, type, UNKNOWN: the first that is not empty."""
    first = lambda c: F.try_element_at(F.filter(F.col(c), lambda x: x.isNotNull() & (x != "")), F.lit(1))
    label = C.truthy(F.col("label"))
    return df.withColumn(
        "dominant",
        F.coalesce(
            C.truthy(F.col("hint")), F.when(label != "OTHER", label), first("group_tags"), first("subgroup_tags"), first("flags"),
            C.truthy(F.col("type")), F.lit("UNKNOWN")
        )
    )


def obs_confidence(df: DataFrame) -> DataFrame:
    c = F.when(F.col("label_confidence") > 0, F.col("label_confidence")).otherwise(F.coalesce("score", F.lit(0.0)) / 100)
    return df.withColumn("confidence", C.clamp(c, 0, 1))


RULE_KEYS = ("tier", "type", "label")


def quota_bucket(df: DataFrame, rules: DataFrame, default: str = "other") -> DataFrame:
    """bucket of the first rule (by priority) whose given tier, type and label all agree; a null in a rule agrees with all, a
    null in a row with nothing else. A rule with min_confidence needs that much label_confidence; of ties the least rule in
    the order of its fields counts.

    FEW rules become one expression. More are joined with the distinct (tier, type, label) of the rows, once for each set of
    fields that rules give, and each row takes the first of its combination's rules that its confidence allows.
    """
    fields = ("priority", *RULE_KEYS, "min_confidence", "bucket")
    given = rules.select(*fields)
    few = given.orderBy(*fields).limit(FEW + 1).collect()
    if len(few) <= FEW:
        bucket = F.lit(default)
        for r in reversed(few):
            fits = F.lit(True)
            for c in RULE_KEYS:
                fits = fits & (F.col(c) == r[c]) if r[c] is not None else fits
            fits = fits & (F.col("label_confidence") >= r["min_confidence"]) if r["min_confidence"] is not None else fits
            bucket = F.when(fits, F.lit(r["bucket"])).otherwise(bucket)
        return df.withColumn("bucket", F.coalesce(bucket, F.lit(default)))
    combos = cut(df.select(*[F.col(c).alias(f"_{c}") for c in RULE_KEYS]).distinct())
    rule = F.struct(*fields).alias("rule")
    found = []
    for mask in itertools.product((True, False), repeat=len(RULE_KEYS)):
        of = given
        for c, has in zip(RULE_KEYS, mask):
            of = of.where(F.col(c).isNotNull() if has else F.col(c).isNull())
        keys = [F.col(f"_{c}") == F.col(c) for c, has in zip(RULE_KEYS, mask) if has]
        found.append(combos.join(of, keys or F.lit(True)).select(*combos.columns, rule))
    listed = functools.reduce(DataFrame.unionAll, found).groupBy(*combos.columns).agg(F.array_sort(F.collect_set("rule"), _in_order(fields)).alias("_rules"))
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in RULE_KEYS])
    x = df.join(cut(listed), same, "left")
    allowed = F.filter("_rules", lambda r: r["min_confidence"].isNull() | (F.col("label_confidence") >= r["min_confidence"]))
    return x.withColumn("bucket", F.coalesce(F.get(allowed, F.lit(0))["bucket"], F.lit(default))).drop("_rules", *combos.columns)


def _in_order(fields: tuple[str, ...]) -> Callable[[Column, Column], Column]:
    """Structs by their fields, nulls first."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for c in reversed(fields):
            less = (a[c].isNull() & b[c].isNotNull()) | (a[c] < b[c])
            out = F.when(a[c].eqNullSafe(b[c]), out).when(F.coalesce(less, F.lit(False)), -1).otherwise(1)
        return out

    return compare


def validate_obs(df: DataFrame, min_score: float = 40.0, min_sharpness: float = 60.0, warn_confidence: float = 0.4, mode: str = "hard_block") -> DataFrame:
    """reject_codes, warnings, eligible. demote turns reject codes into warnings, and nothing is blocked."""
    given = lambda *pairs: F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]), lambda x: x.isNotNull())
    rejects = given(("unparsed", ~F.col("parse_succeeded")), ("low_score", F.col("score") < min_score), ("low_sharpness", F.col("sharpness") < min_sharpness))
    warnings = given(("low_confidence", F.col("label_confidence") < warn_confidence), ("no_raw_score", F.col("model_score_raw").isNull()))
    if mode == "demote":
        return df.withColumns({"warnings": F.concat(rejects, warnings), "reject_codes": F.array().cast("array<string>"), "eligible": F.lit(True)})
    return df.withColumns({"reject_codes": rejects, "warnings": warnings, "eligible": F.size(rejects) == 0})


def record_quality(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """record_quality: the weights of the fields that are filled, at most 1, 3 places."""
    total = sum((F.when(C.truthy(F.col(c).cast("string")).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("record_quality", F.round(F.least(F.lit(1.0), total), 3))


def curation_quality(df: DataFrame, generic_words: list[str]) -> DataFrame:
    """curation_score 0..5 and curation_reasons, from the lengths of title and description, the tags and generic words."""
    title, text, tags = F.length(F.coalesce("title", F.lit(""))), F.length(F.coalesce("description", F.lit(""))), F.size(F.coalesce("tags", F.array()))
    generic = F.size(F.array_intersect(C.token_set(F.col("title")), F.array(*map(F.lit, generic_words))))
    parts = {
        "title_length": F.when(title.between(18, 110), 1.5).when(title > 0, 0.5).otherwise(0.0),
        "long_text": F.when(text >= 200, 1.5).when(text >= 80, 1.0).when(text > 0, 0.3).otherwise(0.0),
        "tag_count": F.when(tags >= 5, 2.0).when(tags >= 2, 1.0).otherwise(0.0),
    }
    reasons = F.filter(F.array(*[F.when(v > 0, F.lit(k)) for k, v in parts.items()], F.when(generic > 0, F.lit("generic_words"))), lambda x: x.isNotNull())
    score = sum(parts.values(), F.lit(0.0)) - F.least(F.lit(1.5), generic * 0.5)
    return df.withColumns({"curation_score": F.round(C.clamp(score, 0, 5), 2), "curation_reasons": reasons})


def acceptance_score(df: DataFrame) -> DataFrame:
    """1 for unchanged, .65 for edited, else .5; .1 more when ready (at most 1), less .08 a blocker (.6 at most), 4 places."""
    base = F.when(F.col("acceptance_label") == "unchanged", 1.0).when(F.col("acceptance_label") == "edited", 0.65).otherwise(0.5)
    base = F.when(F.col("ready"), F.least(F.lit(1.0), base + 0.1)).otherwise(base)
    return df.withColumn("acceptance", F.round(F.greatest(F.lit(0.0), base - F.least(F.lit(0.6), F.col("blockers") * 0.08)), 4))


#: Patterns or needles up to which each row is tested against all of them in one expression; more are looked for in one scan of the row.
FEW = 200


def _tags_of(low: Column, patterns: list[Row]) -> Column:
    """array<string>: the tags of which a pattern (tag, pattern) matches, sorted; one expression."""
    by_tag: dict[str, list[Column]] = {}
    for r in sorted(patterns):
        by_tag.setdefault(r["tag"], []).append(low.rlike(r["pattern"]))
    hits = [F.when(functools.reduce(lambda a, b: a | b, tests), F.lit(tag)) for tag, tests in sorted(by_tag.items())]
    return F.filter(F.array(*hits), lambda t: t.isNotNull()) if hits else F.array().cast("array<string>")


def dictionary_tags(df: DataFrame, col: str, patterns: DataFrame, key: str) -> DataFrame:
    """(key, tags), one row a row of df: the tags of which a pattern matches the lower-cased text, sorted.

    A dictionary of FEW patterns becomes one expression a row. Of a larger one the texts that matches must hold are looked
    for in one scan of a row (functions/literals), and what is found is verified; patterns without such a text are tested
    against all texts. Either way rows are not shuffled. Null tags, patterns and texts match nothing.
    """
    given = patterns.select("tag", "pattern").where("tag is not null and pattern is not null").distinct()
    few = given.limit(FEW + 1).collect()
    if len(few) <= FEW:
        return df.select(key, _tags_of(F.lower(F.col(col)), few).alias("tags"))
    given = cut(given.withColumn("needles", literals.required(F.col("pattern"))))
    rows = literals.tagged(df.select(key, F.lower(F.col(col)).alias("_low")), "_low", given.where("needles is not null"))
    rest = given.where("needles is null").select("tag", "pattern")
    few = rest.limit(FEW + 1).collect()
    if len(few) <= FEW:
        more = _tags_of(F.col("_low"), few)
    else:
        rows = rows.join(F.broadcast(rest.agg(F.collect_list(F.struct("tag", "pattern")).alias("_rest"))), how="cross")
        more = F.transform(F.filter("_rest", lambda p: F.rlike(F.col("_low"), p["pattern"])), lambda p: p["tag"])
    return rows.select(key, F.array_sort(F.array_distinct(F.concat("tags", more))).alias("tags"))


def source_detect(df: DataFrame, col: str, patterns: DataFrame, key: str) -> DataFrame:
    """(key, source), one row a row of df: the first dictionary entry, by its order, that the lower-cased path contains; of
    ties the least source, entries without an order last.

    FEW entries become one expression; more are looked for in one scan of a row (functions/literals), without a shuffle.
    Null needles and paths match nothing, an empty needle all paths.
    """
    given = patterns.select(F.struct(F.col("ord").isNull().alias("last"), "ord", "source").alias("entry"), F.lower("needle").alias("needle")).where("needle is not null")
    few = given.limit(FEW + 1).collect()
    if len(few) <= FEW:
        low, out = F.lower(F.col(col)), F.lit(None).cast("string")
        for r in sorted(few, key=lambda r: (r["entry"]["last"], r["entry"]["ord"] or 0, r["entry"]["source"] or ""), reverse=True):
            out = F.when(low.contains(r["needle"]), F.lit(r["entry"]["source"])).otherwise(out)
        return df.select(key, out.alias("source"))
    every = given.where("needle = ''").agg(F.min("entry").alias("every"))
    ranked = given.where("needle != ''").groupBy("needle").agg(F.min("entry").alias("entry"))
    ranked = cut(ranked.withColumn("rank", F.row_number().over(Window.orderBy("entry", "needle")).cast("long")))
    rows = literals.first_held(df.select(key, F.lower(F.col(col)).alias("_low")), "_low", ranked.select("needle", "rank"))
    joined = rows.join(C.small(ranked.select("rank", "entry")), "rank", "left").join(F.broadcast(every), how="cross")
    return joined.select(key, F.when(F.col("_low").isNotNull(), F.least("entry", "every"))["source"].alias("source"))


def inherit_metadata(files: DataFrame, sidecars: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """files (path), sidecars (folder, fields...) -> (path, fields): per field, the value of the deepest folder that has one.

    fields: name -> the sidecar columns that may hold it, first that is filled.
    """
    parts = F.split("path", "/")
    depths = F.sequence(F.lit(1), F.size(parts) - 1)
    up = files.select(
        "path",
        F.explode(
            F.transform(depths, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("folder")))
        ).alias("x")
    ).select("path", "x.depth", "x.folder")
    side = sidecars.select("folder", *[F.coalesce(*[C.truthy(F.col(c)) for c in cols]).alias(name) for name, cols in fields.items()])
    found = up.join(side, "folder").groupBy("path").agg(*[F.max_by(name, F.when(F.col(name).isNotNull(), F.col("depth"))).alias(name) for name in fields])
    return files.select("path").join(found, "path", "left")


def sync_labels(df: DataFrame) -> DataFrame:
    """Parsed labels and flags where there are such, else defaults; from_parser tells which."""
    ok = F.coalesce(F.col("parse_succeeded"), F.lit(False)) & C.truthy(F.col("label")).isNotNull()
    return df.withColumns(
        {
            "label": F.when(ok, F.col("label")).otherwise("OTHER"),
            "label_confidence": F.when(ok, F.coalesce("label_confidence", F.lit(0.0))).otherwise(0.0), "from_parser": ok,
        }
    )


def code_class(df: DataFrame, col: str, letters: tuple[str, str], rules: list[tuple[int, int, str]], default: str = "group") -> DataFrame:
    """Counts of two letters in a composition code and the class of the first rule (n1, n2, class) that equals them.

    review: other letters, or a code without either.
    """
    code = F.upper(F.coalesce(F.col(col), F.lit("")))
    count = lambda x: F.length(F.regexp_replace(code, f"[^{x}]", ""))
    a, b = count(letters[0]), count(letters[1])
    name = F.when(a + b == 0, F.lit("unknown")).otherwise(default)
    for x, y, c in reversed(rules):
        name = F.when((a == x) & (b == y), F.lit(c)).otherwise(name)
    odd = F.length(F.regexp_replace(code, f"[{letters[0]}{letters[1]}]", "")) > 0
    return df.withColumns({"n_first": a, "n_second": b, "code_class": name, "review": odd | (a + b == 0)})


def primary_type(df: DataFrame, priority: list[str], count_fallback: list[tuple[int, str]], default: str = "general") -> DataFrame:
    """The first of priority among the tags; else by the number of contributors, the first (at least, type) that holds."""
    out = F.lit(default)
    for least, name in reversed(sorted(count_fallback, reverse=True)):
        out = F.when(F.col("n_contributors") >= least, F.lit(name)).otherwise(out)
    for tag in reversed(priority):
        out = F.when(F.array_contains("tags", tag), F.lit(tag)).otherwise(out)
    return df.withColumn("primary_type", out)


def scene_status(logs: DataFrame, reviews: DataFrame, enough: int = 6) -> DataFrame:
    """REVIEWED where a final review exists, else REVIEW from `enough` picks on, DRAFT above none, FAILED."""
    done = reviews.where("finalized").select("scene_id").distinct().withColumn("_done", F.lit(True))
    status = F.when(F.col("_done"), "REVIEWED").when(F.col("picks") >= enough, "REVIEW").when(F.col("picks") > 0, "DRAFT").otherwise("FAILED")
    return logs.join(done, "scene_id", "left").withColumn("status", status).drop("_done")


#: Stage time: (from, to), columns of seconds since some start.
STAGES = {"download_sec": ("download_started", "download_finished"), "wait_sec": ("wait_started", "pipeline_started"), "pipeline_sec": ("pipeline_started", "pipeline_finished")}


def latency_per_unit(df: DataFrame, stages: dict[str, tuple[str, str]] = STAGES) -> DataFrame:
    """latency_ms: milliseconds of work a second of video, null for no duration, 1 place; and each stage's time, 2 places,
    null where an end of it is missing or 0 (not reached)."""
    at = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    spans = {name: F.round(at(b) - at(a), 2) for name, (a, b) in stages.items()}
    return df.withColumns({"latency_ms": F.when(F.col("video_sec") > 0, F.round(F.col("elapsed_sec") * 1000 / F.col("video_sec"), 1)), **spans})


def bottleneck(df: DataFrame, stages: list[str]) -> DataFrame:
    """bottleneck: the stage column with the most time, the first of equals; need_data if none is positive."""
    best = F.array_max(F.array(*[F.struct(F.coalesce(F.col(s), F.lit(0.0)).alias("v"), F.lit(-i).alias("o"), F.lit(s).alias("s")) for i, s in enumerate(stages)]))
    return df.withColumn("bottleneck", F.when(best["v"] > 0, best["s"]).otherwise("need_data"))


def hash_bucket(df: DataFrame, token_col: str, mod: int = 1000) -> DataFrame:
    return df.withColumn("bucket", C.hash_fraction(F.col(token_col), mod) / mod)


def artifact_name(df: DataFrame) -> DataFrame:
    """name: zero-padded rank, scene, label and MMmSSs."""
    t = F.floor("timestamp_sec").cast("int")
    return df.withColumn("name", F.format_string("%02d_%s_%s_%02dm%02ds.jpg", "rank", "scene_id", F.lower("label"), F.floor(t / 60).cast("int"), t % 60))


def token_priority(df: DataFrame, col: str, priority: list[str]) -> DataFrame:
    """tokens: distinct, those of the priority list first in its order, then the others by alphabet."""
    known = F.filter(F.array(*map(F.lit, priority)), lambda x: F.array_contains(F.col(col), x))
    rest = F.array_sort(F.array_except(F.array_distinct(col), F.array(*map(F.lit, priority))))
    return df.withColumn("tokens", F.concat(known, rest))


def title_fit(df: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, channel, fits, warnings) for each title and channel rule (title_min, title_max, banned_terms)."""
    r = C.small(rules.select("channel", "title_min", "title_max", "banned_terms"))
    n = F.length(F.coalesce("title", F.lit("")))
    banned = F.exists("banned_terms", lambda t: F.contains(F.lower("title"), F.lower(t)))
    warn = F.filter(
        F.array(
            F.when(n < F.col("title_min"), F.lit("too_short")), F.when(n > F.col("title_max"), F.lit("too_long")),
            F.when(banned, F.lit("banned_term"))
        ),
        lambda x: x.isNotNull()
    )
    return df.crossJoin(r).select(key, "channel", n.between(F.col("title_min"), F.col("title_max")).alias("fits"), warn.alias("warnings"))


def apply_rule_pack(titles: DataFrame, banned: list[str], required: list[str], prefix: str = "", suffix: str = "", boost: list[str] = (), limit: int = 110) -> DataFrame:
    """titles (key, text): those with a banned term go; the first required token, prefix and suffix are added where
    absent and the title stays within limit; boosted says whether a boosted term occurs."""
    low = F.lower("text")
    has = lambda words: sum((F.when(F.contains(low, F.lit(w.lower())), 1).otherwise(0) for w in words), F.lit(0)) > 0
    kept = titles.where(~has(banned)) if banned else titles
    text = F.col("text")
    if required:
        more = F.concat(text, F.lit(f" {required[0]}"))
        text = F.when(~has(required) & (F.length(more) <= limit), more).otherwise(text)
    if prefix:
        more = F.concat(F.lit(prefix), text)
        text = F.when(~F.startswith(F.lower(text), F.lit(prefix.lower())) & (F.length(more) <= limit), more).otherwise(text)
    if suffix:
        more = F.concat(text, F.lit(suffix))
        text = F.when(~F.endswith(F.lower(text), F.lit(suffix.lower())) & (F.length(more) <= limit), more).otherwise(text)
    return kept.withColumns({"text": text, "boosted": has(list(boost))})


def sentence_dedup(df: DataFrame, col: str) -> DataFrame:
    """The text's sentences, each once by its lower-cased form, joined by a blank."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(col), F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn("deduped", F.array_join(first_by_key(parts, F.lower), " "))


def supported_candidates(df: DataFrame, min_conf: float = 0.25, base: str = "base", prior: str = "prior") -> DataFrame:
    """Rows sure enough or with the base source, unless priors are all they have."""
    other = F.array_except("sources", F.array(F.lit(prior)))
    return df.where(((F.col("confidence") >= min_conf) | F.array_contains("sources", base)) & (F.size(other) > 0))


def context_digest(df: DataFrame, max_chars: int = 120, top: int = 5) -> DataFrame:
    """df (scene_id, label, weight) -> (scene_id, digest): the top labels with their weights, cut to max_chars."""
    n = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("weight"), "label"))
    ranked = df.withColumn("_n", n).where(F.col("_n") <= top)
    item = F.concat("label", F.lit("="), F.format_string("%.2f", "weight"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_n", item.alias("s")))), lambda x: x["s"])
    return ranked.groupBy("scene_id").agg(F.substring(F.array_join(parts, "; "), 1, max_chars).alias("digest"))


def time_window_filter(df: DataFrame, ts_col: str, days: int, as_of: str, keep_unparsed: bool) -> DataFrame:
    """Rows of the last `days` days before as_of; rows whose time does not parse stay or go as asked."""
    t = F.try_to_timestamp(F.col(ts_col))
    recent = t >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(F.when(t.isNull(), F.lit(keep_unparsed)).otherwise(recent))

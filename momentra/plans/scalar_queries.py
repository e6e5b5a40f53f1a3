"""Queries of the scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentra.operators import scalars as S
from momentra.plans.registry import query
from momentra.plans.tables import FEEDBACK, LOGS, OBS, PHASES, ZONED, feedback, frame_obs, joined, run_timing, scene_log, scenes, table, values, zoned


@query("zone_tags", f"WITH {ZONED} SELECT obs_id, array_to_string(zone_tags, '|') AS zone_tags FROM zoned")
def _(spark, sf):
    return zoned(spark, sf).select("obs_id", joined("zone_tags").alias("zone_tags"))


SCENE = OBS + ", scene AS (SELECT scene_id, max(duration_sec) AS duration_sec FROM frame_obs GROUP BY scene_id)"
SCALES = [(0.0, 600.0, 1.0), (600.0, 3300.0, 1.5), (3300.0, None, 2.25)]


@query("adaptive_interval", f"""
    WITH {SCENE} SELECT scene_id, CASE WHEN duration_sec < 600 THEN 2.0::DOUBLE WHEN duration_sec < 3300 THEN 3.0::DOUBLE ELSE 4.0::DOUBLE END AS interval_sec
    FROM scene""")
def _(spark, sf):
    return S.adaptive_interval(scenes(frame_obs(spark, sf)), 2.0, values(spark, SCALES, "lo double, hi double, scale double"), 4.0).select("scene_id", "interval_sec")


@query("duration_cap", f"""
    WITH {SCENE} SELECT scene_id, CASE WHEN duration_sec >= 60 AND duration_sec < 3000 THEN 12 WHEN duration_sec >= 3000 AND duration_sec < 3450 THEN 18 ELSE 15 END AS cap
    FROM scene""")
def _(spark, sf):
    return S.duration_cap(scenes(frame_obs(spark, sf)), values(spark, [(60.0, 3000.0, 12), (3000.0, 3450.0, 18)], "lo double, hi double, cap int")).select("scene_id", "cap")


@query("score_window", f"""
    WITH {OBS} SELECT obs_id, CASE WHEN score BETWEEN 80 AND 100 THEN 30.0::DOUBLE WHEN score BETWEEN 50 AND 79.99 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS window_sec,
        CASE WHEN score BETWEEN 80 AND 100 THEN 5.0::DOUBLE WHEN score BETWEEN 50 AND 79.99 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS step_sec
    FROM frame_obs""")
def _(spark, sf):
    return S.score_window(frame_obs(spark, sf), windows_of(spark)).select("obs_id", "window_sec", "step_sec")


def windows_of(spark):
    return values(spark, [(80.0, 100.0, 30.0, 5.0), (50.0, 79.99, 20.0, 10.0)], "lo double, hi double, window_sec double, step_sec double")


@query("tier_assign", f"""
    WITH {OBS} SELECT obs_id, CASE WHEN sharpness >= 300 AND motion <= 2 THEN 'TIER_1' WHEN sharpness >= 120 AND motion <= 3 THEN 'TIER_2' WHEN sharpness >= 60 AND motion <= 4.5 THEN 'TIER_3' END AS tier
    FROM frame_obs""")
def _(spark, sf):
    return S.tier_assign(frame_obs(spark, sf), {"TIER_1": 300, "TIER_2": 120, "TIER_3": 60}, {"TIER_1": 2, "TIER_2": 3, "TIER_3": 4.5}).select("obs_id", "tier")


SIEVED = OBS + """,
first AS (SELECT *, CASE WHEN brightness < 0.1 THEN 'dark' WHEN sharpness < 50 THEN 'below_floor' WHEN motion > 4.5 THEN 'high_motion' END AS why FROM frame_obs),
fit AS (SELECT scene_id, list({'id': obs_id, 'h': phash} ORDER BY timestamp_sec, obs_id) AS rows FROM first WHERE why IS NULL GROUP BY scene_id),
passed AS (SELECT scene_id, unnest(list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: bit_count(xor(y.h, x[1].h)) <= 5)) = 0 THEN list_concat(acc, x) ELSE acc END, [])) AS p FROM fit),
sieved AS (SELECT first.*, coalesce(why, CASE WHEN p.id IS NULL THEN 'duplicate' ELSE 'passed' END) AS drop_reason FROM first LEFT JOIN passed ON p.id = obs_id)"""


@query("obs_sieve", f"WITH {SIEVED} SELECT scene_id, floor(timestamp_sec / 600)::BIGINT AS segment, drop_reason, count(*) AS n FROM sieved GROUP BY ALL")
def _(spark, sf):
    x = S.obs_sieve(frame_obs(spark, sf).withColumn("floor", F.lit(50.0)))
    return S.sieve_counts(x, ["scene_id", F.floor(F.col("timestamp_sec") / 600).alias("segment")])


@query("candidate_priority", f"""
    WITH {ZONED} SELECT obs_id, round(sharpness - least(50, greatest(0, (motion - 1) * 10)) + CASE WHEN list_contains(zone_tags, 'late') THEN 200 ELSE 0 END + CASE WHEN list_contains(zone_tags, 'build') THEN 120 ELSE 0 END,
            4) AS priority FROM zoned""")
def _(spark, sf):
    return S.candidate_priority(zoned(spark, sf)).select("obs_id", F.round("priority", 4).alias("priority"))


@query("reservoir_priority", f"""
    WITH {ZONED} SELECT obs_id, round(CASE tier WHEN 'TIER_1' THEN 300 WHEN 'TIER_2' THEN 200 ELSE 100 END + CASE WHEN list_contains(zone_tags, 'late') THEN 45 ELSE 0 END + CASE WHEN list_contains(zone_tags, 'build') THEN 30 ELSE 0 END + least(sharpness / 20, 50),
            4) AS priority FROM zoned""")
def _(spark, sf):
    return S.reservoir_priority(zoned(spark, sf)).select("obs_id", F.round("priority", 4).alias("priority"))


FUSED = ZONED + """, fused AS (SELECT *, score * 0.7::DOUBLE + greatest(0.0::DOUBLE, least(100.0::DOUBLE, sharpness / 10.0::DOUBLE)) * 0.3::DOUBLE + (CASE WHEN list_contains(zone_tags, 'late') THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN list_contains(zone_tags, 'build') THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END) AS fused
        FROM zoned WHERE parse_succeeded AND score > 0)"""


@query("fused_score", f"WITH {FUSED} SELECT obs_id, round(fused, 4) AS fused FROM fused")
def _(spark, sf):
    return S.fused_score(zoned(spark, sf)).select("obs_id", F.round("fused", 4).alias("fused"))


@query("quality_adjust", f"""
    WITH {OBS}, a AS (SELECT obs_id, score + CASE WHEN sharpness < 60 THEN -10.0::DOUBLE WHEN sharpness < 200 THEN 0.0::DOUBLE ELSE 4.5::DOUBLE END + greatest(-2.0::DOUBLE, least(2.0::DOUBLE, (label_confidence - 0.5::DOUBLE) * 4)) + CASE WHEN model_score_raw IS NULL THEN 0.0::DOUBLE ELSE greatest(-2.0::DOUBLE, least(2.0::DOUBLE, (model_score_raw - score) * 0.1::DOUBLE)) END AS x
        FROM frame_obs)
    SELECT obs_id, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, x))::VARCHAR::DECIMAL(38, 20), 1)::DOUBLE AS adjusted
    FROM a""")
def _(spark, sf):
    return S.quality_adjust(frame_obs(spark, sf), bands_of(spark)).select("obs_id", "adjusted")


def bands_of(spark):
    return values(spark, [(0.0, 60.0, -10.0), (60.0, 200.0, 0.0), (200.0, None, 4.5)], "lo double, hi double, adj double")


def responses(spark, sf):
    """Scorer texts made from the events: a score, a confidence, a label, codes, and a fail code for some."""
    x = frame_obs(spark, sf)
    text = F.concat(
        F.lit("SCORE: "), F.col("k").cast("string"), F.lit("\nConfidence: 0."), F.lpad(F.col("k").cast("string"), 2, "0"), F.lit("\nlabel: "),
        F.lower("label"), F.lit("-view\nBONUS: B1, B2, b1\nPENALTY: "), F.when(F.col("k") % 2 == 0, "none").otherwise("P1"),
        F.when(F.col("k") % 9 == 0, "\nFAIL: blocked").otherwise("")
    )
    return x.select("scene_id", "obs_id", (F.col("k") % 10 != 0).alias("ok"), text.alias("raw_text"))


@query("parse_response", f"""
    WITH {OBS} SELECT obs_id, CASE WHEN k % 10 <> 0 THEN CASE WHEN k % 9 = 0 THEN 0.0::DOUBLE ELSE k::DOUBLE END END AS score, k % 10 <> 0 AS parse_succeeded,
        CASE WHEN k % 9 = 0 THEN 'BLOCKED' END AS fail_code, k % 10 <> 0 AND k % 9 <> 0 AS gate_pass, 'B1|B2' AS bonus_codes, CASE WHEN k % 2 = 0 THEN '' ELSE 'P1' END AS penalty_codes,
        label || '_VIEW' AS label, k / 100.0::DOUBLE AS label_confidence FROM frame_obs""")
def _(spark, sf):
    x = S.parse_response(responses(spark, sf), ["BLOCKED"])
    return x.select(
        "obs_id", "score", "parse_succeeded", "fail_code", "gate_pass", joined("bonus_codes").alias("bonus_codes"),
        joined("penalty_codes").alias("penalty_codes"), "label", "label_confidence"
    )


@query("rubric_score", f"""
    WITH {OBS} SELECT obs_id, CASE WHEN len(flags) > 0 THEN least(96.0::DOUBLE, 60.0::DOUBLE + CASE WHEN list_contains(flags, 'five') THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN list_contains(flags, 'eleven') THEN -15.0::DOUBLE ELSE 0.0::DOUBLE END) END AS rubric
    FROM frame_obs""")
def _(spark, sf):
    w = values(spark, [("five", 40.0), ("eleven", -15.0)], "code string, weight double")
    return S.rubric_score(frame_obs(spark, sf).select("obs_id", F.col("flags").alias("codes")), w, 60.0, [(0, 96.0), (2, 98.8), (3, 100.0)])


@query("normalize_label", "SELECT event_id, CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'view' THEN 'WATCH' ELSE 'OTHER' END AS label_norm FROM events")
def _(spark, sf):
    x = table(spark, sf, "events").select("event_id", F.concat(F.lit(" "), "event_type").alias("raw_label"))
    a = values(spark, [("VIEW", "WATCH")], "raw string, canonical string")
    return S.normalize_label(x, "raw_label", a, ["CLICK", "WATCH"], "OTHER").select("event_id", "label_norm")


@query("clean_label", "SELECT p_partkey, replace(upper(p_name), ' ', '_') AS label_clean FROM part")
def _(spark, sf):
    x = table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit("! ")).alias("x"))
    return S.clean_label(x, "x").select("p_partkey", F.regexp_replace("label_clean", "_+$", "").alias("label_clean"))


@query("parse_tokens", "SELECT p_partkey, array_to_string(list_filter([p_name, p_type, p_brand], lambda x: true), '|') AS tokens FROM part")
def _(spark, sf):
    x = table(spark, sf, "part").select(
        "p_partkey",
        F.concat("p_name", F.lit(" ,; "), F.upper("p_name"), F.lit("\n"), "p_type", F.lit("|  "), F.lower("p_type"), F.lit(";"), "p_brand").alias("t")
    )
    return S.parse_tokens(x, "t").select("p_partkey", joined("tokens").alias("tokens"))


@query("reason_codes", """
    SELECT o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') || '|s_' || lower(o_orderstatus) AS codes
    FROM orders""")
def _(spark, sf):
    x = table(spark, sf, "orders").select("o_orderkey", F.array("o_orderpriority", F.concat(F.lit("S: "), "o_orderstatus"), "o_orderpriority").alias("r"))
    return S.reason_codes(x, "r").select("o_orderkey", joined("codes").alias("codes"))


@query("norm_score", """
    SELECT event_id, CASE WHEN value BETWEEN 0 AND 10 THEN round((value * 10)::DECIMAL(18, 6), 1)::DOUBLE WHEN value BETWEEN 0 AND 100 THEN round(value::DECIMAL(18, 6),
            1)::DOUBLE END AS score_100 FROM events""")
def _(spark, sf):
    return S.norm_score(table(spark, sf, "events"), "value").select("event_id", "score_100")


@query("decision_rank", f"WITH {FEEDBACK} SELECT doc_id, CASE decision WHEN 'keep' THEN 2 WHEN 'maybe' THEN 1 WHEN 'reject' THEN 0 END AS rank FROM feedback")
def _(spark, sf):
    return S.decision_rank(feedback(spark, sf).withColumn("decision", F.upper("decision")), "decision").select("doc_id", "rank")


@query("dominant_label", f"""
    WITH {OBS} SELECT obs_id, CASE WHEN k % 4 = 0 THEN 'hinted' WHEN label <> 'ERROR' THEN label WHEN len(flags) > 0 THEN flags[1] ELSE type END AS dominant
    FROM frame_obs""")
def _(spark, sf):
    none = F.array().cast("array<string>")
    x = frame_obs(spark, sf).withColumns(
        {
            "hint": F.when(F.col("k") % 4 == 0, "hinted").otherwise(" "),
            "label": F.when(F.col("label") == "ERROR", "OTHER").otherwise(F.col("label")), "group_tags": none, "subgroup_tags": F.array(F.lit("")),
        }
    )
    return S.dominant_label(x).select("obs_id", "dominant")


@query("obs_confidence", f"""
    WITH {OBS} SELECT obs_id, round(least(1, CASE WHEN label_confidence > 0 THEN label_confidence ELSE score / 100 END), 4) AS confidence
    FROM frame_obs""")
def _(spark, sf):
    return S.obs_confidence(frame_obs(spark, sf)).select("obs_id", F.round("confidence", 4).alias("confidence"))


BUCKETED = OBS + """, bucketed AS (SELECT *, CASE WHEN tier = 'TIER_1' THEN 'best' WHEN type = 'wide' THEN 'wide' WHEN label = 'CLICK' AND label_confidence >= 0.6 THEN 'click' ELSE 'other' END AS bucket
        FROM frame_obs)"""


def bucketed(spark, sf):
    rules = values(
        spark, [(1, "TIER_1", None, None, None, "best"), (2, None, "wide", None, None, "wide"), (3, None, None, "CLICK", 0.6, "click")],
        "priority int, tier string, type string, label string, min_confidence double, bucket string"
    )
    return S.quota_bucket(frame_obs(spark, sf), rules)


@query("quota_bucket", f"WITH {BUCKETED} SELECT obs_id, bucket FROM bucketed")
def _(spark, sf):
    return bucketed(spark, sf).select("obs_id", "bucket")


VALID = OBS + """, v AS (SELECT *, list_filter([CASE WHEN NOT parse_succeeded THEN 'unparsed' END, CASE WHEN score < 40 THEN 'low_score' END, CASE WHEN sharpness < 60 THEN 'low_sharpness' END], lambda x: x IS NOT NULL) AS rejects,
            list_filter([CASE WHEN label_confidence < 0.4 THEN 'low_confidence' END, CASE WHEN model_score_raw IS NULL THEN 'no_raw_score' END], lambda x: x IS NOT NULL) AS warnings
        FROM frame_obs)"""


@query("validate_obs", f"""
    WITH {VALID} SELECT obs_id, array_to_string(rejects, '|') AS reject_codes, array_to_string(warnings, '|') AS warnings, len(rejects) = 0 AS eligible
    FROM v""")
def _(spark, sf):
    return S.validate_obs(frame_obs(spark, sf)).select("obs_id", joined("reject_codes").alias("reject_codes"), joined("warnings").alias("warnings"), "eligible")


@query("record_quality", f"""
    WITH {FEEDBACK} SELECT doc_id, round(CASE WHEN trim(title) <> '' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN decision IS NOT NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + 0.1::DOUBLE,
            3) AS record_quality FROM feedback""")
def _(spark, sf):
    return S.record_quality(feedback(spark, sf), {"title": 0.4, "decision": 0.5, "scene_id": 0.1}).select("doc_id", "record_quality")


@query("curation_quality", f"""
    WITH {FEEDBACK}, c AS (SELECT doc_id, length(title) AS a, length(text) AS b, (doc_id % 8)::INTEGER AS n, list_contains(regexp_split_to_array(lower(title), '[^a-z0-9]+'), 'the')::INTEGER + list_contains(regexp_split_to_array(lower(title), '[^a-z0-9]+'), 'of')::INTEGER AS g
        FROM feedback),
    s AS (SELECT *, CASE WHEN a BETWEEN 18 AND 110 THEN 1.5 WHEN a > 0 THEN 0.5 ELSE 0 END AS x, CASE WHEN b >= 200 THEN 1.5 WHEN b >= 80 THEN 1 WHEN b > 0 THEN 0.3 ELSE 0 END AS y,
            CASE WHEN n >= 5 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END AS z FROM c)
    SELECT doc_id, round(greatest(0, least(5, x + y + z - least(1.5, g * 0.5)))::DOUBLE, 2) AS curation_score, array_to_string(list_filter([CASE WHEN x > 0 THEN 'title_length' END, CASE WHEN y > 0 THEN 'long_text' END, CASE WHEN z > 0 THEN 'tag_count' END, CASE WHEN g > 0 THEN 'generic_words' END], lambda v: v IS NOT NULL),
            '|') AS curation_reasons FROM s""")
def _(spark, sf):
    x = feedback(spark, sf).withColumns({"description": F.col("text"), "tags": F.slice(F.array(*[F.lit(str(i)) for i in range(8)]), F.lit(1), (F.col("doc_id") % 8).cast("int"))})
    return S.curation_quality(x, ["the", "of"]).select("doc_id", "curation_score", joined("curation_reasons").alias("curation_reasons"))


@query("acceptance_score", f"""
    WITH {LOGS}, a AS (SELECT scene_id, n, CASE n % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.65::DOUBLE ELSE 0.5::DOUBLE END AS b
        FROM scene_log)
    SELECT scene_id, round(greatest(0, CASE WHEN n % 2 = 0 THEN least(1.0::DOUBLE, b + 0.1::DOUBLE) ELSE b END - least(0.6::DOUBLE, (n % 10) * 0.08::DOUBLE)),
            4) AS acceptance FROM a""")
def _(spark, sf):
    n = F.col("n")
    x = scene_log(spark, sf).withColumns(
        {
            "acceptance_label": F.when(n % 3 == 0, "unchanged").when(n % 3 == 1, "edited").otherwise("rewritten"), "ready": n % 2 == 0,
            "blockers": n % 10,
        }
    )
    return S.acceptance_score(x).select("scene_id", "acceptance")


@query("dictionary_tags", """
    SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '\\d{2,}') THEN 'numbers' END, CASE WHEN regexp_matches(lower(text), '\\bthe\\b') OR regexp_matches(lower(text), '\\bwith\\b') THEN 'the_word' END], lambda x: x IS NOT NULL),
            '|') AS tags FROM documents""")
def _(spark, sf):
    p = values(spark, [("the_word", r"\bthe\b"), ("the_word", r"\bwith\b"), ("numbers", r"\d{2,}")], "tag string, pattern string")
    return S.dictionary_tags(table(spark, sf, "documents"), "text", p, "doc_id").select("doc_id", joined("tags").alias("tags"))


@query("source_detect", """
    SELECT page_id, CASE WHEN contains(lower(url), 'blog.') THEN 'blogs' WHEN contains(lower(url), 'example.com') THEN 'com' WHEN contains(lower(url),
            'example') THEN 'example' END AS source FROM pages""")
def _(spark, sf):
    p = values(spark, [(3, "example", "example"), (2, "com", "Example.com"), (1, "blogs", "blog.")], "ord int, source string, needle string")
    return S.source_detect(table(spark, sf, "pages"), "url", p, "page_id")


#: Words of the benchmark's items as a dictionary: a tag for each pair of first letters.
WORDS = "words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM benchmark)"


def words(spark, sf):
    return table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("w")).distinct()


@query("dictionary_tags_many", f"""
    WITH {WORDS}, t AS (SELECT doc_id, lower(text) AS low FROM documents), p AS (SELECT substr(w, 1, 2) AS tag, w, CASE WHEN length(w) % 2 = 0 THEN '[ .,]' || w ELSE w || '[a-z]' END AS pattern FROM words),
    h AS (SELECT DISTINCT doc_id, tag FROM t, p WHERE contains(low, w) AND regexp_matches(low, pattern))
    SELECT d.doc_id, coalesce(string_agg(tag, '|' ORDER BY tag), '') AS tags FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id""")
def _(spark, sf):
    pattern = F.when(F.length("w") % 2 == 0, F.concat(F.lit("[ .,]"), "w")).otherwise(F.concat("w", F.lit("[a-z]")))
    p = words(spark, sf).select(F.substring("w", 1, 2).alias("tag"), pattern.alias("pattern"))
    return S.dictionary_tags(table(spark, sf, "documents"), "text", p, "doc_id").select("doc_id", joined("tags").alias("tags"))


@query("source_detect_many", f"""
    WITH {WORDS}, t AS (SELECT doc_id, lower(text) AS low FROM documents), f AS (SELECT doc_id, min({{'o': length(w), 's': w}}) AS f FROM t, words WHERE contains(low, w) GROUP BY doc_id)
    SELECT doc_id, f.s AS source FROM documents LEFT JOIN f USING (doc_id)""")
def _(spark, sf):
    p = words(spark, sf).select(F.length("w").alias("ord"), F.col("w").alias("source"), F.upper("w").alias("needle"))
    return S.source_detect(table(spark, sf, "documents"), "text", p, "doc_id")


@query("inherit_metadata", """
    SELECT 'lib/' || c_mktsegment || '/' || (c_custkey % 50)::VARCHAR || '/f' || c_custkey::VARCHAR || '.mp4' AS path, CASE WHEN (c_custkey % 50) % 2 = 0 THEN 'deep' || (c_custkey % 50)::VARCHAR ELSE c_mktsegment END AS title,
        CASE WHEN (c_custkey % 50) % 5 = 0 THEN 't' || (c_custkey % 50)::VARCHAR END AS tags FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 50).cast("string").alias("m"))
    folder = F.concat(F.lit("lib/"), "c_mktsegment", F.lit("/"), "m")
    files = c.select(F.concat(folder, F.lit("/f"), F.col("c_custkey").cast("string"), F.lit(".mp4")).alias("path"))
    none = F.lit(None).cast("string")
    top = c.select(F.concat(F.lit("lib/"), "c_mktsegment").alias("folder"), F.lit(" ").alias("title"), F.col("c_mktsegment").alias("name"), none.alias("tags")).distinct()
    deep = c.select(
        folder.alias("folder"), F.when(F.col("m") % 2 == 0, F.concat(F.lit("deep"), "m")).alias("title"), none.alias("name"),
        F.when(F.col("m") % 5 == 0, F.concat(F.lit("t"), "m")).alias("tags")
    ).distinct()
    return S.inherit_metadata(files, top.unionByName(deep), {"title": ["title", "name"], "tags": ["tags"]})


@query("sync_labels", f"""
    WITH {OBS} SELECT obs_id, CASE WHEN parse_succeeded THEN label ELSE 'OTHER' END AS label, CASE WHEN parse_succeeded THEN label_confidence ELSE 0.0::DOUBLE END AS label_confidence,
        parse_succeeded AS from_parser FROM frame_obs""")
def _(spark, sf):
    return S.sync_labels(frame_obs(spark, sf)).select("obs_id", "label", "label_confidence", "from_parser")


@query("code_class", """
    WITH c AS (SELECT p_partkey, (p_size % 3)::INTEGER AS a, (p_partkey % 3)::INTEGER AS b, p_size % 7 = 0 AS odd
        FROM part)
    SELECT p_partkey, a AS n_first, b AS n_second, CASE WHEN a + b = 0 THEN 'unknown' WHEN a = 1 AND b = 0 THEN 'single' WHEN a = 1 AND b = 1 THEN 'pair' ELSE 'group' END AS code_class,
        odd OR a + b = 0 AS review FROM c""")
def _(spark, sf):
    x = table(spark, sf, "part").select(
        "p_partkey",
        F.concat(
            F.repeat(F.lit("a"), (F.col("p_size") % 3).cast("int")), F.repeat(F.lit("B"), (F.col("p_partkey") % 3).cast("int")),
            F.when(F.col("p_size") % 7 == 0, "x").otherwise("")
        ).alias("code")
    )
    return S.code_class(x, "code", ("A", "B"), [(1, 0, "single"), (1, 1, "pair")]).drop("code")


@query("primary_type", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' WHEN o_orderpriority = '5-LOW' THEN '5-LOW' WHEN o_orderkey % 6 >= 4 THEN 'crowd' WHEN o_orderkey % 6 >= 2 THEN 'pair' ELSE 'general' END AS primary_type
    FROM orders""")
def _(spark, sf):
    x = table(spark, sf, "orders").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("tags"), (F.col("o_orderkey") % 6).alias("n_contributors"))
    return S.primary_type(x, ["F", "5-LOW"], [(2, "pair"), (4, "crowd")]).select("o_orderkey", "primary_type")


def final_reviews(spark, sf):
    """A review for every third scene, every sixth final."""
    return scene_log(spark, sf).where("n % 3 = 0").select("scene_id", (F.col("n") % 6 == 0).alias("finalized"))


@query("scene_status", f"""
    WITH {LOGS} SELECT scene_id, CASE WHEN n % 6 = 0 THEN 'REVIEWED' WHEN picks >= 6 THEN 'REVIEW' WHEN picks > 0 THEN 'DRAFT' ELSE 'FAILED' END AS status
    FROM scene_log""")
def _(spark, sf):
    return S.scene_status(scene_log(spark, sf), final_reviews(spark, sf)).select("scene_id", "status")


@query("latency_per_unit", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 1000 / 50 AS latency_ms,
           CASE WHEN l_linenumber > 1 THEN l_quantity / 4 END AS download_sec, CASE WHEN l_linenumber < 5 THEN l_quantity END AS wait_sec, CASE WHEN l_linenumber < 5 AND l_linenumber <> 3 THEN l_quantity * 2 END AS pipeline_sec
    FROM lineitem""")
def _(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    at = {
        "download_started": F.when(n > 1, 100.0).otherwise(0.0), "download_finished": 100 + q / 4, "wait_started": F.lit(200.0),
        "pipeline_started": F.when(n < 5, 200 + q), "pipeline_finished": F.when(n != 3, 200 + q * 3),
    }
    x = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("elapsed_sec"), F.lit(50.0).alias("video_sec"),
        *[c.alias(k) for k, c in at.items()]
    )
    return S.latency_per_unit(x).drop("elapsed_sec", "video_sec", *at)


@query("bottleneck", f"""
    WITH {PHASES}, p AS (SELECT job_id, coalesce(max(sec) FILTER (phase = 'AF'), 0) AS a, coalesce(max(sec) FILTER (phase = 'NO'), 0) AS b, coalesce(max(sec) FILTER (phase = 'RF'), 0) AS c
        FROM phase_rows GROUP BY job_id)
    SELECT job_id, CASE WHEN greatest(a, b, c) <= 0 THEN 'need_data' WHEN a >= b AND a >= c THEN 'AF' WHEN b >= c THEN 'NO' ELSE 'RF' END AS bottleneck
    FROM p""")
def _(spark, sf):
    x = run_timing(spark, sf).select("job_id", *[F.col("phases")[p].alias(p) for p in ("AF", "NO", "RF")])
    return S.bottleneck(x, ["AF", "NO", "RF"]).select("job_id", "bottleneck")


@query("hash_bucket", "SELECT c_custkey, (('0x' || substr(sha1(c_name), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE AS bucket FROM customer")
def _(spark, sf):
    return S.hash_bucket(table(spark, sf, "customer"), "c_name").select("c_custkey", "bucket")


@query("artifact_name", f"""
    WITH {OBS} SELECT obs_id, lpad((k % 40)::VARCHAR, 2, '0') || '_' || scene_id || '_' || lower(label) || '_' || lpad((floor(timestamp_sec)::BIGINT // 60)::VARCHAR,
            2, '0') || 'm' || lpad((floor(timestamp_sec)::BIGINT % 60)::VARCHAR, 2, '0') || 's.jpg' AS name
    FROM frame_obs""")
def _(spark, sf):
    return S.artifact_name(frame_obs(spark, sf).withColumn("rank", F.col("k") % 40)).select("obs_id", "name")


@query("token_priority", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'P|' ELSE '' END || CASE WHEN o_orderpriority = '2-HIGH' THEN '2-HIGH|' ELSE '' END || array_to_string(list_sort(list_filter(['zz', o_orderstatus, o_orderpriority], lambda x: x NOT IN ('P', '2-HIGH'))),
            '|') AS tokens FROM orders""")
def _(spark, sf):
    x = table(spark, sf, "orders").select("o_orderkey", F.array(F.lit("zz"), "o_orderstatus", "o_orderpriority", F.lit("zz")).alias("t"))
    return S.token_priority(x, "t", ["P", "2-HIGH"]).select("o_orderkey", joined("tokens").alias("tokens"))


CHANNEL_RULES = [("alpha", 10, 22, ["urgent"]), ("beta", 20, 40, [])]


@query("title_fit", f"""
    WITH {LOGS}, r(channel, lo, hi, bad) AS (VALUES ('alpha', 10, 22, 'urgent'), ('beta', 20, 40, '~'))
    SELECT scene_id, channel, length(title) BETWEEN lo AND hi AS fits, array_to_string(list_filter([CASE WHEN length(title) < lo THEN 'too_short' END, CASE WHEN length(title) > hi THEN 'too_long' END, CASE WHEN contains(lower(title), bad) THEN 'banned_term' END], lambda x: x IS NOT NULL),
            '|') AS warnings FROM scene_log, r""")
def _(spark, sf):
    r = values(spark, CHANNEL_RULES, "channel string, title_min int, title_max int, banned_terms array<string>")
    return S.title_fit(scene_log(spark, sf), r, "scene_id").withColumn("warnings", joined("warnings"))


@query("apply_rule_pack", f"""
    WITH {LOGS} SELECT scene_id, 'New: ' || title || CASE WHEN contains(lower(title), 'medium') THEN '' ELSE ' MEDIUM' END || '!' AS text, contains(lower(title),
            'low') AS boosted FROM scene_log WHERE NOT contains(lower(title), 'urgent')""")
def _(spark, sf):
    x = scene_log(spark, sf).select("scene_id", F.col("title").alias("text"))
    return S.apply_rule_pack(x, ["urgent"], ["MEDIUM"], "New: ", "!", ["low"])


@query("sentence_dedup", "SELECT o_orderkey, o_orderpriority || '. Next ' || o_orderstatus || '!' AS deduped FROM orders")
def _(spark, sf):
    x = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(
            "o_orderpriority", F.lit(". Next "), "o_orderstatus", F.lit("! "), F.upper("o_orderpriority"), F.lit(".  next "),
            F.lower("o_orderstatus"), F.lit("!")
        ).alias("t")
    )
    return S.sentence_dedup(x, "t").select("o_orderkey", "deduped")


@query("supported_candidates", f"WITH {OBS} SELECT obs_id FROM frame_obs WHERE (label_confidence >= 0.25 OR k % 3 = 0) AND k % 4 <> 0")
def _(spark, sf):
    k = F.col("k")
    x = frame_obs(spark, sf).select(
        "obs_id", F.col("label_confidence").alias("confidence"),
        F.when(k % 4 == 0, F.array(F.lit("prior"))).when(
            k % 3 == 0, F.array(F.lit("base"), F.lit("prior"))
        ).otherwise(F.array(F.lit("model"))).alias("sources")
    )
    return S.supported_candidates(x).select("obs_id")


@query("context_digest", f"""
    WITH {OBS}, g AS (SELECT scene_id, label, count(*) / 100.0::DOUBLE AS w FROM frame_obs GROUP BY ALL)
    SELECT scene_id, string_agg(label || '=' || printf('%.2f', w), '; ' ORDER BY w DESC, label) AS digest
    FROM g GROUP BY scene_id""")
def _(spark, sf):
    x = frame_obs(spark, sf).groupBy("scene_id", "label").agg((F.count(F.lit(1)) / 100.0).alias("weight"))
    return S.context_digest(x, 200, 9)


@query("time_window_filter", f"WITH {LOGS} SELECT scene_id FROM scene_log WHERE n % 10 = 0 OR processed_at >= TIMESTAMP '1999-06-01' - INTERVAL 400 DAY")
def _(spark, sf):
    x = scene_log(spark, sf).withColumn("t", F.when(F.col("n") % 10 == 0, "soon").otherwise(F.date_format("processed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return S.time_window_filter(x, "t", 400, "1999-06-01", True).select("scene_id")

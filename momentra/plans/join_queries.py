"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentra.operators import aggregates as A
from momentra.operators import joins as J
from momentra.operators import windows as W
from momentra.plans.aggregate_queries import KPI, kpi_rows
from momentra.plans.registry import query
from momentra.plans.scalar_queries import final_reviews
from momentra.plans.tables import FEEDBACK, LOGS, OBS, feedback, frame_obs, joined, scene_log, table, values
from momentra.plans.window_queries import RUNS


def order_feedback(spark, sf):
    """Feedback on scenes: line items stand for the judged moments."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("scene_id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("operator_score")
    )


@query("feedback_by_source", f"""
    WITH {LOGS} SELECT scene_id, l_linenumber, l_partkey, l_suppkey, l_quantity AS operator_score, source
    FROM lineitem JOIN scene_log ON l_orderkey = n WHERE source = 'machinery'""")
def _(spark, sf):
    return J.feedback_by_source(order_feedback(spark, sf), scene_log(spark, sf).select("scene_id", "source"), "MACHINERY")


@query("review_enriched", f"""
    WITH {LOGS} SELECT scene_id, finalized, source, ndocs FROM (SELECT scene_id, n % 6 = 0 AS finalized, source, n
        FROM scene_log WHERE n % 3 = 0) LEFT JOIN (SELECT doc_id, n_chars AS ndocs FROM documents) ON doc_id = n""")
def _(spark, sf):
    insight = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("scene_id"), F.col("n_chars").alias("ndocs"))
    return J.review_enriched(final_reviews(spark, sf), scene_log(spark, sf).select("scene_id", "source"), insight)


@query("library_find", f"""
    WITH {LOGS} SELECT scene_id, top_score FROM scene_log WHERE source = 'building' AND contains(lower(title), 'high') AND top_score >= 20 AND picks >= 3 AND processed_at >= TIMESTAMP '1995-01-01' AND len(error_codes) > 0 AND NOT flagged AND n % 3 <> 0 AND n % 4 = 0
    ORDER BY top_score DESC, processed_at DESC, scene_id LIMIT 100""")
def _(spark, sf):
    logs = scene_log(spark, sf)
    ready = logs.select("scene_id", F.lit("alpha").alias("channel"), (F.col("n") % 4 == 0).alias("ready"))
    return J.library_find(
        logs, final_reviews(spark, sf), ready, source="Building", text="HIGH", min_score=20, min_picks=3, since="1995-01-01", has_errors=True,
        flagged=False, reviewed=False, channel="alpha"
    ).select("scene_id", "top_score")


@query("library_page", f"""
    WITH {LOGS}, s AS (SELECT *, CASE WHEN n % 6 = 0 THEN 'REVIEWED' WHEN picks >= 6 THEN 'REVIEW' WHEN picks > 0 THEN 'DRAFT' ELSE 'FAILED' END AS status
        FROM scene_log)
    SELECT scene_id, status, row_number() OVER (ORDER BY CASE status WHEN 'REVIEW' THEN 0 WHEN 'DRAFT' THEN 1 WHEN 'REVIEWED' THEN 2 ELSE 3 END, processed_at DESC,
            scene_id)::INTEGER AS place FROM s WHERE contains(lower(scene_id || ' ' || source || ' ' || title), 'urgent')
    QUALIFY place <= 24""")
def _(spark, sf):
    from momentra.operators.scalars import scene_status

    return J.library_page(scene_status(scene_log(spark, sf), final_reviews(spark, sf)), q="Urgent", sort="status").select("scene_id", "status", "place")


@query("exclude_seen", f"""
    WITH {OBS} SELECT obs_id FROM frame_obs a WHERE NOT EXISTS (SELECT 1 FROM frame_obs b WHERE b.k % 4 = 0 AND b.scene_id = a.scene_id AND floor(b.timestamp_sec * 10 + 0.5) = floor(a.timestamp_sec * 10 + 0.5))""")
def _(spark, sf):
    x = frame_obs(spark, sf)
    return J.exclude_seen(x, x.where("k % 4 = 0")).select("obs_id")


@query("exclude_near", f"""
    WITH {OBS} SELECT obs_id FROM frame_obs a WHERE NOT EXISTS (SELECT 1 FROM frame_obs b WHERE b.k % 9 = 0 AND b.scene_id = a.scene_id AND abs(b.timestamp_sec - a.timestamp_sec) <= 5)""")
def _(spark, sf):
    x = frame_obs(spark, sf)
    return J.exclude_near(x, x.where("k % 9 = 0"), 5.0).select("obs_id")


NEAR = OBS + """,
near AS (SELECT p.scene_id, p.obs_id, p.sharpness, o.dt, b.obs_id AS near_id, b.sharpness AS ns FROM (SELECT * FROM frame_obs WHERE score >= 40) p, (VALUES (-10.0::DOUBLE), (-5.0), (5.0), (10.0)) o(dt), frame_obs b
         WHERE b.scene_id = p.scene_id AND floor(b.timestamp_sec + 0.5) = floor(p.timestamp_sec + o.dt + 0.5))"""


@query("nearest_better", f"""
    WITH {NEAR}, best AS (SELECT scene_id, obs_id, sharpness, arg_max(near_id, (ns, -abs(dt), dt, -near_id)) AS i, max(ns) AS ns
        FROM near GROUP BY ALL)
    SELECT p.scene_id, p.obs_id, CASE WHEN ns - p.sharpness >= 35 AND ns - p.sharpness >= 0.12 * p.sharpness THEN i END AS better_id, CASE WHEN ns - p.sharpness >= 35 AND ns - p.sharpness >= 0.12 * p.sharpness THEN round(ns - p.sharpness,
            2) END AS gain FROM frame_obs p LEFT JOIN best USING (scene_id, obs_id) WHERE score >= 40""")
def _(spark, sf):
    x = frame_obs(spark, sf)
    return J.nearest_better(x.where("score >= 40"), x, [-10.0, -5.0, 5.0, 10.0])


@query("nearest_clearing_floor", f"""
    WITH {NEAR}, best AS (SELECT scene_id, obs_id, arg_min(near_id, (abs(dt), dt < 0, near_id)) AS near_id, arg_min(dt, (abs(dt), dt < 0, near_id)) AS dt
        FROM near WHERE ns >= 200 GROUP BY ALL)
    SELECT scene_id, obs_id, best.near_id, best.dt FROM frame_obs p LEFT JOIN best USING (scene_id, obs_id)
    WHERE score >= 40""")
def _(spark, sf):
    x = frame_obs(spark, sf)
    return J.nearest_clearing_floor(x.where("score >= 40"), x, [-10.0, -5.0, 5.0, 10.0], 200.0)


@query("temporal_support", f"""
    WITH {OBS} SELECT obs_id, label_confidence >= 0.85 OR EXISTS (SELECT 1 FROM frame_obs b WHERE b.scene_id = a.scene_id AND b.label = a.label AND b.obs_id <> a.obs_id AND b.label_confidence >= 0.6 AND b.timestamp_sec BETWEEN a.timestamp_sec - 45 AND a.timestamp_sec + 45) AS supported
    FROM frame_obs a""")
def _(spark, sf):
    return J.temporal_support(frame_obs(spark, sf)).select("obs_id", "supported")


@query("preference_pairs", f"""
    WITH {FEEDBACK}, p AS (SELECT (doc_id // 20)::VARCHAR AS scene_id, doc_id AS idx, CASE decision WHEN 'keep' THEN 2 WHEN 'maybe' THEN 1 WHEN 'reject' THEN 0 END AS r,
            coalesce(operator_score, -1) AS s FROM feedback),
    x AS (SELECT a.scene_id, a.idx AS i, b.idx AS j, CASE WHEN a.r <> b.r THEN a.r > b.r WHEN a.s <> b.s THEN a.s > b.s END AS f, coalesce(a.r <> b.r, false) AS by_rank
        FROM p a JOIN p b ON a.scene_id = b.scene_id AND a.idx < b.idx)
    SELECT scene_id, CASE WHEN f THEN i ELSE j END AS better, CASE WHEN f THEN j ELSE i END AS worse, CASE WHEN by_rank THEN 'rank' ELSE 'score' END AS by
    FROM x WHERE f IS NOT NULL""")
def _(spark, sf):
    from momentra.operators.scalars import decision_rank

    p = decision_rank(feedback(spark, sf), "decision").select(
        F.expr("cast(doc_id div 20 as string)").alias("scene_id"), F.col("doc_id").alias("idx"), "rank", F.col("operator_score").alias("score")
    )
    return J.preference_pairs(p)


RULES = """channel string, title_min int, title_max int, desc_min int, desc_max int, min_tags int, max_tags int, min_categories int, max_categories int, banned_terms array<string>,
        requires_identity_record boolean, requires_individual_releases boolean, min_width int, min_height int"""


def channel_rules(spark):
    return values(spark, [("alpha", 10, 25, 5, 400, 2, 3, 1, 2, ["urgent"], True, True, 640, 360), ("beta", 5, 40, 0, 90, 0, 9, 0, 5, [], False, True, 0, 0)], RULES)


def delivery(spark, sf):
    """What a scene would be delivered with: its title, texts and tags from the order."""
    n = F.col("n")
    tags = F.slice(F.array(*[F.lit(f"t{i}") for i in range(5)]), F.lit(1), (n % 5).cast("int"))
    return scene_log(spark, sf).select(
        "scene_id", "title", F.repeat(F.col("source"), (n % 12).cast("int")).alias("description"), tags.alias("tags"),
        F.slice(F.array(F.lit("c1"), F.lit("c2"), F.lit("c3")), F.lit(1), (n % 4).cast("int")).alias("categories"),
        F.when(F.col("flagged"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("flags"), (n % 10 != 0).alias("records_ok"),
        F.lit(1280).alias("width"), F.when(n % 9 == 0, 240).otherwise(720).alias("height"), "picks", n.alias("n")
    )


CHANNEL = LOGS + """,
d AS (SELECT *, length(title) AS tl, length(source) * (n % 12) AS dl, n % 5 AS nt, n % 4 AS nc, n % 9 = 0 AS lowres FROM scene_log),
cv AS (SELECT scene_id, 'alpha' AS channel, list_filter([CASE WHEN tl < 10 THEN 'title_short' END, CASE WHEN tl > 25 THEN 'title_long' END, CASE WHEN dl < 5 THEN 'description_short' END, CASE WHEN dl > 400 THEN 'description_long' END, CASE WHEN nt < 2 THEN 'few_tags' END, CASE WHEN nc < 1 THEN 'few_categories' END, CASE WHEN contains(lower(title), 'urgent') THEN 'banned_term' END, CASE WHEN n % 10 = 0 THEN 'no_records' END, CASE WHEN lowres THEN 'low_resolution' END], lambda x: x IS NOT NULL) AS b, list_filter([CASE WHEN nt > 3 THEN 'many_tags' END, CASE WHEN nc > 2 THEN 'many_categories' END, CASE WHEN flagged THEN 'flagged' END], lambda x: x IS NOT NULL) AS w, picks FROM d
       UNION ALL SELECT scene_id, 'beta', list_filter([CASE WHEN tl < 5 THEN 'title_short' END, CASE WHEN tl > 40 THEN 'title_long' END, CASE WHEN dl > 90 THEN 'description_long' END], lambda x: x IS NOT NULL), list_filter([CASE WHEN flagged THEN 'flagged' END], lambda x: x IS NOT NULL), picks FROM d),
cr AS (SELECT *, len(b) = 0 AS ready, bool_or(len(b) = 0) OVER (PARTITION BY scene_id) AND picks > 0 AS overall_ready FROM cv)"""


@query("channel_validate", f"""
    WITH {CHANNEL} SELECT scene_id, channel, array_to_string(b, '|') AS blockers, array_to_string(w, '|') AS warnings, ready, overall_ready
    FROM cr""")
def _(spark, sf):
    x = J.channel_validate(delivery(spark, sf), channel_rules(spark))
    return x.withColumns({"blockers": joined("blockers"), "warnings": joined("warnings")})


def registry(spark, sf):
    """A document registry: every customer has a release (for one channel or all), most an identity record; some have expired."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("n"), F.sha2(F.lower("c_name").cast("binary"), 256).alias("contributor_key"))
    n = F.col("n")
    none = F.array().cast("array<string>")
    at = F.when(n % 8 == 0, F.to_date(F.lit("2020-01-01"))).otherwise(F.to_date(F.lit("2030-01-01")))
    release = c.where(n % 6 != 0).select(
        "contributor_key", F.lit("release").alias("document_type"), F.concat(F.lit("r"), n).alias("path"),
        F.when(n % 2 == 0, F.array(F.lit("alpha"))).otherwise(none).alias("channels"), at.alias("expiry_date")
    )
    return release.unionByName(
        c.where(n % 5 != 0).select(
            "contributor_key", F.lit("identity").alias("document_type"), F.concat(F.lit("i"), n).alias("path"), none.alias("channels"),
            F.to_date(F.lit("2030-01-01")).alias("expiry_date")
        )
    )


def people(spark, sf):
    """The contributors of each scene: the order's customer and, for even orders, customer 1."""
    x = scene_log(spark, sf)
    key = lambda i: F.sha2(F.lower(F.concat(F.lit("Customer#"), F.lpad(i.cast("string"), 9, "0"))).cast("binary"), 256)
    return x.select(
        "scene_id",
        F.array_distinct(
            F.when(F.col("n") % 2 == 0, F.array(key(F.col("c_custkey")), key(F.lit(1)))).otherwise(F.array(key(F.col("c_custkey"))))
        ).alias("contributor_keys")
    )


RECORDS = LOGS + """,
who AS (SELECT scene_id, c_custkey AS c FROM scene_log UNION SELECT scene_id, 1 FROM scene_log WHERE n % 2 = 0),
each AS (SELECT scene_id, channel, c % 6 <> 0 AND c % 8 <> 0 AND (c % 2 <> 0 OR channel = 'alpha') AS release, c % 5 <> 0 OR channel = 'beta' AS identity FROM who, (VALUES ('alpha'), ('beta')) x(channel)),
rr AS (SELECT scene_id, channel, concat_ws('|', CASE WHEN bool_or(NOT identity) THEN 'missing_identity' END, CASE WHEN bool_or(NOT release) THEN 'missing_release' END) AS problems, bool_and(release AND identity) AS ready FROM each GROUP BY ALL)"""


@query("records_ready", f"WITH {RECORDS} SELECT * FROM rr")
def _(spark, sf):
    return J.records_ready(people(spark, sf), registry(spark, sf), channel_rules(spark), "2025-01-01").withColumn("problems", joined("problems"))


@query("package_eligible", f"""
    WITH {RECORDS} SELECT scene_id, channel, concat_ws('|', CASE WHEN NOT ready THEN 'not_ready' END, CASE WHEN n % 3 <> 0 THEN 'not_reviewed' END,
            CASE WHEN n % 6 <> 0 THEN 'not_final' END, CASE WHEN picks = 0 THEN 'no_pick' END) AS reasons, ready AND n % 6 = 0 AND picks > 0 AS eligible
    FROM scene_log JOIN rr USING (scene_id)""")
def _(spark, sf):
    ready = J.records_ready(people(spark, sf), registry(spark, sf), channel_rules(spark), "2025-01-01")
    return J.package_eligible(scene_log(spark, sf), final_reviews(spark, sf), ready).withColumn("reasons", joined("reasons"))


@query("taxonomy_lookup", f"WITH {OBS} SELECT obs_id, CASE label WHEN 'CLICK' THEN 'act' WHEN 'VIEW' THEN 'look' END AS category FROM frame_obs")
def _(spark, sf):
    m = values(spark, [("click", "zzz", 2), ("Click", "act", 1), ("view", "look", 1), ("VIEW", "see", 1)], "label string, category string, priority int")
    return J.taxonomy_lookup(frame_obs(spark, sf).select("obs_id", "label"), m).select("obs_id", "category")


@query("flagged_sections", f"""
    WITH {OBS}, {RUNS.format(gap=75, keep='true')}, s AS (SELECT scene_id, run::BIGINT AS section, bool_or(label_confidence >= 0.5 AND list_contains(flags, 'eleven')) AS hit,
            count(*) AS n FROM g GROUP BY ALL)
    SELECT scene_id, section, n::INTEGER AS n FROM s WHERE hit""")
def _(spark, sf):
    x = frame_obs(spark, sf)
    s = W._with_run(x, 75.0).groupBy("scene_id", F.col("run").alias("section")).agg(F.collect_list("obs_id").alias("evidence"))
    flags = A.flag_summary(x.withColumn("flag_confidence", F.col("label_confidence")), evidence=10**6).where("flag = 'eleven'")
    return J.flagged_sections(s, flags).select("scene_id", "section", F.size("evidence").alias("n"))


DELTAS = ("accept_rate", "ready_rate", "median_title_edit", "severity_per_scene", "avg_titles")


@query(
    "cohort_delta",
    f"WITH {KPI.replace('pack || ' + chr(39) + '/' + chr(39) + ' || cohort AS cohort', 'cohort')} SELECT " + ", ".join(f"round(max({c}) FILTER (cohort = 'candidate') - max({c}) FILTER (cohort = 'baseline'), 4) AS delta_{c}" for c in DELTAS) + " FROM kpis"
)
def _(spark, sf):
    k = A.rule_kpis(kpi_rows(spark, sf).withColumn("cohort", F.split("cohort", "/")[1]))
    return J.cohort_delta(k, list(DELTAS))


@query("canary_assign", """
    SELECT c_custkey, CASE WHEN (('0x' || substr(sha1(c_name), 1, 8))::BIGINT % 10000) / 100.0 < 25 THEN 'pack7' END AS applied_pack
    FROM customer""")
def _(spark, sf):
    p = values(
        spark,
        [("2024-01-01", True, "full", "pack6", 0.0), ("2024-02-01", True, "canary", "pack7", 25.0), ("2023-12-01", False, "full", "pack5", 0.0)],
        "updated_at string, enabled boolean, mode string, rule_pack_id string, canary_pct double"
    )
    return J.canary_assign(table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("scene_id")), p).select("c_custkey", "applied_pack")

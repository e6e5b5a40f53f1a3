"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentra.operators import aggregates as A
from momentra.plans.registry import query
from momentra.plans.scalar_queries import BUCKETED, VALID, bucketed
from momentra.plans.tables import FEEDBACK, LOGS, OBS, PHASES, feedback, frame_obs, joined, run_timing, scene_log, table
from momentra.operators import scalars as S


@query("log_rollup", f"""
    WITH {LOGS} SELECT source, grouping(source)::INTEGER AS is_total, count(*) AS scenes, sum(picks)::BIGINT AS picks, round(avg(CASE WHEN top_score > 0 THEN top_score END),
            2) AS avg_score, round(avg(duration_sec), 2) AS avg_duration, round(100.0::DOUBLE * count(*) FILTER (picks >= 10) / count(*), 1) AS pct_enough,
        count(*) FILTER (list_contains(error_codes, 'SCAN_TIMEOUT')) AS timeouts FROM scene_log
    GROUP BY ROLLUP (source)""")
def _(spark, sf):
    return A.log_rollup(scene_log(spark, sf))


@query("error_frequency", f"WITH {LOGS}, x AS (SELECT unnest(error_codes) AS code FROM scene_log) SELECT code, count(*) AS n FROM x GROUP BY code")
def _(spark, sf):
    return A.error_frequency(scene_log(spark, sf))


@query("fallback_usage", f"WITH {LOGS}, x AS (SELECT unnest(fallbacks) AS fallback FROM scene_log) SELECT fallback, count(*) AS n FROM x GROUP BY fallback")
def _(spark, sf):
    return A.fallback_usage(scene_log(spark, sf))


@query("phase_thresholds", f"""
    WITH {PHASES} SELECT phase, count(*) AS n, round(quantile_cont(sec, 0.5), 1) AS p50, round(quantile_cont(sec, 0.75), 1) AS p75, round(quantile_cont(sec, 0.9),
            1) AS p90, round(max(sec), 1) AS max_sec FROM phase_rows WHERE sec > 0 GROUP BY phase
    HAVING count(*) >= 5""")
def _(spark, sf):
    return A.phase_thresholds(run_timing(spark, sf))


@query("slowest_phases", f"""
    WITH {PHASES} SELECT phase, round(avg(sec), 2) AS avg_sec, max(sec) AS max_sec, count(*) AS n
    FROM phase_rows WHERE sec > 0 GROUP BY phase ORDER BY avg_sec DESC, phase LIMIT 5""")
def _(spark, sf):
    return A.slowest_phases(run_timing(spark, sf))


RANKED = OBS + ", l AS (SELECT scene_id, list_sort(list(sharpness)) AS v, count(*) AS n FROM frame_obs GROUP BY scene_id)"


@query("calibrate_scene", f"""
    WITH {RANKED}, r AS (SELECT *, v[least(n - 1, floor(n * 0.75)::BIGINT) + 1] AS a, v[least(n - 1, floor(n * 0.5)::BIGINT) + 1] AS b, v[least(n - 1, floor(n * 0.25)::BIGINT) + 1] AS c
        FROM l)
    SELECT scene_id, n::INTEGER AS n, greatest(a, 100.0) AS floor_1, greatest(b, 50.0) AS floor_2, greatest(c, 25.0) AS floor_3, v[n] - v[1] < 50 AS no_variation,
        a < 100 AS all_blurry FROM r""")
def _(spark, sf):
    return A.calibrate_scene(frame_obs(spark, sf))


@query("calibrate_source", f"""
    WITH {LOGS}, k AS (SELECT source, top_score FROM scene_log WHERE top_score > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY top_score DESC, scene_id) <= 50),
    l AS (SELECT source, list_sort(list(top_score)) AS v, count(*) AS n, avg(top_score) AS a FROM k
        GROUP BY source),
    o AS (SELECT source, avg(top_score) * 1.4 AS b FROM scene_log WHERE n % 2 = 0 AND source <> 'building'
        GROUP BY source),
    d AS (SELECT *, coalesce((a - b) / b * 100, 0) AS delta FROM l LEFT JOIN o USING (source))
    SELECT source, n::INTEGER AS n, round(a, 2) AS avg_score, v[n // 4 + 1] AS p25, v[3 * n // 4 + 1] AS p75, round(delta, 1) AS delta_pct, CASE WHEN abs(delta) > 5 THEN 'shifted' ELSE 'stable' END AS verdict
    FROM d WHERE n >= 5""")
def _(spark, sf):
    x = scene_log(spark, sf)
    old = x.where("n % 2 = 0 and source != 'building'").groupBy("source").agg((F.avg("top_score") * 1.4).alias("avg_score"))
    return A.calibrate_source(x, old)


@query("batch_summary", f"""
    WITH {LOGS} SELECT strftime(processed_at, '%Y-%m') AS batch_id, count(*) AS attempted, count(*) FILTER (outcome = 'completed') AS completed, count(*) FILTER (outcome = 'warning') AS warnings,
        count(*) FILTER (outcome = 'aborted') AS aborted, round(count(*) FILTER (outcome = 'completed') * 100.0::DOUBLE / count(*), 1) AS success_rate,
        min(duration_sec) AS min_sec, round(avg(duration_sec), 2) AS avg_sec, max(duration_sec) AS max_sec
    FROM scene_log GROUP BY batch_id""")
def _(spark, sf):
    return A.batch_summary(scene_log(spark, sf).withColumn("batch_id", F.date_format("processed_at", "yyyy-MM")))


@query("feedback_agreement", f"""
    WITH {FEEDBACK}, x AS (SELECT *, operator_label IS NOT NULL AND model_label IS NOT NULL AS l, operator_score IS NOT NULL AS s
        FROM feedback)
    SELECT count(*) AS rows, count(*) FILTER (l) AS labelled, round(count(*) FILTER (l AND operator_label = model_label) * 100.0::DOUBLE / count(*) FILTER (l),
            1) AS label_match_pct, count(*) FILTER (s) AS scored, round(avg(abs(operator_score - model_score)), 2) AS mae, round(count(*) FILTER (s AND abs(operator_score - model_score) <= 5) * 100.0::DOUBLE / count(*) FILTER (s),
            1) AS within_5_pct FROM x""")
def _(spark, sf):
    return A.feedback_agreement(feedback(spark, sf))


@query("decision_mix", f"""
    WITH {FEEDBACK}, x AS (SELECT scene_id, count(*) AS rows, count(*) FILTER (decision = 'keep') AS keep, count(*) FILTER (decision = 'maybe') AS maybe,
            count(*) FILTER (decision = 'reject') AS reject, round(avg(abs(operator_score - model_score)), 2) AS mae
        FROM feedback WHERE decision IS NOT NULL GROUP BY scene_id)
    SELECT *, keep * reject + keep * maybe + maybe * reject AS pairs_possible FROM x""")
def _(spark, sf):
    return A.decision_mix(feedback(spark, sf).where("decision is not null").withColumn("score_100", F.col("operator_score")))


@query("text_completeness", f"""
    WITH {FEEDBACK}, x AS (SELECT trim(title) AS t, lower(title) AS lt, model_label AS name, decision AS d
        FROM feedback)
    SELECT count(*) AS rows, round(count(*) FILTER (t <> '') * 100.0::DOUBLE / count(*), 1) AS title_pct, round(count(d) * 100.0::DOUBLE / count(*),
            1) AS description_pct, round(count(DISTINCT lower(t)) FILTER (t <> '') / count(*) FILTER (t <> ''), 4) AS distinct_title_ratio, round(count(*) FILTER (t <> '' AND contains(lt, name)) * 100.0::DOUBLE / count(*) FILTER (t <> ''),
            1) AS name_in_title_pct FROM x""")
def _(spark, sf):
    return A.text_completeness(feedback(spark, sf).select("title", F.col("decision").alias("description"), F.col("model_label").alias("name")))


KPI = LOGS + """,
r AS (SELECT scene_id, source AS pack, CASE WHEN n % 2 = 0 THEN 'candidate' ELSE 'baseline' END AS cohort, CASE WHEN n % 5 <> 0 THEN (n % 14) / 10.0::DOUBLE END AS title_edit, CASE WHEN n % 4 <> 0 THEN (n % 9) / 10.0::DOUBLE END AS description_edit, n % 3 <> 0 AS accepted, n % 7 <> 0 AS ready, (n % 4)::INTEGER AS severity, (n % 6)::INTEGER AS n_titles, (n % 10) / 10.0::DOUBLE AS title_diversity FROM scene_log),
c AS (SELECT *, least(1, coalesce(title_edit, 0.25))::DOUBLE AS te, least(1, coalesce(description_edit, 0.25))::DOUBLE AS de FROM r),
kpis AS (SELECT pack || '/' || cohort AS cohort, count(DISTINCT scene_id) AS scene_count, round(count(DISTINCT scene_id) FILTER (accepted) / count(DISTINCT scene_id), 4) AS accept_rate, round(count(DISTINCT scene_id) FILTER (ready) / count(DISTINCT scene_id), 4) AS ready_rate, round(quantile_cont(te, 0.5), 4) AS median_title_edit, round(quantile_cont(de, 0.5), 4) AS median_description_edit,
    round(count(DISTINCT scene_id) FILTER (te <= 0.1) / count(DISTINCT scene_id), 4) AS light_edit_rate, round(sum(severity) / count(DISTINCT scene_id), 4) AS severity_per_scene, round(count(DISTINCT scene_id) FILTER (severity >= 2) / count(DISTINCT scene_id), 4) AS severe_rate, round(avg(n_titles), 2) AS avg_titles, round(avg(title_diversity), 4) AS title_diversity FROM c GROUP BY 1)"""


def kpi_rows(spark, sf):
    n = F.col("n")
    return scene_log(spark, sf).select(
        "scene_id", F.concat("source", F.lit("/"), F.when(n % 2 == 0, "candidate").otherwise("baseline")).alias("cohort"),
        F.when(n % 5 != 0, (n % 14) / 10.0).alias("title_edit"), F.when(n % 4 != 0, (n % 9) / 10.0).alias("description_edit"),
        (n % 3 != 0).alias("accepted"), (n % 7 != 0).alias("ready"), (n % 4).cast("int").alias("severity"), (n % 6).cast("int").alias("n_titles"),
        ((n % 10) / 10.0).alias("title_diversity")
    )


@query("rule_kpis", f"WITH {KPI} SELECT * FROM kpis")
def _(spark, sf):
    return A.rule_kpis(kpi_rows(spark, sf))


@query("promotion_gates", f"""
    WITH {KPI} SELECT cohort, array_to_string(list_filter([CASE WHEN scene_count < 20 THEN 'too_few_scenes' END, CASE WHEN accept_rate < 0.5 THEN 'accept_rate' END, CASE WHEN ready_rate < 0.5 THEN 'ready_rate' END, CASE WHEN median_title_edit > 0.35 THEN 'title_edits' END, CASE WHEN median_description_edit > 0.35 THEN 'description_edits' END, CASE WHEN light_edit_rate < 0.2 THEN 'light_edits' END, CASE WHEN severity_per_scene > 1 THEN 'severity' END, CASE WHEN severe_rate > 0.2 THEN 'severe_share' END, CASE WHEN title_diversity < 0.2 THEN 'diversity' END, CASE WHEN scene_count % 3 < 2 THEN 'windows' END], lambda x: x IS NOT NULL),
            '|') AS blocked_reasons FROM kpis""")
def _(spark, sf):
    k = A.rule_kpis(kpi_rows(spark, sf)).withColumn("streak", F.col("scene_count") % 3)
    return A.promotion_gates(k, streak_col="streak").select("cohort", joined("blocked_reasons").alias("blocked_reasons"))


@query("retrain_gates", f"""
    WITH {FEEDBACK}, x AS (SELECT scene_id, count(*) AS rows, count(*) FILTER (decision = 'keep') AS keep, count(*) FILTER (decision = 'reject') AS reject,
            round(avg(abs(operator_score - model_score)), 2) AS mae FROM feedback WHERE decision IS NOT NULL
        GROUP BY scene_id)
    SELECT scene_id, array_to_string(list_filter([CASE WHEN rows < 20 THEN 'few_rows' END, CASE WHEN keep < 15 THEN 'few_keep' END, CASE WHEN reject < 2 THEN 'few_reject' END, CASE WHEN mae IS NULL OR mae > 30 THEN 'mae' END], lambda x: x IS NOT NULL),
            '|') AS blocked_reasons FROM x""")
def _(spark, sf):
    m = A.decision_mix(feedback(spark, sf).where("decision is not null").withColumn("score_100", F.col("operator_score")))
    return A.retrain_gates(m, {"rows": 20, "keep": 15, "reject": 2}, 30.0).select("scene_id", joined("blocked_reasons").alias("blocked_reasons"))


@query("phrase_mining", """
    WITH d AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w, source AS tag, lang, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(lower(s), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), lambda s: length(s) BETWEEN 12 AND 72)[1:3] AS ss FROM documents WHERE trim(text) <> ''),
    p AS (SELECT 'first_two' AS kind, w[1] || ' ' || w[2] AS phrase FROM d WHERE len(w) >= 2 UNION ALL SELECT 'last_two', w[-2] || ' ' || w[-1] FROM d WHERE len(w) >= 2 UNION ALL SELECT 'token', t FROM (SELECT unnest(w) AS t FROM d) WHERE length(t) >= 3
        UNION ALL SELECT 'sentence', unnest(ss) FROM d UNION ALL SELECT 'tag', lower(tag) FROM d UNION ALL SELECT 'category', upper(lang[1]) || lang[2:] || ' ' || upper(tag[1]) || tag[2:] FROM d UNION ALL SELECT 'tone', lower(lang) FROM d),
    c AS (SELECT kind, phrase, count(*) AS n FROM p WHERE phrase IS NOT NULL GROUP BY ALL)
    SELECT kind, phrase, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, phrase)::INTEGER AS rank FROM c QUALIFY rank <= 5""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("text").alias("title"), F.col("text").alias("description"), F.array("source").alias("tags"),
        F.array(F.concat("lang", F.lit(" "), "source")).alias("categories"), F.col("lang").alias("tone")
    )
    return A.phrase_mining(d)


@query("flag_summary", f"""
    WITH {OBS}, x AS (SELECT scene_id, obs_id, timestamp_sec, label_confidence AS c, unnest(flags) AS flag
        FROM frame_obs WHERE label_confidence >= 0.5),
    y AS (SELECT *, row_number() OVER (PARTITION BY scene_id, flag ORDER BY timestamp_sec, obs_id) AS r
        FROM x)
    SELECT scene_id, flag, count(*) AS n, max(c) AS max_conf, string_agg(obs_id::VARCHAR, '|' ORDER BY r) FILTER (r <= 12) AS evidence
    FROM y GROUP BY scene_id, flag""")
def _(spark, sf):
    x = A.flag_summary(frame_obs(spark, sf).withColumn("flag_confidence", F.col("label_confidence")))
    return x.withColumn("evidence", joined(F.col("evidence").cast("array<string>")))


@query("validation_summary", f"""
    WITH {VALID}, t AS (SELECT count(*) AS total, count(*) FILTER (len(rejects) = 0) AS eligible, count(*) FILTER (len(rejects) > 0) AS rejected, count(*) FILTER (len(rejects) = 0 AND len(warnings) > 0) AS suspicious
        FROM v)
    SELECT 'total' AS kind, code, n FROM (UNPIVOT t ON total, eligible, rejected, suspicious INTO NAME code VALUE n)
    UNION ALL SELECT 'reject', code, count(*) FROM (SELECT unnest(rejects) AS code FROM v) GROUP BY code
    UNION ALL SELECT 'warning', code, count(*) FROM (SELECT unnest(warnings) AS code FROM v) GROUP BY code""")
def _(spark, sf):
    return A.validation_summary(S.validate_obs(frame_obs(spark, sf)))


@query("tag_rollup", f"""
    WITH {OBS}, b AS (SELECT scene_id, label, label_confidence FROM frame_obs UNION ALL SELECT scene_id, label, label_confidence
        FROM frame_obs WHERE score >= 80),
    c AS (SELECT scene_id, label, count(*) AS n, max(label_confidence) AS max_conf FROM b GROUP BY scene_id, label)
    SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, label)::INTEGER AS rank
    FROM c QUALIFY rank <= 3""")
def _(spark, sf):
    x = frame_obs(spark, sf)
    return A.tag_rollup(x, x.where("score >= 80"), 3)


@query("weighted_signals", f"""
    WITH {OBS}, t AS (SELECT scene_id, label, label_confidence AS c, type AS source FROM frame_obs
        UNION ALL SELECT scene_id, unnest(flags), label_confidence, 'flag' FROM frame_obs),
    g AS (SELECT scene_id, label, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), '|') AS sources, round(max(c) + least(0.25, count(*) * 0.025), 4)::DOUBLE AS weight
        FROM t GROUP BY scene_id, label)
    SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY weight DESC, n DESC, label)::INTEGER AS rank
    FROM g""")
def _(spark, sf):
    x = frame_obs(spark, sf)
    tags = x.select("scene_id", "label", F.col("label_confidence").alias("confidence"), F.col("type").alias("source")).unionByName(
        x.select("scene_id", F.explode("flags").alias("label"), F.col("label_confidence").alias("confidence"), F.lit("flag").alias("source"))
    )
    return A.weighted_signals(tags).withColumn("sources", joined("sources"))


@query("score_buckets", f"""
    WITH {OBS} SELECT scene_id, count(*) FILTER (score >= 95) AS b_95_up, count(*) FILTER (score >= 90 AND score < 95) AS b_90_95, count(*) FILTER (score >= 85 AND score < 90) AS b_85_90,
        count(*) FILTER (score >= 80 AND score < 85) AS b_80_85, count(*) FILTER (score >= 70 AND score < 80) AS b_70_80, count(*) FILTER (score >= 50 AND score < 70) AS b_50_70,
        count(*) FILTER (score < 50) AS b_lt_50 FROM frame_obs GROUP BY scene_id""")
def _(spark, sf):
    return A.score_buckets(frame_obs(spark, sf))


@query("resource_totals", f"""
    WITH {PHASES} SELECT job_id AS scene_id, sum(CASE WHEN phase = 'AF' THEN 1 ELSE frames END)::BIGINT AS frames, round(sum(sec), 2) AS seconds, count(*) AS phases
    FROM phase_rows GROUP BY job_id""")
def _(spark, sf):
    entry = lambda k, v: F.struct(
        F.when(k == "AF", F.lit(None).cast("long")).otherwise(F.element_at("frames", k)).alias("frames_scored"),
        F.lit(1).cast("long").alias("candidates_found"), v.alias("duration_sec")
    )
    return A.resource_totals(run_timing(spark, sf).select(F.col("job_id").alias("scene_id"), F.transform_values("phases", entry).alias("phases")))


@query("recent_latency", f"""
    WITH {LOGS}, x AS (SELECT mode, duration_sec FROM scene_log WHERE duration_sec > 0 QUALIFY row_number() OVER (PARTITION BY mode ORDER BY processed_at DESC, scene_id DESC) <= 40)
    SELECT mode, count(*) AS n, round(avg(duration_sec), 2) AS avg_ms FROM x GROUP BY mode""")
def _(spark, sf):
    return A.recent_latency(
        scene_log(spark, sf).select(
            "mode", F.col("processed_at").alias("ts"), F.col("scene_id").alias("job_id"), F.col("duration_sec").alias("latency_ms")
        ),
        40
    )


@query("status_mix", """
    SELECT count(*) FILTER (o_orderkey % 4 = 0) AS queued, count(*) FILTER (o_orderkey % 4 = 1) AS active, count(*) FILTER (o_orderkey % 4 = 2) AS done,
        count(*) FILTER (o_orderkey % 4 = 3) AS failed, round(least(1.0, (count(*) FILTER (o_orderkey % 4 = 1) + count(*) FILTER (o_orderkey % 4 = 0) * 0.25) / 200000.0)::DOUBLE,
            4) AS utilisation FROM orders""")
def _(spark, sf):
    states = F.array(*map(F.lit, ("queued", "active", "done", "failed")))
    return A.status_mix(table(spark, sf, "orders").select(states[(F.col("o_orderkey") % 4).cast("int")].alias("status")), 200_000)


@query("artifact_latest", """
    SELECT p_type AS type, count(*) AS n, arg_max(p_partkey, (p_size, p_partkey)) AS latest_id, max(p_size) AS latest_at
    FROM part GROUP BY p_type""")
def _(spark, sf):
    return A.artifact_latest(table(spark, sf, "part").select(F.col("p_type").alias("type"), F.col("p_size").alias("created_at"), F.col("p_partkey").alias("artifact_id")))


@query("feedback_pivot", f"""
    WITH {FEEDBACK} SELECT scene_id, count(*) FILTER (decision = 'keep') AS keep, count(*) FILTER (decision = 'reject') AS reject, count(*) FILTER (decision = 'maybe') AS maybe,
        count(*) FILTER (decision IS NULL) AS other FROM feedback GROUP BY scene_id""")
def _(spark, sf):
    return A.feedback_pivot(feedback(spark, sf).withColumn("decision", F.upper("decision")))


@query("label_rollup", f"""
    WITH {OBS}, x AS (SELECT scene_id, unnest(list_concat(flags, [label, type])) AS label FROM frame_obs),
    c AS (SELECT scene_id, label, count(*) AS n FROM x GROUP BY scene_id, label)
    SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, label)::INTEGER AS rank
    FROM c QUALIFY rank <= 6""")
def _(spark, sf):
    return A.label_rollup(frame_obs(spark, sf).select("scene_id", F.col("flags").alias("labels_a"), F.array("label", "type").alias("labels_b")))


@query("quota_progress", f"""
    WITH {BUCKETED} SELECT scene_id, count(*) FILTER (bucket = 'best') AS n_best, count(*) FILTER (bucket = 'wide') AS n_wide, count(*) FILTER (bucket = 'click') AS n_click,
        count(*) FILTER (bucket = 'best') >= 20 AND count(*) FILTER (bucket = 'wide') >= 10 AND count(*) FILTER (bucket = 'click') >= 1 AS satisfied
    FROM bucketed GROUP BY scene_id""")
def _(spark, sf):
    return A.quota_progress(bucketed(spark, sf), {"best": 20, "wide": 10, "click": 1})


@query("failure_profile", f"""
    WITH {OBS} SELECT scene_id, count(*) AS n, count(*) FILTER (parse_succeeded AND score >= 60) AS over_floor, round(count(*) FILTER (parse_succeeded AND score < 1 AND floor(score) = 0 AND score = 0) / count(*),
            4) AS zero_share, count(*) FILTER (NOT parse_succeeded) AS failures FROM frame_obs GROUP BY scene_id""")
def _(spark, sf):
    return A.failure_profile(frame_obs(spark, sf), 60.0)


@query("cohort_timing", f"""
    WITH {PHASES}, p AS (SELECT job_id, max(sec) FILTER (phase = 'AF') AS af, max(sec) FILTER (phase = 'NO') AS no
        FROM phase_rows GROUP BY job_id)
    SELECT CASE WHEN job_id::BIGINT % 2 = 0 THEN 'candidate' ELSE 'baseline' END AS cohort, count(*) AS n, round(avg(af), 3) AS avg_af, round(avg(no),
            3) AS avg_no FROM p GROUP BY cohort""")
def _(spark, sf):
    x = run_timing(spark, sf).select("job_id", F.col("phases")["AF"].alias("af"), F.col("phases")["NO"].alias("no"))
    return A.cohort_timing(x, F.col("job_id").cast("long") % 2 == 0, ["af", "no"])


@query("call_percentiles", f"""
    WITH {LOGS}, l AS (SELECT mode, list_sort(list(duration_sec)) AS v, count(*) AS n FROM scene_log
        GROUP BY mode)
    SELECT mode, n::INTEGER AS n, v[round_even((n - 1) * 0.5, 0)::BIGINT + 1] AS p50, v[round_even((n - 1) * 0.95, 0)::BIGINT + 1] AS p95
    FROM l""")
def _(spark, sf):
    return A.call_percentiles(scene_log(spark, sf).select("mode", F.col("duration_sec").alias("ms")))


@query("library_facets", f"""
    WITH {LOGS} SELECT source, outcome AS status, grouping(source, outcome)::INTEGER AS level, count(*) AS n
    FROM scene_log GROUP BY CUBE (source, outcome)""")
def _(spark, sf):
    return A.library_facets(scene_log(spark, sf).withColumnRenamed("outcome", "status"))

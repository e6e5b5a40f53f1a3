"""Queries of the selections. Sorted passes have SQL folds beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentra.operators import scalars as S
from momentra.operators import selection as P
from momentra.plans.registry import query
from momentra.plans.scalar_queries import BUCKETED, FUSED, bucketed, windows_of
from momentra.plans.tables import FEEDBACK, LOGS, OBS, ZONED, feedback, frame_obs, joined, scene_log, table, zoned

#: rows: (scene_id, list of (t, id, s) in order); picks kept apart by gap, up to k, then topped off.
FOLD = """
apart AS (SELECT scene_id, rows, list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) < {k} AND len(list_filter(acc, lambda y: abs(y.t - x[1].t) < {gap})) = 0 THEN list_concat(acc, x) ELSE acc END, []) AS kept FROM ranked),
topped AS (SELECT scene_id, kept, list_concat(kept, list_filter(rows, lambda r: NOT list_contains(list_transform(kept, lambda y: y.id), r.id))[1:{k} - len(kept)]) AS picks FROM apart),
picked AS (SELECT scene_id, unnest(picks) AS p, unnest(range(1, len(picks) + 1)) AS rank, len(kept) AS n_kept FROM topped)"""


@query("min_gap_select", f"""
    WITH {OBS}, ranked AS (SELECT scene_id, list({{'t': timestamp_sec, 'id': obs_id, 's': score}} ORDER BY score DESC, timestamp_sec, obs_id) AS rows
        FROM frame_obs GROUP BY scene_id), {FOLD.format(k=12, gap=300)} SELECT scene_id, p.id AS obs_id, p.s AS score, rank::INTEGER AS rank, rank > n_kept AS relaxed
    FROM picked""")
def _(spark, sf):
    return P.min_gap_select(frame_obs(spark, sf), "score", 12, 300.0).drop("timestamp_sec")


GATED = FUSED + """,
gate AS (SELECT *, greatest(100, quantile_cont(sharpness, 0.25) OVER (PARTITION BY scene_id)) AS hi, greatest(50, quantile_cont(sharpness, 0.1) OVER (PARTITION BY scene_id)) AS lo FROM fused),
gated AS (SELECT *, count(*) FILTER (sharpness >= hi) OVER (PARTITION BY scene_id) < {k} AS gate_relaxed FROM gate),
pool AS (SELECT * FROM gated WHERE sharpness >= CASE WHEN gate_relaxed THEN lo ELSE hi END)"""


@query("sharp_gate", f"WITH {GATED.format(k=25)} SELECT obs_id, gate_relaxed FROM pool")
def _(spark, sf):
    return P.sharp_gate(S.fused_score(zoned(spark, sf)), 25).select("obs_id", "gate_relaxed")


@query("live_select", f"""
    WITH {GATED.format(k=10)}, ranked AS (SELECT scene_id, list({{'t': timestamp_sec, 'id': obs_id, 's': fused}} ORDER BY fused DESC, timestamp_sec, obs_id) AS rows
        FROM pool GROUP BY scene_id), {FOLD.format(k=10, gap=20)} SELECT scene_id, p.id AS obs_id, round(p.s, 4) AS score, rank::INTEGER AS rank, rank > n_kept AS relaxed
    FROM picked""")
def _(spark, sf):
    return P.live_select(zoned(spark, sf), 10).select("scene_id", "obs_id", F.round("score", 4).alias("score"), "rank", "relaxed")


SEEDS = OBS + """, seeds AS (SELECT *, CASE WHEN score BETWEEN 80 AND 100 THEN 30.0::DOUBLE WHEN score BETWEEN 50 AND 79.99 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS window_sec,
            CASE WHEN score BETWEEN 80 AND 100 THEN 5.0::DOUBLE WHEN score BETWEEN 50 AND 79.99 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS step_sec
        FROM frame_obs)"""


@query("interval_consolidate", f"""
    WITH {SEEDS}, r AS (SELECT scene_id, list({{'lo': timestamp_sec - window_sec, 'hi': timestamp_sec + window_sec, 'id': obs_id, 's': score}} ORDER BY score DESC, timestamp_sec, obs_id) AS rows
        FROM seeds WHERE window_sec > 0 GROUP BY scene_id),
    f AS (SELECT scene_id, unnest(list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x[1].lo < y.hi AND y.lo < x[1].hi)) = 0 THEN list_concat(acc, x) ELSE acc END, [])) AS p
        FROM r)
    SELECT scene_id, p.id AS obs_id, round(p.lo, 3) AS lo, round(p.hi, 3) AS hi, p.s AS score FROM f""")
def _(spark, sf):
    return P.interval_consolidate(S.score_window(frame_obs(spark, sf), windows_of(spark)))


@query("window_expand", f"""
    WITH {SEEDS}, x AS (SELECT scene_id, obs_id, score, duration_sec, floor((timestamp_sec + i * step_sec) * 10 + 0.5) / 10 AS t
        FROM seeds, range(-6, 7) r(i) WHERE step_sec > 0 AND abs(i) <= floor(window_sec / step_sec)),
    f AS (SELECT scene_id, t, arg_max(obs_id, (score, -obs_id)) AS seed_id FROM x WHERE t >= 0 AND t <= duration_sec
        GROUP BY scene_id, t)
    SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM frame_obs o WHERE o.scene_id = f.scene_id AND floor(o.timestamp_sec * 10 + 0.5) / 10 = f.t)""")
def _(spark, sf):
    x = frame_obs(spark, sf)
    return P.window_expand(S.score_window(x, windows_of(spark)), x)


KEEP = """
hashed AS (SELECT scene_id, list({{'id': obs_id, 'h': phash}} ORDER BY timestamp_sec, obs_id) AS rows FROM {source} GROUP BY scene_id),
kept AS (SELECT scene_id, unnest(list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: bit_count(xor(y.h, x[1].h)) <= {t})) = 0 THEN list_concat(acc, x) ELSE acc END, [])) AS p FROM hashed)"""


@query("near_dup_keep_first", f"WITH {OBS}, {KEEP.format(source='frame_obs', t=5)} SELECT p.id AS obs_id FROM kept")
def _(spark, sf):
    return P.near_dup_keep_first(frame_obs(spark, sf), "phash").select("obs_id")


@query("zone_topn", f"""
    WITH {ZONED}, late AS (SELECT * FROM zoned WHERE list_contains(zone_tags, 'late') AND sharpness >= 50), {KEEP.format(source='late', t=2)}, t AS (SELECT late.*,
            row_number() OVER (PARTITION BY late.scene_id ORDER BY sharpness DESC, obs_id) AS n
        FROM late JOIN kept ON p.id = obs_id)
    SELECT scene_id, obs_id, score FROM t WHERE n <= 8 AND score >= 40""")
def _(spark, sf):
    return P.zone_topn(zoned(spark, sf), "late", 8, 2, 40.0).select("scene_id", "obs_id", "score")


@query("queue_cap", f"""
    WITH {ZONED}, p AS (SELECT scene_id, obs_id, sharpness - least(50, greatest(0, (motion - 1) * 10)) + CASE WHEN list_contains(zone_tags, 'late') THEN 200 ELSE 0 END + CASE WHEN list_contains(zone_tags, 'build') THEN 120 ELSE 0 END AS priority
        FROM zoned)
    SELECT obs_id, row_number() OVER (PARTITION BY scene_id ORDER BY priority DESC, obs_id)::INTEGER AS queue_rank, queue_rank > 40 AS skipped
    FROM p""")
def _(spark, sf):
    return P.queue_cap(S.candidate_priority(zoned(spark, sf)), 40).select("obs_id", "queue_rank", "skipped")


@query("tier_escalate", f"""
    WITH {OBS}, c AS (SELECT *, CASE WHEN count(*) FILTER (tier = 'TIER_1' AND score >= 80) OVER w >= 12 THEN 1 WHEN count(*) FILTER (tier IN ('TIER_1', 'TIER_2') AND score >= 45) OVER w >= 22 THEN 2 ELSE 3 END AS level
        FROM frame_obs WHERE tier IS NOT NULL WINDOW w AS (PARTITION BY scene_id)),
    d AS (SELECT * FROM c WHERE CASE level WHEN 1 THEN tier = 'TIER_1' AND score >= 80 WHEN 2 THEN tier IN ('TIER_1', 'TIER_2') AND score >= 45 ELSE score >= 30 END)
    SELECT obs_id, level FROM d""")
def _(spark, sf):
    x = frame_obs(spark, sf)
    one = P.tier_escalate(x, (80, 45, 30), 12)
    two = P.tier_escalate(x, (80, 45, 30), 22)
    return one.where("level = 1").select("obs_id", "level").unionByName(
        two.join(one.where("level = 1").select("scene_id").distinct(), "scene_id", "left_anti").where("level != 1").select("obs_id", "level")
    )


CASCADE = OBS + """,
pool AS (
    SELECT scene_id, obs_id, 'P' AS stage, 0 AS o, -score AS k FROM frame_obs WHERE score >= 95
    UNION ALL SELECT scene_id, obs_id, 'A', 1, -score FROM frame_obs WHERE parse_succeeded AND score >= 30 AND score < 50
    UNION ALL SELECT scene_id, obs_id, 'C', 2, ('0x' || substr(md5(scene_id || ':' || obs_id::VARCHAR), 1, 13))::BIGINT::DOUBLE FROM frame_obs WHERE parse_succeeded AND score > 0
    UNION ALL SELECT scene_id, obs_id, 'D', 3, -sharpness FROM frame_obs
),
once AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY scene_id, obs_id ORDER BY o, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY o, k, obs_id)::INTEGER AS rank FROM once),
begun AS (SELECT *, min(rank) OVER (PARTITION BY scene_id, o) - 1 AS before FROM ranked)"""


@query("floor_cascade", f"WITH {CASCADE} SELECT scene_id, obs_id, stage, rank FROM begun WHERE o = 0 OR before < 15 AND rank <= 20")
def _(spark, sf):
    x = frame_obs(spark, sf)
    return P.floor_cascade(x.where("score >= 95"), x.where("parse_succeeded"), x)


@query("recheck_queue", f"""
    WITH {OBS}, p AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, obs_id) AS rank
        FROM frame_obs),
    q AS (SELECT scene_id, obs_id, k, row_number() OVER (PARTITION BY scene_id ORDER BY rank, obs_id)::INTEGER AS queue_rank
        FROM p WHERE score >= 40 AND k % 2 = 0)
    SELECT scene_id, obs_id, queue_rank, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 4 = 0 THEN 'reject' ELSE 'ok' END ELSE 'pending' END AS verdict, NOT (k % 3 = 0 AND k % 4 = 0) AS still_eligible
    FROM q WHERE queue_rank <= 8""")
def _(spark, sf):
    x = frame_obs(spark, sf)
    k = F.col("k")
    picks = P._ranked(x, [F.desc("score"), "obs_id"], "rank").withColumns({"eligible": F.col("score") >= 40, "needs_recheck": k % 2 == 0})
    return P.recheck_queue(picks, x.where(k % 3 == 0).select("scene_id", "obs_id", F.when(k % 4 == 0, "reject").otherwise("ok").alias("verdict")))


ROUNDS = OBS + """,
c AS (SELECT scene_id, obs_id, score, k % 2 = 0 AS recheck, k % 3 = 0 AS known, k % 4 = 0 AS bad FROM frame_obs WHERE score >= 20),
p1 AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, obs_id)::INTEGER AS rank FROM c QUALIFY rank <= 8),
q1 AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY rank)::INTEGER AS queue_rank FROM p1 WHERE recheck QUALIFY queue_rank <= 3),
c2 AS (SELECT * FROM c WHERE obs_id NOT IN (SELECT obs_id FROM q1 WHERE known AND bad)),
p2 AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, obs_id)::INTEGER AS rank FROM c2 QUALIFY rank <= 8),
q2 AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY rank)::INTEGER AS queue_rank FROM p2 WHERE recheck AND obs_id NOT IN (SELECT obs_id FROM q1) QUALIFY queue_rank <= 3),
c3 AS (SELECT * FROM c2 WHERE obs_id NOT IN (SELECT obs_id FROM q2 WHERE known AND bad)),
p3 AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, obs_id)::INTEGER AS rank FROM c3 QUALIFY rank <= 8)"""


def rechecked(spark, sf):
    x = frame_obs(spark, sf).where("score >= 20")
    k = F.col("k")
    best = lambda c: P._ranked(c, [F.desc("score"), "obs_id"], "rank").where("rank <= 8").select("scene_id", "obs_id", "rank")
    candidates = x.select("scene_id", "obs_id", "score", F.lit(True).alias("eligible"), (k % 2 == 0).alias("needs_recheck"))
    return P.recheck_rounds(candidates, x.where(k % 3 == 0).select("scene_id", "obs_id", F.when(k % 4 == 0, "reject").otherwise("ok").alias("verdict")), best, 3)


@query("recheck_rounds", f"WITH {ROUNDS} SELECT scene_id, obs_id, rank FROM p3")
def _(spark, sf):
    return rechecked(spark, sf)[0]


@query("recheck_rounds_queue", f"""
    WITH {ROUNDS}, q AS (SELECT *, 1 AS round FROM q1 UNION ALL SELECT *, 2 FROM q2)
    SELECT scene_id, obs_id, queue_rank, round, CASE WHEN known THEN CASE WHEN bad THEN 'reject' ELSE 'ok' END ELSE 'pending' END AS verdict, NOT (known AND bad) AS still_eligible
    FROM q""")
def _(spark, sf):
    return rechecked(spark, sf)[1]


def bank_rows(spark, sf):
    """Orders as examples: their attributes are the token sets."""
    n = F.col("n")
    none = F.array().cast("array<string>")
    return scene_log(spark, sf).select(
        n.alias("id"), "source", F.array("mode", F.concat(F.lit("p"), F.col("picks"))).alias("tags"), F.col("error_codes").alias("labels"),
        F.split(F.lower("title"), "[ #]+").alias("title_tokens"), F.array(F.concat(F.lit("c"), F.col("c_custkey"))).alias("contributors"),
        none.alias("categories"), ((n % 10) / 10.0).alias("acceptance"), ((n % 3) / 10.0).alias("reject_rate")
    )


BANK = LOGS + """,
bank AS (SELECT n AS id, source, [mode, 'p' || picks::VARCHAR] AS a, error_codes AS b, list_distinct(list_filter(regexp_split_to_array(lower(title), '[ #]+'), lambda x: true)) AS c, ['c' || c_custkey::VARCHAR] AS d, (n % 10) / 10.0::DOUBLE AS acceptance, (n % 3) / 10.0::DOUBLE AS reject FROM scene_log),
pairs AS (SELECT q.id AS query_id, x.id, x.acceptance, x.reject, q.source = x.source AS same, q.a AS a, x.a AS xa, q.b AS b, x.b AS xb, q.c AS c, x.c AS xc, q.d AS d, x.d AS xd FROM bank q JOIN bank x ON q.id <> x.id WHERE q.id % 100 = 0 AND (list_has_any(q.a, x.a) OR list_has_any(q.b, x.b) OR list_has_any(q.c, x.c) OR q.d = x.d)),
summed AS (SELECT query_id, id, round(0.30 * len(list_intersect(a, xa)) / len(list_distinct(a || xa)) + coalesce(0.22 * len(list_intersect(b, xb)) / nullif(len(list_distinct(b || xb)), 0), 0) + 0.24 * len(list_intersect(c, xc)) / len(list_distinct(c || xc)) + CASE WHEN d = xd THEN 0.14 ELSE 0 END + 0.08 * acceptance - 0.04 * reject + CASE WHEN same THEN 0.22 ELSE 0 END, 6)::DOUBLE AS total FROM pairs)"""


@query("retrieve_topk", f"""
    WITH {BANK} SELECT query_id, id, least(1.0::DOUBLE, total) AS signal, row_number() OVER (PARTITION BY query_id
        ORDER BY total DESC, id)::INTEGER AS rank FROM summed WHERE total > 0 QUALIFY rank <= 3""")
def _(spark, sf):
    b = bank_rows(spark, sf)
    return P.retrieve_topk(b.where("id % 100 = 0"), b)


@query("external_accept", f"""
    WITH {OBS}, r AS (SELECT *, CASE WHEN NOT parse_succeeded THEN 'unparsed' WHEN score < 40 THEN 'low_score' END AS why
        FROM frame_obs),
    o AS (SELECT *, row_number() OVER (PARTITION BY scene_id, why IS NULL ORDER BY score DESC, obs_id) AS n
        FROM r),
    f AS (SELECT obs_id, coalesce(why, CASE WHEN n > least(6, user_slots) THEN 'over_cap' END) AS reason
        FROM (SELECT *, scene_id::BIGINT % 9 AS user_slots FROM o))
    SELECT obs_id, reason, reason IS NULL AS accepted FROM f""")
def _(spark, sf):
    x = frame_obs(spark, sf).withColumn("slots_left", F.col("scene_id").cast("long") % 9)
    return P.external_accept(x, 6, 40.0).select("obs_id", "reason", "accepted")


def titles(spark, sf):
    """Titles: name, type and brand of each part, twenty a scene."""
    p = table(spark, sf, "part")
    return p.select(F.expr("cast(p_partkey div 20 as string)").alias("scene_id"), F.col("p_partkey").alias("ord"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))


TITLES = "titles AS (SELECT (p_partkey // 20)::VARCHAR AS scene_id, p_partkey AS ord, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part)"


@query("title_sanitize", f"""
    WITH {TITLES}, w AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w
        FROM titles WHERE length(text) BETWEEN 18 AND 110),
    c AS (SELECT *, array_to_string(w[1:4], ' ') AS head FROM w WHERE len(w) > 0 AND len(list_distinct(w)) / len(w) >= 0.5 AND len(list_filter(range(1, len(w) - 2), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2] AND w[i] = w[i + 3])) = 0),
    a AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY scene_id, lower(text) ORDER BY ord) = 1),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY scene_id, head ORDER BY ord) = 1),
    r AS (SELECT scene_id, list({{'n': ord, 'text': text, 'tokens': list_distinct(w)}} ORDER BY ord) AS rows
        FROM b GROUP BY scene_id),
    f AS (SELECT scene_id, unnest(list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: len(list_intersect(y.tokens, x[1].tokens)) / len(list_distinct(list_concat(y.tokens, x[1].tokens))) >= 0.72)) = 0 THEN list_concat(acc, x) ELSE acc END, [])) AS p
        FROM r)
    SELECT scene_id, p.n AS ord, p.text AS text FROM f""")
def _(spark, sf):
    return P.title_sanitize(titles(spark, sf))


@query("title_balance", f"""
    WITH {TITLES}, t AS (SELECT scene_id, ord, CASE WHEN contains(lower(text), 'red') THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), 'bolt') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'small') THEN 1 ELSE 0 END + CASE WHEN length(text) BETWEEN 40 AND 80 THEN 1 ELSE 0 END AS points,
            list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS tokens
        FROM titles),
    r AS (SELECT scene_id, list({{'ord': ord, 'points': points, 'tokens': tokens}} ORDER BY points DESC, ord) AS rows
        FROM t GROUP BY scene_id),
    f AS (SELECT scene_id, rows, list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) < 6 AND len(list_filter(acc, lambda y: coalesce(len(list_intersect(y.tokens, x[1].tokens)) / nullif(len(list_distinct(list_concat(y.tokens, x[1].tokens))), 0), 0) >= 0.68)) = 0 THEN list_concat(acc, x) ELSE acc END, []) AS kept
        FROM r),
    g AS (SELECT scene_id, list_concat(kept, list_filter(rows, lambda x: NOT list_contains(list_transform(kept, lambda y: y.ord), x.ord))[1:6 - len(kept)]) AS o
        FROM f),
    h AS (SELECT scene_id, unnest(o) AS p, unnest(range(1, len(o) + 1)) AS place FROM g)
    SELECT scene_id, p.ord AS ord, p.points::INTEGER AS points, place::INTEGER AS place FROM h""")
def _(spark, sf):
    return P.title_balance(titles(spark, sf), "red", ["bolt", "small"], 6)


@query("disagreements", f"""
    WITH {FEEDBACK}, l AS (SELECT * FROM feedback ORDER BY ts DESC, doc_id DESC LIMIT 120),
    x AS (SELECT doc_id, 'label' AS field, CASE WHEN model_label = operator_label THEN 'ok' ELSE 'err' END AS verdict
        FROM l WHERE operator_label IS NOT NULL UNION ALL SELECT doc_id, 'visible', CASE WHEN doc_id % 2 = doc_id % 3 THEN 'ok' ELSE 'err' END
        FROM l UNION ALL SELECT doc_id, 'score', CASE WHEN model_score = operator_score THEN 'ok' WHEN abs(model_score - operator_score) <= 10 THEN 'warn' ELSE 'err' END
        FROM l WHERE operator_score IS NOT NULL)
    SELECT doc_id AS feedback_id, field, verdict FROM x WHERE verdict <> 'ok'""")
def _(spark, sf):
    x = feedback(spark, sf).withColumns({"feedback_id": F.col("doc_id"), "model_visible": F.col("doc_id") % 2, "operator_visible": F.col("doc_id") % 3})
    return P.disagreements(x).select("feedback_id", "field", "verdict")


@query("repair_fill", f"""
    WITH {LOGS}, x AS (SELECT scene_id, ['a', 'b', 'c', 'd', 'e'][1:n % 6] AS have, ['b', 'x', 'e', 'y', 'z'] AS cand
        FROM scene_log)
    SELECT scene_id, array_to_string(list_concat(have, list_filter(cand, lambda y: NOT list_contains(have, y)))[1:greatest(len(have), 4)], '|') AS repaired
    FROM x""")
def _(spark, sf):
    lit = lambda s: F.array(*map(F.lit, s))
    x = scene_log(spark, sf).select("scene_id", F.slice(lit("abcde"), F.lit(1), (F.col("n") % 6).cast("int")).alias("have"), lit("bxeyz").alias("candidates"))
    return P.repair_fill(x, 4).select("scene_id", joined("repaired").alias("repaired"))


COVERED = OBS + """,
o AS (SELECT scene_id, list_sort(list_distinct(list(label))) AS seen, min(timestamp_sec) AS a, max(timestamp_sec) - min(timestamp_sec) AS l FROM frame_obs GROUP BY scene_id),
p AS (SELECT scene_id, count(*) AS n, list_distinct(list(label)) AS picked, max(timestamp_sec) - min(timestamp_sec) AS pl, count(DISTINCT least({s} - 1, floor(CASE WHEN l > 0 THEN (timestamp_sec - a) / l * {s} ELSE 0 END))) AS covered FROM frame_obs JOIN o USING (scene_id) WHERE score >= 90 GROUP BY scene_id),
x AS (SELECT scene_id, coalesce(n, 0) >= 8 AS enough, list_filter(seen, lambda y: NOT list_contains(coalesce(picked, []), y)) AS missing, round(CASE WHEN l > 0 THEN coalesce(pl, 0) / l ELSE 1 END, 4) AS span_share, coalesce(covered, 0)::INTEGER AS segments_covered FROM o LEFT JOIN p USING (scene_id))
SELECT scene_id, enough, array_to_string(missing, '|') AS labels_missing, span_share, segments_covered, enough AND len(missing) = 0 AND span_share >= {span} AND segments_covered >= {need} AS ready FROM x"""


@query("coverage_ready", f"WITH {COVERED.format(s=1, span=0.8, need=0)}")
def _(spark, sf):
    x = frame_obs(spark, sf)
    return P.coverage_ready(x, x.where("score >= 90"), 8).withColumn("labels_missing", joined("labels_missing"))


@query("coverage_ready_segments", f"WITH {COVERED.format(s=6, span=0.65, need=5)}")
def _(spark, sf):
    x = frame_obs(spark, sf)
    return P.coverage_ready(x, x.where("score >= 90"), 8, segments=6).withColumn("labels_missing", joined("labels_missing"))


@query("failure_stop", f"""
    WITH {OBS}, x AS (SELECT scene_id, row_number() OVER w AS n, count(*) FILTER (k > 60 AND k % 10 <> 9 AND score > 0) OVER w AS ok, count(*) FILTER (k <= 60 OR k % 10 = 9) OVER w AS bad
        FROM frame_obs WINDOW w AS (PARTITION BY scene_id ORDER BY timestamp_sec, obs_id ROWS UNBOUNDED PRECEDING))
    SELECT scene_id, min(n) FILTER (n >= 3 AND ok = 0 AND bad >= 0.75 * n) AS stop_at FROM x GROUP BY scene_id""")
def _(spark, sf):
    x = frame_obs(spark, sf).withColumn("parse_succeeded", (F.col("k") > 60) & (F.col("k") % 10 != 9))
    return P.failure_stop(x, 3)


def _quota(spark, sf):
    return P.quota_fill(bucketed(spark, sf), {"best": 4, "wide": 3, "click": 2}, 18, 12, per_label=2, per_run=1, run_gap=240.0)


#: Visits in the order of the passes, folded past the picks so far.
QUOTA = BUCKETED + """,
    n AS (SELECT *, lag(label) OVER w IS DISTINCT FROM label OR timestamp_sec - lag(timestamp_sec) OVER w > 240 AS new FROM bucketed WINDOW w AS (PARTITION BY scene_id ORDER BY timestamp_sec, obs_id)),
    q AS (SELECT *, sum(new::INT) OVER (PARTITION BY scene_id ORDER BY timestamp_sec, obs_id) AS run, sum(new::INT) OVER (PARTITION BY scene_id, label ORDER BY timestamp_sec, obs_id) AS nth FROM n),
    total AS (SELECT scene_id, count(*)::INTEGER AS eligible, max(run)::INTEGER AS runs, least(36, greatest(18, max(run)))::INTEGER AS most FROM q GROUP BY scene_id),
    visits AS (
        SELECT *, 0 AS step, 0 AS o1, 2 * run AS o2, '' AS o3 FROM q UNION ALL SELECT *, 1, 0, 2 * run + 1, '' FROM q
        UNION ALL SELECT *, 2, 2, CASE bucket WHEN 'best' THEN 0 WHEN 'wide' THEN 1 ELSE 2 END, '' FROM q WHERE bucket IN ('best', 'wide', 'click')
        UNION ALL SELECT *, 3, 3, 0, label FROM q UNION ALL SELECT *, 4, 4, 0, '' FROM q UNION ALL SELECT *, 5, 5, 0, '' FROM q
    ),
    listed AS (SELECT scene_id, list({'id': obs_id, 't': timestamp_sec, 'label': label, 'bucket': bucket, 'run': run, 'name': label || '_' || lpad(nth::VARCHAR, greatest(2, length(nth::VARCHAR))::INTEGER, '0'), 'score': score, 'step': step, 'most': most, 'gap': CASE step WHEN 1 THEN 8.0 WHEN 5 THEN 0.0 ELSE 20.0 END}
        ORDER BY o1, o2, o3, -score, -label_confidence, -motion, timestamp_sec, obs_id) AS rows FROM visits JOIN total USING (scene_id) GROUP BY scene_id),
    folded AS (SELECT scene_id, list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: CASE
        WHEN len(acc) < x[1].most AND NOT list_contains(list_transform(acc, lambda y: y.id), x[1].id) AND len(list_filter(acc, lambda y: abs(y.t - x[1].t) < x[1].gap)) = 0
            AND CASE WHEN x[1].step <= 1 THEN len(list_filter(acc, lambda y: y.step <= 1 AND y.run = x[1].run)) < 1
                WHEN x[1].step = 2 THEN len(list_filter(acc, lambda y: y.bucket = x[1].bucket)) < CASE x[1].bucket WHEN 'best' THEN 4 WHEN 'wide' THEN 3 ELSE 2 END
                WHEN x[1].step = 3 THEN len(list_filter(acc, lambda y: y.label = x[1].label)) < 2
                ELSE len(acc) < 12 END
        THEN list_concat(acc, x) ELSE acc END, []) AS picks FROM listed)"""


@query("quota_fill", f"""
    WITH {QUOTA}, u AS (SELECT scene_id, unnest(picks) AS p, unnest(range(1, len(picks) + 1)) AS rank FROM folded)
    SELECT scene_id, p.id AS obs_id, p.t AS timestamp_sec, p.label AS label, p.bucket AS bucket, p.name AS run_label, p.score AS score,
        CASE WHEN p.step <= 1 THEN 0 WHEN p.step <= 3 THEN 1 ELSE p.step - 2 END AS pick_pass, rank::INTEGER AS rank FROM u""")
def _(spark, sf):
    return _quota(spark, sf)[0]


@query("quota_fill_stats", f"WITH {QUOTA} SELECT scene_id, eligible, runs, most AS effective_max, len(picks)::INTEGER AS picks FROM folded JOIN total USING (scene_id)")
def _(spark, sf):
    return _quota(spark, sf)[1]

"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentra.operators import windows as W
from momentra.plans.registry import query
from momentra.plans.tables import LOGS, OBS, PUBLICATION, frame_obs, joined, publication, scene_log, scenes, table

RUNS = """
f AS (SELECT *, CASE WHEN lag(label) OVER w IS NULL OR lag(label) OVER w <> label OR timestamp_sec - lag(timestamp_sec) OVER w > {gap} THEN 1 ELSE 0 END AS new FROM frame_obs WHERE {keep} WINDOW w AS (PARTITION BY scene_id ORDER BY timestamp_sec, obs_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY scene_id ORDER BY timestamp_sec, obs_id) AS run FROM f)"""


@query("label_runs", f"""
    WITH {OBS}, {RUNS.format(gap=120, keep='label_confidence >= 0.45')}, r AS (SELECT scene_id, run::BIGINT AS run, label, min(timestamp_sec) AS start_sec,
            max(timestamp_sec) AS end_sec, count(*) AS n FROM g GROUP BY ALL)
    SELECT *, dense_rank() OVER (PARTITION BY scene_id, label ORDER BY run)::INTEGER AS label_run
    FROM r""")
def _(spark, sf):
    return W.label_runs(frame_obs(spark, sf))


@query("semantic_sections", f"""
    WITH {OBS}, {RUNS.format(gap=75, keep='true')}, s AS (SELECT scene_id, run, label, min(timestamp_sec) AS t0, max(timestamp_sec) AS t1, count(*) AS n,
            avg(score) AS s, round(avg(motion), 5) AS avg_motion, avg(label_confidence) AS c, arg_max(timestamp_sec, (score, -timestamp_sec, -obs_id)) AS thumb_sec
        FROM g GROUP BY ALL),
    o AS (SELECT *, greatest(0.0::DOUBLE, t0 - 2) AS a, row_number() OVER (PARTITION BY scene_id ORDER BY run)::INTEGER AS section
        FROM s)
    SELECT scene_id, label, round(a, 3) AS start_sec, round(greatest(a + 1, t1 + 2), 3) AS end_sec, n, round(s, 4) AS avg_score, avg_motion, round(greatest(c, s / 100),
            6) AS confidence, thumb_sec, section FROM o WHERE section <= 20""")
def _(spark, sf):
    return W.semantic_sections(frame_obs(spark, sf), top=20)


@query("rolling_floor", f"""
    WITH {OBS} SELECT obs_id, round(greatest(50.0::DOUBLE, CASE WHEN count(*) OVER w >= 30 THEN quantile_cont(sharpness, 0.1) OVER w ELSE 25.0::DOUBLE END),
            4) AS floor FROM frame_obs WHERE brightness >= 0.1 WINDOW w AS (PARTITION BY scene_id
        ORDER BY timestamp_sec, obs_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return W.rolling_floor(frame_obs(spark, sf)).select("obs_id", "floor")


@query("motion_delta", """
    WITH x AS (SELECT vec_id, label, embedding AS v, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p
        FROM embeddings WHERE vec_id % 3 <> 0)
    SELECT vec_id, round(list_sum(list_transform(list_zip(v, p), lambda z: abs(z[1] - z[2])::DOUBLE)) / 64 / 32, 8) AS motion
    FROM x""")
def _(spark, sf):
    x = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("scene_id"), F.col("vec_id").alias("obs_id"),
        F.col("vec_id").cast("double").alias("timestamp_sec"), "embedding"
    )
    return W.motion_delta(x, "embedding", F.col("vec_id") % 3 != 0).select("vec_id", F.round("motion", 8).alias("motion"))


SIGNED = """signed AS (SELECT vec_id, label, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN (1::BIGINT << (i - 1)::INTEGER) ELSE 0::BIGINT END))::BIGINT AS hash
        FROM embeddings)"""


@query("signature", f"WITH {SIGNED} SELECT vec_id, hash FROM signed")
def _(spark, sf):
    return W.signature(table(spark, sf, "embeddings"), "embedding").select("vec_id", "hash")


@query("chapters", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),
            3) AS start_sec FROM lineitem""")
def _(spark, sf):
    x = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_orderkey").alias("group_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"), F.col("l_quantity").alias("duration_sec")
    )
    return W.chapters(x).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "start_sec")


@query("spec_compat", """
    WITH x AS (SELECT *, first(l_quantity) OVER w AS f, first(l_returnflag) OVER w AS r, first(l_linestatus) OVER w AS c
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([CASE WHEN abs(l_quantity - f) > 10 THEN 'fps' END, CASE WHEN l_returnflag <> r THEN 'resolution' END, CASE WHEN l_linestatus <> c THEN 'codec' END], lambda x: x IS NOT NULL),
            '|') AS issues FROM x""")
def _(spark, sf):
    x = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_orderkey").alias("group_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"), F.col("l_quantity").alias("fps"),
        F.col("l_returnflag").alias("resolution"), F.col("l_linestatus").alias("codec")
    )
    return W.spec_compat(x, 10).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", joined("issues").alias("issues"))


BATCHES = LOGS + ", b AS (SELECT source AS lane, strftime(processed_at, '%Y-%m') AS batch_id, avg(duration_sec) AS avg_sec FROM scene_log GROUP BY ALL)"


def batches(spark, sf):
    return scene_log(spark, sf).groupBy(F.col("source").alias("lane"), F.date_format("processed_at", "yyyy-MM").alias("batch_id")).agg(F.avg("duration_sec").alias("avg_sec"))


@query("trend_verdict", f"""
    WITH {BATCHES}, x AS (SELECT *, count(*) OVER w AS n, avg(avg_sec) OVER w AS base FROM b WINDOW w AS (PARTITION BY lane ORDER BY batch_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
    y AS (SELECT *, (avg_sec - base) / base * 100 AS p FROM x)
    SELECT lane, batch_id, round(base, 4) AS baseline, round(p, 2) AS pct, CASE WHEN n = 0 THEN 'first' WHEN p < -10 THEN 'faster' WHEN p > 25 THEN 'much_slower' WHEN p > 10 THEN 'slower' ELSE 'stable' END AS verdict
    FROM y""")
def _(spark, sf):
    return W.trend_verdict(batches(spark, sf)).drop("avg_sec")


@query("trend_split", f"""
    WITH {BATCHES}, x AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY batch_id DESC) AS n
        FROM b)
    SELECT lane, round(avg(avg_sec) FILTER (n <= 5), 4) AS recent, round(avg(avg_sec) FILTER (n > 5), 4) AS previous, count(*) AS batches
    FROM x WHERE n <= 10 GROUP BY lane""")
def _(spark, sf):
    return W.trend_split(batches(spark, sf))


@query("pass_streak", """
    WITH x AS (SELECT o_custkey, o_totalprice > 100000 AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
        FROM orders)
    SELECT o_custkey AS pack_id, coalesce(min(n) FILTER (NOT ok), count(*) + 1) - 1 AS streak FROM x
    GROUP BY o_custkey""")
def _(spark, sf):
    x = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pack_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("run_id"),
        (F.col("o_totalprice") > 100000).alias("gates_pass")
    )
    return W.pass_streak(x)


@query("latest_status", f"""
    WITH {PUBLICATION} SELECT scene_id, lower(trim(channel)) AS channel, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts, count(*) AS events
    FROM publication GROUP BY scene_id, lower(trim(channel))""")
def _(spark, sf):
    return W.latest_status(publication(spark, sf))


@query("even_samples", f"""
    WITH {OBS}, s AS (SELECT scene_id, least(max(duration_sec), 3000.0::DOUBLE) AS d FROM frame_obs
        GROUP BY scene_id HAVING max(duration_sec) > 0)
    SELECT scene_id, i::INTEGER AS i, floor(((i + 0.5::DOUBLE) * d / 20) * 10) AS t10 FROM s, range(20) t(i)""")
def _(spark, sf):
    x = W.even_samples(scenes(frame_obs(spark, sf)), 20, 3000.0)
    return x.select("scene_id", "i", F.floor(F.col("timestamp_sec") * 10).cast("double").alias("t10"))


@query("segments", f"""
    WITH {OBS} SELECT obs_id, CASE WHEN duration_sec > 0 THEN CASE WHEN duration_sec >= 1800 THEN least(7, floor(timestamp_sec / (duration_sec / 8)))::INTEGER ELSE 0 END ELSE 0 END AS segment_idx
    FROM frame_obs""")
def _(spark, sf):
    x = frame_obs(spark, sf)
    return W.segments(x.drop("duration_sec"), scenes(x), 8).select("obs_id", "segment_idx")


@query("activity_curve", f"""
    WITH {OBS} SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY timestamp_sec, obs_id)::INTEGER AS point, timestamp_sec, score, motion
    FROM frame_obs QUALIFY point <= 1200""")
def _(spark, sf):
    return W.activity_curve(frame_obs(spark, sf))

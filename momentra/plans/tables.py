"""The engine's tables built from the driver's tables, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]), lambda x: x.isNotNull())


def joined(c: str | Column) -> Column:
    return F.array_join(c, "|")


OBS = """
e AS (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER AS k, epoch_us(ts) AS us FROM events),
frame_obs AS (
    SELECT user_id::VARCHAR AS scene_id, event_id AS obs_id, ((us - min(us) OVER w) // 720000) / 1000.0::DOUBLE AS timestamp_sec, ((max(us) OVER w - min(us) OVER w) // 720000) / 1000.0::DOUBLE AS duration_sec,
           value * 6 AS sharpness, k / 20.0::DOUBLE AS motion, value / 20.0::DOUBLE AS brightness, upper(event_type) AS label, k / 100.0::DOUBLE AS label_confidence, least(100.0::DOUBLE, value) AS score, k % 10 <> 0 AS parse_succeeded,
           CASE WHEN k % 7 <> 0 THEN value * 1.1::DOUBLE END AS model_score_raw, xor(('0x' || substr(md5(k::VARCHAR), 1, 15))::BIGINT, event_id % 4) AS phash,
           CASE WHEN value >= 50 THEN 'TIER_1' WHEN value >= 20 THEN 'TIER_2' WHEN value >= 5 THEN 'TIER_3' END AS tier, CASE k % 3 WHEN 0 THEN 'wide' WHEN 1 THEN 'close' ELSE 'mid' END AS type,
           list_filter([CASE WHEN k % 5 = 0 THEN 'five' END, CASE WHEN k % 11 = 0 THEN 'eleven' END], lambda x: x IS NOT NULL) AS flags, k, value AS v
    FROM e WINDOW w AS (PARTITION BY user_id)
)"""


def frame_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: a scene is a user, its time the user's, 30 days as an hour."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("scene_id"), F.col("event_id").alias("obs_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("v"), F.upper("event_type").alias("label"),
        F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    span = e.groupBy("scene_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    x = e.join(span, "scene_id")
    v, k = F.col("v"), F.col("k")
    sec = lambda a, b: F.expr(f"({a} - {b}) div 720000") / 1000.0
    kind = F.when(k % 3 == 0, "wide").when(k % 3 == 1, "close").otherwise("mid")
    return x.select(
        "scene_id", "obs_id", sec("us", "lo").alias("timestamp_sec"), sec("hi", "lo").alias("duration_sec"), (v * 6).alias("sharpness"), (k / 20.0).alias("motion"), (v / 20.0).alias("brightness"), "label", (k / 100.0).alias("label_confidence"), F.least(F.lit(100.0), v).alias("score"), (k % 10 != 0).alias("parse_succeeded"),
        F.when(k % 7 != 0, v * 1.1).alias("model_score_raw"), F.conv(
            F.substring(F.md5(k.cast("string").cast("binary")), 1, 15), 16, 10
        ).cast("long").bitwiseXOR(F.col("obs_id") % 4).alias("phash"),
        F.when(v >= 50, "TIER_1").when(v >= 20, "TIER_2").when(v >= 5, "TIER_3").alias("tier"), kind.alias("type"), listed(
            (k % 5 == 0, "five"), (k % 11 == 0, "eleven")
        ).alias("flags"), "k", "v",
    )


def scenes(obs: DataFrame) -> DataFrame:
    return obs.groupBy("scene_id").agg(F.max("duration_sec").alias("duration_sec"))


ZONED = OBS + """,
zoned AS (
    SELECT *, list_filter([CASE WHEN duration_sec > 0 AND timestamp_sec / duration_sec >= 0.8 THEN 'late' END, CASE WHEN duration_sec > 0 AND timestamp_sec / duration_sec BETWEEN 0.25 AND 0.5 THEN 'build' END], lambda x: x IS NOT NULL) AS zone_tags FROM frame_obs
)"""


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from momentra.operators.scalars import zone_tags

    return zone_tags(frame_obs(spark, sf_dir))


LOGS = """
scene_log AS (
    SELECT o_orderkey::VARCHAR AS scene_id, o_orderkey AS n, lower(c_mktsegment) AS source, o_orderdate AS processed_at, CASE WHEN o_orderkey % 17 = 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, o_totalprice / 4000.0::DOUBLE) END AS top_score, (o_orderkey % 20)::INTEGER AS picks, o_totalprice / 1000.0::DOUBLE AS duration_sec,
           list_filter([CASE WHEN o_orderstatus = 'P' THEN 'SCAN_TIMEOUT' END, CASE WHEN o_orderstatus = 'F' THEN 'DECODE' END, CASE WHEN o_orderkey % 13 = 0 THEN 'LOW_LIGHT' END], lambda x: x IS NOT NULL) AS error_codes,
           list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'A' END, CASE WHEN o_orderkey % 7 = 0 THEN 'D' END], lambda x: x IS NOT NULL) AS fallbacks,
           o_orderpriority || ' ' || c_name AS title, o_orderkey % 11 = 0 AS flagged, o_orderpriority AS mode, CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'warning' ELSE 'aborted' END AS outcome, c_custkey, o_totalprice
    FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def scene_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = F.col("o_orderkey")
    x = o.join(c, o["o_custkey"] == c["c_custkey"])
    return x.select(
        n.cast("string").alias("scene_id"), n.alias("n"), F.lower("c_mktsegment").alias("source"), F.col("o_orderdate").cast("timestamp").alias("processed_at"), F.when(n % 17 == 0, 0.0).otherwise(
            F.least(F.lit(100.0), F.col("o_totalprice") / 4000.0)
        ).alias("top_score"), (n % 20).cast("int").alias("picks"), (F.col("o_totalprice") / 1000.0).alias("duration_sec"),
        listed(
            (F.col("o_orderstatus") == "P", "SCAN_TIMEOUT"), (F.col("o_orderstatus") == "F", "DECODE"), (n % 13 == 0, "LOW_LIGHT")
        ).alias("error_codes"), listed((n % 3 == 0, "A"), (n % 7 == 0, "D")).alias("fallbacks"),
        F.concat("o_orderpriority", F.lit(" "), "c_name").alias("title"), (n % 11 == 0).alias("flagged"), F.col("o_orderpriority").alias("mode"), F.when(
            F.col("o_orderstatus") == "O", "completed"
        ).when(F.col("o_orderstatus") == "F", "warning").otherwise("aborted").alias("outcome"), "c_custkey", "o_totalprice",
    )


PHASES = """
phase_rows AS (SELECT l_orderkey::VARCHAR AS job_id, l_returnflag || l_linestatus AS phase, sum(l_quantity) AS sec, count(*) AS frames, max(l_shipdate) AS ts FROM lineitem GROUP BY l_orderkey, phase)"""


def run_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, ts, phases map<string, double>)"""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("job_id"), F.concat("l_returnflag", "l_linestatus").alias("phase")).agg(
        F.sum("l_quantity").alias("sec"), F.count(F.lit(1)).alias("frames"), F.max(F.col("l_shipdate").cast("timestamp")).alias("ts")
    )
    return x.groupBy("job_id").agg(
        F.max("ts").alias("ts"), F.map_from_entries(F.collect_list(F.struct("phase", "sec"))).alias("phases"),
        F.map_from_entries(F.collect_list(F.struct("phase", "frames"))).alias("frames")
    )


FEEDBACK = """
feedback AS (
    SELECT d.doc_id, d.source AS scene_id, 'f' || d.doc_id::VARCHAR AS filename, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'keep' WHEN quality = 0 THEN 'maybe' END AS decision, CASE WHEN quality IS NOT NULL THEN quality * 60.0::DOUBLE + (d.doc_id % 40) - toxic * 30 END AS operator_score,
           (n_chars % 101)::DOUBLE AS model_score, lang AS model_label, CASE WHEN quality IS NOT NULL THEN CASE WHEN d.doc_id % 7 = 0 THEN 'xx' ELSE lang END END AS operator_label, text AS title, text, TIMESTAMP '2024-01-01' + to_seconds(d.doc_id) AS ts, n_chars, quality, toxic
    FROM documents d LEFT JOIN labels USING (doc_id)
)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    x = d.join(lab, "doc_id", "left")
    i = F.col("doc_id")
    return x.select(
        "doc_id", F.col("source").alias("scene_id"), F.concat(F.lit("f"), i.cast("string")).alias("filename"), F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "keep").when(F.col("quality") == 0, "maybe").alias("decision"), F.when(
            F.col("quality").isNotNull(), F.col("quality") * 60.0 + i % 40 - F.col("toxic") * 30
        ).alias("operator_score"),
        (F.col("n_chars") % 101).cast("double").alias("model_score"), F.col("lang").alias("model_label"), F.when(
            F.col("quality").isNotNull(), F.when(i % 7 == 0, "xx").otherwise(F.col("lang"))
        ).alias("operator_label"), F.col("text").alias("title"), "text", F.timestamp_seconds(i + F.lit(1704067200)).alias("ts"), "n_chars", "quality", "toxic",
    )


PUBLICATION = """
publication AS (
    SELECT event_id, user_id::VARCHAR AS scene_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE ' ' || event_type END AS channel, CASE WHEN value < 10 THEN 'submitted' WHEN value < 40 THEN 'accepted' WHEN value < 80 THEN 'published' ELSE 'rejected' END AS status, ts FROM events
)"""


def publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("scene_id"),
        F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type")).alias("channel"),
        F.when(v < 10, "submitted").when(v < 40, "accepted").when(v < 80, "published").otherwise("rejected").alias("status"),
        F.col("ts").cast("timestamp").alias("ts")
    )


def values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A literal lookup table."""
    return spark.createDataFrame(rows, schema)

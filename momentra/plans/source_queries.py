"""Queries of sources, sinks and streams. Files are written to the shared folder from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from momentra.operators import joins as J
from momentra.plans.join_queries import CHANNEL, channel_rules, delivery
from momentra.plans.registry import query
from momentra.plans.similarity_queries import SPLIT, train
from momentra.plans.tables import FEEDBACK, OBS, PUBLICATION, feedback, frame_obs, publication, table
from momentra.sources import files, versions
from momentra.streaming import feeds
from momentra.streaming.run import open_stream, run_available, shared_dir


def _new(spark, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@query("read_ledger", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 3")
def _(spark, sf):
    path = _new(spark, "ledger")
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    i = F.col("event_id")
    table(spark, sf, "events").select(F.when(i % 10 == 3, F.when(i % 20 == 3, "").otherwise('{"event_id": 1, ')).otherwise(line).alias("value")).write.text(path)
    return files.read_ledger(spark, path, "event_id long, user_id long, event_type string")


@query("append_ledger", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf):
    path = _new(spark, "append")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    files.append_ledger(o.where("o_orderkey % 2 = 0"), path)
    files.append_ledger(o.where("o_orderkey % 2 != 0"), path)
    return files.read_ledger(spark, path, "o_orderkey long, o_orderstatus string")


@query("read_scene_docs", "SELECT s_suppkey::VARCHAR AS scene_id, s_name AS source FROM supplier WHERE s_suppkey % 5 <> 0")
def _(spark, sf):
    path = _new(spark, "docs")
    key = F.col("s_suppkey")  # a file a supplier, every fifth of them broken, a thousand a folder
    doc = F.when(key % 5 == 0, '{\n "scene_id": ').otherwise(F.concat(F.lit('{\n "scene_id": "'), key.cast("string"), F.lit('",\n "source": "'), "s_name", F.lit('"\n}')))
    folder = F.concat(F.lit("docs-"), F.floor(key / 1000).cast("string"))
    files.write_docs(table(spark, sf, "supplier").select(folder.alias("folder"), F.concat(key.cast("string"), F.lit(".json")).alias("name"), doc.alias("value")), path)
    return files.read_scene_docs(spark, f"{path}/docs-*", "scene_id string, source string", f"{path}-compact")


@query("read_label_csv", """
    SELECT doc_id::VARCHAR AS scene_id, quality::VARCHAR AS operator_score, CASE WHEN toxic = 1 THEN 'reject' END AS decision
    FROM labels""")
def _(spark, sf):
    path = _new(spark, "csv")
    table(spark, sf, "labels").select(
        F.col("doc_id").alias("Scene ID"), F.col("quality").alias("Human-Score"), F.when(F.col("toxic") == 1, "reject").alias("Verdict")
    ).write.option("header", True).csv(path)
    return files.read_label_csv(spark, path).select("scene_id", "operator_score", "decision")


def assets(spark, sf):
    """An asset listing made from the parts: a path, a size, a duration."""
    i = F.col("p_partkey")
    ext = F.when(i % 5 == 0, "mp4").when(i % 5 == 1, "jpg").when(i % 5 == 2, "pdf").when(i % 5 == 3, "MOV").otherwise("json")
    folder = F.concat(F.lit("/lib/"), F.regexp_replace("p_brand", "#", ""), F.lit("/"), (F.expr("p_partkey div 10")).cast("string"))
    name = F.when(i % 30 == 2, "identity_record").when(i % 30 == 12, "Identity-Record").when(i % 15 == 0, "trailer").otherwise("clip")
    path = F.concat(folder, F.when(i % 35 == 0, "/_work/").otherwise("/"), name, F.when(name == "identity_record", "").otherwise(i.cast("string")), F.lit("."), ext)
    return table(spark, sf, "part").select(
        i.alias("n"), path.alias("path"), folder.alias("scene_id"), (F.col("p_retailprice") * 2000).cast("long").alias("length"),
        F.col("p_size").cast("double").alias("duration_sec"), F.col("p_partkey").alias("size")
    )


ASSETS = """
a0 AS (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'mp4' WHEN 1 THEN 'jpg' WHEN 2 THEN 'pdf' WHEN 3 THEN 'MOV' ELSE 'json' END AS ext, '/lib/' || replace(p_brand, '#', '') || '/' || (p_partkey // 10)::VARCHAR AS folder, CASE WHEN p_partkey % 30 = 2 THEN 'identity_record' WHEN p_partkey % 30 = 12 THEN 'Identity-Record' WHEN p_partkey % 15 = 0 THEN 'trailer' ELSE 'clip' END AS nm FROM part),
assets AS (SELECT p_partkey AS n, folder || CASE WHEN p_partkey % 35 = 0 THEN '/_work/' ELSE '/' END || nm || CASE WHEN nm = 'identity_record' THEN '' ELSE p_partkey::VARCHAR END || '.' || ext AS path, folder AS scene_id, (p_retailprice * 2000)::BIGINT AS length, p_size::DOUBLE AS duration_sec, p_partkey AS size, ext, nm FROM a0)"""


@query("asset_inventory", """
    SELECT 'part=' || event_type || '.' || CASE WHEN event_id % 3 = 0 THEN 'mp4' ELSE 'doc' END AS folder, count(*) * 2 AS length
    FROM events WHERE event_id % 3 = 0 AND event_type <> 'click' GROUP BY ALL HAVING count(*) * 2 >= 20""")
def _(spark, sf):
    """Writes a file of two bytes a row for each kind of event, then lists the folder; click files lie in a work folder."""
    path = _new(spark, "assets")
    kind = F.concat("event_type", F.lit("."), F.when(F.col("event_id") % 3 == 0, "mp4").otherwise("doc"))
    e = table(spark, sf, "events").select(F.lit("x").alias("value"), F.when(F.col("event_type") == "click", "_work").otherwise("files").alias("place"), kind.alias("part"))
    e.repartition(1, "part").write.partitionBy("place", "part").text(path)
    extension = r"part=[^/]*\.(mp4|mov|doc)/"
    found = files.asset_inventory(spark, path, min_bytes=20, skip=r"place=_work/", kind_of=extension)
    return found.select(F.regexp_extract("path", r"(part=[^/]*)/", 1).alias("folder"), "length")


@query("inventory_filter", f"WITH {ASSETS} SELECT path FROM assets WHERE lower(ext) IN ('mp4', 'mov') AND length >= 1850000 AND path NOT LIKE '%/_work/%'")
def _(spark, sf):
    return files.inventory_filter(assets(spark, sf), min_bytes=1_850_000).select("path")


@query("asset_manifest", f"""
    WITH {ASSETS}, t AS (SELECT * FROM assets QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY path) <= 3)
    SELECT scene_id, count(*) FILTER (ext = 'pdf') AS document, count(*) FILTER (ext = 'jpg') AS image, count(*) FILTER (ext = 'json') AS metadata,
        count(*) FILTER (lower(ext) IN ('mp4', 'mov')) AS video, 0::BIGINT AS other, min(path) FILTER (lower(ext) IN ('mp4', 'mov') AND nm <> 'trailer') AS primary_path
    FROM t GROUP BY scene_id""")
def _(spark, sf):
    return files.asset_manifest(assets(spark, sf), 3)


@query("companion_files", f"""
    WITH {ASSETS}, x AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, path, CASE WHEN path LIKE '%.json' THEN 0 WHEN path LIKE '%.pdf' THEN 1 END AS p
        FROM assets)
    SELECT folder, arg_min(path, (p, path)) FILTER (p IS NOT NULL) AS companion FROM x GROUP BY folder""")
def _(spark, sf):
    return files.companion_files(assets(spark, sf), [".json", ".pdf"])


@query("record_presence", f"""
    WITH {ASSETS}, x AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, max(CASE WHEN nm = 'identity_record' THEN 3 WHEN nm = 'Identity-Record' THEN 1 END) AS h
        FROM assets GROUP BY 1)
    SELECT folder, CASE h WHEN 3 THEN 'exact' WHEN 1 THEN 'pattern' ELSE 'none' END AS found, CASE WHEN h IS NULL THEN 'RECORD_MISSING' END AS error_code,
        h IS NULL AS blocked FROM x""")
def _(spark, sf):
    return files.record_presence(assets(spark, sf))


@query("primary_asset", f"""
    WITH {ASSETS} SELECT scene_id, path FROM assets QUALIFY row_number() OVER (PARTITION BY scene_id
        ORDER BY duration_sec DESC, size DESC, path) = 1""")
def _(spark, sf):
    return files.primary_asset(assets(spark, sf))


@query("write_splits", f"WITH {SPLIT} SELECT split, count(*) AS n FROM marked GROUP BY split UNION ALL SELECT 'all', count(*) FROM marked")
def _(spark, sf):
    from momentra.operators.similarity import hash_split

    return files.write_splits(hash_split(train(spark, sf)), _new(spark, "splits"))


@query("handoff_metadata", f"""
    WITH {CHANNEL} SELECT channel, scene_id, d.title AS title, nullif(array_to_string(['t0', 't1', 't2', 't3', 't4'][1:nt], ','), '') AS tags
    FROM cr JOIN d USING (scene_id) WHERE ready""")
def _(spark, sf):
    x = delivery(spark, sf)
    ok = J.channel_validate(x, channel_rules(spark)).select("scene_id", "channel", F.col("ready").alias("eligible"))
    return files.handoff_metadata(x, ok, _new(spark, "handoff")).select("channel", F.col("scene_id").cast("string"), "title", "tags")


@query("checksum_manifest", """
    SELECT sha256(event_type || chr(10)) AS sha256, octet_length((event_type || chr(10))::BLOB) AS length
    FROM (SELECT DISTINCT event_type FROM events)""")
def _(spark, sf):
    path = _new(spark, "sums")
    table(spark, sf, "events").select(F.col("event_type").alias("value"), F.col("event_type").alias("part")).distinct().repartition("part").write.partitionBy("part").text(path)
    return files.checksum_manifest(spark, path).select("sha256", "length")


# streams --------------------------------------------------------------------------------------------------------

@query("stream_status", f"""
    WITH {PUBLICATION} SELECT scene_id, lower(trim(channel)) AS channel, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts, count(*) AS events
    FROM publication GROUP BY 1, 2""")
def _(spark, sf):
    e = open_stream(spark, sf, "events")
    v = F.col("value")
    x = e.select(
        "event_id", F.col("user_id").cast("string").alias("scene_id"),
        F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type")).alias("channel"),
        F.when(v < 10, "submitted").when(v < 40, "accepted").when(v < 80, "published").otherwise("rejected").alias("status"),
        F.col("ts").cast("timestamp").alias("ts")
    )
    return run_available(feeds.stream_status(x, "40 days"), "complete")


@query("stream_status_batch", f"""
    WITH {PUBLICATION} SELECT scene_id, lower(trim(channel)) AS channel, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts, count(*) AS events
    FROM publication GROUP BY 1, 2""")
def _(spark, sf):
    return feeds.stream_status(publication(spark, sf))


@query("stream_phase_windows", """
    SELECT date_trunc('hour', ts) AS start_ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_ts, event_type AS phase, count(*) AS n, round(avg(value),
            6) AS avg_sec, max(value) AS max_sec FROM events WHERE value > 0 GROUP BY ALL""")
def _(spark, sf):
    e = open_stream(spark, sf, "events")
    x = e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("phase"), F.col("value").alias("sec"))
    return run_available(feeds.stream_phase_windows(x), "complete")


SESSIONS = """
WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS new
        FROM events WHERE value > 0 WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g
        FROM x)
    SELECT min(ts) AS start_ts, max(ts) + INTERVAL 20 MINUTE AS end_ts, event_type AS phase, count(*) AS n, max(value) AS max_sec
    FROM s GROUP BY event_type, g"""


def sessions_of(events):
    x = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("phase"), F.col("value").alias("sec"))
    return feeds.stream_phase_windows(x, session_gap="20 minutes").drop("avg_sec")


@query("stream_phase_sessions", SESSIONS)
def _(spark, sf):
    return run_available(sessions_of(open_stream(spark, sf, "events")), "complete")


@query("stream_phase_sessions_batch", SESSIONS)
def _(spark, sf):
    return sessions_of(table(spark, sf, "events"))


@query("stream_feedback_mix", f"WITH {FEEDBACK} SELECT scene_id, coalesce(decision, 'other') AS decision, count(*) AS n FROM feedback GROUP BY 1, 2")
def _(spark, sf):
    d = open_stream(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    decision = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "keep").when(F.col("quality") == 0, "maybe")
    return run_available(feeds.stream_feedback_mix(d.select(F.col("source").alias("scene_id"), decision.alias("decision"))), "complete")


SIEVE = """
x AS (SELECT user_id::VARCHAR AS scene_id, event_id AS obs_id, epoch_us(ts) AS t, value * 6 AS sharpness, value / 20.0::DOUBLE AS brightness, regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER AS k, event_id FROM events),
y AS (SELECT *, k / 20.0::DOUBLE AS motion, xor(('0x' || substr(md5(k::VARCHAR), 1, 15))::BIGINT, event_id % 4) AS phash FROM x),
lit AS (SELECT *, quantile_cont(sharpness, 0.1) OVER w AS low, count(*) OVER w AS c FROM y WHERE brightness >= 0.1 WINDOW w AS (PARTITION BY scene_id ORDER BY t, obs_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
floored AS (SELECT *, greatest(50.0::DOUBLE, CASE WHEN c >= 30 THEN low ELSE 25 END) AS floor FROM lit),
why AS (SELECT *, CASE WHEN sharpness < floor THEN 'below_floor' WHEN motion > 4.5 THEN 'high_motion' END AS verdict FROM floored),
fit AS (SELECT scene_id, list({'id': obs_id, 'h': phash} ORDER BY t, obs_id) AS rows FROM why WHERE verdict IS NULL GROUP BY scene_id),
kept AS (SELECT unnest(list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: bit_count(xor(y.h, x[1].h)) <= 5)) = 0 THEN list_concat(acc, x) ELSE acc END, [])) AS p FROM fit),
sieved AS (SELECT scene_id, obs_id, round(floor, 4) AS floor, coalesce(verdict, CASE WHEN p.id IS NULL THEN 'duplicate' ELSE 'kept' END) AS verdict FROM why LEFT JOIN kept ON p.id = obs_id UNION ALL SELECT scene_id, obs_id, NULL, 'dark' FROM y WHERE brightness < 0.1)"""


def sieve_feed(spark, sf):
    """The events as a stream of observations."""
    e, k, v = open_stream(spark, sf, "events"), F.get_json_object("props", "$.k").cast("int"), F.col("value")
    hashed = F.conv(F.substring(F.md5(k.cast("string").cast("binary")), 1, 15), 16, 10).cast("long").bitwiseXOR(F.col("event_id") % 4)
    return e.select(
        F.col("user_id").cast("string").alias("scene_id"), F.col("event_id").alias("obs_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("timestamp_sec"), (v * 6).alias("sharpness"),
        (v / 20.0).alias("brightness"), (k / 20.0).alias("motion"), hashed.alias("phash")
    )


@query("stream_sieve", f"WITH {SIEVE} SELECT * FROM sieved")
def _(spark, sf):
    return run_available(feeds.stream_sieve(sieve_feed(spark, sf))).drop("timestamp_sec")


@query("stream_sieve_counts", f"WITH {SIEVE} SELECT scene_id, verdict, count(*) AS n FROM sieved GROUP BY ALL")
def _(spark, sf):
    return feeds.verdict_counts(run_available(feeds.stream_sieve(sieve_feed(spark, sf))))


@query("erase_versions", """
    SELECT 2::BIGINT AS version, count(*) FILTER (user_id % 7 = 0 AND event_id % 50 <> 0) AS removed, count(*) FILTER (user_id % 7 <> 0 OR event_id % 50 = 0) AS kept
    FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("scene_id"))
    root = _new(spark, "ledger")
    versions.append_rows(e, root)
    return versions.erase_keys(spark, root, e.where("scene_id % 7 = 0").select("scene_id")).drop("rewritten")


@query("feedback_rows", f"WITH {FEEDBACK} SELECT doc_id, scene_id, decision, operator_score, model_score FROM feedback")
def _(spark, sf):
    return feedback(spark, sf).select("doc_id", "scene_id", "decision", "operator_score", "model_score")


@query("frame_obs", f"WITH {OBS} SELECT obs_id, timestamp_sec, duration_sec, phash, tier FROM frame_obs")
def _(spark, sf):
    return frame_obs(spark, sf).select("obs_id", "timestamp_sec", "duration_sec", "phash", "tier")

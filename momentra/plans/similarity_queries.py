"""Queries of merges, near-duplicates, training data and user scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentra.functions import columns as C
from momentra.operators import merges as M
from momentra.operators import similarity as D
from momentra.operators.scoring import score_with
from momentra.plans.registry import query
from momentra.plans.selection_queries import TITLES, titles
from momentra.plans.tables import FEEDBACK, LOGS, OBS, feedback, frame_obs, scene_log, table, values


@query("pool_union", f"""
    WITH {OBS}, p AS (SELECT *, 0 AS pool FROM frame_obs WHERE score >= 80 UNION ALL SELECT *, 1 AS pool
        FROM frame_obs WHERE k % 2 = 0)
    SELECT obs_id, pool FROM p QUALIFY row_number() OVER (PARTITION BY scene_id, timestamp_sec, label
        ORDER BY pool, obs_id) = 1""")
def _(spark, sf):
    x = frame_obs(spark, sf)
    return M.pool_union(x.where("score >= 80"), x.where("k % 2 = 0")).select("obs_id", "pool")


@query("bank_append", """
    SELECT lower(c_mktsegment) || (c_custkey % 40)::VARCHAR AS k, min(c_custkey) AS id FROM customer
    WHERE c_custkey % 4 = 0 GROUP BY 1 UNION ALL SELECT lower(c_mktsegment) || (c_custkey % 40)::VARCHAR AS k, min(c_custkey)
    FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1 HAVING k NOT IN (SELECT lower(c_mktsegment) || (c_custkey % 40)::VARCHAR
        FROM customer WHERE c_custkey % 4 = 0)""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("example_key"), F.col("c_custkey").alias("id"))
    bank = c.where("id % 4 = 0").groupBy(F.lower("example_key").alias("example_key")).agg(F.min("id").alias("id")).select("id", "example_key")
    return M.bank_append(bank, c.where("id % 4 != 0").select("id", "example_key")).select(F.lower("example_key").alias("k"), "id")


@query("bank_refresh", f"""
    WITH {LOGS} SELECT scene_id AS id FROM scene_log WHERE n % 5 = 0 UNION ALL SELECT scene_id FROM scene_log
    WHERE n % 5 <> 0 AND (n % 10) / 10.0 >= 0.2 AND (n % 9) / 10.0 < 0.8 AND n % 7 <> 0""")
def _(spark, sf):
    n = F.col("n")
    x = scene_log(spark, sf).select(
        F.col("scene_id").alias("id"), (n % 5 == 0).alias("is_seed"), "title", F.col("source").alias("description"),
        F.when(n % 7 != 0, "c").otherwise(" ").alias("category"), ((n % 10) / 10.0).alias("acceptance"), ((n % 9) / 10.0).alias("reject_rate")
    )
    return M.bank_refresh(x, x.where("not is_seed")).select("id")


@query("doc_upsert", """
    SELECT c_custkey::VARCHAR AS contributor_key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS state, 1::BIGINT AS created_at
    FROM customer UNION ALL SELECT 'n' || c_custkey::VARCHAR, 'new', 2 FROM customer WHERE c_custkey % 30 = 0""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    key = F.col("c_custkey").cast("string")
    doc = lambda k, s, at: [
        k.alias("contributor_key"), F.lit("release").alias("document_type"), F.lit("p").alias("path"), F.lit(s).alias("state"),
        F.lit(at).cast("long").alias("created_at"), F.lit(at).cast("long").alias("updated_at"),
    ]
    changes = c.where("c_custkey % 3 = 0").select(*doc(key, "new", 2)).unionByName(c.where("c_custkey % 30 = 0").select(*doc(F.concat(F.lit("n"), key), "new", 2)))
    return M.doc_upsert(c.select(*doc(key, "old", 1)), changes).select("contributor_key", "state", "created_at")


@query("erase_scene", """
    SELECT count(*) FILTER (user_id % 7 = 0 AND event_id % 50 <> 0) AS removed, count(*) FILTER (user_id % 7 <> 0 OR event_id % 50 = 0) AS kept
    FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("scene_id"))
    return M.erase_scene(e, e.where("scene_id % 7 = 0").select("scene_id"))[1]


@query("pointer_update", """
    WITH r AS (SELECT arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS pack, arg_max(o_totalprice > 50000, (o_orderdate, o_orderkey)) AS ok
        FROM orders)
    SELECT 'O' AS rule_pack_id, 'canary_5' AS stage, true AS enabled UNION ALL SELECT pack, CASE WHEN pack = 'O' THEN 'canary_25' ELSE 'canary_5' END,
        true FROM r WHERE ok""")
def _(spark, sf):
    runs = table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("rule_pack_id"),
        (F.col("o_totalprice") > 50000).alias("gates_pass")
    )
    pointer = values(
        spark, [("2020-01-01", "O", "canary_5", True)], "updated_at string, rule_pack_id string, stage string, enabled boolean"
    ).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    return M.pointer_update(pointer, runs, "promote", "2025-01-01").select("rule_pack_id", "stage", "enabled")


def train(spark, sf):
    """Judged documents as feedback, the benchmark's items as imported rows."""
    fb = feedback(spark, sf).where("decision is not null").select(
        F.col("filename").alias("sample_id"), "scene_id", "filename", "decision", F.col("operator_score").alias("score_100"), "model_score", "title"
    )
    b = table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), "item_id").alias("sample_id"), F.lit("").alias("scene_id"), F.concat(F.lit("b"), "item_id").alias("filename"),
        F.col("text").alias("title"), F.lit("bench").alias("notes")
    )
    return M.train_union(fb, b)


TRAIN = FEEDBACK + """, train AS (SELECT filename AS sample_id, 'feedback' AS source_type, scene_id, filename, decision, operator_score AS score_100, model_score, title,
            NULL::VARCHAR AS notes FROM feedback WHERE decision IS NOT NULL UNION ALL SELECT 'b' || item_id::VARCHAR, 'imported', '', 'b' || item_id::VARCHAR,
            NULL, NULL, NULL, text, 'bench' FROM benchmark)"""


@query("train_union", f"WITH {TRAIN} SELECT * FROM train")
def _(spark, sf):
    return train(spark, sf)


SPLIT = TRAIN + """, split AS (SELECT *, (('0x' || substr(sha1(CASE WHEN trim(scene_id) <> '' THEN trim(scene_id) ELSE filename END), 1, 8))::BIGINT % 1000) AS u
        FROM train),
    marked AS (SELECT *, CASE WHEN u < 100 THEN 'test' WHEN u < 200 THEN 'val' ELSE 'train' END AS split
        FROM split)"""


@query("hash_split", f"WITH {SPLIT} SELECT sample_id, split FROM marked")
def _(spark, sf):
    return D.hash_split(train(spark, sf)).select("sample_id", "split")


@query("score_points", f"""
    WITH {TRAIN} SELECT sample_id, scene_id, CASE decision WHEN 'keep' THEN 2 WHEN 'maybe' THEN 1 WHEN 'reject' THEN 0 END AS rank, score_100 AS target,
        model_score FROM train WHERE decision IS NOT NULL""")
def _(spark, sf):
    return D.score_points(train(spark, sf))


@query("text_examples", """
    WITH t AS (SELECT conv_id, list({'role': role, 'content': trim(text)} ORDER BY turn) AS m FROM conversations
        WHERE trim(text) <> '' GROUP BY conv_id)
    SELECT conv_id, len(m)::INTEGER AS n, sha256(array_to_string(list_transform(m, lambda x: x.role || ':' || x.content), chr(30))) AS h
    FROM t""")
def _(spark, sf):
    x = D.text_examples(table(spark, sf, "conversations"))
    m = F.from_json("messages", "array<struct<role: string, content: string>>")
    body = F.array_join(F.transform(F.slice(m, F.lit(2), F.size(m)), lambda y: F.concat(y["role"], F.lit(":"), y["content"])), "\x1e")
    return x.select("conv_id", "n", F.sha2(body.cast("binary"), 256).alias("h"))


@query("text_instructions", """
    WITH t AS (SELECT conv_id, turn, role, trim(text) AS a, lead(role) OVER w AS r, lead(trim(text)) OVER w AS b
        FROM conversations WHERE trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, sha256(a) AS instruction, sha256(b) AS output FROM t WHERE role = 'user' AND r = 'assistant'""")
def _(spark, sf):
    x = D.text_examples(table(spark, sf, "conversations"), "instruction")
    return x.select("conv_id", "turn", F.sha2(F.col("instruction").cast("binary"), 256).alias("instruction"), F.sha2(F.col("output").cast("binary"), 256).alias("output"))


@query("import_labels", """
    WITH x AS (SELECT o_custkey::VARCHAR AS scene_id, o_orderpriority AS filename, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'keep' WHEN o_orderkey % 5 = 0 THEN 'reject' END AS d,
            o_orderkey % 4 <> 0 AS has_title FROM orders),
    q AS (SELECT *, round((CASE WHEN has_title THEN 0.3 ELSE 0.0 END + 0.2 + CASE WHEN d IS NOT NULL THEN 0.2 ELSE 0.0 END)::DOUBLE, 3) AS record_quality
        FROM x),
    f AS (SELECT * FROM q WHERE record_quality >= 0.3 QUALIFY row_number() OVER (PARTITION BY scene_id, filename ORDER BY record_quality DESC, k) = 1)
    SELECT scene_id, filename, d AS decision, k::DOUBLE AS score_100, record_quality FROM f""")
def _(spark, sf):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("scene_id"), F.col("o_orderpriority").alias("filename"), F.lit("x").alias("model_score"),
        k.cast("string").alias("operator_score"), F.when(k % 3 == 0, "KEEP ").otherwise("?").alias("decision"),
        F.when((k % 3 != 0) & (k % 5 == 0), "No").alias("should_have_picked"), none.alias("categories"), F.lit("a, b; A").alias("tags"),
        F.when(k % 4 != 0, "title").alias("title"), none.alias("notes")
    )
    return D.import_labels(rows).select("scene_id", "filename", "decision", "score_100", "record_quality")


@query("near_dup_pairs", f"""
    WITH {OBS}, h AS (SELECT phash AS x, min(obs_id) AS id FROM frame_obs GROUP BY 1)
    SELECT a.id AS a, b.id AS b, bit_count(xor(a.x, b.x))::INTEGER AS distance FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.x, b.x)) <= 3""")
def _(spark, sf):
    return D.near_dup_pairs(frame_obs(spark, sf).select(F.col("obs_id").alias("id"), "phash"), "phash", 3, bits=60)


CLUSTERS = OBS + """,
l AS (SELECT scene_id, list({'id': obs_id, 'h': phash} ORDER BY timestamp_sec, obs_id) AS rows FROM frame_obs GROUP BY scene_id),
f AS (SELECT scene_id, rows, list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: bit_count(xor(y.h, x[1].h)) <= 5)) = 0 THEN list_concat(acc, x) ELSE acc END, []) AS heads FROM l),
m AS (SELECT scene_id, unnest(list_transform(rows, lambda r: {'id': r.id, 'c': list_filter(heads, lambda y: bit_count(xor(y.h, r.h)) <= 5)[1].id})) AS p FROM f)"""


@query("near_dup_clusters", f"""
    WITH {CLUSTERS} SELECT m.scene_id, p.id AS obs_id, p.c AS cluster_id, row_number() OVER (PARTITION BY m.scene_id, p.c
        ORDER BY sharpness DESC, p.id) = 1 AS is_best FROM m JOIN frame_obs ON obs_id = p.id""")
def _(spark, sf):
    return D.near_dup_clusters(frame_obs(spark, sf), "phash")


#: difflib's ratio of the pairs of p (id, a, b) of texts under 200 characters: the longest common block, then both sides of it.
MATCHED = """
    states AS (
        SELECT id, a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS size FROM p
        UNION ALL
        SELECT id, a, b, unnest([alo, i + size]), unnest([i, ahi]), unnest([blo, j + size]), unnest([j, bhi]), unnest([size, 0])
        FROM (
            SELECT *, row_number() OVER (PARTITION BY id, alo, ahi, blo, bhi ORDER BY size DESC, i, j) AS place
            FROM (
                SELECT id, a, b, alo, ahi, blo, bhi, min(i) AS i, min(j) AS j, count(*)::INTEGER AS size
                FROM (
                    SELECT *, i - row_number() OVER (PARTITION BY id, alo, ahi, blo, bhi, i - j ORDER BY i) AS island
                    FROM (SELECT s.id, s.a, s.b, alo, ahi, blo, bhi, x.i::INTEGER AS i, y.i::INTEGER AS j
                        FROM states s JOIN places x ON x.i >= alo AND x.i < ahi JOIN places y ON y.i >= blo AND y.i < bhi
                        WHERE substr(s.a, x.i, 1) = substr(s.b, y.i, 1))
                )
                GROUP BY id, a, b, alo, ahi, blo, bhi, i - j, island
            )
        )
        WHERE place = 1
    ),
    matched AS (SELECT id, 2.0::DOUBLE * sum(size) / (length(a) + length(b)) AS ratio FROM states GROUP BY id, a, b)"""


@query("text_near_dup", f"""
    WITH RECURSIVE {TITLES},
    x AS (SELECT ord AS id, lower(text) AS n, ord % 8 >= 3 AS ok FROM titles),
    f AS (SELECT n, min(id) AS id FROM x WHERE ok GROUP BY n),
    places AS (SELECT unnest(range(1, 200)) AS i),
    chars AS (SELECT f.id, substr(n, i::BIGINT, 1) AS c, count(*) AS k FROM f JOIN places ON i <= length(n) GROUP BY ALL),
    most AS (SELECT x.id AS a, y.id AS b, sum(least(x.k, y.k)) AS k FROM chars x JOIN chars y ON x.c = y.c AND x.id > y.id GROUP BY ALL),
    p AS (SELECT {{'a': a.id, 'b': b.id}} AS id, a.n AS a, b.n AS b FROM most JOIN f a ON a.id = most.a JOIN f b ON b.id = most.b
        WHERE 2 * k >= 0.86 * (length(a.n) + length(b.n))),
    {MATCHED},
    near AS (SELECT id.a AS id, list(id.b ORDER BY id.b) AS ids, list({{'r': ratio, 'b': id.b}} ORDER BY ratio DESC, id.b) AS best
        FROM matched WHERE ratio >= 0.86 GROUP BY id.a),
    r AS (SELECT list({{'id': f.id, 'ids': coalesce(ids, [])}} ORDER BY f.id) AS rows FROM f LEFT JOIN near USING (id)),
    g AS (SELECT list_transform(list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: CASE WHEN list_has_any(list_transform(acc, lambda y: y.id), x[1].ids) THEN acc ELSE list_concat(acc, x) END), lambda y: y.id) AS kept FROM r),
    told AS (SELECT f.n, f.id AS first, list_filter(best, lambda y: list_contains(kept, y.b))[1].b AS near FROM f CROSS JOIN g LEFT JOIN near USING (id))
    SELECT x.id, CASE WHEN NOT ok THEN 'low_quality' WHEN near IS NOT NULL THEN 'near' WHEN x.id <> first THEN 'exact' END AS reason,
        CASE WHEN ok THEN coalesce(near, nullif(first, x.id)) END AS dup_of
    FROM x LEFT JOIN told USING (n)""")
def _(spark, sf):
    x = titles(spark, sf).select(F.col("ord").alias("id"), "text", (F.col("ord") % 8).cast("double").alias("q"))
    return D.text_near_dup(x, "id", "text", "q", k=3)


@query("text_near_dup_turns")
def _(spark, sf):
    x = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", (F.length("text") % 7).cast("double").alias("q"))
    return D.text_near_dup(x, "id", "text", "q")


@query("edit_distance")
def _(spark, sf):
    p = table(spark, sf, "part")
    return D.edit_distance(p, "p_name", "p_type").select("p_partkey", "edit_distance")


@query("edit_distance_native", f"""
    WITH {TITLES}, x AS (SELECT ord, lower(text) AS a, lower(p_type || '  ' || p_name) AS b FROM titles
        JOIN part ON ord = p_partkey),
    y AS (SELECT ord, a, replace(b, '  ', ' ') AS b FROM x)
    SELECT ord, round(levenshtein(a, b) / greatest(length(a), length(b)), 4) AS edit_distance FROM y""")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.concat("p_type", F.lit("  "), F.upper("p_name")).alias("b"))
    return D.edit_distance(titles(spark, sf).join(p, "ord"), "text", "b", native=True).select("ord", "edit_distance")


@query("title_diversity", f"""
    WITH {TITLES}, t AS (SELECT scene_id, ord, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w
        FROM titles),
    p AS (SELECT a.scene_id, 1 - coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0) AS d
        FROM t a JOIN t b ON a.scene_id = b.scene_id AND a.ord < b.ord)
    SELECT t.scene_id, round(coalesce(quantile_cont(d, 0.5), 0), 4) AS title_diversity FROM (SELECT DISTINCT scene_id
        FROM t) t LEFT JOIN p USING (scene_id) GROUP BY t.scene_id""")
def _(spark, sf):
    x = titles(spark, sf).groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda t: t["text"]).alias("titles"))
    return D.title_diversity(x)


@query("score_with", f"WITH {OBS} SELECT obs_id, sharpness * 2 + motion AS user_score FROM frame_obs")
def _(spark, sf):
    def fn(x):
        return x[["obs_id"]].assign(user_score=x["sharpness"] * 2 + x["motion"])

    return score_with(frame_obs(spark, sf).select("obs_id", "sharpness", "motion"), fn, "obs_id long, user_score double")


@query("person_keys", "SELECT c_custkey, sha256(lower(trim(c_name))) AS contributor_key FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.person_key(F.concat(F.lit(" "), F.upper("c_name"))).alias("contributor_key"))



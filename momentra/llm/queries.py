"""The registered queries of this folder, one an operator, over whole tables; SQL where SQL can say the same."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentra.llm import bpe, decontam, langid, linededup, lm, periodic, private, quality, sharding, simhash, spelling, urlfilter, warc
from momentra.llm.common import crc32_text, crc_mod, read_table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, words=1, radius=3)
    return found.select("doc_id", simhash.fingerprint_hex(1).alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.split_rows(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = langid.fit(docs.where("not held_out"))
    found = docs.select("doc_id", "held_out", langid.identifier(model, spark)(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    hit = decontam.n_hit()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.size(linededup.text_lines(F.col("text"))).cast("long")
    return found.select("doc_id", lines.alias("n_lines"), "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lm.score_documents(docs, lm.training_part())
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"))


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document's words, by the id's hash: from some word on a cycle of the words from there."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"), looped)
    more = lambda x, b: x["length"] * b["period"] > b["length"] * x["period"]
    best = F.aggregate("runs", F.expr("cast(null as struct<start: long, length: long, period: long>)"), lambda b, x: F.when(b.isNull() | more(x, b), x).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find_private(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in private.KINDS if k.base]
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(listed(F.filter("spans", lambda x: x["kind"].isin(base))).cast("binary"), 256)
    return found.select("doc_id", *map(count, base), digest.alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.explode(spelling.letter_runs(F.col("text"), 5)).alias("w"))
    h = crc32_text(F.concat_ws(":", "i", "w"))
    at = (h % F.length("w")).cast("int")
    less = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
    return spelling.variants(docs.select(F.when(h % 97 == 0, less).otherwise(F.col("w")).alias("word")))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_warc, op3_bpe, op4_quality, op5_langid, op6_decontaminate, op7_line_dedup, op8_sharding, op9_lm, op10_url_filter, op11_periodic, op12_private, op13_spelling)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[ \t\n\x0B\f\r]"

def private_sql() -> str:
    """The spans by running sums over rows; patterns without look-around, whose failing matches are dropped."""
    alnum, digits = "[A-Za-z0-9]", "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN substr({digits}, i, 1)::INT ELSE substr('0246813579', substr({digits}, i, 1)::INT + 1, 1)::INT END)) % 10 = 0"
    number = "list_reduce(list_prepend(0, list_transform(string_split(substr(x, 5) || substr(x, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE 100 + ascii(c) - 55 END)), lambda r, y: CASE WHEN y < 10 THEN (r * 10 + y) % 97 ELSE (r * 100 + y - 100) % 97 END)"
    heads = "list_transform(range(len(string_split(v, ' ')), 0, -1), lambda k: array_to_string(string_split(v, ' ')[1:k], ' '))"
    account = f"list_filter({heads}, lambda h: length(replace(h, ' ', '')) BETWEEN 15 AND 34 AND list_transform([replace(h, ' ', '')], lambda x: {number})[1] = 1)[1]"
    parts = "len(list_filter(string_split(v, '.'), lambda p: NOT regexp_full_match(p, '0*([0-9]|[0-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])'))) = 0"
    apart = lambda more, after="a": f"NOT regexp_matches(b, '[A-Za-z0-9{more}]$') AND NOT regexp_matches({after}, '^[A-Za-z0-9{more}]')"
    rules = {  # pattern, check, the span's text
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", "v"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", parts, "v"),
        "card": ("[0-9](?:[ -]?[0-9])+", f"length({digits}) BETWEEN 13 AND 19 AND {luhn}", "v"),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15", "v"),
        "iban": ("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", f"{account} IS NOT NULL AND {apart('', f"(CASE WHEN {account} = v THEN a ELSE '' END)")}", account),
        "ssn": ("[0-9]{3}-[0-9]{2}-[0-9]{4}", f"{apart('-')} AND NOT regexp_matches(v, '^(?:000|666|9)|-00-|-0000$')", "v"),
        "local_phone": (r"\(?[0-9]{2,5}\)?(?:[ -][0-9]{2,5}){1,4}", rf"{apart('-')} AND NOT regexp_matches(b, '[+.]$|\+[0-9][0-9 ().-]*$') AND length({digits}) BETWEEN 9 AND 15", "v"),
    }
    low = f"translate(CASE WHEN length(b) <= {private.BEFORE} THEN ' ' ELSE '' END || right(b, {private.BEFORE}) || ' ' || left(a, {private.AFTER}) || CASE WHEN length(a) <= {private.AFTER} THEN ' ' ELSE '' END, '{UPPER}', '{LOWER}')"
    near = lambda words: f"regexp_matches({low}, '[^a-zà-ÿ](?:{'|'.join(words)})[^a-zà-ÿ]')"
    steps = []
    for at, k in enumerate(private.KINDS):
        pattern, check, value = rules[k.name]
        score = f"{k.score} + CASE WHEN {near(k.words)} THEN {k.gain} ELSE 0 END - CASE WHEN {near(private.AGAINST)} THEN {private.LESS} ELSE 0 END"
        steps.append(rf"""m{at} AS (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}')),
        u{at} AS (SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS v, unnest(g[1:len(m)]) AS b0, unnest(g[2:]) AS a0 FROM m{at}),
        w{at} AS (SELECT *, right(b0, {private.BEFORE + 1}) AS b, left(a0, {private.AFTER + 1}) AS a, (sum(length(b0) + length(v)) OVER (PARTITION BY r ORDER BY i))::BIGINT - length(v) AS s FROM u{at}),
        k{at} AS (SELECT r, {at} AS k, '{k.name}' AS kind, s, s + length({value}) AS e FROM w{at} WHERE {check}{"" if k.base else f" AND {score} >= {private.ACCEPT}"})""")
    n_base = sum(k.base for k in private.KINDS)
    counts = ", ".join(f"coalesce(count(*) FILTER (k = {at}), 0)::BIGINT AS n_{k.name}" for at, k in enumerate(private.KINDS) if k.base)
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        {", ".join(steps)},
        p AS ({" UNION ALL ".join(f"SELECT * FROM k{at}" for at in range(len(private.KINDS)))})
        SELECT doc_id, {counts},
               sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < {n_base}), '')) AS base_sha256,
               coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s), '') AS spans
        FROM d LEFT JOIN p USING (r) GROUP BY d.r, doc_id"""


ORACLE = {
    # each 40 bits of the digest are ten hex digits and eight base-32 digits
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (1 + 10 * (i // 8))::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p JOIN f USING (h)""",
    "op4_quality": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
        w AS (SELECT r, list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda x: x <> '') AS ws FROM d),
        o AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
        g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS win FROM o),
        gg AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
        rep AS (SELECT r, count(DISTINCT i + k) AS n FROM gg, (SELECT unnest(range(8)) AS k) GROUP BY r),
        l AS (SELECT r, doc_id, host, unnest(string_split(text, chr(10))) AS x FROM d),
        dup AS (SELECT r, (count(*) - count(DISTINCT x))::BIGINT AS n FROM l WHERE regexp_matches(x, '[^ \t\n\x0B\f\r]') GROUP BY r),
        nl AS (SELECT r, doc_id, host, regexp_replace(translate(regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g'), '{UPPER}', '{LOWER}'), '[0-9]+', '0', 'g') AS k FROM l),
        hl AS (SELECT r, host, ('0x' || substr(md5(k), 1, 15))::BIGINT AS line, sum(len(regexp_split_to_array(k, '{BLANK}+'))) AS words FROM nl WHERE k <> '' GROUP BY r, host, line),
        held AS (SELECT hl.host, line, count(DISTINCT text) AS n FROM hl JOIN d USING (r) GROUP BY hl.host, line),
        size AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
        common AS (SELECT host, line FROM held JOIN size USING (host) WHERE n > {quality.MAX_DOCS} AND n > {quality.MAX_SHARE} * docs OR n > {quality.MOST_DOCS}),
        gone AS (SELECT r, sum(words) AS removed FROM hl JOIN common USING (host, line) GROUP BY r),
        a AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                     (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
              FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - removed_words AS rest FROM a)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed,
               NOT base_failed AND NOT (removed_words > 0 AND (rest < {quality.MIN_WORDS} OR rest < {quality.MIN_LEFT} * n_words)) AS kept
        FROM b""",
    "op6_decontaminate": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
        bi AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM bi),
        sizes AS (SELECT DISTINCT n FROM win),
        dp AS (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n),
        hit AS (SELECT r, i, dp.n, item_id FROM dp JOIN win ON win.n = dp.n AND win.win = array_to_string(ws[i:i + dp.n - 1], ' ')),
        pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
        it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit) GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)""",
    "op7_line_dedup": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT r, doc_id, i, ls[i] AS x, translate(regexp_replace(ls[i], '^{BLANK}+|{BLANK}+$', '', 'g'), '{UPPER}', '{LOWER}') AS k FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
        f AS (SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        t AS (SELECT r, i, x, holder IS NOT NULL AND l.doc_id <> holder AS gone FROM l LEFT JOIN f USING (k))
        SELECT d.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM t JOIN d USING (r) GROUP BY d.r, d.doc_id""",
    "op12_private": private_sql(),
}

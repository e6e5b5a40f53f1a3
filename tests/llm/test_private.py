"""Personal data against the plain patterns, on tables and on odd texts."""

import hashlib
import os
import random
import re
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from momentra.llm import private
from momentra.llm import queries as Q

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in private.find_private(docs).collect()}


def found(spark, *texts):
    got = spans(spark, texts)
    return [[(k, texts[i][a:b]) for k, a, b, _ in got[i]] for i in range(len(texts))]


def test_op12_base(spark, docs):
    got = {r["doc_id"]: r for r in Q.op12_private(spark, "/root/testdata/sf0.001").collect()}
    n = 0
    for r in docs.collect():
        want = base(r["text"])
        g = got[r["doc_id"]]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert g["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [g[f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in want) for k in PLAIN]
        assert g["spans"].startswith(listed)
        n += len(want)
    assert n > 10


def test_base_kinds_of_odd_texts(spark):
    rng = random.Random(4)
    pieces = ["a@b.c", "x_1@", "@d.e", ".f", "..", "é", "😀", " ", "-", "1.2.3.4", "256.1.1.1", ".7", "4465758382889437", "4465 7583 8288 9437", "12", "3", "+1 (743) 555-3824", "+", "(", ") ", "001.02.3.255", "\n", "4-4-6", "0" * 13]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(1500)] + [None, ""]
    got = spans(spark, texts)
    kinds = list(PLAIN)
    for i, t in enumerate(texts):
        assert [s[:3] for s in got[i] if s[0] in kinds] == base(t), t


def test_sql_agrees_on_odd_texts(spark, tmp_path):
    import compare

    rng = random.Random(5)
    pieces = ["a@b.c", "x_1@", ".7", "é", "😀 ", " ", "-", "1.2.3.4", "4465758382889437", "12", "+1 (743) 555-3824", "IBAN ", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE89370400440532013001", " ISBN ", "ssn ", "123-45-6789", "call ", "(020) 555 1234", "tel. ", "555-123-4567", "NEXT ", "order "]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(1500)] + [None, "", "Account: DE89 3704 0044 0532 0130 00 NEXT word, SSN 123-45-6789, order tel 555-123-4567"]
    spark.createDataFrame([(None if i == 7 else i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare.differences(spark, con, str(tmp_path), Q.op12_private, Q.ORACLE["op12_private"]) == []


def test_checksums_and_context(spark):
    got = found(
        spark,
        "Pay to DE89 3704 0044 0532 0130 00 NEXT week", "DE89 3704 0044 0532 0130 01", "xDE89370400440532013000", "iban GB82WEST12345698765432.",
        "my SSN is 123-45-6789", "part 123-45-6789", "ssn 000-45-6789", "call 555-123-4567 now", "555-123-4567", "hotel 555-123-4567", "order no, tel 555-123-4567", "Tel. (020) 555 1234",
    )
    assert got == [
        [("iban", "DE89 3704 0044 0532 0130 00")], [], [], [("iban", "GB82WEST12345698765432")],
        [("ssn", "123-45-6789")], [], [], [("local_phone", "555-123-4567")], [], [], [], [("local_phone", "(020) 555 1234")],
    ]


def test_scores(spark):
    got = spans(spark, ["card 4465758382889437", "order 4465758382889437", "4465758382889437"])
    assert [got[i][0][3] for i in range(3)] == [100, 60, 80]


def test_odd_rows(spark):
    rows = [(None, None), (None, "a@b.c"), (None, "a@b.c"), (1, "")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted((str(r["doc_id"]), len(r["spans"])) for r in private.find_private(docs).collect())
    assert got == [("1", 0), ("None", 0), ("None", 1), ("None", 1)]
    assert private.find_private(docs.where("false")).count() == 0


def test_long_texts_end_soon(spark):
    began = time.time()
    many = "a@b.c 1.2.3.4 " * 20_000
    got = spans(spark, ["a" * 2_000_000, "1" * 2_000_000, "+1" + "(" * 1_000_000, many, "a@" + "b." * 200_000, "A" * 500_000])
    assert [len(got[i]) for i in range(3)] == [0, 0, 0] and len(got[3]) == 40_000 and len(got[4]) == 1
    assert got[3][-1][1:3] == (len(many) - 8, len(many) - 1)
    assert time.time() - began < 60


def test_no_python_in_the_tasks(spark, docs):
    plan = private.find_private(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)

"""Versions of a ledger: old or new, never half; lines byte for byte."""

import json

import pytest

from momentra.sources import versions as V

BAD = [b"not json", b'{"scene_id": ', b"\xff\xfe odd bytes\r", b"", b'{"scene_id": null, "n": 1}']


def ledger(tmp_path):
    root = tmp_path / "ledger"
    root.mkdir()
    line = lambda s, n: json.dumps({"scene_id": s, "n": n}, indent=None).encode()
    (root / "a.json").write_bytes(b"\n".join([line("s1", 1), BAD[0], line("s2", 2), BAD[1]]) + b"\n")
    (root / "b.json").write_bytes(b"\n".join([line("s3", 3), BAD[2]]) + b"\n")
    (root / "c.json").write_bytes(b"\n".join([BAD[3], line("s1", 4), BAD[4]]) + b"\n")
    return root, f"file://{root}"


def values(spark, root, number=None):
    return sorted(bytes(r[0]) for r in V.read_lines(spark, root, number).selectExpr("cast(value as binary)").collect())


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "scene_id string")


def test_erase_rewrites_only_files_with_hits(spark, tmp_path):
    folder, root = ledger(tmp_path)
    before = values(spark, root)
    assert tuple(V.erase_keys(spark, root, keys(spark, "s1", None)).first()) == (1, 2, 7, 2)
    assert values(spark, root) == [v for v in before if b'"s1"' not in v] and set(BAD) <= set(values(spark, root))
    assert values(spark, root, 0) == before
    assert sum(f.endswith("b.json") for f in V.files_of(spark, root)) == 1 and not any(f.endswith(("a.json", "c.json")) for f in V.files_of(spark, root))
    assert tuple(V.erase_keys(spark, root, keys(spark, "none")).first()) == (1, 0, 7, 0)
    spark.sparkContext.parallelize([1]).count()
    V.sweep(spark, root)
    assert not (folder / "a.json").exists() and (folder / "b.json").exists() and len(values(spark, root)) == 7


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    _, root = ledger(tmp_path)
    before = values(spark, root)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(V, "publish", dies)
        with pytest.raises(KeyboardInterrupt):
            V.erase_keys(spark, root, keys(spark, "s1"))
    assert V.version(spark, root) == 0 and values(spark, root) == before
    assert V.erase_keys(spark, root, keys(spark, "s1")).first()["version"] == 1
    assert V.sweep(spark, root) >= 3 and len(values(spark, root)) == 7


def test_append_and_two_writers(spark, tmp_path):
    root = f"file://{tmp_path}/new"
    assert V.read_lines(spark, root).count() == 0
    assert V.append_rows(spark.createDataFrame([("s1", 1), ("s2", 2)], "scene_id string, n int"), root) == 1
    assert V.append_rows(spark.createDataFrame([("s1", 3)], "scene_id string, n int"), root) == 2
    assert tuple(V.erase_keys(spark, root, keys(spark, "s1")).first())[:3] == (3, 2, 1)
    assert [json.loads(v) for v in values(spark, root)] == [{"scene_id": "s2", "n": 2}]
    with pytest.raises(RuntimeError, match="another writer"):
        V.publish(spark, root, 3, [])

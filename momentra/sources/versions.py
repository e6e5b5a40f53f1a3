"""Ledgers of JSON lines as versions: a manifest lists a version's files, data files are never changed, and the manifest is
put in place last, so that a reader sees the old version or the new one.

<root>/manifests/<number>.json holds one file path a line. A root without manifests is version 0: all files right below it.
A rewrite reads and writes only the files that hold a hit. Two writers that build on one version can't both publish, as a
manifest's name is taken once (in file systems whose rename doesn't replace a file).
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentra.functions.shared import cut

LINE = "value string, file string"


def _fs(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Data files right below the folder, by name."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if s.isFile()]
    return sorted(f.toString() for f in found if not f.getName().startswith(("_", ".")))


def version(spark: SparkSession, root: str) -> int:
    """The number of the latest version."""
    return max((int(f.rsplit("/", 1)[1].removesuffix(".json")) for f in _files(spark, f"{root}/manifests")), default=0)


def files_of(spark: SparkSession, root: str, number: int | None = None) -> list[str]:
    number = version(spark, root) if number is None else number
    if number == 0:
        return _files(spark, root)
    return [r["value"] for r in spark.read.text(f"{root}/manifests/{number:08}.json").collect() if r["value"]]


def read_lines(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """(value, file): the lines of a version, the latest by default, byte for byte; an old version is there until it is swept."""
    return _lines(spark, files_of(spark, root, number))


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], LINE)
    return spark.read.option("lineSep", "\n").text(files).select("value", F.col("_metadata.file_path").alias("file"))


def publish(spark: SparkSession, root: str, number: int, files: list[str]) -> None:
    """The version `number` with these files; an error if there is one already."""
    fs, target = _fs(spark, f"{root}/manifests/{number:08}.json")
    fs.mkdirs(target.getParent())
    _, draft = _fs(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray("".join(f"{f}\n" for f in files).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {number} of {root} has been published by another writer")


def _written(spark: SparkSession, root: str, number: int, lines: DataFrame) -> list[str]:
    folder = f"{root}/data/{number:08}-{uuid.uuid4().hex}"
    lines.select("value").write.option("lineSep", "\n").text(folder)
    return _files(spark, folder)


def append_rows(rows: DataFrame, root: str) -> int:
    """The rows as JSON lines in files of their own, in a new version; gives its number."""
    spark = rows.sparkSession
    now = version(spark, root)
    new = _written(spark, root, now + 1, rows.select(F.to_json(F.struct("*")).alias("value")))
    publish(spark, root, now + 1, [*files_of(spark, root, now), *new])
    return now + 1


def erase_keys(spark: SparkSession, root: str, keys: DataFrame, key: Column | None = None) -> DataFrame:
    """A new version without the lines whose key is in keys, a table of one column; gives one row (version, removed, kept, rewritten).

    key: of `value`, a line's key, by default its scene_id. Lines without a key, malformed ones among them, stay as they
    are. Only files with a hit are rewritten, lines in their order; without a hit there is no new version.
    """
    key = F.get_json_object("value", "$.scene_id") if key is None else key
    ids = cut(keys.select(F.col(keys.columns[0]).cast("string").alias("_k")).where("_k is not null").distinct())
    now = version(spark, root)
    files = files_of(spark, root, now)
    counted = _lines(spark, files).withColumn("_k", key).join(ids.withColumn("_hit", F.lit(1)), "_k", "left")
    told = counted.groupBy("file").agg(F.count("_hit").alias("removed"), F.count_if(F.col("_hit").isNull()).alias("kept")).collect()  # a row a file
    hit = {r["file"] for r in told if r["removed"]}
    plain = lambda f: spark._jvm.org.apache.hadoop.fs.Path(f).toUri().getPath()
    paths = {plain(f) for f in hit}
    again = [f for f in files if plain(f) in paths]
    if again:
        kept = _lines(spark, again).withColumn("_k", key).join(F.broadcast(ids) if ids.count() <= 50_000 else ids, "_k", "left_anti")
        publish(spark, root, now + 1, [*(f for f in files if f not in set(again)), *_written(spark, root, now + 1, kept)])
    row = (now + bool(again), sum(r["removed"] for r in told), sum(r["kept"] for r in told), len(again))
    return spark.createDataFrame([row], "version long, removed long, kept long, rewritten int")


def sweep(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Removes manifests but the last `keep` and data files that none of these lists; gives the number of files removed.

    Not while a writer is at work: what it has written isn't listed yet.
    """
    last = version(spark, root)
    if last == 0:
        return 0
    stay = range(max(1, last - keep + 1), last + 1)
    listed = {f for n in stay for f in files_of(spark, root, n)}
    fs, data = _fs(spark, f"{root}/data")
    folders = [s.getPath().toString() for s in fs.listStatus(data)] if fs.exists(data) else []
    old = [f for f in [*_files(spark, root), *(f for d in folders for f in _files(spark, d))] if f not in listed]
    old += [f for f in _files(spark, f"{root}/manifests") if int(f.rsplit("/", 1)[1].removesuffix(".json")) not in stay]
    for f in old:
        fs.delete(_fs(spark, f)[1], False)
    return len(old)

"""Readers and writers: ledgers, documents, label files, inventories, splits and delivery rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentra.functions import columns as C

#: Files that a task writes at a time.
WRITERS = 4


def _typed(schema: str) -> T.StructType:
    return T.StructType.fromDDL(f"{schema}, _bad string")


def _good(rows: DataFrame) -> DataFrame:
    return rows.where("_bad is null").drop("_bad")


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    x = lines.select(F.from_json("value", _typed(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return _good(x.select("r.*"))


def write_docs(docs: DataFrame, path: str) -> int:
    """docs (folder, name, value): each row's value as a file of its own, in a shared folder that pyarrow.fs can open; their
    number. Tasks put whole files in place themselves, many at a time, so nothing waits for a driver that moves them."""
    cores = docs.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)

        def put(row: tuple[str, str, str]) -> None:
            with store.open_output_stream(f"{base}/{row[0]}/{row[1]}") as out:
                out.write(row[2].encode())

        with ThreadPoolExecutor(WRITERS) as pool:
            for b in batches:
                rows = list(zip(*(c.to_pylist() for c in b.columns)))
                for folder in {r[0] for r in rows}:
                    store.create_dir(f"{base}/{folder}")
                yield pa.record_batch({"n": pa.array([len(list(pool.map(put, rows)))], pa.int64())})

    written = docs.select("folder", "name", "value").where("value is not null").repartition(4 * cores, "folder", "name").mapInArrow(run, "n long")
    return written.agg(F.sum("n")).first()[0] or 0


def read_scene_docs(spark: SparkSession, path: str, schema: str, compact_to: str | None = None) -> DataFrame:
    """One multi-line JSON document a file, unreadable ones skipped; compact_to lands them as Parquet first."""
    x = spark.read.schema(_typed(schema)).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    if not compact_to:
        return _good(x)
    # Spark reads few small files a task: without fewer tasks the compact form would be as many small files.
    x.coalesce(16 * spark.sparkContext.defaultParallelism).write.mode("overwrite").parquet(compact_to)
    return _good(spark.read.parquet(compact_to))


LABEL_ALIASES = {
    "scene_id": ["scene", "sceneid"], "filename": ["file", "file_name"], "model_score": ["ai_score"], "operator_score": ["score", "human_score"],
    "decision": ["verdict"], "should_have_picked": ["should_pick"], "categories": ["category"], "tags": ["tag", "keywords"], "title": ["name"],
    "notes": ["note", "comment"],
}


def read_label_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]] = LABEL_ALIASES) -> DataFrame:
    """CSV with a header: names are lower-cased with _ for blanks, alias columns coalesced, all strings."""
    x = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = ["_".join(c.strip().lower().replace("-", " ").split()) for c in x.columns]
    x = x.toDF(*[f"{n}__{i}" for i, n in enumerate(names)])
    at = lambda n: [F.col(f"{n}__{i}") for i, m in enumerate(names) if m == n]
    cols = {n: [c for a in (n, *other) for c in at(a)] for n, other in aliases.items()}
    return x.select(*[F.coalesce(*[C.truthy(c) for c in cs]).alias(n) if cs else F.lit(None).cast("string").alias(n) for n, cs in cols.items()])


EXTENSION = r"\.([^./]+)$"
VIDEO = ("mp4", "mov", "mkv", "avi", "m4v", "wmv", "webm", "flv")


def asset_inventory(
    spark: SparkSession, root: str, extensions: tuple[str, ...] = VIDEO, min_bytes: int = 1 << 20, skip: str = r"/(_work|\.cache|output)/",
    kind_of: str = EXTENSION
) -> DataFrame:
    """Files below root with a known extension and min_bytes, work folders left out; contents are not read.

    kind_of: the pattern whose first group is a path's extension.
    """
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return inventory_filter(x, extensions, min_bytes, skip, kind_of)


def inventory_filter(
    files: DataFrame, extensions: tuple[str, ...] = VIDEO, min_bytes: int = 1 << 20, skip: str = r"/(_work|\.cache|output)/", kind_of: str = EXTENSION
) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", kind_of, 1))
    return files.where(ext.isin(*extensions) & (F.col("length") >= min_bytes) & ~F.col("path").rlike(skip))


KINDS = (("document", r"\.(pdf|docx?|txt)$"), ("image", r"\.(jpe?g|png|webp)$"), ("metadata", r"\.(json|csv|xml)$"), ("video", r"\.(mp4|mov|mkv|avi|m4v|wmv|webm|flv)$"))


def asset_manifest(assets: DataFrame, max_files: int = 200, secondary: str = r"(trailer|preview|sample)") -> DataFrame:
    """assets (scene_id, path) -> per scene the files of each kind (max_files at most, by path) and the primary videos."""
    low = F.lower("path")
    kind = F.lit("other")
    for name, pattern in reversed(KINDS):
        kind = F.when(low.rlike(pattern), name).otherwise(kind)
    n = F.row_number().over(Window.partitionBy("scene_id").orderBy("path"))
    x = assets.withColumns({"kind": kind, "_n": n}).where(F.col("_n") <= max_files)
    per = x.groupBy("scene_id").pivot("kind", [*[k for k, _ in KINDS], "other"]).count().na.fill(0)
    main = x.where((F.col("kind") == "video") & ~F.lower("path").rlike(secondary)).groupBy("scene_id").agg(F.min("path").alias("primary_path"))
    return per.join(main, "scene_id", "left")


def companion_files(assets: DataFrame, suffixes: list[str]) -> DataFrame:
    """assets (path) -> (folder, companion): the folder's file whose name ends with the earliest of suffixes."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    prio = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(suffixes))):
        prio = F.when(F.endswith(F.lower("path"), F.lit(s)), i).otherwise(prio)
    x = assets.select(folder.alias("folder"), "path", prio.alias("p"))
    return x.groupBy("folder").agg(F.min_by("path", F.when(F.col("p").isNotNull(), F.struct("p", "path"))).alias("companion"))


def record_presence(assets: DataFrame, exact: str = "identity_record.pdf", pattern: str = r"identity[-_ ]?record") -> DataFrame:
    """assets (path) -> (folder, found, error_code, blocked): the required record by exact name, other case, or name pattern.

    A folder without one is blocked: this gate has no switch.
    """
    name = F.regexp_extract("path", "([^/]+)$", 1)
    how = F.when(name == exact, 3).when(F.lower(name) == exact.lower(), 2).when(F.lower(name).rlike(pattern), 1)
    x = assets.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.max(how).alias("h"))
    found = F.when(F.col("h") == 3, "exact").when(F.col("h") == 2, "case").when(F.col("h") == 1, "pattern").otherwise("none")
    return x.select("folder", found.alias("found"), F.when(F.col("h").isNull(), F.lit("RECORD_MISSING")).alias("error_code"), F.col("h").isNull().alias("blocked"))


def primary_asset(assets: DataFrame) -> DataFrame:
    """assets (scene_id, path, duration_sec, size) -> the longest, then the largest, then the first by path."""
    n = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("duration_sec"), F.desc("size"), "path"))
    return assets.withColumn("_n", n).where("_n = 1").select("scene_id", "path")


def split_manifest(df: DataFrame) -> DataFrame:
    """df (split) -> counts of train, val, test and all."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("split"), "n"))


def write_splits(df: DataFrame, path: str) -> DataFrame:
    """df as JSON lines by split below path, and its manifest beside; gives the manifest."""
    df.write.mode("overwrite").partitionBy("split").json(f"{path}/splits")
    split_manifest(df).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return df.sparkSession.read.schema("split string, n long").json(f"{path}/manifest")


def append_ledger(df: DataFrame, path: str) -> None:
    """Append events as JSON lines; earlier files are never touched."""
    df.write.mode("append").json(path)


def handoff_rows(review: DataFrame, eligibility: DataFrame) -> DataFrame:
    """A delivery row for each scene and channel that is eligible: flat strings."""
    x = review.join(eligibility.where("eligible").select("scene_id", "channel"), "scene_id")
    return x.select("channel", "scene_id", "title", F.array_join("tags", ",").alias("tags"), F.array_join("categories", ",").alias("categories"))


def handoff_metadata(review: DataFrame, eligibility: DataFrame, path: str) -> DataFrame:
    """handoff_rows as CSV with a header, one folder a channel; gives the rows as read back."""
    handoff_rows(review, eligibility).write.mode("overwrite").option("header", True).partitionBy("channel").csv(path)
    return review.sparkSession.read.option("header", True).option("basePath", path).csv(path)


def checksum_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of each file below root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.sha2("content", 256).alias("sha256"))

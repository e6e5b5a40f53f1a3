"""Set operations and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentra.functions import columns as C


def pool_union(*pools: DataFrame) -> DataFrame:
    """Pools (scene_id, obs_id, timestamp_sec, label, ...) as one: a time (3 places) and label once, of the first pool that has it."""
    both = reduce(DataFrame.unionByName, [p.withColumn("pool", F.lit(i)) for i, p in enumerate(pools)])
    w = Window.partitionBy("scene_id", F.round("timestamp_sec", 3), "label").orderBy("pool", "obs_id")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def bank_append(bank: DataFrame, rows: DataFrame, key: str = "example_key") -> DataFrame:
    """bank and the rows whose key, whatever its case, is new; of new rows with one key the least stays."""
    k = F.lower(F.trim(F.col(key)))
    new = rows.withColumn("_k", k).where(F.col("_k") != "").join(bank.select(k.alias("_k")), "_k", "left_anti")
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*bank.columns))).where("_n = 1")
    return bank.unionByName(first.select(*bank.columns))


def bank_refresh(bank: DataFrame, approved: DataFrame, min_acceptance: float = 0.2, max_reject: float = 0.8) -> DataFrame:
    """The bank's seed rows and the approved rows (acceptance, reject_rate) that are good enough and whole."""
    ok = approved.where((F.col("acceptance") >= min_acceptance) & (F.col("reject_rate") < max_reject))
    for c in ("title", "description", "category"):
        ok = ok.where(C.truthy(F.col(c)).isNotNull())
    return bank.where("is_seed").unionByName(ok.select(*bank.columns))


def doc_upsert(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """docs with the changes put in by (contributor_key, document_type, path); the first created_at is kept."""
    both = docs.withColumn("_o", F.lit(0)).unionByName(changes.withColumn("_o", F.lit(1)))
    key = ["contributor_key", "document_type", "path"]
    rest = [c for c in docs.columns if c not in (*key, "created_at")]
    out = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_o", "updated_at")).alias("l"), F.min("created_at").alias("created_at"))
    return out.select(*[c if c in (*key, "created_at") else F.col(f"l.{c}").alias(c) for c in docs.columns])


def erase_scene(ledger: DataFrame, scene_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row of counts): rows of the scenes go; rows without a scene (malformed ones) stay."""
    ids = scene_ids.select("scene_id").distinct()
    kept = ledger.join(ids, "scene_id", "left_anti")
    marked = ledger.join(ids.withColumn("_gone", F.lit(1)), "scene_id", "left")
    return kept, marked.agg(F.count("_gone").alias("removed"), F.count_if(F.col("_gone").isNull()).alias("kept"))


STAGES = ("off", "canary_5", "canary_25", "full")


def pointer_update(pointer: DataFrame, runs: DataFrame, action: str, at: str) -> DataFrame:
    """pointer rows with one more: promote moves the latest run's pack one stage on if its gates passed, rollback turns it off.

    pointer (updated_at, rule_pack_id, stage, enabled); runs (created_at, run_id, rule_pack_id, gates_pass). Current is the latest row.
    """
    now = pointer.agg(F.max_by(F.struct("rule_pack_id", "stage", "enabled"), "updated_at").alias("p"))
    run = runs.agg(F.max_by(F.struct("rule_pack_id", "gates_pass"), F.struct("created_at", "run_id")).alias("r"))
    x = now.crossJoin(run)  # one row each
    same = F.col("p.rule_pack_id") == F.col("r.rule_pack_id")
    at_stage = F.array_position(F.array(*map(F.lit, STAGES)), F.when(same & F.col("p.enabled"), F.col("p.stage")).otherwise("off")).cast("int")
    following = F.element_at(F.array(*map(F.lit, STAGES)), F.least(F.lit(len(STAGES)), at_stage + 1))
    if action == "promote":
        new = x.where("r.gates_pass").select(
            F.lit(at).cast("timestamp").alias("updated_at"), F.col("r.rule_pack_id").alias("rule_pack_id"), following.alias("stage"),
            F.lit(True).alias("enabled")
        )
    else:
        new = x.where("p is not null").select(
            F.lit(at).cast("timestamp").alias("updated_at"), F.col("p.rule_pack_id").alias("rule_pack_id"), F.lit("off").alias("stage"),
            F.lit(False).alias("enabled")
        )
    return pointer.unionByName(new)


TRAIN = ("sample_id", "source_type", "scene_id", "filename", "decision", "score_100", "model_score", "title", "notes")


def train_union(feedback: DataFrame, imported: DataFrame) -> DataFrame:
    """Feedback and imported rows in one schema; columns that one lacks are null there."""
    both = feedback.withColumn("source_type", F.lit("feedback")).unionByName(imported.withColumn("source_type", F.lit("imported")), allowMissingColumns=True)
    return both.select(*[F.col(c) if c in both.columns else F.lit(None).cast("string").alias(c) for c in TRAIN])

"""Re-import over user edits (inventory K): keys, plan, ids, apply, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.jsonleaf import canonical, leaf_array
from quire.functions.scans import running_number

SEGMENT = 65536
REMOVAL_KEPT = "removal-kept"
# Fields that change without the content changing.
VOLATILE = ["_id", "_stats", "folder", "sort", "ownership"]


def document_keys(docs: DataFrame, kind: Column, name: Column, order: str) -> DataFrame:
    """Stable key of each document; the second of a name is ``#2``, the third ``#3``, in input order."""
    base = F.concat_ws("|", kind, F.lower(F.regexp_replace(F.trim(name), r"\s+", " ")))
    docs = docs.withColumn("_base", base).withColumn("_seg", F.floor(F.col(order) / SEGMENT))
    docs = running_number(docs, ["_base"], "_seg", [order], "_n")
    key = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("#"), F.col("_n").cast("string")))
    return docs.withColumn("key", key).drop("_base", "_seg", "_n")


def fingerprint_docs(docs: DataFrame) -> DataFrame:
    """Hash of the content of JSON column ``doc``, volatile fields left out at any depth."""
    kept = F.filter(
        leaf_array("parse_json(doc)"), lambda l: ~F.arrays_overlap(F.split(l["path"], r"\."), F.array(*[F.lit(v) for v in VOLATILE]))
    )
    return docs.withColumn("fingerprint", F.sha2(canonical(kept), 256))


def plan_import(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """One action per key: create, unchanged, replace, remove, or a conflict.

    ``incoming`` has key, source_hash; ``existing`` id, key, source_hash,
    fingerprint, current_fingerprint. Rows without a key are the user's own
    and never part of the plan.
    """
    held = existing.where("key is not null").select(
        "key", F.col("id").alias("existing_id"), F.col("source_hash").alias("held_hash"),
        (F.col("fingerprint") != F.col("current_fingerprint")).alias("edited"),
    )
    both = incoming.select("key", "source_hash").join(held, "key", "full_outer")
    action = (
        F.when(F.col("existing_id").isNull(), "create")
        .when(F.col("source_hash").isNull() & (F.col("held_hash") == REMOVAL_KEPT), "kept")
        .when(F.col("source_hash").isNull() & F.col("edited"), "conflict removed")
        .when(F.col("source_hash").isNull(), "remove")
        .when(F.col("source_hash") == F.col("held_hash"), "unchanged")
        .when(F.col("edited"), "conflict changed")
        .otherwise("replace")
    )
    return both.select("key", "existing_id", "source_hash", action.alias("action"))


def fresh_ids(created: DataFrame, used: DataFrame, rounds: int = 4) -> DataFrame:
    """New rows whose id another row already holds take the first free re-hash of it.

    Only colliding ids are re-hashed. A re-hash that is taken in every round
    would need ``rounds`` hash collisions in turn; that raises an error.
    """
    held = used.select("id")
    clash = created.join(held, "id", "left_semi").select("key", "id")
    tries = clash.select(
        "key", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda n: F.substr(F.sha2(F.concat_ws("#", "id", "key", n.cast("string")), 256), F.lit(1), F.lit(16)))).alias("n", "new_id")
    )
    free = tries.join(held.withColumnRenamed("id", "new_id"), "new_id", "left_anti")
    fresh = free.groupBy("key").agg(F.min_by("new_id", "n").alias("new_id"))
    marked = created.join(clash.select("key", F.lit(True).alias("_clash")), "key", "left").join(fresh, "key", "left")
    return marked.withColumn("new_id", F.when(F.col("_clash"), F.coalesce("new_id", F.raise_error(F.lit("no free id for a new row")))).otherwise(F.col("id"))).drop("_clash")


def apply_plan(existing: DataFrame, incoming: DataFrame, plan: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The table after the import: conflicts keep the user's row unless resolved, hashes are stamped again."""
    decided = plan.join(resolutions, "key", "left").withColumn(
        "do",
        F.when(~F.col("action").startswith("conflict"), F.col("action"))
        .when(F.coalesce("resolution", F.lit("keep")) == "keep", "keep")
        .when(F.col("action") == "conflict changed", "replace")
        .otherwise("remove"),
    )
    gone = decided.where("do in ('remove', 'replace')").select("key")
    own = existing.where("key is null")
    kept = existing.where("key is not null").join(gone, "key", "left_anti")
    # a kept conflict remembers what it declined, so the next import does not ask again
    declined = decided.where("do = 'keep'").select("key", F.coalesce("source_hash", F.lit(REMOVAL_KEPT)).alias("_declined"))
    kept = kept.join(declined, "key", "left").withColumn("source_hash", F.coalesce("_declined", "source_hash")).drop("_declined")
    written = (
        decided.where("do in ('create', 'replace')").select("key", "existing_id")
        .join(incoming, "key")
        .select(
            F.coalesce("existing_id", "id").alias("id"), "key", "name", "source_hash",
            F.col("source_hash").alias("fingerprint"), F.col("source_hash").alias("current_fingerprint"),
        )
    )
    cols = ["id", "key", "name", "source_hash", "fingerprint", "current_fingerprint"]
    return own.select(*cols).unionByName(kept.select(*cols)).unionByName(written)


def replace_refs(docs: DataFrame, keys: list[str], pattern: str, targets: DataFrame, missing: Column) -> DataFrame:
    """References in ``text`` (group 1 of ``pattern`` is the target) replaced through ``targets`` (ref, address).

    Only the references travel to the join; the text is rebuilt in its row.
    """
    refs = docs.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("ref"))
    found = refs.join(targets.select("ref", "address"), "ref", "left")
    maps = found.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("ref", F.coalesce("address", missing).alias("address")))).alias("_to"),
        F.count_if(F.col("address").isNull()).alias("unresolved"),
    )
    ref = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    gaps = F.split("text", pattern, -1)
    rebuilt = F.expr(
        "aggregate(sequence(1, size(_refs)), _gaps[0], (s, i) -> concat(s, _to[_refs[i - 1]], _gaps[i]))"
    )
    out = docs.join(maps, keys, "left").withColumns({"_refs": ref, "_gaps": gaps})
    return out.withColumn("text", F.when(F.size("_refs") > 0, rebuilt).otherwise(F.col("text"))).withColumn(
        "unresolved", F.coalesce("unresolved", F.lit(0))
    ).drop("_refs", "_gaps", "_to")

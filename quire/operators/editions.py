"""Emit, reconcile editions, package (inventory J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions.jsonleaf import quoted

ID = (1, 16)


def short_hash(preimage: Column) -> Column:
    return F.substr(F.sha2(preimage, 256), F.lit(ID[0]), F.lit(ID[1]))


def content_id(docs: DataFrame, volatile: list[str]) -> DataFrame:
    """Id from the canonical JSON of column ``doc`` (keys sorted at every level) within its pack."""
    names = ", ".join(f"'{v}'" for v in volatile)
    body = F.expr(f"to_json(map_filter(cast(parse_json(doc) as map<string, variant>), (k, v) -> k not in ({names})))")
    return docs.withColumn("content", body).withColumn("id", short_hash(F.concat_ws("\n", "pack", "content")))


def resolve_collisions(docs: DataFrame) -> DataFrame:
    """A repeated id of a pack is hashed again with the row's ordinal; ``collided`` warns of it."""
    first = docs.groupBy("pack", "id").agg(F.min("ordinal").alias("_first"))
    docs = docs.join(first, ["pack", "id"]).withColumn("collided", F.col("ordinal") != F.col("_first"))
    again = short_hash(F.concat_ws("\n", "pack", "content", F.col("ordinal").cast("string")))
    return docs.withColumn("id", F.when(F.col("collided"), again).otherwise(F.col("id"))).drop("_first")


def edition_groups(docs: DataFrame, key: list[str]) -> DataFrame:
    """Documents whose key has exactly one reading in each of at least two editions.

    Per edition counts are combined before the shuffle; a key repeated inside
    an edition drops out as a count, not as a group.
    """
    per_edition = docs.groupBy(*key, "edition").agg(F.count("*").alias("n"))
    ok = per_edition.groupBy(*key).agg(F.count("*").alias("editions"), F.max("n").alias("most")).where("editions >= 2 and most = 1")
    return docs.join(ok.select(*key), key, "left_semi")


def merge_editions(fields: DataFrame, key: list[str], order: Column, lists: list[str]) -> DataFrame:
    """Field rows (key, edition, field, value) of grouped readings to one merged value per field.

    Equal values stay flat, differing ones become a map by edition, list
    fields are united. A group has one reading per edition, so its arrays are
    no longer than the list of editions.
    """
    grouped = fields.withColumn("_o", order).groupBy(*key, "field").agg(
        F.count_distinct("value").alias("values"),
        F.sort_array(F.collect_list(F.struct("edition", "value"))).alias("by_edition"),
        F.max_by("edition", "_o").alias("canonical"),
    )
    is_list = F.col("field").isin(lists)
    united = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("by_edition", lambda e: F.split(e["value"], ","))))), ",")
    value = (
        F.when(is_list, united)
        .when(F.col("values") == 1, F.col("by_edition")[0]["value"])
        .otherwise(F.array_join(F.transform("by_edition", lambda e: F.concat(e["edition"], F.lit(":"), e["value"])), ";"))
    )
    return grouped.select(*key, "field", "canonical", value.alias("value"))


def merge_leaves(leaf_rows: DataFrame, key: list[str]) -> DataFrame:
    """Leaves (key, edition, path, value) of grouped readings to the leaves of the merged document.

    Equal values stay, lists are united in byte order, other values become an object by edition. What only some editions
    have is theirs alone: an object of those. A group has one reading of each edition.
    """
    grouped = leaf_rows.groupBy(*key, "path").agg(
        F.count_distinct("value").alias("values"), F.sort_array(F.collect_list(F.struct("edition", "value"))).alias("by_edition")
    ).join(leaf_rows.groupBy(*key).agg(F.count_distinct("edition").alias("editions")), key)
    items = F.transform("by_edition", lambda e: F.transform(F.try_parse_json(e["value"]).cast("array<variant>"), lambda v: F.to_json(v)))
    united = F.concat(F.lit("["), F.array_join(F.array_sort(F.array_distinct(F.flatten(items))), ","), F.lit("]"))
    apart = F.concat(F.lit("{"), F.array_join(F.transform("by_edition", lambda e: F.concat(quoted(e["edition"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    lists = F.forall("by_edition", lambda e: e["value"].startswith("["))
    alike = (F.col("values") == 1) & (F.size("by_edition") == F.col("editions"))
    return grouped.select(*key, "path", F.when(lists, united).when(alike, F.col("by_edition")[0]["value"]).otherwise(apart).alias("value"))


def wrap_edition(docs: DataFrame, edition: Column, fields: list[str]) -> DataFrame:
    """Flat rules fields as maps by edition."""
    return docs.withColumns({f: F.create_map(edition, F.col(f)) for f in fields})


def pack_flags(packs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Line and role of each pack by its longest registered prefix, and builder ranks from 1001 in name order.

    ``packs`` are distinct pack names, ``prefixes`` the registered lines: both
    as many as the schema has, not as the data.
    """
    starts = packs.select("pack", F.explode(F.expr("transform(sequence(1, length(pack)), i -> substr(pack, 1, i))")).alias("prefix"))
    hit = starts.join(prefixes, "prefix").groupBy("pack").agg(F.max_by("prefix", F.length("prefix")).alias("line"))
    out = packs.join(hit, "pack", "left").withColumn("role", F.expr("substr(pack, length(coalesce(line, '')) + 1)"))
    w = W.partitionBy("line", "role").orderBy("pack")
    return out.withColumn("rank", F.row_number().over(w) + 1000)


def module_id(docs: DataFrame) -> DataFrame:
    """Module id from its content: a hash over sorted hashes of id buckets, so no task holds a whole module."""
    entry = F.concat_ws("/", "pack", "id")
    bucket = docs.select("module", F.substr(F.md5("id"), F.lit(1), F.lit(3)).alias("bucket"), entry.alias("e"))
    parts = bucket.groupBy("module", "bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("e")), "\n"), 256).alias("h"))
    return parts.groupBy("module").agg(
        short_hash(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "h"))), lambda p: p["h"]), "\n")).alias("module_id")
    )


def module_identity(docs: DataFrame, assets: DataFrame) -> DataFrame:
    """``module, module_id``: an id of what a module holds, its documents (module, pack, id) and its assets (module, name).

    Each different entry's SHA-256 is cut in four numbers that are summed, and the id is the hash of sums and count. Sums do
    not depend on order and combine before the shuffle, so a module's entries are never put together in one place.
    """
    entries = docs.select("module", F.concat_ws("/", "pack", "id").alias("e")).unionByName(assets.select("module", F.concat(F.lit("asset/"), "name").alias("e"))).distinct()
    hashed = entries.withColumn("_h", F.sha2("e", 256))
    parts = [F.conv(F.substring("_h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in range(4)]
    sums = hashed.groupBy("module").agg(F.count("*").alias("n"), *[F.sum(p).cast("string").alias(f"s{k}") for k, p in enumerate(parts)])
    return sums.select("module", short_hash(F.concat_ws(",", F.col("n").cast("string"), "s0", "s1", "s2", "s3")).alias("module_id"))


def referenced_assets(assets: DataFrame, docs: DataFrame, pattern: str) -> DataFrame:
    """Assets (path) some document's text names."""
    named = docs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("path")).distinct()
    return assets.join(named, "path", "left_semi")


def repoint(text: Column, prefix: str, target: str) -> Column:
    """Paths below ``prefix`` moved below ``target``."""
    return F.replace(text, F.lit(prefix), F.lit(target))


def run_report(entities: DataFrame, pack: str, kind: str) -> DataFrame:
    """Entities per pack and type, per pack, and in all."""
    return entities.rollup(pack, kind).agg(F.count("*").alias("n"))


def single_value(df: DataFrame, column: str) -> DataFrame:
    """The one value of a column; fails the job where there are two."""
    seen = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return seen.select(F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("lo")).otherwise(F.raise_error(F.lit(f"{column}: more than one value"))).alias(column))


def by_target(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def merged_documents(docs: DataFrame, merged: DataFrame, key: list[str]) -> DataFrame:
    """Each edition's copy replaced by the merged document of its group, its own sort kept."""
    return docs.join(merged, key, "left").withColumn("doc", F.coalesce("merged", "doc")).drop("merged")

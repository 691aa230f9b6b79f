"""Document trees and packs: readers and the sink (inventory A2, A3, A6, A7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.jsonleaf import canonical_json

SKIPPED = r"^(homebrew|_)"


def parse_tree(files: DataFrame) -> DataFrame:
    """(path, value) rows of ``<group>/<pack>/_source/<file>`` as documents; skipped groups leave, bad JSON shows as null."""
    part = F.split("path", "/")
    n = F.size(part)
    rows = files.select(
        F.get(part, n - 4).alias("grp"), F.get(part, n - 3).alias("pack"), F.get(part, n - 1).alias("file"),
        F.try_parse_json("value").alias("doc"),
    )
    return rows.where(~F.col("grp").rlike(SKIPPED)).withColumn("bad", F.col("doc").isNull())


def read_json_tree(spark: SparkSession, root: str) -> DataFrame:
    # a folder that starts with "_" is only listed where the path names it
    files = spark.read.option("wholetext", True).text(f"{root}/*/*/_source/*.json")
    return parse_tree(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def join_packs(manifests: DataFrame, lines: DataFrame) -> DataFrame:
    """Manifest packs joined to the one-document-per-line files they name.

    ``manifests``: module, packs array<struct<name, type, path>>; ``lines``: module, file, value.
    """
    packs = manifests.select("module", F.explode("packs").alias("p")).select(
        "module", F.col("p.name").alias("pack"), F.col("p.type").alias("type"), F.concat("p.path", F.lit(".db")).alias("file")
    )
    return lines.join(packs, ["module", "file"]).select("module", "pack", "type", "value")


def read_packs(spark: SparkSession, root: str) -> DataFrame:
    """Modules below a folder: ``<module>/module.json`` and ``<module>/packs/*.db``."""
    schema = "id string, packs array<struct<name string, type string, path string>>"
    manifests = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/module.json").select(F.col("id").alias("module"), "packs")
    lines = spark.read.text(f"{root}/*/packs/*.db").select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/(packs/[^/]+)$", 1).alias("module"),
        F.regexp_extract("_metadata.file_path", r"([^/]+)/(packs/[^/]+)$", 2).alias("file"), "value",
    )
    return join_packs(manifests, lines)


def pack_lines(docs: DataFrame) -> DataFrame:
    """One canonical JSON line per document of (pack, id, doc)."""
    return docs.select("pack", "id", canonical_json(F.col("doc")).alias("value"))


def write_packs(docs: DataFrame, path: str, files: int | None = None) -> None:
    """Packs as text, one folder each, lines in id order across and within files.

    Ranges over (pack, id) rather than a hash of the pack: a pack that holds a
    third of all documents is written by many tasks, and stays in order.
    """
    lines = pack_lines(docs)
    by_range = lines.repartitionByRange(files, "pack", "id") if files else lines.repartitionByRange("pack", "id")
    by_range.sortWithinPartitions("pack", "id").select("pack", "value").write.partitionBy("pack").mode("errorifexists").text(path)


def manifest(packs: DataFrame) -> DataFrame:
    """One row per module: its packs in name order with label and type.

    ``packs`` is one row per pack of a module, so lists are as long as a manifest.
    """
    label = F.initcap(F.translate("pack", "-_", "  "))
    return packs.groupBy("module").agg(F.sort_array(F.collect_list(F.struct("pack", label.alias("label"), "type"))).alias("packs"))


def module_manifest(packs: DataFrame, sources: DataFrame, release: str) -> DataFrame:
    """One row per module: its sources and title, its packs with label, path and flags, and the folder that shows them.

    ``packs`` (module, line, pack, type, flags: null or what the system wants told) has a row for each pack, ``sources``
    (module, source) the books; both are as many as a manifest lists. A pack's label leaves out the line it is for.
    """
    prefix = F.concat("line", F.lit("-"))
    rest = F.when(F.startswith("pack", prefix), F.substr("pack", F.length(prefix) + 1)).otherwise(F.col("pack"))
    words = F.filter(F.split(rest, "-"), lambda w: w != "")
    label = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    flags = F.struct(F.lit(release).alias("release"), F.col("flags").alias("system"))
    pack = F.struct("pack", label.alias("label"), F.concat(F.lit("packs/"), "pack").alias("path"), "type", flags.alias("flags"))
    listed = packs.groupBy("module").agg(F.sort_array(F.collect_list(pack)).alias("packs"))
    books = sources.groupBy("module").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    out = listed.join(books, "module", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    return out.withColumns({"title": F.array_join("sources", ", "), "folder": F.struct(F.col("module").alias("name"), F.col("packs.pack").alias("packs"))})

"""Versioned backup records: integrity, versions, forbidden names, migration; and backups as whole JSON packages that are saved and read back.

A record is a row (record_id, version, workspace, digest). A package is one JSON text: format, schemaVersion, createdAt, workspace and, over the canonical
form of all these, integrity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import staging
from tallyloom.functions import json_text

#: The version that records are brought to.
CURRENT = 2
# fixed values: algorithm of the digest, keys that a workspace must have, keys that no level of it may have
ALGORITHM = "fnv1a-32"
KEYS = ["teacherContext", "decisions", "justifications", "questionApprovals", "reportTexts", "approvals", "timestamps"]
FORBIDDEN = ["students", "student", "studentRecords", "studentNo", "fullName", "rawExamData", "rawFile", "uploadedFiles"]
FORMAT = "workspace-backup"


def sealed(records: DataFrame) -> DataFrame:
    """records(record_id, version, workspace) with the digest of their workspace."""
    return records.withColumn("digest", json_text.fnv1a_texts("workspace"))


def inspected(records: DataFrame, forbidden: list[str]) -> DataFrame:
    """status of each record(record_id, version, workspace, digest): ok, old, newer, broken (digest), unreadable (no JSON object) or private (a forbidden key at any depth)."""
    space = F.try_parse_json("workspace")
    private = F.size(json_text.key_paths(forbidden)("workspace")) > 0
    fits = F.coalesce(F.col("digest") == json_text.fnv1a_texts("workspace"), F.lit(False))
    status = F.when(~fits, "broken").when(~_is_object(space), "unreadable").when(private, "private").when(F.col("version") > CURRENT, "newer").when(F.col("version") < CURRENT, "old").otherwise(F.lit("ok"))
    return records.withColumn("status", status)


def migrated(records: DataFrame, forbidden: list[str]) -> DataFrame:
    """Good records at the current version: old ones get an empty list of approvals, where they have none, and a new digest; others are left out."""
    good = inspected(records, forbidden).where(F.col("status").isin("ok", "old"))
    there = F.try_variant_get(F.try_parse_json("workspace"), "$.questionApprovals", "variant").isNotNull()
    space = F.when((F.col("status") == "old") & ~there, json_text.with_fields({"questionApprovals": []})("workspace")).otherwise(F.col("workspace"))
    return sealed(good.withColumn("workspace", space).withColumn("version", F.lit(CURRENT)).drop("digest"))


def tally(records: DataFrame, forbidden: list[str]) -> DataFrame:
    return inspected(records, forbidden).groupBy("status").agg(F.count("*").alias("many"))


def _is_object(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to all tasks: a package takes Python far longer than it takes to read, and few tasks may have read them all."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _packed(head: dict[str, Column], version: int, defaults: dict, more: dict[str, Column] | None = None) -> Column:
    """The package of the column workspace, with head's fields, then the workspace with its version and more's fields, and the integrity of all. Null where the workspace is no object."""
    text = lambda fields: F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])) if fields else F.lit("{}")
    return json_text.sealed(ALGORITHM, {"schemaVersion": version}, defaults)(text(head), F.col("workspace"), text(more))


def packages(spaces: DataFrame, created: Column, format: str = FORMAT, version: int = CURRENT) -> DataFrame:
    """record_id, package of spaces(record_id, workspace as a JSON object): keys that a workspace must have are added empty. Null for what is no object."""
    empty = {k: {} if k in ("teacherContext", "reportTexts", "approvals", "timestamps") else [] for k in KEYS}
    head = {"format": F.lit(format), "schemaVersion": F.lit(version), "createdAt": created}
    return spaces.select("record_id", _packed(head, version, empty).alias("package"))


def opened(rows: DataFrame, format: str = FORMAT, forbidden: list[str] = FORBIDDEN) -> DataFrame:
    """rows(record_id, package, ...) with status and detail (what is missing or forbidden): ok, old (version 1), or the first thing wrong.

    In this order: unreadable (no JSON object), foreign (another format), unversioned, newer, unsupported, unsealed (no integrity, or of another kind), broken (its digest), no-workspace,
    mismatch (the workspace's version is another), incomplete (a key that it must have), private (the first forbidden key, at any depth).
    """
    seen = rows.withColumn("_seen", json_text.looked_into(forbidden)("package"))
    out = seen.withColumns({"_v": F.try_parse_json("package"), "_digest": F.col("_seen.digest"), "_private": F.col("_seen.paths")}).drop("_seen")
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    whole = F.schema_of_variant(get("$.schemaVersion", "variant")) == "BIGINT"
    version = F.when(whole, get("$.schemaVersion", "bigint"))
    inner = F.when(F.schema_of_variant(get("$.workspace.schemaVersion", "variant")) == "BIGINT", get("$.workspace.schemaVersion", "bigint"))
    digest = F.when(F.schema_of_variant(get("$.integrity.digest", "variant")) == "STRING", get("$.integrity.digest"))
    gone = F.filter(F.array(*[F.when(get(f"$.workspace.{k}", "variant").isNull(), F.lit(k)) for k in KEYS]), lambda x: x.isNotNull())
    # a key counts wherever it stands; the package's own fields have none of these names
    private = F.filter(F.transform("_private", lambda p: F.substring(p, 2, 10_000)), lambda p: p.startswith("workspace."))
    out = out.withColumns({"_gone": gone, "_private": private, "_version": version})
    version, gone, private = F.col("_version"), F.col("_gone"), F.col("_private")
    fine = lambda c: F.coalesce(c, F.lit(False))
    status = (
        F.when(~_is_object(F.col("_v")), "unreadable").when(~fine(get("$.format") == format), "foreign").when(version.isNull(), "unversioned").when(version > CURRENT, "newer").when(version < 1, "unsupported")
        .when(~fine((get("$.integrity.algorithm") == ALGORITHM) & digest.isNotNull()), "unsealed").when(~fine(digest == F.col("_digest")), "broken").when(~_is_object(get("$.workspace", "variant")), "no-workspace")
        .when(~fine(inner == version), "mismatch").when(F.size(gone) > 0, "incomplete").when(F.size(private) > 0, "private").when(version < CURRENT, "old").otherwise(F.lit("ok"))
    )
    detail = F.when(F.col("status") == "incomplete", gone[0]).when(F.col("status") == "private", private[0])
    return out.withColumn("status", status).withColumn("detail", detail).drop("_v", "_digest", "_private", "_gone", "_version")


def brought_up(rows: DataFrame, converted: Column, format: str = FORMAT) -> DataFrame:
    """record_id, package, status of rows(record_id, package): packages of version 1 with a workspace of the current version, which notes the migration, and a new seal; good ones as they are; others with null.

    converted is the time of the migration, as a text.
    """
    # staged, as a filter on what comes out would else be put through all the conditions of a status again
    seen = staging.stage(opened(rows.select("record_id", "package"), format)).withColumnRenamed("package", "_before")
    seen = seen.withColumn("_old", F.when(F.col("status") == "old", F.try_parse_json("_before")))
    seen = seen.withColumn("workspace", F.to_json(F.try_variant_get("_old", "$.workspace", "variant")))
    note = F.struct(F.lit(1).alias("sourceVersion"), F.lit(CURRENT).alias("targetVersion"), converted.alias("convertedAt"))
    head = {"format": F.lit(format), "schemaVersion": F.lit(CURRENT), "createdAt": F.try_variant_get("_old", "$.createdAt", "string")}
    made = seen.withColumn("package", _packed(head, CURRENT, {}, {"migration": note}))
    return made.select("record_id", F.when(F.col("status") == "old", F.col("package")).when(F.col("status") == "ok", F.col("_before")).alias("package"), "status")


def saved(rows: DataFrame, path: str, format: str = FORMAT) -> DataFrame:
    """Writes rows(record_id, package) to a new folder and returns what is read back, with status and detail: a save counts if it reads as ok or old."""
    rows.select("record_id", "package").write.parquet(path)
    spark = rows.sparkSession
    if not staging.committed(spark, path):
        raise OSError(f"{path} was not finished")
    return opened(spark.read.parquet(path), format)

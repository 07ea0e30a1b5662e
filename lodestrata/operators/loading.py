"""Insert-only, idempotent loads of tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestrata.operators.checks import CheckFailed, duplicate_keys, require_empty
from lodestrata.sinks import publish


def classify_load(incoming: DataFrame, stored: DataFrame, keys: list[str], columns: list[str] | None = None, diagnostics: int = 5) -> DataFrame:
    """``keys, outcome, differing``: ``new``, ``unchanged`` or ``conflict`` with the first columns that differ.

    Columns are compared null-safely. Rows of ``stored`` that aren't delivered say nothing.
    """
    columns = columns or [c for c in incoming.columns if c not in keys]
    old = stored.select(*keys, F.lit(True).alias("_there"), *[F.col(c).alias(f"_old_{c}") for c in columns])
    differing = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_old_{c}")), c) for c in columns]))
    joined = incoming.join(old, keys, "left").withColumn("_d", F.when(F.col("_there"), differing))
    outcome = F.when(F.col("_there").isNull(), "new").when(F.size("_d") == 0, "unchanged").otherwise("conflict")
    return joined.select(*keys, outcome.alias("outcome"), F.slice(F.coalesce("_d", F.array().cast("array<string>")), 1, diagnostics).alias("differing"))


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.join(stored.select(*keys), keys, "left_anti")


def load(incoming: DataFrame, path: str, keys: list[str], partition: str) -> dict[str, int]:
    """Add the new rows to the table at ``path``; nothing is written if any row conflicts.

    Returns the counts ``inserted`` and ``unchanged``. Keys must be unique and not null. A second load
    of the same rows inserts none. The rows are staged beside the table and published by renames.
    """
    spark = incoming.sparkSession
    require_empty(incoming.where(" OR ".join(f"`{k}` IS NULL" for k in keys)), "null keys")
    require_empty(duplicate_keys(incoming, keys), "repeated keys")
    if not publish.exists(spark, path):
        return {"inserted": publish.append(incoming, path, partition), "unchanged": 0}
    stored = spark.read.schema(incoming.schema).parquet(path)
    outcomes = classify_load(incoming, stored, keys)
    require_empty(outcomes.where("outcome = 'conflict'"), "rows differ from stored ones")
    counts = {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    inserted = publish.append(new_rows(incoming, stored, keys), path, partition) if counts.get("new") else 0
    return {"inserted": inserted, "unchanged": counts.get("unchanged", 0)}


def frozen_difference(derived: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, as often as they are surplus, with ``side`` derived or frozen."""
    frozen = frozen.select(*derived.columns)
    return derived.exceptAll(frozen).withColumn("side", F.lit("derived")).unionByName(frozen.exceptAll(derived).withColumn("side", F.lit("frozen")))


def check_frozen(derived: DataFrame, frozen: DataFrame) -> None:
    rest = frozen_difference(derived, frozen)
    if not rest.isEmpty():
        raise CheckFailed(f"the derived table differs from the frozen one: {rest.limit(3).collect()}")


LEDGER = "import_id string, version string, language string, digest string, tables string"


def prior_imports(ledger: DataFrame, **where: str) -> DataFrame:
    """The ledger's rows with these values."""
    for column, value in where.items():
        ledger = ledger.where(F.col(column).eqNullSafe(F.lit(value)))
    return ledger


def import_tables(tables: dict[str, DataFrame], path: str, version: str, language: str, digest: str, problems: dict[str, DataFrame] | None = None) -> dict[str, int] | None:
    """Import several tables under one version, all or none; the rows of each, or None if this very import is there.

    problems: tables that must be empty, by what their rows would mean; they are looked at before
    anything is written. Every table goes to its own folder of the import, and the ledger row comes
    last: readers take only imports of the ledger (``imported``), so a failed import is never seen
    and its left-over folders are replaced by the next try. The same version with other language
    or content is an error, and so is content that is there under another version.
    """
    spark = next(iter(tables.values())).sparkSession
    ledger_path = f"{path.rstrip('/')}/imports"
    if publish.exists(spark, ledger_path):
        ledger = spark.read.schema(LEDGER).parquet(ledger_path)
        same = prior_imports(ledger, version=version).collect()
        if any((r["language"], r["digest"]) != (language, digest) for r in same):
            raise CheckFailed(f"version {version} is there with another language or content")
        if same:
            return None
        require_empty(prior_imports(ledger, digest=digest), "the same content is there under another version")
    for what, rows in (problems or {}).items():
        require_empty(rows, what)
    import_id = f"{version}-{language}"
    counts = {}
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/import_id={import_id}")
        counts[name] = seen.get["rows"]
    publish.append(spark.createDataFrame([(import_id, version, language, digest, json.dumps(counts))], LEDGER), ledger_path)
    return counts


def imported(spark, path: str, name: str) -> DataFrame:
    """A table's rows of all completed imports, with ``import_id``."""
    ledger = spark.read.schema(LEDGER).parquet(f"{path.rstrip('/')}/imports").select("import_id").distinct()
    return spark.read.option("basePath", f"{path.rstrip('/')}/{name}").parquet(f"{path.rstrip('/')}/{name}").join(ledger, "import_id", "left_semi")


def require_version(spark, path: str, version: int) -> None:
    """Mark a new warehouse folder with its schema's version; one that is there must have the same."""
    marker = f"{path.rstrip('/')}/schema_version"
    if not publish.exists(spark, marker):
        publish.append(spark.createDataFrame([(version,)], "version int"), marker)
    found = [r[0] for r in spark.read.schema("version int").parquet(marker).distinct().collect()]
    if found != [version]:
        raise CheckFailed(f"the warehouse has schema version {found}, not {version}")

"""Stored tables: their columns, keys, defaults and allowed values; rows that break them are set aside with reasons; versions that are replaced whole.

A version of a table is a folder of its own, and a small file names the one that counts.  A refresh writes the new folder first
and then renames the file over the old one, which the file system does at once, so a reader sees the old table or the new
one, and what was read before goes on, for old folders stay until ``tidied``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"


@dataclass(frozen=True)
class Table:
    """Columns as DDL; ``required`` may not be null, ``allowed`` lists values, ``defaults`` are SQL expressions for null, ``parents`` are (column, table)."""

    columns: dict[str, str]
    key: tuple[str, ...] = ("id",)
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    parents: tuple[tuple[str, str], ...] = ()


# The stored tables.
TABLES = {
    "analyses": Table(
        {
            "id": "string", "user_id": "string", "created_at": "timestamp", "status": "string", "bill_total": MONEY, "insurance_approved": MONEY, "insurance_rejected": MONEY, "patient_liability": MONEY,
            "verified_overcharge": MONEY, "min_recoverable": MONEY, "max_recoverable": MONEY, "raw_result": "string", "patient_name": "string", "hospital_name": "string", "bill_number": "string",
            "policy_number": "string", "claim_number": "string",
        },
        required=("user_id",), allowed={"status": ("processing", "complete", "failed")}, defaults={"id": "uuid()", "created_at": "current_timestamp()", "status": "'processing'"},
    ),
    "documents": Table(
        {"id": "string", "analysis_id": "string", "doc_type": "string", "file_path": "string", "file_size": "int", "uploaded_at": "timestamp"},
        required=("analysis_id", "doc_type", "file_path"), allowed={"doc_type": ("bill", "discharge", "rejection", "policy")}, defaults={"id": "uuid()", "uploaded_at": "current_timestamp()"}, parents=(("analysis_id", "analyses"),),
    ),
    "issues": Table(
        {
            "id": "string", "analysis_id": "string", "issue_id": "string", "issue_type": "string", "description": "string", "billed_amount": MONEY, "benchmark_amount": MONEY, "overcharge_amount": MONEY,
            "confidence": "string", "evidence": "array<string>", "action_required": "string",
        },
        required=("analysis_id", "issue_id", "issue_type", "description", "confidence"), allowed={"confidence": ("high", "medium", "low")}, defaults={"id": "uuid()"}, parents=(("analysis_id", "analyses"),),
    ),
    "letters": Table(
        {"id": "string", "analysis_id": "string", "letter_type": "string", "content": "string", "generated_at": "timestamp"},
        required=("analysis_id", "letter_type", "content"), allowed={"letter_type": ("hospital_polite", "hospital_professional", "hospital_firm", "insurer", "patient_summary")},
        defaults={"id": "uuid()", "generated_at": "current_timestamp()"}, parents=(("analysis_id", "analyses"),),
    ),
    "audit_log": Table({"id": "string", "user_id": "string", "action": "string", "timestamp": "timestamp", "metadata": "string"}, required=("action",), defaults={"id": "uuid()", "timestamp": "current_timestamp()"}),
    "regulation_cache": Table(
        {"id": "string", "regulation_name": "string", "content": "string", "source_url": "string", "last_verified": "timestamp", "verified_by": "string", "is_current": "boolean"},
        required=("regulation_name",), unique=("regulation_name",), defaults={"id": "uuid()", "last_verified": "current_timestamp()", "is_current": "true"},
    ),
}


def admitted(rows: DataFrame, table: Table, parents: dict[str, DataFrame] | None = None, order: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows that the table takes, and the others with ``reasons``; both have the table's columns.

    Columns that ``rows`` lacks are null, others are ignored; nulls get their defaults first.  A value that its column's type cannot hold is
    a reason.  Of rows with one key, or one value of a unique column, the first by ``order`` stays, or of equal ones any.
    ``parents``: tables (id) of which a row must have one; those not given are not looked for.
    """
    have = set(rows.columns)
    typed = {c: (F.col(f"`{c}`").try_cast(t) if not t.startswith("array") else F.col(f"`{c}`").cast(t)) if c in have else F.lit(None).cast(t) for c, t in table.columns.items()}
    odd = [F.when(F.col(f"`{c}`").isNotNull() & typed[c].isNull(), F.lit(f"{c} is no {t}")) for c, t in table.columns.items() if c in have and not t.startswith("array")]
    filled = {c: F.coalesce(v, F.expr(table.defaults[c]).cast(table.columns[c])) if c in table.defaults else v for c, v in typed.items()}
    ranks = [F.col(f"`{c}`") for c in order]
    marked = rows.select(*[v.alias(c) for c, v in filled.items()], F.array_compact(F.array(*odd)).alias("_odd"), *[c.alias(f"_order{i}") for i, c in enumerate(ranks)])
    for i, (column, name) in enumerate(table.parents):
        if parents and name in parents:
            known = parents[name].select(F.col("id").cast("string").alias(f"_parent{i}")).distinct()
            marked = marked.join(known.hint("merge"), F.col(column) == F.col(f"_parent{i}"), "left")
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in dict.fromkeys([*table.key, *table.required])]
    barred = [F.when(~F.col(c).isin(*values), F.lit(f"{c} is none of the allowed")) for c, values in table.allowed.items()]
    lost = [F.when(F.col(column).isNotNull() & F.col(f"_parent{i}").isNull(), F.lit(f"{column} has no row in {name}")) for i, (column, name) in enumerate(table.parents) if parents and name in parents]
    first = marked.withColumn("_reasons", F.concat("_odd", F.array_compact(F.array(*missing, *barred, *lost))))
    # only rows without another fault compete for a key
    fine, places = F.size("_reasons") == 0, [f"_order{i}" for i in range(len(order))]
    for n, keys in enumerate([table.key, *[(u,) for u in table.unique]]):
        turn = F.row_number().over(Window.partitionBy(*keys, fine).orderBy(*(places or [F.lit(0)])))
        first = first.withColumn(f"_again{n}", F.when(fine & (turn > 1), F.lit(f"{', '.join(keys)} is there already")))
    again = [F.col(f"_again{n}") for n in range(1 + len(table.unique))]
    told = first.withColumn("reasons", F.concat("_reasons", F.array_compact(F.array(*again)))).select(*table.columns, "reasons")
    return told.filter(F.size("reasons") == 0).drop("reasons"), told.filter(F.size("reasons") > 0)


POINTER = "CURRENT"


def _paths(spark: SparkSession, path: str):
    """Hadoop's file context, which renames over a file at once, and its path class."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf) if root.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf), root.getFileSystem(conf)


def refreshed(df: DataFrame, path: str, partition: tuple[str, ...] = ()) -> str:
    """Writes ``df`` as the whole new content of the table at ``path`` and makes it the one that counts; returns its version."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition).parquet(f"{path}/{version}")
    fs, context, files = _paths(spark, path)
    new, current = fs.Path(f"{path}/.{version}.next"), fs.Path(f"{path}/{POINTER}")
    out = files.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    rename[0] = getattr(fs, "Options$Rename").OVERWRITE
    context.rename(files.makeQualified(new), files.makeQualified(current), rename)
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that counts, or None before the first refresh."""
    fs, _, files = _paths(spark, path)
    pointer = fs.Path(f"{path}/{POINTER}")
    if not files.exists(pointer):
        return None
    return spark.read.text(str(pointer.toString())).first().value


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is now; a later refresh does not change what this frame reads."""
    version = current_version(spark, path)
    if version is None:
        raise ValueError(f"no table at {path}")
    return spark.read.parquet(f"{path}/{version}")


def tidied(spark: SparkSession, path: str) -> int:
    """Removes the versions that do not count any more, once nobody reads them; returns their number."""
    fs, _, files = _paths(spark, path)
    keep, n = current_version(spark, path), 0
    for status in files.listStatus(fs.Path(path)):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("v-") and name != keep:
            files.delete(status.getPath(), True)
            n += 1
    return n

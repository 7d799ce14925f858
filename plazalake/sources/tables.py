"""Readers. Every one returns a DataFrame; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def optional_table(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """The catalog's table, or no rows where it doesn't exist; lacking columns are null."""
    if not spark.catalog.tableExists(name):
        return spark.createDataFrame([], schema)
    found = spark.table(name)
    return found.select([(F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a folder whose files were written by several versions: columns that a file lacks are null, others are left out.

    No rows where the folder isn't there or holds no files. The schema is given, so no file is opened before the scan.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    if not any(not n.startswith(("_", ".")) for n in names):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(path)


#: Tables that may be written.
WRITABLE = ("assist_responses",)


def statement_kind(text: Column, writable: tuple[str, ...] = WRITABLE) -> Column:
    """What a statement may do: read if it begins with SELECT, write if it names a table that may be written, else rejected; null is rejected."""
    head = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\A\s+", ""))
    named = F.lit(False)
    for t in writable:
        named = named | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(t))
    return F.when(F.startswith(head, F.lit("SELECT")), "read").when(named, "write").otherwise("rejected")


def read_only(spark: SparkSession, statement: str) -> DataFrame:
    """The result of a statement that begins with SELECT; any other is refused before it runs."""
    if not statement.lstrip().upper().startswith("SELECT"):
        raise PermissionError(f"only SELECT may run here: {statement[:80]}")
    return spark.sql(statement)


def tsv_rows(lines: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    """Columns of tab-separated lines, as strings; blank lines go, missing cells are null."""
    parts = F.split(value, "\t")
    return lines.where(F.trim(value) != "").select([F.get(parts, i).alias(n) for i, n in enumerate(names)])


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file; lines that aren't JSON of that schema go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def probe_values(text: DataFrame, value: str = "value") -> DataFrame:
    """name, number of KEY=number lines; others go."""
    found = text.select(F.regexp_extract(value, r"^\s*([A-Z]+)=(\d+)\s*$", 1).alias("name"), F.regexp_extract(value, r"^\s*([A-Z]+)=(\d+)\s*$", 2).alias("n"))
    return found.where("name <> ''").select("name", F.expr("try_cast(n AS long)").alias("number"))

"""Reading and writing of the engine's tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import schemas
from lumenfold.sources.vectors import VectorStore

#: What windows-1252 has where ISO-8859-1 has control characters; bytes that it leaves undefined are kept.
WINDOWS_1252 = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_raw_catalog(spark: SparkSession, path: str) -> DataFrame:
    """pos (ascending by place in the file, then by file), raw_facet of one-column CSV files with the header Facets or facets.

    Each file is read as UTF-8, or where its bytes aren't valid UTF-8 as windows-1252, or as ISO-8859-1 where it has bytes
    that windows-1252 doesn't define. Blank lines are left out; NA, null and empty cells are null.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    lines = spark.read.text(path)  # lines are read as the bytes they are
    found = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.bool_and(F.is_valid_utf8("value")).alias("valid")).collect()  # a row a file
    plain, other = (sorted(unquote(r.file) for r in found if r.valid == kind) for kind in (True, False))
    raw = _one_column(spark, plain, "UTF-8") if plain else None
    if other:
        latin = _one_column(spark, other, "ISO-8859-1")
        odd = [r.file for r in latin.filter(F.col("raw_facet").rlike("[\\x81\\x8D\\x8F\\x90\\x9D]")).select("file").distinct().collect()]
        shown = F.translate("raw_facet", "".join(WINDOWS_1252), "".join(WINDOWS_1252.values()))
        latin = latin.withColumn("raw_facet", F.when(F.col("file").isin(*odd), F.col("raw_facet")).otherwise(shown) if odd else shown)
        raw = latin if raw is None else raw.unionByName(latin)
    value = F.when(F.col("raw_facet").isin("NA", "null", ""), None).otherwise(F.col("raw_facet"))
    if raw is None:
        raise ValueError(f"{path} has no column Facets")
    return raw.select(F.monotonically_increasing_id().alias("pos"), value.alias("raw_facet"))  # ids of a scan's rows grow with their place


def _one_column(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    found = None
    for name in ("Facets", "facets"):
        for path in paths:
            head = spark.read.option("encoding", encoding).option("header", True).csv(path).columns
            if own := [c for c in head if c.strip() == name]:
                part = spark.read.option("encoding", encoding).option("header", True).csv(path).select(F.col(f"`{own[0]}`").alias("raw_facet"), F.lit(path).alias("file"))
                found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError(f"{paths[0]} has no column Facets")
    return found


KINDS = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json"}


def kind_of(path: str) -> str:
    """The format that a path's last parts name: catalog.csv, catalog_csv, catalog_json/part-0.json, catalog_csv/*."""
    for part in reversed(path.rstrip("/").split("/")[-2:]):
        if kind := KINDS.get(part.replace("_", ".").rsplit(".", 1)[-1]):
            return kind
    raise ValueError(f"{path} names no format: give one of {sorted(set(KINDS.values()))}")


def read_catalog(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The enriched catalog from Parquet, CSV or JSON (kind, or what the path names), all records of all its files.

    A JSON file whose first line is a whole record has a record a line and is split among tasks; any other (an array, or
    records over several lines) is read whole, a file a task. CSV doesn't tell an empty text from a null: both read as null."""
    kind = kind or kind_of(path)
    reader = spark.read.schema(schemas.CATALOG)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"), F.trim(F.regexp_replace("value", "^\ufeff", "")).alias("value"))
    first = lines.filter("value <> ''").groupBy("file").agg(F.min_by("value", "at").alias("value"))
    found = first.select("file", (F.col("value").startswith("{") & F.get_json_object("value", "$").isNotNull()).alias("lines")).collect()  # a row a file
    parts = [(reader if whole else spark.read.schema(schemas.CATALOG).option("multiLine", True)).json(sorted(unquote(r.file) for r in found if r.lines == whole)) for whole in sorted({r.lines for r in found})]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schemas.CATALOG)


def read_reference_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REFERENCE_SET).option("multiLine", True).json(path)


def annotations_of(reference: DataFrame) -> DataFrame:
    """A row an annotation, with its place in the conversation."""
    each = reference.select("conversation_id", "conversation_text", "category", F.posexplode("annotations").alias("pos", "a"))
    return each.select("conversation_id", "conversation_text", "category", "pos", "a.*")


def read_cases(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Test cases with pos; the first limit by their place in the file."""
    rows = spark.read.schema(schemas.CASES).option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn("pos", F.monotonically_increasing_id())
    return rows if limit is None else rows.orderBy("pos").limit(limit)


def read_if_there(spark: SparkSession, paths: Iterable[str]) -> DataFrame | None:
    """The cases of those files that exist, or None."""
    found = [p for p in paths if exists(spark, p)]
    return spark.read.schema(schemas.CASES).option("header", True).option("multiLine", True).option("escape", '"').csv(found) if found else None


def scenarios(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "case_id string, description string, text string")


def embeddings(spark: SparkSession, path: str, docs: DataFrame, backend: str = "model") -> tuple[DataFrame, DataFrame]:
    """(docs with stored vectors, docs to embed): a stored vector is that of the text's hash, so edits are noticed, and of
    the backend named, so that vectors of two kinds never meet in one search. Each document has one vector in the store."""
    keyed = docs.withColumn("text_hash", F.sha2(F.col("text"), 256))
    stored = VectorStore(spark, path).read(backend)
    if stored is None:
        return keyed.withColumn("vector", F.lit(None).cast("array<double>")).filter("false"), keyed
    return keyed.join(stored, ["doc_id", "text_hash"]), keyed.join(stored, ["doc_id", "text_hash"], "left_anti")


def write_embeddings(vectors: DataFrame, path: str, backend: str = "model") -> int:
    """vectors: doc_id, text_hash, vector. A document's new vector replaces the one before; returns the store's version."""
    return VectorStore(vectors.sparkSession, path).write(vectors, backend)


def write_catalog(catalog: DataFrame, folder: str, one_file: bool = False) -> None:
    rows = catalog.select(*schemas.CATALOG.fieldNames())
    rows = rows.coalesce(1) if one_file else rows
    rows.write.mode("overwrite").parquet(f"{folder}/catalog.parquet")
    whole = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("overwrite").options(**whole).csv(f"{folder}/catalog_csv")
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/catalog_json")


def write_rows(rows: DataFrame, folder: str, formats: tuple[str, ...] = ("json", "csv"), mode: str = "overwrite") -> None:
    """Predictions, metrics and logs: JSON lines and CSV with a header; mode append adds to a log."""
    for kind in formats:
        writer = rows.write.mode(mode)
        (writer.option("header", True).option("escape", '"').csv if kind == "csv" else writer.option("ignoreNullFields", False).json if kind == "json" else writer.parquet)(f"{folder}/{kind}")


def nested_export(results: DataFrame, by: str = "conv_id") -> DataFrame:
    """One JSON text a conversation with its results in rank order."""
    columns = [c for c in results.columns if c != by]
    return results.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*sorted(columns, key=lambda c: c != "rank")))), {"ignoreNullFields": "false"}).alias("results_json"))


def markdown_table(rows: DataFrame, title: str = "", limit: int = 1000) -> str:
    """A report's table of aggregated rows; more than limit rows are refused, not cut."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"over {limit} rows: aggregate before rendering")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---" for _ in rows.columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in found)]) + "\n"


def markdown_report(title: str, tables: dict[str, DataFrame]) -> str:
    """A report: a heading, then each aggregated table under its own."""
    return f"# {title}\n\n" + "\n".join(markdown_table(rows, name) for name, rows in tables.items())

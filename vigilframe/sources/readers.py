"""Record files: CSV, JSON lines, JSON documents and Parquet, plus labelled folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.operators.merge import header_union
from vigilframe.operators.ordering import position

CONTAINERS = ("records", "data", "items")


def _suffix(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def load_records(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a record table by suffix or by the given format."""
    kind = (fmt or _suffix(path).lstrip(".")).lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    if kind in ("jsonl", "ndjson"):
        return reader.json(path)
    if kind == "json":
        return _json_documents(reader.json(path, multiLine=not _is_lines(spark, path)))
    if kind in ("parquet", "pq"):
        return reader.parquet(path)
    raise ValueError(f"unsupported record format: {path}")


def _is_lines(spark: SparkSession, path: str) -> bool:
    """Whether every line is a document of its own, as ``save_records`` writes them, and not part of a longer one."""
    text = F.trim("value")
    broken = spark.read.text(path).where((text != "") & F.try_parse_json(text).isNull())
    return broken.limit(1).count() == 0


def _json_documents(doc: DataFrame) -> DataFrame:
    """Arrays of objects, objects holding records, data or items (the first that a document has), and single objects."""
    held = [c for c in CONTAINERS if c in doc.columns and isinstance(doc.schema[c].dataType, T.ArrayType)]
    if not held:
        return doc
    parts, free = [], F.lit(True)
    for c in held:
        parts.append(doc.where(free & F.col(c).isNotNull()).select(F.explode(c).alias("r")).select("r.*"))
        free = free & F.col(c).isNull()
    single = [c for c in doc.columns if c not in held]
    if single:
        parts.append(doc.where(free).select(*single))
    return header_union(parts)


def save_records(df: DataFrame, path: str, fmt: str | None = None) -> None:
    kind = (fmt or _suffix(path).lstrip(".")).lower()
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True)
    elif kind in ("json", "jsonl", "ndjson"):
        writer.json(path)
    elif kind in ("parquet", "pq"):
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported record format: {path}")


def write_detections(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_detections(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Detection documents; blank lines are skipped by the JSON source."""
    return spark.read.schema(schema).json(path)


# --- discovery --------------------------------------------------------------------------
def list_csv(spark: SparkSession, root: str) -> DataFrame:
    """Every CSV file below a folder (path, name, length), listed by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def find_csv(spark: SparkSession, root: str, preferred: Sequence[str] = ()) -> list[str]:
    """Preferred names (case-insensitive, in the given order) where present, else all files."""
    files = list_csv(spark, root)
    rank = F.lit(None).cast("int")
    for i, p in enumerate(preferred):
        rank = F.when(F.lower("name") == p.lower(), i).otherwise(rank)
    rows = files.select("path", rank.alias("r")).orderBy("r", "path").collect()  # one row per file
    chosen = [r["path"] for r in rows if r["r"] is not None] or [r["path"] for r in rows]
    if not chosen:
        raise ValueError(f"no CSV files below {root}")
    return chosen


def single_csv(spark: SparkSession, root: str, preferred: Sequence[str] = ()) -> DataFrame:
    paths = find_csv(spark, root, preferred)
    if len(paths) != 1:
        raise ValueError(f"expected one CSV below {root}, found {len(paths)}: {paths[:5]}")
    return load_records(spark, paths[0], "csv")


def _folder(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -2))


def folder_labelled(
    spark: SparkSession, root: str, labels: Mapping[str, str], schema: T.StructType | str
) -> tuple[DataFrame, DataFrame]:
    """Rows labelled by their parent folder, and row counts per folder, file and label.

    An unknown folder is an error, and so is a header other than the schema's: the CSV
    source checks every file's header in FAILFAST mode.
    """
    df = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
        .option("enforceSchema", False).option("mode", "FAILFAST")
        .csv(root, header=True)
    )
    tagged = df.select("*", _folder(F.col("_metadata.file_path")).alias("source_folder"),
                       F.col("_metadata.file_name").alias("source_file"))
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    out = tagged.withColumn("label", F.try_element_at(known, F.col("source_folder")))
    bad = out.where(F.col("label").isNull()).select("source_folder").limit(1).collect()
    if bad:
        raise ValueError(f"folder without a label: {bad[0][0]}")
    counts = out.groupBy("source_folder", "source_file", "label").agg(F.count(F.lit(1)).alias("rows"))
    return out, counts


def truncate_malformed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows before the first line whose comma count differs from the header's.

    Line order inside the file comes from the split's block offset and the row's place in
    its split, so the file is never read by one task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_block_start").alias("blk"), F.monotonically_increasing_id().alias("seq"), "value"
    )
    fields = F.size(F.split("value", ",", -1))
    head = lines.agg(F.min_by(fields, F.struct("blk", "seq")).alias("n"), F.min(F.struct("blk", "seq")).alias("first")).first()
    at = F.struct("blk", "seq")
    point = lambda r: F.struct(F.lit(r["blk"]).cast("long").alias("blk"), F.lit(r["seq"]).cast("long").alias("seq"))
    bad = lines.where(fields != head["n"]).agg(F.min(at).alias("bad")).first()["bad"]
    keep = lines.where(at > point(head["first"]))
    if bad is not None:
        keep = keep.where(at < point(bad))
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    return keep.select(F.from_csv("value", ddl).alias("r")).select("r.*")


def pair_union(spark: SparkSession, paths: Sequence[str], fmt: str = "csv") -> DataFrame:
    """Train and test files in one table with the file each row came from."""
    frames = [
        load_records(spark, p, fmt).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"))
        for p in paths
    ]
    return header_union(frames)


def header_union_files(spark: SparkSession, root: str) -> DataFrame:
    """Many CSVs with different headers over the union of columns, with folder and file.

    Files are grouped by their header line, so there is one read per distinct header.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
        .select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("blk"),
            F.monotonically_increasing_id().alias("seq"), "value",
        )
        .where(F.col("blk") == 0)
    )
    heads = lines.groupBy("path").agg(F.min_by("value", "seq").alias("header"))
    groups = heads.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    frames = [
        spark.read.csv(g["paths"], header=True).select(
            "*", _folder(F.col("_metadata.file_path")).alias("source_folder"),
            F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"),
        )
        for g in groups
    ]
    return header_union(frames)


def known_class_rows(df: DataFrame, label: str, mapping: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose class is mapped, and counts of repeated headers, blank and other rows."""
    c = F.trim(F.col(label).cast("string"))
    profile = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(c.isin(list(mapping))).alias("kept"),
        F.count_if(c == label).alias("repeated_headers"),
        F.count_if(c.isNull() | (c == "")).alias("blank"),
    )
    known = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.where(c.isin(list(mapping))).withColumn("label_normalized", F.try_element_at(known, c)), profile


# --- reports ----------------------------------------------------------------------------
def read_reports(spark: SparkSession, root: str, name: str = "eval_report.json") -> DataFrame:
    """Every report file below a folder, nested objects flattened to dotted columns."""
    from vigilframe.operators.reports import flatten_structs

    doc = (
        spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    )
    return flatten_structs(doc.select(_folder(F.col("_metadata.file_path")).alias("run"), "*"))


def number_rows(df: DataFrame, order: Sequence[str], name: str = "record_id") -> DataFrame:
    return position(df, [], order, name)

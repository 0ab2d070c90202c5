"""File listings, payload tables and first-available sources."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators.ordering import cut_lineage

_ENTRY = "rel_path string, folder boolean, bytes bigint, ms bigint"
#: Names of a file system for Hadoop and for Arrow, where they differ.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def read_listing(
    spark: SparkSession,
    path: str,
    suffixes: Iterable[str] | None = None,
    recursive: bool = False,
) -> DataFrame:
    """One row per file under ``path``: ``path, rel_path, category, name, ext, bytes, mtime``.

    Nothing is opened. Names that start with ``.`` are skipped, files and folders alike; all others are
    listed, empty files and names that start with ``_`` or hold an equals sign included. ``category`` is the
    first folder, or empty. A path that is no folder is an error, an empty folder gives no rows.

    Folders are listed in tasks, a level of the tree per round; the folders found are the rows of the next
    round. Only a count per round reaches the driver. The files of one folder are listed by one task.
    """
    root = qualified(spark, path)
    found = _levels(spark, root, recursive) if _arrow_reaches(root) else [_driver_listing(spark, root, recursive)]
    entries = found[0]
    for level in found[1:]:
        entries = entries.unionByName(level)
    rel = F.col("rel_path")
    full = F.concat(F.lit(root + "/"), rel)
    listing = entries.where(~F.col("folder")).select(
        full.alias("path"),
        rel,
        F.regexp_extract(rel, r"^([^/]+)/", 1).alias("category"),
        text.basename(rel).alias("name"),
        text.suffix(rel).alias("ext"),
        "bytes",
        F.timestamp_millis("ms").alias("mtime"),
    )
    return listing if suffixes is None else listing.where(F.col("ext").isin([s.lower() for s in suffixes]))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that its file system gives it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")


def arrow_system(root: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = root.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}:{rest}")


def _arrow_reaches(root: str) -> bool:
    try:
        arrow_system(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _levels(spark: SparkSession, root: str, recursive: bool) -> list[DataFrame]:
    """What stands in ``root``, in its folders, in theirs: a written table for each level."""
    frontier, folders, levels = spark.createDataFrame([("",)], "folder string"), 1, []
    while folders:
        tasks = min(folders, 4 * spark.sparkContext.defaultParallelism)
        levels.append(cut_lineage(frontier.repartition(tasks).mapInArrow(_listed(root), _ENTRY)))
        if not recursive:
            break
        frontier = levels[-1].where("folder").select(F.col("rel_path").alias("folder"))
        folders = frontier.count()
    return levels


def _listed(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = arrow_system(root)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                inside = f"{base}/{folder}".rstrip("/")
                infos = system.get_file_info(fs.FileSelector(inside or "/"))
                infos = [i for i in infos if not i.base_name.startswith(".")]
                files = [i.type == fs.FileType.File for i in infos]
                columns = [
                    pa.array([f"{folder}/{i.base_name}".lstrip("/") for i in infos], pa.string()),
                    pa.array([not f for f in files], pa.bool_()),
                    pa.array([i.size if f else None for i, f in zip(infos, files)], pa.int64()),
                    pa.array([None if i.mtime_ns is None else i.mtime_ns // 1_000_000 for i in infos], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["rel_path", "folder", "bytes", "ms"])

    return run


def _driver_listing(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """For file systems that only Hadoop knows: Spark lists in tasks, but for what its sources skip."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true" if recursive else "false")
    files = reader.load(root).select(F.col("path"), F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("ms"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    statuses, more = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, recursive), []
    while statuses.hasNext():
        status = statuses.next()
        name = status.getPath().toString()
        # Spark lists a part with an equals sign: it may be a partition.
        if not status.getLen() or any(part.startswith("_") and "=" not in part for part in name[len(root) + 1 :].split("/")):
            more.append((name, status.getLen(), status.getModificationTime()))
    if more:
        files = files.unionByName(spark.createDataFrame(more, "path string, bytes bigint, ms bigint"))
    entries = files.select(F.substring("path", len(root) + 2, 2**31 - 1).alias("rel_path"), F.lit(False).alias("folder"), "bytes", "ms")
    entries = entries.where(~F.col("rel_path").rlike(r"(^|/)\."))
    return entries if recursive else entries.where(F.instr("rel_path", "/") == 0)


def read_first_available(spark: SparkSession, uris: list[str], fmt: str = "parquet", **options) -> tuple[DataFrame, str]:
    """The first source whose schema resolves, with its URI; only metadata is read here."""
    failures = []
    for uri in uris:
        try:
            df = spark.read.format(fmt).options(**options).load(uri)
            if df.schema.fields:
                return df, uri
            failures.append(f"{uri}: no columns")
        except PySparkException as error:
            failures.append(f"{uri}: {type(error).__name__}")
    raise ValueError("no source is readable: " + "; ".join(failures))


def detect_payload_column(df: DataFrame) -> str:
    """First binary column, or struct with a binary ``bytes`` field; decided from the schema alone."""
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.BinaryType):
            return field.name
        if isinstance(kind, T.StructType) and any(
            f.name == "bytes" and isinstance(f.dataType, T.BinaryType) for f in kind.fields
        ):
            return field.name
    raise ValueError(f"no payload column among {df.columns}")


def payload_of(df: DataFrame, column: str) -> Column:
    return F.col(column)["bytes"] if isinstance(df.schema[column].dataType, T.StructType) else F.col(column)


def extract_payload(df: DataFrame, column: str | None = None, out: str = "payload") -> DataFrame:
    """Replace the payload column by one binary column; null and empty payloads are dropped."""
    column = column or detect_payload_column(df)
    others = [c for c in df.columns if c != column]
    return df.select(*others, payload_of(df, column).alias(out)).where(F.octet_length(out) > 0)

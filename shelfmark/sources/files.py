"""Files as rows (I4, D1, Q6): listed without their content, hashed in ranges only where that can matter."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Suffixes of books that are taken in.
SUFFIXES = ("epub", "pdf", "mobi", "azw3", "cbz", "cbr")
EDGE = 64 * 1024


def _supported(suffixes: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)


def listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """I4: path, length and modificationTime of a folder's files, at any depth. Content is no column of the plan, so nothing is opened. Spark's file source leaves empty files out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", "modificationTime").where(_supported(suffixes))


def arriving(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, at_once: int = 1000, age: str | None = None) -> DataFrame:
    """I4 as a stream: each file once. The checkpoint is the seen-set; `age` bounds it, as files older than that, counted from the newest, are neither kept in it nor taken."""
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", at_once)
    source = source.option("maxFileAge", age) if age else source
    schema = "path string, modificationTime timestamp, length long, content binary"
    return source.schema(schema).load(folder).select("path", "length", "modificationTime").where(_supported(suffixes))


def _open(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store.open_input_file(at)


def sparse_hash(path: str, length: int) -> str:
    """Length, and 16 digits over it and the first and last 64 KiB, or the whole where these would meet."""
    if not length:
        return "0:empty"
    h = hashlib.sha256(str(length).encode())
    with _open(path) as f:
        if length <= 2 * EDGE:
            h.update(f.read())
        else:
            h.update(f.read(EDGE))
            f.seek(length - EDGE)
            h.update(f.read(EDGE))
    return f"{length}:{h.hexdigest()[:16]}"


def full_hash(path: str, length: int) -> str:
    h = hashlib.sha256()
    with _open(path) as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def _hashed(files: DataFrame, name: str, of: Callable[[str, int], str]) -> DataFrame:
    """`files` with a hash that tasks take from the files, a range or a MiB at a time; null where a file can't be read any more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                try:
                    out.append(of(path, length))
                except OSError:
                    out.append(None)
            yield pa.record_batch([*b.columns, pa.array(out, pa.string())], [*b.schema.names, name])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField(name, StringType())]))


def _shared(files: DataFrame, *by: str) -> DataFrame:
    """Files whose values several files share."""
    several = files.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return files.join(several, list(by), "left_semi").select(*files.columns)


def clones(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """D1 over files (path, length): groups of equal content, as path, length, sparse, full.

    Files of a length of their own aren't opened, those that share it are read at both ends, and only those that share that hash are read whole.
    """
    n = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = _shared(files.select("path", "length"), "length").repartition(n, "path")
    two = _shared(_hashed(one, "sparse", sparse_hash).where("sparse is not null"), "sparse").repartition(n, "path")
    return _shared(_hashed(two, "full", full_hash).where("full is not null"), "full")


def missing(formats: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Q6 over files: stored formats (book_id, path, name, format) without a file under `root`, with the reason; a path that leaves the root is never looked up."""
    root = root.rstrip("/")
    at = F.concat_ws("/", "path", F.concat("name", F.lit("."), F.lower("format")))
    unsafe = F.startswith("path", F.lit("/")) | F.exists(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), lambda p: p == "..")
    there = files.select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{root}/", "").alias("at"), F.lit(True).alias("there")).distinct()
    rows = formats.select("book_id", "path", F.concat("name", F.lit("."), F.lower("format")).alias("file"), at.alias("at"))
    reason = F.when(F.coalesce("path", F.lit("")) == "", "NO_PATH_IN_DB").when(unsafe, "UNSAFE_BOOK_PATH").when(F.col("there").isNull(), "FILE_MISSING_ON_DISK")
    return rows.join(there, "at", "left").select("book_id", "file", reason.alias("reason")).where("reason is not null")

"""Documents from files and from tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell.functions.metadata import string_map
from chunkwell.sources.uris import is_url, last_segment, suffix

#: Formats whose files are text. Binary office and PDF formats need a codec
#: that is not available; such files must arrive as text in a table.
TEXT_FORMATS = ("txt", "md", "html", "htm", "csv", "json", "xml")

#: The same as a file pattern, in any case of letters: other files are never opened.
TEXT_FILES = "*.{%s}" % ",".join(
    "".join(f"[{c}{c.upper()}]" for c in suffix_) for suffix_ in TEXT_FORMATS
)


def as_documents(files: DataFrame) -> DataFrame:
    """Rows of Spark's ``binaryFile`` source as document rows."""
    name = last_segment(F.col("path"))
    return files.select(
        F.col("path").alias("doc_uri"),
        name.alias("file_name"),
        F.ltrim(suffix(F.col("path")), F.lit(".")).alias("format"),
        F.col("length").alias("file_size"),
        # a byte that is not UTF-8 is replaced, it does not end the job
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    ).where(F.col("format").isin(*TEXT_FORMATS))


def read_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Load text documents from a path, a glob or several of them.

    A path that matches nothing is an ``AnalysisException``. Files that are not
    of a text format are left out. A file is one document and one row, so it must
    fit an executor; :func:`read_records` makes a document of every line instead.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", TEXT_FILES)
    return as_documents(reader.load(path))


def read_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Load line-wise files (CSV, JSON lines, logs) as a document per line that is not blank.

    Large files are split over tasks. The address is that of the file with the
    line's place in its split, ``file#part-line``; it does not change while the
    files and the split size stay the same.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    place = F.col("_metadata.file_path")
    start = F.col("_metadata.file_block_start").cast("string")
    rows = lines.select(
        "value", place.alias("path"), start.alias("start"), F.monotonically_increasing_id().alias("n")
    ).where(F.trim("value") != "")
    # the low bits count the rows of a task, which may read several splits
    line = F.col("n").bitwiseAND(F.lit((1 << 33) - 1)).cast("string")
    return rows.select(
        F.concat("path", F.lit("#"), "start", F.lit("-"), line).alias("doc_uri"),
        last_segment(F.col("path")).alias("file_name"),
        F.ltrim(suffix(F.col("path")), F.lit(".")).alias("format"),
        F.octet_length("value").cast("bigint").alias("file_size"),
        F.col("value").alias("content"),
    )


def spread(table: DataFrame) -> DataFrame:
    """Put a table that comes in a few large pieces on all cores.

    Chunking and embedding follow the layout of the scan, which for a table of
    many files is what one wants: no shuffle. A table with fewer scan tasks than
    cores would leave cores idle, so that one, and only that one, is dealt out
    again. For tables as they come from storage; the scan is planned, not run.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores)


def documents_from_table(
    df: DataFrame,
    uri_col: str,
    content_col: str,
    *,
    format_: str | None = None,
    metadata: Sequence[str] = (),
) -> DataFrame:
    """Document rows from any table that holds an address and a text.

    ``metadata`` names columns that become caller-supplied fields.
    """
    uri = F.col(uri_col).cast("string")
    kind: Column = F.lit(format_) if format_ else F.ltrim(suffix(uri), F.lit("."))
    out = df.select(
        uri.alias("doc_uri"),
        last_segment(uri).alias("file_name"),
        kind.alias("format"),
        F.octet_length(content_col).cast("bigint").alias("file_size"),
        F.col(content_col).alias("content"),
        F.when(is_url(uri), uri).alias("source_url"),
        *[F.col(c).cast("string").alias(f"_m_{i}") for i, c in enumerate(metadata)],
    )
    pairs: list[Column] = []
    for i, c in enumerate(metadata):
        pairs += [F.lit(c), F.col(f"_m_{i}")]
    fields = F.create_map(*pairs) if pairs else string_map(None)
    return out.withColumn("metadata", fields).drop(*[f"_m_{i}" for i in range(len(metadata))])

"""Text files of one folder whose headers differ: files are grouped by header, each group is one scan."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.sources.paths import open_uri

#: More different headers than this are an error: they are written by people and programs, not per file.
MOST_HEADERS = 1000
_BLOCK, _LONGEST = 1 << 14, 1 << 20


def _first_line(path: str) -> str | None:
    """The first line that is not blank; null where there is none."""
    files, name = open_uri(path)
    head = b""
    with files.open_input_stream(name, compression="detect") as file:
        while more := file.read(_BLOCK):
            head = (head + more).lstrip(b"\r\n")
            if b"\n" in head:
                break
            if len(head) > _LONGEST:
                raise ValueError(f"no line end in the first {_LONGEST} bytes of {path}")
    line = head.split(b"\n")[0].decode("utf-8-sig", "replace").rstrip("\r")
    return line if line.strip() else None


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [_first_line(p) for p in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(lines, pa.string())], names=["file", "line"])


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the header line of every file, with ``file`` as in ``_metadata.file_path``. Reads only first blocks."""
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("file"))
    return listed.mapInArrow(_first_lines, "file string, line string")


def header_files(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Columns of each header that occurs and the files that have it; files without any line are left out."""
    lines = first_lines(spark, path).where("line IS NOT NULL")
    grouped = lines.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).limit(MOST_HEADERS + 1).collect()
    if len(grouped) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers below {path}")
    found: dict[tuple[str, ...], list[str]] = {}
    for r in grouped:
        found.setdefault(tuple(next(csv.reader([r["line"]]))), []).extend(r["files"])
    return found

"""Rows of a stored table by an address that stays the same however the table is split.

An address is the file of a row and the block of ``GROUP`` row numbers it lies in; Spark reads both from the scan itself.
What earlier steps found out about the rows of a block is written to side tables under its address, and a task that
meets rows of the block loads them, whichever task that is and wherever Spark cuts the files that time.

``docs`` is best a table on storage, or a filter or projection of one; anything else is written to the shared folder
once and addressed there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.llm.warc import open_folder
from skuflow.session import materialize, new_shared_path

GROUP = 1 << 16
#: Addresses that share a folder of a side table; tasks read the row groups of their own by file statistics.
PER_FOLDER = 16
_PLAIN = {"Project", "Filter", "Relation", "SubqueryAlias"}


@dataclass(frozen=True)
class Scan:
    """``rows`` are the columns asked for, then part (the address) and row (the number in the block)."""

    rows: DataFrame
    parts: int
    stored_bytes: int

    @property
    def folders(self) -> int:
        return max(1, self.parts // PER_FOLDER)


def _stored(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().analyzed().toString()
    return all(line.lstrip(" :+-").split(" ")[0].split("(")[0] in _PLAIN for line in plan.splitlines() if line.strip())


def addressed(docs: DataFrame) -> Scan:
    """Scan of ``docs`` with addresses. Runs a job that reads no column, to learn the size of the table."""
    if not _stored(docs):
        docs = materialize(docs, "addressed")
    meta = docs.metadataColumn("_metadata")
    file, number = meta["file_path"], meta["row_index"]
    part = F.xxhash64(file, F.floor(number / GROUP))
    rows = docs.select(*docs.columns, part.alias("part"), (number % GROUP).cast("int").alias("row"))
    files = docs.select(file.alias("f"), meta["file_size"].alias("n"), part.alias("p")).groupBy("f").agg(F.max("n").alias("n"), F.count_distinct("p").alias("p"))
    parts, size = files.agg(F.sum("p"), F.sum("n")).first()
    return Scan(rows, int(parts or 0), int(size or 0))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name``, unique per row and the same on every reading: file (hashed) and row number, 16 bytes."""
    if not _stored(docs):
        docs = materialize(docs, "numbered")
    meta = docs.metadataColumn("_metadata")
    eight = lambda n: F.unhex(F.lpad(F.hex(n), 16, "0"))
    return docs.withColumn(name, F.concat(eight(F.xxhash64(meta["file_path"])), eight(meta["row_index"])))


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one address. A task meets all its rows of an address one after the other."""
    for batch in batches:
        parts = batch.column("part").to_numpy()
        if not len(parts):
            continue
        ends = np.append(np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts))
        first = 0
        for end in ends.tolist():
            yield int(parts[first]), batch.slice(first, end - first)
            first = end


def write_side(rows: DataFrame, scan: Scan, label: str) -> str:
    """Write a side table with a column ``part``; gives its folder."""
    path = new_shared_path(rows.sparkSession, label)
    dealt = rows.withColumn("folder", F.pmod("part", F.lit(scan.folders))).repartition(scan.folders, "folder")
    dealt.sortWithinPartitions("folder", "part").write.partitionBy("folder").parquet(path)
    return path


def read_side(path: str, part: int, folders: int, columns: list[str]) -> Iterator[pa.Table]:
    """What a side table holds for an address."""
    files, root = open_folder(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/folder={part % folders}", allow_not_found=True))
    for f in sorted(found, key=lambda f: f.path):
        if f.base_name.startswith("part-"):
            yield pq.read_table(f.path, filesystem=files, partitioning=None, columns=columns, filters=[("part", "==", part)])

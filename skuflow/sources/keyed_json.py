"""JSON objects keyed by id, read in pieces by many tasks.

A file ``{"id": value, ...}`` need not have line ends to split at, and whether a byte lies inside a string depends on
all bytes before it. Two passes settle that, and no task reads a whole file. A data source counts quotes and brackets
per piece, the brackets for both cases: the piece begins inside a string, or it does not. Running sums over the pieces
(a row each) then tell how each one begins, and every task takes the entries that begin in its piece, reading on to the
end of the last one.

Defined cases: an empty or blank file and ``{}`` have no entries; several objects in a file follow each other; repeated
keys are rows of their own; a value may be of any JSON kind and ``null`` reads as null under a schema; an entry longer
than a piece is read by the task in whose piece it begins. What is not an object, does not end, or holds an entry
without a key is an error. Files are plain UTF-8: compressed ones cannot be cut and are refused like any other text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skuflow.session import materialize
from skuflow.sources.paths import data_files, open_uri

PIECE = 16 << 20
#: How much is read at a time beyond the end of a piece, and entries per batch.
MORE, BATCH = 1 << 16, 4096
#: Bytes of a piece that are looked at together.
BLOCK = 1 << 18

_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_ENTRY = re.compile(rb'\s*("(?:[^"\\]|\\.)*")\s*:(.*)\Z', re.DOTALL)
_MARK = b"\xef\xbb\xbf"
#: Bytes that are looked at, and how they change the depth.
_SHOWN = np.isin(np.arange(256), list(b'"{}[],'))
_CHANGE = np.isin(np.arange(256), list(b"{[")).astype(np.int64) - np.isin(np.arange(256), list(b"}]"))


# ------------------------------------------------------------------ first pass


def _read(file, first: int, last: int) -> bytes:
    file.seek(first)
    return file.read(last - first)


def _escaped(file, at: int) -> bool:
    """Whether the byte at ``at`` is escaped: backslashes only stand in strings, so their run before it decides."""
    run, step = 0, 64
    while at - run > 0:
        first = max(0, at - run - step)
        tail = _read(file, first, at - run)
        same = len(tail) - len(tail.rstrip(b"\\"))
        run += same
        if same < len(tail):
            break
    return run % 2 == 1


def _marks(data: bytes, escaped: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Brackets and commas of ``data``, a block at a time, so that memory stays small beside the data: their places, the
    bytes, whether the quotes before them are odd in number, and whether those up to the end of the block are."""
    odd = False
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        if escaped:
            block = b" " + block[1:]
        if b"\\" in block:
            block = _ESCAPE.sub(b"  ", block)
        escaped = block.endswith(b"\\")
        raw = np.frombuffer(block, np.uint8)
        place = np.flatnonzero(_SHOWN[raw])
        mark = raw[place]
        quote = mark == ord('"')
        before = np.bitwise_xor.accumulate(quote) ^ odd
        odd = bool(before[-1]) if len(before) else odd
        yield at + place[~quote], mark[~quote], before[~quote], odd


@dataclass
class Piece(InputPartition):
    file: str
    piece: int
    first: int
    last: int


class _PieceReader(DataSourceReader):
    def __init__(self, path: str, length: int):
        self.path, self.length = path, length

    def partitions(self) -> list[Piece]:
        """Pieces of the files, by their sizes alone."""
        cuts = [(f, n, at) for f in data_files(self.path) for n, at in enumerate(range(0, f.size, self.length))]
        return [Piece(f.path, n, at, min(at + self.length, f.size)) for f, n, at in cuts] or [Piece("", 0, 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        if not partition.last:
            return
        files, _ = open_uri(self.path)
        with files.open_input_file(partition.file) as file:
            data, escaped = _read(file, partition.first, partition.last), _escaped(file, partition.first)
        begun = data.removeprefix(_MARK).lstrip()[:1]
        if partition.piece == 0 and begun not in (b"", b"{"):
            raise ValueError(f"{partition.file} is no JSON object")
        outside, inside, odd = 0, 0, False
        for _, mark, quoted, odd in _marks(data, escaped):
            outside += int(_CHANGE[mark[~quoted]].sum())
            inside += int(_CHANGE[mark[quoted]].sum())
        yield partition.file, partition.piece, partition.first, partition.last, int(odd), outside, inside


class PieceSource(DataSource):
    """Pieces of keyed JSON files: where they lie, whether their quotes are odd in number, and how they change the depth."""

    @classmethod
    def name(cls) -> str:
        return "keyed_json_pieces"

    def schema(self) -> str:
        return "file string, piece long, first long, last long, odd int, outside long, inside long"

    def reader(self, schema) -> _PieceReader:
        return _PieceReader(self.options["path"], int(self.options["piece_bytes"]))


# ----------------------------------------------------------------- second pass


def _rest(file, at: int, in_string: bool, depth: int) -> bytes:
    """Bytes from ``at`` to the end of the entry that is open there."""
    found = []
    while True:
        data = _read(file, at, at + MORE)
        if not data:
            raise ValueError("a JSON object does not end")
        odd = False
        for place, mark, quoted, odd in _marks(data, _escaped(file, at)):
            place, mark = place[quoted == in_string], mark[quoted == in_string]
            level = depth + np.cumsum(_CHANGE[mark])
            ends = place[(mark == ord(",")) & (level == 1) | (_CHANGE[mark] < 0) & (level == 0)]
            if len(ends):
                return b"".join([*found, data[: ends[0]]])
            depth = int(level[-1]) if len(level) else depth
        found.append(data)
        at, in_string = at + len(data), in_string ^ odd


def _piece_entries(file, first: int, last: int, in_string: bool, depth: int) -> Iterator[bytes]:
    """Texts of the entries that begin in a piece: behind a comma at depth 1, or behind the brace that opens an object."""
    data, odd = _read(file, first, last), False
    found, ending = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for place, mark, quoted, odd in _marks(data, _escaped(file, first)):
        place, mark = place[quoted == in_string], mark[quoted == in_string]
        step = _CHANGE[mark]
        level = depth + np.cumsum(step)
        comma, opened, closed = (mark == ord(",")) & (level == 1), (step > 0) & (level == 1), (step < 0) & (level == 0)
        if (mark[opened] != ord("{")).any():
            raise ValueError("a JSON array stands where an object should")
        bound = comma | opened | closed
        found.append(place[bound])
        ending.append(closed[bound])
        depth = int(level[-1]) if len(level) else depth
    bounds, closed = np.concatenate(found), np.concatenate(ending)
    for n in np.flatnonzero(~closed):
        start = bounds[n] + 1
        if n + 1 < len(bounds):
            yield data[start : bounds[n + 1]]
        else:
            yield data[start:] + _rest(file, last, in_string ^ odd, depth)


def _entries(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_uri(path)

        def batch(keys, values):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "value"])

        for piece in (row for b in batches for row in b.to_pylist()):
            keys, values, held = [], [], 0
            with files.open_input_file(piece["file"]) as file:
                for text in _piece_entries(file, piece["first"], piece["last"], piece["in_string"], piece["depth"]):
                    if not text.strip():
                        continue  # an object without entries
                    parts = _ENTRY.match(text)
                    if parts is None:
                        raise ValueError(f"{piece['file']}: no key in an entry that begins with {text[:40]!r}")
                    keys.append(json.loads(parts[1]))
                    values.append(parts[2].strip().decode())
                    held += len(text)
                    if len(keys) == BATCH or held > PIECE:
                        yield batch(keys, values)
                        keys, values, held = [], [], 0
            if keys:
                yield batch(keys, values)

    return read


def read_keyed_json(spark: SparkSession, path: str, schema: str | None = None, piece_bytes: int = PIECE) -> DataFrame:
    """(key, value) of all objects in the file or folder ``path``; ``value`` is JSON text, or by ``schema`` what it holds.

    Runs the first pass. One row per piece and one count come out of it; only the list of files is read on the driver.
    """
    spark.dataSource.register(PieceSource)
    pieces = spark.read.format(PieceSource.name()).option("piece_bytes", piece_bytes).load(path)
    before = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    begun = pieces.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    begun = begun.withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    begun = materialize(begun.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0))), "pieces")
    open_at_end = begun.groupBy("file").agg(F.sum("change").alias("d"), F.sum("odd").alias("q"), F.count("*").alias("n"))
    count, broken = open_at_end.agg(F.sum("n"), F.min(F.when((F.col("d") != 0) | (F.col("q") % 2 != 0), F.col("file")))).first()
    if broken is not None:
        raise ValueError(f"a JSON object in {broken} does not end")
    places = begun.select("file", "first", "last", "in_string", "depth").repartition(max(1, count or 0))
    entries = places.mapInArrow(_entries(path), "key string, value string")
    return entries if schema is None else entries.withColumn("value", F.from_json("value", schema))


# ---------------------------------------------------------------------- writer


def _object_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one object: a brace, the entries with commas between them, a brace."""
    line = "{"
    for batch in batches:
        entries = batch.column(0).to_pylist()
        if not entries:
            continue
        # the last line is held back, as it gets a comma only if another entry follows
        lines = [line + ("" if line == "{" else ","), *(e + "," for e in entries[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        line = entries[-1]
    yield pa.RecordBatch.from_arrays([pa.array([line, "}"], pa.string())], names=["value"])


def write_keyed_json(rows: DataFrame, path: str, key: str) -> None:
    """Each task writes its rows as one object, keyed by ``key`` (a null key as ``"null"``); the other columns are the value."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    value = F.struct(*[c for c in rows.columns if c != key])
    whole = F.to_json(F.create_map(name, value), {"ignoreNullFields": "false"})
    entries = rows.select(F.substring(whole, F.lit(2), F.length(whole) - 2).alias("value"))
    entries.mapInArrow(_object_lines, "value string").write.option("lineSep", "\n").text(path)

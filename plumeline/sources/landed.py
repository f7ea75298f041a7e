"""A data source of landed observations: files of JSON lines, by source, as batch or stream.

    spark = landed.register(spark)
    rows = spark.read.format("landed_observations").load(path)

`path` holds folders `source=<name>` of files, one observation in a line, as Spark writes them with partitionBy("source").json. Conditions on source choose
folders, those on time, place, metric and value are applied to Arrow batches before anything reaches Spark. A file is a partition. A stream takes
files in the order in which they were finished; its offset is the last one's time and name. Files whose names begin with a dot or underscore are
not read. A line that is no JSON fails the job; a field that is absent, or no number or time, is null. Driver and executors reach `path` by
Arrow's file systems (local or mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.json as pj
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

FORMAT = "landed_observations"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "timestamp timestamp, lat double, lon double, metric string, value double, unit string, source string, source_entity_id string, raw_json string"
NUMBERS, TEXTS = ("lat", "lon", "value"), ("timestamp", "metric", "unit", "source_entity_id", "raw_json")
TIME = pa.timestamp("us", tz="UTC")
KINDS = {c: pa.float64() for c in NUMBERS} | {c: pa.string() for c in TEXTS} | {"timestamp": TIME, "source": pa.string()}
ORDER = [part.split()[0] for part in SCHEMA.split(", ")]
COMPARE = {D.EqualTo: pc.equal, D.GreaterThan: pc.greater, D.GreaterThanOrEqual: pc.greater_equal, D.LessThan: pc.less, D.LessThanOrEqual: pc.less_equal}
#: Bytes of a file that are parsed at once; a line may be as long.
BLOCK = 8 << 20


@dataclass
class File(D.InputPartition):
    path: str
    source: str
    finished: int
    size: int


def files(root: str) -> list[File]:
    """All landed files with the source of their folder and the time at which they were finished (nanoseconds)."""
    system, base = pafs.FileSystem.from_uri(root)
    found = []
    for info in system.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
        parts = info.path[len(base) :].strip("/").split("/")
        if info.type == pafs.FileType.File and len(parts) > 1 and parts[0].startswith("source=") and not any(p.startswith((".", "_")) for p in parts):
            found.append(File(info.path, unquote(parts[0].removeprefix("source=")), info.mtime_ns or 0, info.size))
    return sorted(found, key=lambda f: (f.finished, f.path))


def lenient(column: pa.ChunkedArray | pa.Array, kind: pa.DataType) -> pa.Array:
    """A column as the schema's kind; what cannot be read is null."""
    if column.type == kind:
        return column
    if pa.types.is_null(column.type):
        return pa.nulls(len(column), kind)
    if kind == TIME:
        text = pc.utf8_trim_whitespace(column.cast(pa.string()))
        zoned = pc.if_else(pc.match_substring_regex(text, r"(Z|[+-]\d\d:?\d\d)$"), text, pc.binary_join_element_wise(text, "Z", ""))
        good = pc.match_substring_regex(zoned, r"^\d{4}-(0[1-9]|1[0-2])-([0-2]\d|3[01])[T ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?(Z|[+-]\d\d:?\d\d)$")
        return pc.if_else(good, zoned, None).cast(kind)
    if kind == pa.float64() and pa.types.is_string(column.type):
        text = pc.utf8_trim_whitespace(column)
        return pc.if_else(pc.match_substring_regex(text, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text, None).cast(kind)
    return column.cast(kind)


def batches(root: str, file: File, tests: list[tuple[str, str, object]], columns: list[str]) -> Iterator[pa.RecordBatch]:
    system, _ = pafs.FileSystem.from_uri(root)
    with system.open_input_stream(file.path) as stream:
        held = b""
        while True:
            block = stream.read(BLOCK)
            lines, mark, rest = (held + block).rpartition(b"\n") if block else (held, b"", b"")
            held = rest
            if lines.strip():
                yield from parsed(lines, file.source, tests, columns)
            if not block:
                return


def parsed(lines: bytes, source: str, tests: list[tuple[str, str, object]], columns: list[str]) -> Iterator[pa.RecordBatch]:
    options = pj.ParseOptions(explicit_schema=pa.schema([(c, pa.string()) for c in TEXTS]), unexpected_field_behavior="infer")
    try:
        table = pj.read_json(pa.BufferReader(lines), read_options=pj.ReadOptions(block_size=len(lines) + 1), parse_options=options)
    except pa.ArrowInvalid:  # a field of several types, or no JSON
        rows = [json.loads(line) for line in lines.split(b"\n") if line.strip()]
        text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
        table = pa.table({c: pa.array([text(r.get(c)) if isinstance(r, dict) else None for r in rows], pa.string()) for c in ORDER})
    data = {c: lenient(table.column(c).combine_chunks(), KINDS[c]) if c in table.column_names else pa.nulls(table.num_rows, KINDS[c]) for c in ORDER if c != "source"}
    data["source"] = pa.array([source] * table.num_rows, pa.string())
    out = pa.table({c: data[c] for c in ORDER})
    for name, column, value in tests:
        out = out.filter(mask(name, out.column(column), value))
    yield from out.select(columns).to_batches()


def mask(name: str, column: pa.ChunkedArray, value: object):
    if name == "IsNotNull":
        return pc.is_valid(column)
    if name == "In":
        return pc.is_in(column, pa.array(value, column.type))
    return next(f for kind, f in COMPARE.items() if kind.__name__ == name)(column, pa.scalar(value, column.type))


class Landed(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], schema.fieldNames())

    def streamReader(self, schema) -> Stream:  # noqa: N802
        return Stream(self.options["path"], schema.fieldNames())


class Reader(D.DataSourceReader):
    def __init__(self, root: str, columns: list[str]):
        self.root, self.columns, self.tests = root, columns, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        """Takes comparisons with single values, lists of values, and tests for null, of any column; returns the rest."""
        for f in filters:
            kind, name = type(f), ".".join(getattr(f, "attribute", ()))
            if name not in KINDS or kind not in (*COMPARE, D.In, D.IsNotNull):
                yield f
            else:
                self.tests.append((kind.__name__, name, getattr(f, "value", None)))

    def partitions(self) -> Sequence[D.InputPartition]:
        """The files of sources that pass."""
        own = [(name, value) for name, column, value in self.tests if column == "source"]
        return [f for f in files(self.root) if all(mask(name, pa.chunked_array([[f.source]]), value)[0].as_py() for name, value in own)]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return iter(())
        return batches(self.root, partition, [t for t in self.tests if t[1] != "source"], self.columns)


class Stream(D.DataSourceStreamReader):
    def __init__(self, root: str, columns: list[str]):
        self.root, self.columns = root, columns

    def initialOffset(self) -> dict:  # noqa: N802
        return {"finished": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        known = files(self.root)
        return {"finished": known[-1].finished, "path": known[-1].path} if known else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[D.InputPartition]:
        low, high = ((o["finished"], o["path"]) for o in (start, end))
        return [f for f in files(self.root) if low < (f.finished, f.path) <= high]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return iter(())
        return batches(self.root, partition, [], self.columns)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to the session, and lets conditions reach it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Landed)
    return spark

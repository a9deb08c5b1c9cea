"""Flat audit logs as CSV.

Records may span lines (a body in quotes) and the log may hold lines left by a failing writer, so lines are filtered
first and records are put together afterwards, split by split. Whether a split starts inside a quoted field is not known
when it is read, so each split is a function of that: it tells for either start where it first is at the end of a record again
and what it leaves open. A fold over the splits of a file, a row each, then says which start was the true one, and the few
records that span splits are put together. A field whose quote is never closed properly does not swallow what follows.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.operators.requests import union_audit
from tracewarden.schemas import AUDIT_FLAT
from tracewarden.session import bounded_rows, stored

# Line endings a failing log writer leaves.
BAD_ENDINGS = ("Failed to write CSV record: short write", "CSV writer error: short write")

#: Files that a task writes side by side when a log is partitioned.
OPEN_FILES = 20
#: Characters of lines that a task holds at once; a longer split is taken in chunks of whole lines, each a split of its own.
CHUNK_CHARS = 4 << 20

#: Different column orders among the files of one read.
MOST_LAYOUTS = 1000


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths (or globs) that match at least one file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        hits = p.getFileSystem(conf).globStatus(p)
        if hits is not None and len(hits) > 0:
            found.append(path)
    return found


def drop_corrupt_lines(lines: DataFrame, endings: tuple[str, ...] = BAD_ENDINGS, line: str = "value") -> DataFrame:
    text = F.regexp_replace(F.col(line), r"[\r\n]+$", "")
    bad = F.lit(False)
    for ending in endings:
        bad = bad | text.endswith(ending)
    return lines.filter(~bad)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    value = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(
        F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit(""))
    )
    return (
        spark.read.option("lineSep", "\n")
        .text(paths)
        .select(
            F.regexp_replace(value, r"\r$", "").alias("value"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )


#: States at the end of a line: at a record's end, inside a quoted field, or a closing quote followed by something else.
_OUT, _IN, _BAD = "out", "in", "bad"

_PIECES = "file string, block long, role string, needs string, seq long, text string"


def _line_end(line: str, inside: bool) -> str:
    """The state after a line that starts inside or outside a quoted field. In a field without quotes a quote is plain text."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line.startswith('"', at + 1):
                at = line.find('"', at + 2)
            if at < 0:
                return _IN
            if at + 1 == len(line):
                return _OUT
            if line[at + 1] != ",":
                return _BAD
            at += 2
        inside = line.startswith('"', at)
        if inside:
            at += 1
        else:
            at = line.find(",", at) + 1
            if not at:
                return _OUT


class _Split:
    """The lines of one split. ``resolves[i]``: the first line from i on that, started inside quotes, does not end inside."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.inside = [_line_end(x, True) if '"' in x else _IN for x in lines]
        self.resolves = [len(lines)] * (len(lines) + 1)
        for i in reversed(range(len(lines))):
            self.resolves[i] = i if self.inside[i] != _IN else self.resolves[i + 1]

    def records(self, at: int) -> Iterator[tuple[int, int]]:
        """(first, last) line of each record from line ``at``, which starts one; last is the number of lines if it is left open.

        A record that ends badly is dropped with its first line, and the next line starts anew. So does what follows a record
        that is left open: it counts if that one turns out to end badly.
        """
        while at < len(self.lines):
            last = at
            if '"' in self.lines[at] and _line_end(self.lines[at], False) == _IN:
                last = self.resolves[at + 1]
                if last < len(self.lines) and self.inside[last] == _BAD:
                    at += 1
                    continue
            yield at, last
            at = last + 1 if last < len(self.lines) else at + 1

    def text(self, first: int, last: int) -> str:
        return "\n".join(self.lines[first : last + 1])

    def pieces(self) -> Iterator[tuple[str, str, int, str | None]]:
        """(role, needs, seq, text): what the split gives, and on which start (o: outside quotes, i: inside, a: inside throughout).

        ``d``: only if the record that the split leaves open is damaged; ``v``: only if it is not. Upper case: that start is needed.
        """
        head = self.resolves[0]
        closes = head < len(self.lines) and self.inside[head] == _OUT
        kind = "all" if head == len(self.lines) else _OUT if closes else _BAD
        runs = {"O": list(self.records(0)), "I": list(self.records(head + 1)) if closes else []}
        common = set(runs["O"]) & set(runs["I"])
        # from the first common record on, both starts go the same way, unless one has left a record open before
        same = min((first for first, _ in common), default=len(self.lines))
        if any(last == len(self.lines) and first < same for run in runs.values() for first, last in run):
            same = len(self.lines)
        opens = {start: any(last == len(self.lines) for _, last in run) for start, run in runs.items()}
        yield "summary", kind, int(opens["O"]), "open" if opens["I"] else None
        if kind == "all":
            yield "all", "A", 0, self.text(0, len(self.lines))
        elif closes:
            yield "head", "I", head, self.text(0, head)
        for start, run in runs.items():
            if start == "I":
                run = [r for r in run if r[0] < same]
            opened = False
            for first, last in run:
                needs = "*" if start == "O" and first >= same and closes else start
                if last < len(self.lines):
                    yield "record", needs + ("d" if opened else ""), first, self.text(first, last)
                else:
                    if not opened:
                        yield "tail", needs + "v", first, self.text(first, last)
                    opened = True


def _as_batches(place: tuple[str, int], lines: list[str]) -> Iterator[pa.RecordBatch]:
    rows = list(_Split(lines).pieces()) if lines else []
    for at in range(0, len(rows), 5000):
        some = [(*place, *r) for r in rows[at : at + 5000]]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), kinds)], names=["file", "block", "role", "needs", "seq", "text"])


def _split_pieces(most: int):
    """A task reads whole splits one after another; it holds the lines of one chunk of ``most`` characters.

    A chunk is known by where it starts, one less than the characters before it: no more than the bytes before it, so
    chunks of a split come after its start, in order, and before the next split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place, lines, before, held = None, ("", 0), [], 0, 0
        for batch in batches:
            for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
                if (file, block) != split:
                    yield from _as_batches(place, lines)
                    split, place, lines, before, held = (file, block), (file, block), [], 0, 0
                elif held >= most:
                    yield from _as_batches(place, lines)
                    before += held
                    place, lines, held = (file, block + before - 1), [], 0
                lines.append(value)
                held += len(value) + 1
        yield from _as_batches(place, lines)

    return run


def _starts(splits: pd.DataFrame) -> pd.DataFrame:
    """Of the splits of one file: the true start (O, I or A), whether what it leaves open is damaged, and the split that opened it.

    A record left open is sound if the next split that does not lie inside it throughout closes it properly.
    """
    splits = splits.sort_values("block").reset_index(drop=True)
    kinds, out, owner = splits["needs"].tolist(), [], None
    closes, sound = [False] * (len(kinds) + 1), False
    for i in reversed(range(len(kinds))):
        sound = sound if kinds[i] == "all" else kinds[i] == _OUT
        closes[i] = sound
    for i, (kind, block) in enumerate(zip(kinds, splits["block"])):
        start = "O" if owner is None else "A" if kind == "all" else "I"
        inherited, opens = owner, splits["seq"][i] > 0 if start == "O" else start == "I" and splits["text"][i] == "open"
        if start != "A":
            owner = block if opens and closes[i + 1] else None
        out.append((splits["file"][i], block, start, bool(opens) and owner is None, inherited))
    return pd.DataFrame(out, columns=["file", "block", "start", "damaged", "owner"])


def _records(lines: DataFrame) -> DataFrame:
    """Records of all files: file, block and seq (where one starts), text. The log is read once; empty lines are no records."""
    pieces = stored(lines.select("file", "block", "value").mapInArrow(_split_pieces(CHUNK_CHARS), _PIECES), "audit-csv-pieces")
    splits = pieces.where("role = 'summary'").select("file", "block", "needs", "seq", "text")
    starts = splits.groupBy("file").applyInPandas(_starts, "file string, block long, start string, damaged boolean, owner long")
    placed = pieces.where("role != 'summary' and text != ''").join(starts, ["file", "block"])
    right_start = (F.substring("needs", 1, 1) == "*") | (F.substring("needs", 1, 1) == F.col("start"))
    right_end = F.when(F.substring("needs", 2, 1) == "d", F.col("damaged")).when(F.substring("needs", 2, 1) == "v", ~F.col("damaged")).otherwise(True)
    placed = placed.where(right_start & right_end)
    parts = placed.where("role != 'record'").withColumn("opened", F.when(F.col("role") == "tail", F.col("block")).otherwise(F.col("owner")))
    ordered = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))
    spanning = parts.groupBy("file", "opened").agg(ordered.alias("p")).select(
        "file", F.col("opened").alias("block"), F.col("p")[0]["seq"].alias("seq"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")
    )
    return placed.where("role = 'record'").select("file", "block", "seq", "text").unionByName(spanning)


def _headers(records: DataFrame) -> DataFrame:
    """The first record of every file, and its place."""
    return records.groupBy("file").agg(F.min_by("text", F.struct("block", "seq")).alias("header"), F.min(F.struct("block", "seq")).alias("at"))


def _header_names(header: str, schema: T.StructType) -> list[str]:
    """Column names in the order of a file; names beyond the schema stay, for their place."""
    names = [n.strip().lstrip("\ufeff") for n in next(csv.reader([header]))]
    if not set(names) & set(schema.fieldNames()):
        raise ValueError(f"no known column in the header: {header[:200]}")
    return names


def _parsed(records: DataFrame, names: list[str], schema: T.StructType) -> DataFrame:
    """Records of files with this header, by the schema's names; columns the files lack are null."""
    fields = [f"f{i}" for i in range(len(names))]
    text_schema = ", ".join(f"{f} string" for f in [*fields, "too_many"])
    options = {"quote": '"', "escape": '"', "nullValue": "\u0001", "emptyValue": "", "mode": "PERMISSIVE",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    rows = records.select(F.from_csv("text", F.lit(text_schema), options).alias("r")).select("r.*").filter("too_many is null")
    place = {name: f for f, name in reversed(list(zip(fields, names)))}
    return rows.select(*[(F.col(place[f.name]) if f.name in place else F.lit(None).cast("string")).alias(f.name) for f in schema.fields])


def _cast(name: str, kind: T.DataType) -> Column:
    text = F.when(F.col(name) != "", F.col(name))
    if isinstance(kind, T.BooleanType):
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(text)
    if isinstance(kind, T.IntegerType):
        return text.try_cast("double").try_cast("int")
    return text.try_cast(kind)


def read_audit_csv(spark: SparkSession, paths: list[str] | str, schema: T.StructType = AUDIT_FLAT) -> DataFrame:
    """Read flat audit logs; missing, empty and header-only files add nothing, rows with too many fields are dropped.

    The first record of a file is its header: columns are taken by name, in any order, quoted or not; a column the file lacks
    is null, a header without any known column is an error. Rows with too few fields are kept with nulls, empty fields are
    null, invalid bytes are left out. A record with an opening quote that is never closed, or closed in the middle of a field,
    loses its first line only; the next line starts a record. Files are read once, in splits, when this is called.
    """
    found = existing_paths(spark, [paths] if isinstance(paths, str) else list(paths))
    if not found:
        return spark.createDataFrame([], schema)
    records = _records(drop_corrupt_lines(_lines(spark, found)))
    headers = stored(_headers(records), "audit-csv-headers")
    layouts = [r["header"] for r in bounded_rows(headers.select("header").distinct(), MOST_LAYOUTS, "different headers")]
    if not layouts:
        return spark.createDataFrame([], schema)
    data = records.join(headers, "file").where(F.struct("block", "seq") != F.col("at"))
    parts = [_parsed(data.where(F.col("header") == header), _header_names(header, schema), schema) for header in layouts]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.select(*[_cast(f.name, f.dataType).alias(f.name) for f in schema.fields])


def read_audit_files(spark: SparkSession, groups: list[list[str]]) -> DataFrame:
    """Union of several recordings, columns aligned by name."""
    return union_audit([read_audit_csv(spark, paths) for paths in groups])


def write_audit_csv(df: DataFrame, base: str, started: str, partition_by: str | None = None) -> str:
    """Write flat rows below ``base_<start time>``; every part file has its header."""
    path = f"{base}_{started}"
    text = df.select(
        *[
            F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.format_string("%.2f", F.col(f.name)).alias(f.name)
            if f.name == "AIScore"
            else F.format_string("%.4f", F.col(f.name)).alias(f.name)
            if f.name == "RatioSpecialCharsToTotalChars"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    writer = text.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"')
    if not partition_by:
        writer.csv(path)
        return path
    # a task keeps a file open for each of a few values instead of sorting its rows by value; with more values it sorts
    conf, most = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(most)
    conf.set(most, max(int(before), OPEN_FILES))
    try:
        writer.partitionBy(partition_by).csv(path)
    finally:
        conf.set(most, before)
    return path

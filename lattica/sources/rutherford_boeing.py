"""Files of sparse matrices in Rutherford-Boeing form: peek, read, write, and a data source named rb.

A file is four header lines of 80 columns, then column pointers, row indices and values in fixed-width fields. Files are
read as text by Spark, so any store that it reaches will do. Lines are numbered by splits of the file, and fields by lines,
so that any number of tasks decode one file; a written file may be a folder of parts, which are one file in order of name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from enum import IntEnum
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import lcg
from ..matrix import MatrixType, SparseMatrix
from ..operators import convert
from ..operators.cutting import Workspace


class FileFlag(IntEnum):
    # Codes of the file routines.
    SUCCESS = 0
    BAD_FILE = -1
    NOT_RB = -2
    IO = -3
    TYPE = -4
    ELEMENT_AND_FORMAT = -5
    MATRIX_TYPE = -6
    EXTRA_SPACE = -10
    TRIANGLE = -11
    VALUES = -13
    ALLOCATION = -20
    WARN_AUXILIARY_FILE = 1


class FileError(ValueError):
    def __init__(self, flag: FileFlag, detail: str = "") -> None:
        super().__init__(f"{flag.name}: {detail}")
        self.flag = flag


# Letters of the second place of a type code.
TYPE_LETTER = {MatrixType.UNSPECIFIED: "r", MatrixType.REAL_RECT: "r", MatrixType.REAL_UNSYM: "u", MatrixType.REAL_SYM_PSDEF: "s", MatrixType.REAL_SYM_INDEF: "s", MatrixType.REAL_SKEW: "z"}
LETTER_TYPE = {"r": MatrixType.REAL_RECT, "u": MatrixType.REAL_UNSYM, "s": MatrixType.REAL_SYM_INDEF, "h": MatrixType.CPLX_HERM_INDEF, "z": MatrixType.REAL_SKEW}


@dataclass(frozen=True)
class Header:
    title: str
    identifier: str
    type_code: str
    m: int
    n: int
    elements: int
    indices: int
    values: int
    lines: tuple[int, int, int]
    formats: tuple[str, str, str]

    @property
    def matrix_type(self) -> MatrixType:
        return LETTER_TYPE[self.type_code[1]]


def parse_header(lines: list[str]) -> Header:
    if len(lines) < 3:
        raise FileError(FileFlag.IO, "no header")
    one, two, three = (x.ljust(80) for x in lines[:3])
    code = three[:3]
    if code[0] not in "rcipq" or code[1] not in "suhzr" or code[2] not in "ae":
        raise FileError(FileFlag.NOT_RB, f"type code {code!r}")
    try:
        a, b, c, d = (int(x) for x in three[14:].split()[:4])
        counts = [int(x) for x in two.split()]
    except ValueError as e:
        raise FileError(FileFlag.NOT_RB, "counts") from e
    if code[2] == "a" and d:
        raise FileError(FileFlag.NOT_RB, "the fourth count of an assembled matrix must be 0")
    formats = lines[3].ljust(52) if len(lines) > 3 else " " * 52
    size = (a, b, 0, c, c) if code[2] == "a" else (a, a, b, c, d)
    return Header(one[:72].strip(), one[72:80].strip(), code, *size, lines=tuple((counts + [0] * 4)[1:4]), formats=(formats[:16].strip(), formats[16:32].strip(), formats[32:52].strip()))


def peek(spark: SparkSession, path: str) -> Header:
    """The header alone, from the first part of the file."""
    try:
        parts = sorted(spark.read.text(path).inputFiles())
        head = spark.read.text(parts[0]).limit(4).collect() if parts else []
    except Exception as e:
        raise FileError(FileFlag.BAD_FILE, path) from e
    return parse_header([r["value"] for r in head])


def field_width(form: str) -> tuple[int, int]:
    """Fields in a line and their width, of a format such as (40i2) or (1p,3e24.16)."""
    m = re.search(r"(\d*)[iefdg](\d+)", form.lower())
    if not m:
        raise FileError(FileFlag.IO, f"format {form!r}")
    return int(m[1] or 1), int(m[2])


def decode_fields(lines: list[str], form: str, count: int) -> list[str]:
    per, width = field_width(form)
    out = [line[k * width : (k + 1) * width] for line in lines for k in range(min(per, -(-len(line.rstrip()) // width)))]
    if len(out) < count:
        raise FileError(FileFlag.IO, "too few fields")
    return out[:count]


def number(text: str) -> float:
    t = text.strip().lower().replace("d", "e")
    return float(re.sub(r"(?<=[\d.])([+-]\d+)$", r"e\1", t) if "e" not in t else t)


def decode(text: str, with_values: bool = True) -> pd.DataFrame:
    """i, j, v, pos of an assembled matrix; v is null where the file has none or none are wanted."""
    lines = text.splitlines()
    h = parse_header(lines)
    if h.type_code[2] == "e":
        raise FileError(FileFlag.ELEMENT_AND_FORMAT, "unassembled matrices are not read")
    if h.type_code[0] == "c":
        raise FileError(FileFlag.TYPE, "complex values")
    a, b, c = h.lines
    ptr = np.array([int(x) for x in decode_fields(lines[4 : 4 + a], h.formats[0], h.n + 1)], dtype=np.int64)
    rows = np.array([int(x) for x in decode_fields(lines[4 + a : 4 + a + b], h.formats[1], h.indices)], dtype=np.int64)
    v = np.full(h.indices, np.nan)
    if with_values and h.type_code[0] in "ri":
        v = np.array([number(x) for x in decode_fields(lines[4 + a + b : 4 + a + b + c], h.formats[2], h.indices)])
    return pd.DataFrame({"i": rows, "j": np.repeat(np.arange(1, h.n + 1), np.diff(ptr)), "v": v, "pos": np.arange(1, h.indices + 1)})


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """at, value: the lines of a file, or of a folder of parts, numbered from 0; and how many there are.

    A split is read by one task from its start to its end, so that ids that grow within tasks number its lines; the driver adds
    up the lengths of the splits, of which there is one for each 128 MB or less.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("part", "start").agg(F.count("*").alias("c"), F.min("id").alias("least")).orderBy("part", "start").collect()
    total = sum(x["c"] for x in splits)
    bases = np.cumsum([0, *(x["c"] for x in splits)])
    known = spark.createDataFrame([(x["part"], x["start"], int(b) - x["least"]) for x, b in zip(splits, bases, strict=False)], "part string, start long, shift long")
    return lines.join(F.broadcast(known), ["part", "start"]).select((F.col("id") + F.col("shift")).alias("at"), "value"), total


def fields_of(lines: DataFrame, first: int, last: int, form: str, count: int) -> DataFrame:
    """k, field: the fields of lines first to last, numbered from 1; all lines of a section but its last are full."""
    per, width = field_width(form)
    cells = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda k: F.trim(F.substring(F.col("value"), k * width + 1, F.lit(width))))
    found = lines.where((F.col("at") >= first) & (F.col("at") < last)).select("at", F.posexplode(cells).alias("place", "field"))
    return found.select(((F.col("at") - first) * per + F.col("place") + 1).alias("k"), "field").where(F.col("k") <= count)


def number_of(field: Column) -> Column:
    """The value of a real field: an exponent may be marked by d, or by its sign alone."""
    t = F.regexp_replace(F.lower(field), "d", "e")
    return F.when(t.contains("e"), t).otherwise(F.regexp_replace(t, r"(?<=[0-9.])([+-][0-9]+)$", "e$1")).cast("double")


def with_columns(fields: DataFrame, pointers: DataFrame, block: int = 4096) -> DataFrame:
    """fields (pos, ...) with the column j that each stands in, by pointers (j, ptr), of which the last one ends the matrix.

    Each block of positions hears where the columns in it begin, and which column goes on at its start; a sweep over the block
    tells each position its column. A long column is told to each of its blocks, and many tasks sweep it.
    """
    ends = pointers.select((F.col("j") - 1).alias("j"), F.col("ptr").alias("end"))
    spans = pointers.join(ends, "j").where("ptr < end")
    begun = spans.select("j", "ptr", F.explode(F.sequence(F.floor(F.col("ptr") / block), F.floor((F.col("end") - 1) / block))).alias("b"))
    begun = begun.select("b", F.greatest("ptr", F.col("b") * block).alias("pos"), F.lit(0).alias("order"), "j")
    rest = [F.col(c) for c in fields.columns if c != "pos"]
    told = fields.select(F.floor(F.col("pos") / block).alias("b"), "pos", F.lit(1).alias("order"), F.lit(None).cast("long").alias("j"), *rest)
    swept = begun.unionByName(told, allowMissingColumns=True).withColumn("j", F.last("j", True).over(W.partitionBy("b").orderBy("pos", "order")))
    return swept.where("order = 1").select("j", "pos", *rest)


def entries_of(spark: SparkSession, path: str, h: Header, with_values: bool) -> DataFrame:
    """i, j, v, pos of an assembled matrix; v is null where the file has none or none are wanted."""
    lines, total = numbered_lines(spark, path)
    a, b, c = h.lines
    with_values = with_values and h.type_code[0] in "ri"
    short = a * field_width(h.formats[0])[0] < h.n + 1 or (h.indices and b * field_width(h.formats[1])[0] < h.indices)
    if with_values and h.indices:
        short = short or c * field_width(h.formats[2])[0] < h.indices
    if short or (h.indices and total < 4 + a + b + (c if with_values else 0)) or total < 4 + a:
        raise FileError(FileFlag.IO, "too few fields")
    pointers = fields_of(lines, 4, 4 + a, h.formats[0], h.n + 1).select(F.col("k").alias("j"), F.col("field").cast("long").alias("ptr"))
    rows = fields_of(lines, 4 + a, 4 + a + b, h.formats[1] if h.indices else "(1i1)", h.indices).select(F.col("k").alias("pos"), F.col("field").cast("long").alias("i"))
    if with_values and h.indices:
        rows = rows.join(fields_of(lines, 4 + a + b, 4 + a + b + c, h.formats[2], h.indices).select(F.col("k").alias("pos"), number_of(F.col("field")).alias("v")), "pos")
    else:
        rows = rows.withColumn("v", F.lit(None).cast("double"))
    return with_columns(rows, pointers).select("i", "j", "v", "pos")


@dataclass(frozen=True)
class ReadOptions:
    add_diagonal: bool = False
    triangle: int = 1  # 1 lower, 2 upper, 3 full
    values: int = 0  # 0 those of the file, 1 pattern only, 2 random, 3 random and diagonally dominant, 4 random and unsymmetric; below 0: always made
    extra_space: float = 1.0


def read(spark: SparkSession, path: str, options: ReadOptions = ReadOptions(), state: lcg.RandomState | None = None) -> tuple[SparseMatrix, Header, FileFlag]:
    """The matrix of an assembled file. Values that the file lacks, or all with values < 0, are drawn in column order."""
    if options.extra_space < 1:
        raise FileError(FileFlag.EXTRA_SPACE)
    if options.triangle not in (1, 2, 3):
        raise FileError(FileFlag.TRIANGLE)
    if not -4 <= options.values <= 4 or options.values == -1:
        raise FileError(FileFlag.VALUES)
    h = peek(spark, path)
    if h.type_code[2] == "e":
        raise FileError(FileFlag.ELEMENT_AND_FORMAT, "unassembled matrices are not read")
    if h.type_code[0] == "c":
        raise FileError(FileFlag.TYPE, "complex values")
    use = options.values >= 0 and options.values != 1 and h.type_code[0] in "ri"

    df = entries_of(spark, path, h, use)
    kind, m, n = h.matrix_type, h.m, h.n
    symmetric, size = kind.lower_only, abs(options.values)
    if options.add_diagonal or (symmetric and not use and size == 3):
        lost = convert.add_missing_diagonal(df.select("i", "j", "v"), m, n).join(df.select("i", "j"), ["i", "j"], "left_anti")
        df = df.unionByName(lost.select("i", "j", F.lit(0.0 if use else None).cast("double").alias("v"), F.lit(2**40).alias("pos")))
    expanded = False
    made = not use and (options.values < 0 or options.values >= 2)
    if made:
        if size == 4 and symmetric and options.triangle == 3:
            df = df.unionByName(df.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v", (F.col("pos") + 2**41).alias("pos")))
            expanded = True
        df = _synthetic(df.select("i", "j", "pos"), n, size == 3 and symmetric, state or lcg.RandomState())
    elif not use:
        df = df.withColumn("v", F.lit(None).cast("double"))
    df = df.select("i", "j", "v")
    if symmetric and options.triangle == 2:
        df = convert.flip_triangle(df)
        df = convert.symmetric_to_skew(df) if kind.skew else df
    elif symmetric and options.triangle == 3 and not expanded:
        df = convert.half_to_full(df, kind.skew)
    matrix = SparseMatrix(df, m, n, kind)
    return matrix, h, FileFlag.WARN_AUXILIARY_FILE if h.type_code[0] == "q" else FileFlag.SUCCESS


def _synthetic(df: DataFrame, n: int, dominant: bool, state: lcg.RandomState) -> DataFrame:
    """Values in column order: the k-th entry takes the k-th draw. A dominant diagonal counts what stands in its row and column."""
    # pos takes the place of i, as added entries of a column come after those of the file
    order = convert.positions(df.select(F.col("pos").alias("i"), "j", F.col("i").alias("row")), n).select(F.col("row").alias("i"), "j", F.col("pos").alias("k"))
    out = order.select("i", "j", lcg.as_real(lcg.state(F.col("k"), state.seed)).alias("v"), "k")
    state.jump(df.count())
    if not dominant:
        return out
    column = out.groupBy(F.col("j").alias("d")).agg(F.count("*").alias("c"))
    row = out.where("j < i").groupBy(F.col("i").alias("d")).agg(F.count("*").alias("r"))
    near = column.join(row, "d", "left")
    joined = out.join(near, out["j"] == near["d"], "left")
    return joined.select("i", "j", F.when(F.col("i") == F.col("j"), F.greatest(F.lit(100.0), 10.0 * (F.col("c") + F.coalesce("r", F.lit(0))))).otherwise(F.col("v")).alias("v"))


def real_field(x: float, width: int = 24, digits: int = 16) -> str:
    """x with a mantissa below 1, as such files write it."""
    if x == 0:
        return f"0.{'0' * digits}E+00".rjust(width)
    mantissa, exponent = f"{abs(x):.{digits - 1}e}".split("e")
    e = int(exponent) + 1
    return f"{'-' if x < 0 else ''}0.{mantissa.replace('.', '')}E{e:+03d}".rjust(width)


def lines_of(fields: list[str], per: int) -> list[str]:
    return ["".join(fields[k : k + per]) for k in range(0, len(fields), per)]


def layout(m: int, n: int, entries: int, wp: int, wr: int, with_values: bool) -> Header:
    """What a header says of fields of widths wp and wr; an empty section of entries is one empty line."""
    a, b = -(-(n + 1) // (80 // wp)), max(1, -(-entries // (80 // wr)))
    c = max(1, -(-entries // 3)) if with_values else 0
    return Header("", "", "", m, n, 0, entries, entries, (a, b, c), (f"({80 // wp}i{wp})", f"({80 // wr}i{wr})", "(3e24.16)"))


def header_lines(h: Header, type: MatrixType, with_values: bool, title: str, identifier: str) -> list[str]:
    code = ("r" if with_values else "p") + TYPE_LETTER[type] + "a"
    counts = (sum(h.lines), *h.lines)
    return [f"{title[:72]:<72}{identifier[:8]:<8}", " ".join([f"{counts[0]:>14}", *(f"{x:>13}" for x in counts[1:])]), f"{code:<14}" + " ".join([f"{h.m:>14}", *(f"{x:>13}" for x in (h.n, h.indices, 0))]), f"{h.formats[0]:<16}{h.formats[1]:<16}{h.formats[2]:<20}"]


def encode(i: np.ndarray, j: np.ndarray, v: np.ndarray | None, m: int, n: int, type: MatrixType, title: str = "Matrix", identifier: str = "0") -> str:
    """The text of a file; entries in column order."""
    if type < 0 or type == 5:
        raise FileError(FileFlag.MATRIX_TYPE)
    ptr = np.append(1, 1 + np.cumsum(np.bincount(j - 1, minlength=n)[:n]))
    width = lambda x: len(str(int(x))) + 1
    wp, wr = width(ptr.max()), width(i.max() if len(i) else 1)
    pointers = lines_of([f"{x:>{wp}}" for x in ptr], 80 // wp)
    rows = lines_of([f"{x:>{wr}}" for x in i], 80 // wr) or [""]
    values = (lines_of([real_field(float(x)) for x in v], 3) or [""]) if v is not None else []
    head = header_lines(layout(m, n, len(i), wp, wr, v is not None), type, v is not None, title, identifier)
    return "\n".join([*head, *pointers, *rows, *values]) + "\n"


def in_column_order(entries: DataFrame, space: Workspace) -> DataFrame:
    """entries with pos, by one range shuffle: what a task got is numbered from where the task before it ended. Long columns are cut too."""
    ranged = space.keep(entries.repartitionByRange("j", "i").sortWithinPartitions("j", "i").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")))
    held = ranged.groupBy("part").agg(F.count("*").alias("c"), F.min("id").alias("least")).orderBy("part").collect()  # a row a task
    bases = np.cumsum([1, *(x["c"] for x in held)])
    known = entries.sparkSession.createDataFrame([(x["part"], int(b) - x["least"]) for x, b in zip(held, bases, strict=False)], "part int, shift long")
    return ranged.join(F.broadcast(known), "part").select(*entries.columns, (F.col("id") + F.col("shift")).alias("pos"))


def joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of fields (at, k, field) that come in order: fields of a line follow each other in memory, so a line is a slice of it."""
    left = None
    for batch in batches:
        rows = pa.Table.from_batches([batch.select(["at", "field"])])
        if left is not None:
            rows = pa.concat_tables([left, rows])
        at = rows.column("at").to_numpy()
        first = np.flatnonzero(np.diff(at, prepend=-1))
        if len(first):
            yield _slices(rows, first)
            left = rows.slice(first[-1])  # may go on in the next batch
    if left is not None:
        yield _slices(left, np.array([0, left.num_rows]))


def _slices(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
    """A line for each two that follow each other in ends."""
    fields = pa.concat_arrays(rows.slice(0, ends[-1]).column("field").cast(pa.large_string()).chunks) if ends[-1] else pa.array([], pa.large_string())
    offsets = np.frombuffer(fields.buffers()[1], dtype=np.int64)[fields.offset : fields.offset + len(fields) + 1] if len(fields) else np.zeros(1, dtype=np.int64)
    text = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(offsets[ends].copy()), fields.buffers()[2] if len(fields) else pa.py_buffer(b""))
    return pa.RecordBatch.from_arrays([text.cast(pa.string())], ["value"])


def write(matrix: SparseMatrix, path: str, with_values: bool = True, title: str = "Matrix", identifier: str = "0", least_parts: int = 1) -> None:
    """The lines of one file in the folder path, as parts that follow each other in order of name.

    Entries are numbered by a range shuffle, and their fields meet in the part of their line, one task a part of 100,000 lines or
    less. `cat part-*` makes one file of them, which a small matrix is already.
    """
    m, n, type, spark = matrix.m, matrix.n, matrix.type, matrix.spark
    if type < 0 or type == 5:
        raise FileError(FileFlag.MATRIX_TYPE)
    space = Workspace(spark)
    kept = space.keep(matrix.entries.select("i", "j", "v").where("i > 0"))
    size = kept.agg(F.count("*").alias("c"), F.max("i").alias("i")).first()
    wp, wr = len(str(size["c"] + 1)) + 1, len(str(size["i"] or 1)) + 1
    shape = layout(m, n, size["c"], wp, wr, with_values)
    a, b, c = shape.lines
    placed = in_column_order(kept, space)

    def fields(df: DataFrame, k: str, field: Column, per: int, first: int) -> DataFrame:
        return df.select((F.floor((F.col(k) - 1) / per) + first).cast("long").alias("at"), F.col(k).cast("long").alias("k"), field.alias("field"))

    padded = lambda x, width: F.lpad(F.col(x).cast("string"), width, " ")
    lines = fields(convert.column_pointers(kept, n), "j", padded("ptr", wp), 80 // wp, 4)
    lines = lines.unionByName(fields(placed, "pos", padded("i", wr), 80 // wr, 4 + a))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"pos": x.pos, "field": [real_field(v) for v in x.v.tolist()]})

    if with_values:
        lines = lines.unionByName(fields(placed.select("pos", "v").mapInPandas(run, "pos long, field string"), "pos", F.col("field"), 3, 4 + a + b))
    single = [(at, 0, text) for at, text in enumerate(header_lines(shape, type, with_values, title, identifier))]
    if not size["c"]:  # an empty section is one empty line
        single += [(4 + a, 0, ""), *([(4 + a + b, 0, "")] if with_values else [])]
    lines = lines.unionByName(spark.createDataFrame(single, "at long, k long, field string"))
    total = 4 + a + b + c
    parts = min(max(least_parts, -(-total // 100_000)), 99_999)  # names of five digits keep their order
    part = F.when(F.col("at") < 4, 0).otherwise(F.floor(F.col("at") * parts / total)).cast("int")  # the header is not cut
    lines.repartitionById(parts, part).sortWithinPartitions("at", "k").mapInArrow(joined_lines, "value string").write.mode("overwrite").text(path)
    space.free()


class RutherfordBoeing(DataSource):
    """spark.read.format("rb").load(path): i, j, v, pos of a file on a mounted path, in tasks of `entries` positions.

    Writing takes i, j, v and the options m, n, type, and makes the text where the write is committed: for small matrices; write() is
    for others.
    """

    @classmethod
    def name(cls) -> str:
        return "rb"

    def schema(self) -> str:
        return "i long, j long, v double, pos long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("entries", 250_000)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


@dataclass(frozen=True)
class FieldRange:
    """A section of count fields of one width, from a byte offset of the file on, in lines of per fields that end in eol bytes."""

    start: int
    per: int
    width: int
    eol: int
    count: int

    def place(self, k: int) -> int:
        """The byte at which field k, from 0, begins; a field at the start of a line follows the last line's end."""
        return self.start + k * self.width + k // self.per * self.eol

    @property
    def end(self) -> int:
        lines = max(1, -(-self.count // self.per))  # an empty section is one empty line
        return self.start + self.count * self.width + lines * self.eol

    def read(self, f: BinaryIO, first: int, last: int) -> list[bytes]:
        """Fields first to last - 1."""
        if first >= last:
            return []
        origin = self.place(first)
        f.seek(origin)
        text = f.read(self.place(last - 1) + self.width - origin)
        return [text[(at := self.place(k) - origin) : at + self.width] for k in range(first, last)]


@dataclass(frozen=True)
class FileMap:
    """Where the pointers, rows and values of a file stand, if all its lines are as wide as its header says."""

    header: Header
    pointers: FieldRange
    rows: FieldRange
    values: FieldRange | None

    @classmethod
    def of(cls, path: str) -> FileMap | None:
        with open(path, "rb") as f:
            head = [f.readline() for _ in range(4)]
            start, size = f.tell(), f.seek(0, 2)
        h = parse_header([x.decode().rstrip("\r\n") for x in head])
        if h.type_code[2] == "e" or h.type_code[0] == "c":
            return None  # decode() says why
        eol = 2 if head[3].endswith(b"\r\n") else 1
        pointers = FieldRange(start, *field_width(h.formats[0]), eol, h.n + 1)
        rows = FieldRange(pointers.end, *field_width(h.formats[1]), eol, h.indices)
        values = FieldRange(rows.end, *field_width(h.formats[2]), eol, h.indices) if h.type_code[0] in "ri" else None
        ends = (values or rows).end
        return cls(h, pointers, rows, values) if ends - eol <= size <= ends else None

    def entries(self, path: str, first: int, last: int) -> Iterator[tuple[int, int, float | None, int]]:
        """i, j, v, pos of positions first to last - 1, from 0. The column of the first is sought by halving among the pointers."""
        with open(path, "rb") as f:
            low, high = 0, self.header.n
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if int(self.pointers.read(f, middle, middle + 1)[0]) - 1 <= first else (low, middle)
            rows = self.rows.read(f, first, last)
            values = self.values.read(f, first, last) if self.values else [None] * len(rows)
            ends: list[bytes] = []
            j, end, ahead = low, -1, low + 1
            for k, (i, v) in enumerate(zip(rows, values, strict=True)):
                while end <= first + k:
                    if not ends:
                        ends = self.pointers.read(f, ahead, min(ahead + 4096, self.header.n + 1))[::-1]
                        ahead += len(ends)
                    j, end = j + 1, int(ends.pop()) - 1
                yield int(i), j, None if v is None else number(v.decode()), first + k + 1


class _Positions(InputPartition):
    def __init__(self, first: int, last: int, known: FileMap | None) -> None:
        self.first, self.last, self.known = first, last, known


class _Reader(DataSourceReader):
    """Ranges of positions, each read by one task by the bytes at which its fields stand; a file of uneven lines is one task."""

    def __init__(self, path: str, entries: int) -> None:
        self.path, self.size = path, entries

    def partitions(self) -> list[InputPartition]:
        known = FileMap.of(self.path)
        if known is None:
            return [_Positions(0, 0, None)]
        return [_Positions(k, min(k + self.size, known.header.indices), known) for k in range(0, max(known.header.indices, 1), self.size)]

    def read(self, partition: InputPartition):
        if partition.known is not None:
            yield from partition.known.entries(self.path, partition.first, partition.last)
            return
        with open(self.path) as f:
            frame = decode(f.read())
        for i, j, v, pos in frame.itertuples(index=False):
            yield int(i), int(j), None if v != v else float(v), int(pos)


@dataclass
class _Message(WriterCommitMessage):
    rows: list


class _Writer(DataSourceWriter):
    """Tasks hand their entries to the commit, which writes the one file."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def write(self, iterator) -> WriterCommitMessage:
        return _Message([(r["i"], r["j"], r["v"]) for r in iterator])

    def commit(self, messages) -> None:
        rows = sorted((x for m in messages if m for x in m.rows), key=lambda x: (x[1], x[0]))
        i, j, v = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, int),) * 3
        o = self.options
        with open(o["path"], "w") as f:
            f.write(encode(i, j, v, int(o["m"]), int(o["n"]), MatrixType(int(o.get("type", 0))), o.get("title", "Matrix"), o.get("identifier", "0")))

    def abort(self, messages) -> None:
        pass

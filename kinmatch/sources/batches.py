"""Batch files for the upsert: delimited, JSON, Parquet and spreadsheet folders.

All values come as text. Column names are lower-cased and trimmed. ``row_no`` counts the
rows of a file from 2, the first row below the header, as a spreadsheet shows it. Files of one
folder may have other columns, in another order: delimited files are read by their own header,
``present`` says which columns a row's file had, and files that can't be used are told apart.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

REQUIRED = ("project_code", "project_name")
FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".xlsx": "xlsx"}
# Cell texts a spreadsheet reader takes as empty (the pandas defaults).
EMPTY_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


class BatchError(ValueError):
    """The batch as a whole cannot be used."""


def check_required(columns: Sequence[str], required: Sequence[str] = REQUIRED) -> None:
    missing = [c for c in required if c not in columns]
    if missing:
        raise BatchError(f"required columns are missing: {', '.join(missing)}")


def read_batch(
    spark: SparkSession, path: str, suffix: str, required: Sequence[str] = REQUIRED
) -> DataFrame:
    """A file or folder of files: text columns plus ``file``, ``row_no``; csv also ``present``.

    Raises BatchError where nothing can be used. Of a csv folder the usable files are read;
    ``read_delimited`` also tells why others aren't.
    """
    kind = FORMATS.get(suffix.lower())
    if kind is None:
        raise BatchError(f"unsupported file type: {suffix}")
    _check_exists(spark, path)
    if kind == "xlsx":
        return read_workbooks(spark, path)
    if kind == "csv":
        rows, problems = read_delimited(spark, path, required)
        if rows is None:
            said = [f"{r.file}: {r.problem}" for r in problems.orderBy("file").limit(10).collect()]
            raise BatchError("; ".join(said) or f"no files: {path}")
        return rows
    reader = spark.read
    df = reader.option("primitivesAsString", True).json(path) if kind == "json" else reader.parquet(path)
    names = [c.lower().strip() for c in df.columns]
    check_required(names, required)
    texts = df.select(
        *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(df.columns, names)],
        F.col("_metadata.file_path").alias("file"),
    )
    return with_row_numbers(texts, "file")


# --- delimited files ----------------------------------------------------------------


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, folded) per file: its first line, and whether a cell holds a line break.

    A line with an odd number of quotes opens a cell that goes on in the next line. Files
    without a line have a NULL header. One pass over the lines; counts combine before the
    shuffle, and a file may be cut into any number of splits.
    """
    text = spark.read.text(path)
    # the listing also has files without a byte; it writes a scheme without host as file:///
    names = [(re.sub(r"^(\w+):///", r"\1:/", f),) for f in text.inputFiles()]
    files = spark.createDataFrame(names, "file string")
    lines = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("place"),
        "value",
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    first = lines.groupBy("file").agg(
        F.min_by("value", "place").alias("header"), F.bool_or(quotes % 2 == 1).alias("folded")
    )
    return files.join(first, "file", "left")


def _as_path(uri: str) -> str:
    """What a reader takes for exactly this file."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(uri))


def _names_of(header: str | None) -> list[str]:
    cells = next(csv.reader([(header or "").removeprefix("\ufeff")]), [])
    return [c.lower().strip() for c in cells]


def _header_problem(names: Sequence[str], required: Sequence[str]) -> str | None:
    named = [n for n in names if n]
    if not named:
        return "no header"
    repeated = sorted({n for n in named if named.count(n) > 1})
    if repeated:
        return f"columns are named twice: {', '.join(repeated)}"
    try:
        check_required(named, required)
    except BatchError as problem:
        return str(problem)
    return None


def read_delimited(
    spark: SparkSession, path: str, required: Sequence[str] = REQUIRED
) -> tuple[DataFrame | None, DataFrame]:
    """(rows of the usable files, (file, problem) of the others); no usable file gives None.

    Files are grouped by their header, and each group is read with the names of its own
    columns; only groups with line breaks inside cells are read a file a task. The list of
    files is held on the driver, as Spark's own listing is.
    """
    groups: dict[tuple, list[str]] = {}
    problems = []
    for row in file_headers(spark, path).collect():
        names = _names_of(row.header)
        problem = _header_problem(names, required)
        if problem:
            problems.append((row.file, problem))
        else:
            groups.setdefault((tuple(names), row.folded), []).append(row.file)
    rows = None
    for (names, folded), files in sorted(groups.items()):
        # a column without a name is read and left out
        places = [n or f"\0{i}" for i, n in enumerate(names)]
        schema = StructType([StructField(n, StringType()) for n in places])
        table = (
            spark.read.schema(schema).option("header", True).option("enforceSchema", True)
            .option("multiLine", folded).option("escape", '"').csv([_as_path(f) for f in files])
        )
        kept = [n for n in names if n]
        texts = table.select(*[F.col(f"`{n}`") for n in kept], F.col("_metadata.file_path").alias("file"))
        part = with_row_numbers(texts, "file").withColumn("present", F.array(*[F.lit(n) for n in kept]))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows, spark.createDataFrame(problems, "file string, problem string")


def _check_exists(spark: SparkSession, path: str) -> None:
    try:
        empty = spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException as problem:
        raise BatchError(f"file not found: {path}") from problem
    if empty:
        raise BatchError(f"file not found: {path}")


def with_row_numbers(df: DataFrame, file_col: str, first: int = 2) -> DataFrame:
    """Number the rows of each file in order, without bringing a file to one task.

    Rows are counted per (file, task); the counts of the tasks before give the start.
    """
    marked = df.withColumn("_id", F.monotonically_increasing_id()).withColumns(
        {"_task": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)}
    )
    earlier = (
        Window.partitionBy(file_col).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        marked.groupBy(file_col, "_task")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
        .select(
            file_col, "_task", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
        )
    )
    number = F.col("_start") + F.col("_place") - F.col("_first") + first
    return (
        marked.join(starts, [file_col, "_task"])
        .withColumn("row_no", number)
        .select(*df.columns, "row_no")
    )


# --- spreadsheets -------------------------------------------------------------------

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of each workbook: (file, row_no, cells map<string,string>, problem).

    A workbook is one compressed file of at most 2^20 rows, so it is one unit of work;
    a folder of them is read in parallel. A cell of the map is NULL when empty and
    missing when its file lacks the column. Unreadable files give one row with ``problem``.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files_pdf in batches:
            for name, content in zip(files_pdf["path"], files_pdf["content"]):
                yield from _workbook_rows(name, content)

    return files.mapInPandas(
        read, "file string, row_no long, cells map<string,string>, problem string"
    )


def _workbook_rows(name: str, content: bytes, rows_per_batch: int = 5000):
    def frame(rows, problem=None):
        return pd.DataFrame(
            {
                "file": name,
                "row_no": [r for r, _ in rows],
                "cells": [c for _, c in rows],
                "problem": problem,
            }
        )

    try:
        sheet = _first_sheet(io.BytesIO(content))
        header = None
        rows = []
        for number, cells in sheet:
            if header is None:
                header = {i: str(v or "").lower().strip() for i, v in cells.items()}
                header = {i: v for i, v in header.items() if v}
                continue
            texts = {h: cells.get(i) for i, h in header.items()}
            rows.append((number, {h: None if v in EMPTY_CELLS else v for h, v in texts.items()}))
            if len(rows) == rows_per_batch:
                yield frame(rows)
                rows = []
        if rows:
            yield frame(rows)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration) as error:
        yield frame([(0, None)], f"unreadable workbook: {error}")


def _first_sheet(source) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number, {column index: text}) of the first sheet, up to its last filled row."""
    with zipfile.ZipFile(source) as book:
        tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
        rel_id = tree.find(f"{_MAIN}sheets")[0].get(f"{_REL}id")
        rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == rel_id)
        target = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared = _shared_texts(book)
        date_styles = _date_styles(book)
        expected = None
        with book.open(target) as xml:
            for _, row in ElementTree.iterparse(xml):
                if row.tag != f"{_MAIN}row":
                    continue
                cells = {}
                for place, cell in enumerate(row.findall(f"{_MAIN}c")):
                    cells[_column_index(cell.get("r"), place)] = _cell_text(
                        cell, shared, date_styles
                    )
                number = int(row.get("r") or (expected or 1))
                row.clear()
                if all(v in (None, "") for v in cells.values()):
                    continue
                # empty rows between filled ones count as rows
                for gap in range(expected or number, number):
                    yield gap, {}
                yield number, cells
                expected = number + 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    tree = ElementTree.fromstring(book.read("xl/styles.xml"))
    # built-in date formats, then custom ones with a year, month or day code
    dates = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
    for custom in tree.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get("formatCode", ""))
        if re.search("[ymdYMD]", code):
            dates.add(int(custom.get("numFmtId")))
    styles = tree.find(f"{_MAIN}cellXfs")
    return {
        i for i, style in enumerate(styles if styles is not None else [])
        if int(style.get("numFmtId", 0)) in dates
    }


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    tree = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in tree]


def _column_index(reference: str | None, place: int) -> int:
    if not reference:
        return place
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _cell_text(cell, shared: list[str], date_styles: set[int]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind in (None, "n") and int(cell.get("s", 0)) in date_styles:
        days = pd.to_timedelta(float(value.text), unit="D").round("s")
        return str(pd.Timestamp("1899-12-30") + days)
    return value.text


def _missing(required: Sequence[str]) -> Column:
    return F.array_except(F.array(*[F.lit(c) for c in required]), F.map_keys("cells"))


def workbook_columns(
    cells: DataFrame, fields: Sequence[str], required: Sequence[str] = REQUIRED
) -> DataFrame:
    """``read_workbooks`` rows as text columns plus ``present``, the columns of their file.

    Workbooks that ``workbook_problems`` reports give no rows.
    """
    usable = F.col("problem").isNull() & (F.size(_missing(required)) == 0)
    return cells.filter(usable).select(
        "file",
        "row_no",
        *[F.try_element_at("cells", F.lit(f)).alias(f) for f in fields],
        F.map_keys("cells").alias("present"),
    )


def workbook_problems(cells: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """(file, problem) of workbooks that are unreadable or lack required columns."""
    missing = _missing(required)
    lacks = F.when(
        F.size(missing) > 0,
        F.concat(F.lit("required columns are missing: "), F.array_join(missing, ", ")),
    )
    return (
        cells.select("file", F.coalesce("problem", lacks).alias("problem"))
        .filter(F.col("problem").isNotNull())
        .distinct()
    )

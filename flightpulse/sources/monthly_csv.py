"""Reader for the monthly flight files.

A file is ``;``-separated UTF-8 text with one preamble line before the header;
its name carries the reference month. Files may order their columns
differently or carry extra ones.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..vocabulary import (
    DROPPED_SOURCE_COLUMN,
    MONTHLY_FILE_GLOB,
    MONTHLY_FILE_PATTERN,
    NA_TOKENS,
    SOURCE_COLUMNS,
    TIMESTAMP_COLUMNS,
)

# Shape of a timestamp text; the cast below checks the calendar.
_TIMESTAMP_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
# One field of a raw line: quoted, with doubled quotes inside, or plain.
_FIELD = r'(?:^|;)(?:"(?:[^"]|"")*+"[^;]*|[^";][^;]*)?'
# What a line without text consists of: control characters and blanks.
_BLANK = "".join(map(chr, range(33)))
_SOME_TEXT = r"[^\\x00-\\x20]"  # in a SQL literal
# Larger than any file, and small enough that the sum over many files is still a long.
_WHOLE_FILES = 1 << 44


def month_of_file(path: str) -> str:
    """``yyyy-MM`` from a file name."""
    found = re.search(MONTHLY_FILE_PATTERN, path)
    if found is None:
        raise ValueError(f"not a monthly file name: {path}")
    year, month = found.groups()
    return f"{year}-{int(month):02d}"


def list_monthly_files(spark: SparkSession, directory: str) -> list[str]:
    """Paths of the monthly files, oldest first. Only the listing is read, no content."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", MONTHLY_FILE_GLOB)
        .load(directory)
        .select("path")
        .collect()
    )
    if not found:
        raise FileNotFoundError(f"no {MONTHLY_FILE_GLOB} in {directory}")
    return sorted((row.path for row in found), key=lambda path: (month_of_file(path), path))


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The header line of the one file that a task reads; nothing more of the file is asked for."""
    number, empty = 0, True
    for batch in batches:
        for line, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if number and line.strip(_BLANK):
                yield pa.RecordBatch.from_pydict({"path": [path], "empty": [empty], "header": [line]})
                return
            empty = empty and not line
            number += 1


def read_beginnings(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[tuple[str, ...], bool]]:
    """Fields of each file's header line, and whether all lines before it are empty; keyed by path.

    The header is the first line with text after the first line. One job for any number of files: a
    session of its own reads each file as one split, and a task stops at the header, a few lines on.
    """
    own = spark.newSession()
    for name, value in {
        "spark.sql.files.maxPartitionBytes": _WHOLE_FILES,
        "spark.sql.files.openCostInBytes": _WHOLE_FILES,
        "spark.sql.files.maxPartitionNum": (1 << 31) - 1,
        "spark.sql.execution.arrow.maxRecordsPerBatch": 16,
    }.items():
        own.conf.set(name, str(value))
    lines = own.read.text(list(paths)).select("value", "_metadata.file_path")
    found = lines.mapInArrow(_beginnings, "path string, empty boolean, header string").collect()
    return {row.path: (tuple(next(csv.reader([row.header], delimiter=";"))), row.empty) for row in found}


def column_names(fields: Sequence[str]) -> tuple[str, ...]:
    """Distinct column names: a repeated or empty field gets its count or place."""
    names: list[str] = []
    for position, name in enumerate(fields):
        name = name or f"Unnamed: {position}"
        repeats = sum(1 for known in names if known == name or known.startswith(f"{name}."))
        names.append(f"{name}.{repeats}" if name in names else name)
    return tuple(names)


def read_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of one file."""
    ((fields, _),) = read_beginnings(spark, [path]).values()
    return column_names(fields)


def parse_timestamp(text: Column) -> Column:
    """TIMESTAMP_NTZ from ``yyyy-M-d H:m:s`` text; null for anything else.

    A cast instead of a pattern-based parse: it does not depend on the
    session's timestamp type or time zone.
    """
    return F.when(text.rlike(_TIMESTAMP_SHAPE), text.try_cast("timestamp_ntz"))


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(column: str) -> str:
    """A quoted SQL identifier."""
    return "`" + column.replace("`", "``") + "`"


def month_of_name(file_name: str) -> str:
    """SQL of ``yyyy-MM`` from a SQL expression for a file name."""
    year, month = (f"regexp_extract({file_name}, {_text(MONTHLY_FILE_PATTERN)}, {n})" for n in (1, 2))
    return f"concat({year}, '-', lpad({month}, 2, '0'))"


def named_rows(
    rows: DataFrame,
    columns: dict[str, str],
    month: str,
    na_tokens: Sequence[str] = NA_TOKENS,
) -> DataFrame:
    """Text fields under their column names, missing-value texts as null, and ``ref_month``.

    ``columns`` maps fields of ``rows`` to names; ``month`` is SQL.
    """
    missing = ", ".join(_text(token) for token in na_tokens) or "NULL"
    return rows.selectExpr(
        *[
            f"CASE WHEN {_name(field)} IN ({missing}) THEN NULL ELSE {_name(field)} END AS {_name(column)}"
            for field, column in columns.items()
        ],
        f"{month} AS ref_month",
    )


def flights_of_named_rows(parts: Sequence[DataFrame], checks: Observation | None = None) -> DataFrame:
    """Flights from parts whose columns differ in order and kind, matched by name.

    ``checks`` is filled by whatever action runs over the flights, without a
    scan of its own: ``rows``, ``refused_`` a time column (text that is no
    time), ``missing_`` any other known column.
    """
    known = {name for part in parts for name in part.columns}
    missing = [
        name for name in (*SOURCE_COLUMNS.values(), DROPPED_SOURCE_COLUMN) if name not in known
    ]
    if missing:
        raise ValueError(f"columns missing from the monthly files: {missing}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    flights = rows.drop(F.col(_name(DROPPED_SOURCE_COLUMN))).withColumnsRenamed(
        {name: ours for ours, name in SOURCE_COLUMNS.items()}
    )
    times = {name: parse_timestamp(F.col(name)) for name in TIMESTAMP_COLUMNS}
    if checks is None:
        return flights.withColumns(times)
    refused = {name: F.count_if(F.col(name).isNotNull() & F.col(f"_time_{name}").isNull()) for name in TIMESTAMP_COLUMNS}
    absent = {name: F.count_if(F.col(name).isNull()) for name in SOURCE_COLUMNS if name not in TIMESTAMP_COLUMNS}
    observed = flights.withColumns({f"_time_{name}": time for name, time in times.items()}).observe(
        checks,
        F.count(F.lit(1)).alias("rows"),
        *[value.alias(f"refused_{name}") for name, value in refused.items()],
        *[value.alias(f"missing_{name}") for name, value in absent.items()],
    )
    return observed.select(
        *[F.col(f"_time_{name}").alias(name) if name in times else F.col(_name(name)) for name in flights.columns]
    )


def _without_header(from_line: bool):
    """Passes on what follows the header of each file, and nothing else of the beginning.

    A batch's last two columns say where in its file a row's split begins and
    which file it is; a header lies in the split that begins at 0. Of lines,
    the first and all up to the next one with text go; of parsed rows, whose
    reader has passed over the preamble, all up to the first with text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, over = None, 0, False
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            *columns, start, files = batch.columns
            files = files.to_numpy()
            at = np.flatnonzero(start.to_numpy() == 0)
            k = 0
            while k < len(at):
                if files[at[k]] != file:
                    file, number, over = files[at[k]], 0, False
                if over:  # on to the next file
                    other = np.flatnonzero(files[at[k:]] != file)
                    k = k + int(other[0]) if len(other) else len(at)
                    continue
                keep[at[k]] = False
                texts = [column[int(at[k])].as_py() for column in columns[:-1]]
                over = (number > 0 or not from_line) and any(text and text.strip(_BLANK) for text in texts)
                number += 1
                k += 1
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2]).filter(pa.array(keep))

    return run


def _read_group(
    spark: SparkSession,
    paths: Sequence[str],
    header: Sequence[str],
    empty: bool,
    na_tokens: Sequence[str],
    multi_line: bool,
) -> DataFrame:
    """Files that share one header, as text columns plus ``ref_month``, in one scan.

    A file's preamble and header go by their place in the file, so rows that
    repeat the header are data. The parser keeps the raw line of a row whose
    number of fields is not the header's; such a row is an error if it has more.
    """
    fields = [f"c{position}" for position in range(len(header))]
    schema = ", ".join(f"{field} STRING" for field in [*fields, "raw_line"])
    options = {"sep": ";", "escape": '"', "columnNameOfCorruptRecord": "raw_line"}
    place = [
        f"{month_of_name('_metadata.file_name')} AS ref_month",
        "_metadata.file_block_start AS start",
        "xxhash64(_metadata.file_path) AS file",
    ]
    if multi_line:
        # With a given schema, ``header`` passes over the first line that is not empty: the header itself if
        # nothing stands before it, or the preamble alone.
        rows = spark.read.schema(schema).options(**options, multiLine=True, header=True).csv(list(paths))
        if empty:
            raw = rows.selectExpr("*", place[0])
        else:
            raw = rows.selectExpr("*", *place).mapInArrow(_without_header(False), f"{schema}, ref_month STRING")
        raw = raw.where(rf"raw_line IS NULL OR raw_line RLIKE '{_SOME_TEXT}'")
    else:
        lines = spark.read.text(list(paths)).selectExpr("value", *place)
        data = lines.mapInArrow(_without_header(True), "value STRING, ref_month STRING")
        parsed = F.from_csv("value", schema, options).alias("row")
        raw = data.where(f"value RLIKE '{_SOME_TEXT}'").select(parsed, "ref_month").select("row.*", "ref_month")
    # The test reads all fields, so the raw line is there whatever columns a caller selects.
    whole = raw.where(
        f"CASE WHEN raw_line IS NULL OR regexp_count(raw_line, {_text(_FIELD)}) <= {len(fields)} THEN true "
        "ELSE raise_error('a row has more fields than its header') END"
    )
    return named_rows(whole, dict(zip(fields, column_names(header))), "ref_month", na_tokens)


def read_monthly_files(
    spark: SparkSession,
    paths: Iterable[str],
    na_tokens: Sequence[str] = NA_TOKENS,
    multi_line: bool = False,
    checks: Observation | None = None,
) -> DataFrame:
    """Flights from the given files, columns matched by name.

    The driver sees one header line per file, found by one job; files with the
    same header are then read together, split and parsed in parallel, once. A
    row shorter than its header is filled with nulls, a longer one, be its
    surplus empty, is an error. ``multi_line`` allows line breaks inside
    quotes, at the price of unsplittable files. ``checks`` is an observation
    that counts rows, refused times and missing codes as the flights are written.
    """
    paths = list(paths)
    for path in paths:
        month_of_file(path)
    listed = spark.read.format("binaryFile").load(paths).select("path", "_metadata.file_path").collect()
    beginnings = read_beginnings(spark, paths)
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = defaultdict(list)
    for row in listed:
        if row.file_path not in beginnings:
            raise ValueError(f"no header line in {row.path}")
        header, empty = beginnings[row.file_path]
        groups[header, empty and multi_line].append(row.path)
    return flights_of_named_rows(
        [_read_group(spark, group, *kind, na_tokens, multi_line) for kind, group in groups.items()], checks
    )


def read_monthly_directory(spark: SparkSession, directory: str, **options) -> DataFrame:
    return read_monthly_files(spark, list_monthly_files(spark, directory), **options)

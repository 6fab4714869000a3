"""Table readers and writers."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AuditError
from ..functions.columns import column
from ..functions.ids import drop_generated_ids
from ..functions.sqltext import quote, text
from .csv_records import borders, headers, records, sample, scanned
from .csv_types import columns_of, fields, fitted_types, parsed
from .scratch import scratch_path

# Quoting and encoding of exchanged CSV files.
_CSV_FORMAT = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
# Times are written to the microsecond; without these Spark would cut them at the millisecond.
_CSV_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}
# Stands for a field without characters while reading, so that only "" in quotes is an empty text.
_ABSENT = "\x00absent\x00"
_BAD = "_malformed"
_RECORD_FORMAT = {"quote": '"', "escape": '"', "nullValue": _ABSENT, "multiLine": "true", "mode": "PERMISSIVE"}

#: Records per file that types are taken from.
SAMPLE_ROWS = 10_000


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    sample_rows: int = SAMPLE_ROWS,
    line_breaks: bool | None = None,
) -> DataFrame:
    """CSV table with a header; line breaks in quotes are part of a field, and large files are still split.

    Without a schema, types (numbers, dates, timestamps, booleans) are those that the first
    ``sample_rows`` records of every file fit, as far as they begin in a file's first byte range. Files
    must have the same header then; with a schema, columns count by position. A record with too many or
    too few fields, or with a value that does not fit its column, fails the read and is named by the
    error: nothing turns into nulls unseen. Columns that are not used are not checked.

    One pass finds out where records begin. ``line_breaks=False`` says that no field holds a line break;
    with a schema, the pass is left out then. Blank lines are skipped. Folder names add no columns.
    """
    paths = [path] if isinstance(path, str) else path
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if schema is not None and line_breaks is False:
        return _checked(_plain(spark, paths, schema), schema)
    scan = scanned(spark, paths, sample_rows if schema is None else 0).persist()
    try:
        known = borders(scan)
        if schema is None:
            names = _header(headers(scan))
            schema = fitted_types(sample(scan), names, _RECORD_FORMAT) if names else T.StructType([])
    finally:
        scan.unpersist()
    if not schema.fields:
        return spark.createDataFrame([], schema)
    if not known.breaks:
        return _checked(_plain(spark, paths, schema), schema)
    bad = _unused(schema)
    places = [f"c{i}" for i in range(len(schema.fields))]
    struct = f"{columns_of(places, schema)}, {_BAD} string"
    rows = records(spark, paths, known).selectExpr(f"{parsed('record', struct, _RECORD_FORMAT | {'columnNameOfCorruptRecord': _BAD})} AS row")
    named = [F.col(f"row.{c}").alias(f.name) for c, f in zip(places, schema.fields, strict=True)]
    return _checked(rows.select(*named, F.col(f"row.{_BAD}").alias(bad)), schema)


def _unused(schema: T.StructType) -> str:
    name = _BAD
    taken = {f.name.lower() for f in schema.fields}
    while {name, f"{name}_why"} & taken:
        name += "_"
    return name


def _plain(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Files in which every line is a record, and the text of records that do not fit."""
    bad = _unused(schema)
    wanted = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields], T.StructField(bad, T.StringType())])
    reader = spark.read.options(**_CSV_FORMAT).option("nullValue", _ABSENT).option("recursiveFileLookup", True)
    return reader.option("columnNameOfCorruptRecord", bad).schema(wanted).csv(paths)


def _checked(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows; a record that does not fit ends the job with its text, and names a column that it does not fit."""
    bad = _unused(schema)
    places = [f"c{i}" for i in range(len(schema.fields))]
    misfits = [
        f"CASE WHEN s.raw.{c} IS NOT NULL AND s.typed.{c} IS NULL THEN concat({text(f'column {f.name} is {f.dataType.simpleString()}, the value is ')}, s.raw.{c}) END"
        for c, f in zip(places, schema.fields, strict=True)
    ]
    typed = parsed(quote(bad), columns_of(places, schema), _RECORD_FORMAT)
    raw = parsed(quote(bad), fields(places, "string"), _RECORD_FORMAT)
    otherwise = f"'it has not {len(places)} fields'"
    why = f"transform(array(named_struct('raw', {raw}, 'typed', {typed})), s -> coalesce({', '.join([*misfits, otherwise])}))[0]"
    message = f"CASE WHEN {quote(bad)} IS NOT NULL THEN concat('malformed record, ', {why}, ': ', left({quote(bad)}, 500)) END"
    # The reason is a column of its own, so that it is planned once and not for every column.
    judged = rows.withColumn(f"{bad}_why", F.expr(message))
    reason = column(f"{bad}_why")
    return judged.select(*[F.when(reason.isNull(), column(f.name)).otherwise(F.raise_error(reason)).alias(f.name) for f in schema.fields])


def _header(found: DataFrame) -> list[str]:
    """Column names, from the headers of all files; missing ones are numbered, repeated ones carry their place."""
    first = found.first()
    if first is None:
        return []
    names = next(csv.reader([first["record"]]), [])
    places = [f"c{i}" for i in range(len(names) + 1)]
    different = found.select(F.expr(parsed("record", fields(places, "string"), _RECORD_FORMAT)).alias("names")).distinct().limit(2).collect()
    if len(different) > 1:
        raise AuditError("files have different headers: " + " and ".join(str([n for n in row["names"] if n is not None]) for row in different))
    lower = [name.lower() for name in names]
    return [f"_c{i}" if not name else f"{name}{i}" if lower.count(name.lower()) > 1 else name for i, name in enumerate(names)]


def staged_parquet(df: DataFrame) -> DataFrame:
    """The table written once to the scratch folder as Parquet and read back.

    For sources that cannot skip columns, like CSV: an audit reads its input several times, and every
    pass over text files parses all of them.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths)


def write_csv(df: DataFrame, path: str, mode: str = "error", single_file: bool = False) -> None:
    """Write the table as UTF-8 CSV with a header, without generated row ids.

    All partitions write in parallel; ``single_file`` sends everything through one task and is meant
    for small results only.
    """
    out = drop_generated_ids(df)
    if single_file:
        out = out.coalesce(1)
    out.write.mode(mode).options(**_CSV_FORMAT, **_CSV_TIMES).csv(path)

"""Types of CSV columns from a sample.

Every value fits a set of types; a column's set is the intersection over its values, kept as bits, so
sets of files or tasks merge in any order. The narrowest type left is the column's. Whether a value
fits is decided by the reader itself, which parses the sample once per type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import batches
from ..functions.sqltext import quote, text

#: From narrow to wide; a string fits always. Digits alone are numbers, never dates, and a time needs its date.
LATTICE = ("int", "bigint", "decimal(38,0)", "double", "date", "timestamp", "boolean")
_SHAPES = {"date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "timestamp": "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"}
COLUMNS_PER_PASS = 50


def fields(names: list[str], kind: str) -> str:
    return ", ".join(f"{quote(name)} {kind}" for name in names)


def columns_of(places: list[str], schema: T.StructType) -> str:
    """The columns of a schema under other names, as text."""
    return ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(places, schema.fields, strict=True))


def parsed(record: str, schema: str, options: dict[str, str]) -> str:
    pairs = ", ".join(f"{text(k)}, {text(v)}" for k, v in options.items())
    return f"from_csv({record}, {text(schema)}, map({pairs}))"


def fitted_types(sample: DataFrame, names: list[str], options: dict[str, str]) -> T.StructType:
    """The schema of columns that have these names, by the records of the sample."""
    places = [f"c{i}" for i in range(len(names))]
    struct = sample.selectExpr(
        f"{parsed('record', fields(places, 'string'), options)} AS raw", *[f"{parsed('record', fields(places, t), options)} AS t{i}" for i, t in enumerate(LATTICE)]
    )

    def fits(c: str) -> str:
        tests = []
        for i, kind in enumerate(LATTICE):
            test = f"t{i}.{c} IS NOT NULL"
            if kind.startswith("decimal"):
                test = f"raw.{c} RLIKE '^[-+]?[0-9]{{1,38}}$'"
            elif kind in _SHAPES:
                test = f"{test} AND raw.{c} RLIKE '{_SHAPES[kind]}'"
            tests.append(f"CASE WHEN {test} THEN {1 << i} ELSE 0 END")
        return f"CASE WHEN raw.{c} IS NOT NULL THEN {' + '.join(tests)} END"

    digits = "length(regexp_replace(raw.{c}, '[-+]', ''))"
    out = []
    for group in batches(list(zip(places, names, strict=True)), COLUMNS_PER_PASS):
        sums = [F.expr(f"bit_and({fits(c)})").alias(c) for c, _ in group] + [F.expr(f"max({digits.format(c=c)})").alias(f"n_{c}") for c, _ in group]
        row = struct.agg(*sums).first()
        for c, name in group:
            left = [kind for i, kind in enumerate(LATTICE) if row[c] is not None and row[c] >> i & 1]
            kind = left[0] if left else "string"
            out.append(T.StructField(name, T.DecimalType(row[f"n_{c}"], 0) if kind.startswith("decimal") else T._parse_datatype_string(kind)))
    return T.StructType(out)

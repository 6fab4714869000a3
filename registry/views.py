"""Input views of the registered queries, in SQL that Spark and DuckDB both run.

The driver tables hold no missing values and no repeated rows. The messy views keep every row of
their table and put defects into it: missing values, NaN, extreme values, odd formats and second
copies of some rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MESSY_CUSTOMERS = """
SELECT c_custkey * 2 + copy_no AS row_id,
       c_custkey AS cust_id,
       CASE WHEN c_custkey % 17 = 0 THEN CAST(NULL AS DOUBLE) WHEN c_custkey % 31 = 0 THEN c_acctbal * 50
            ELSE c_acctbal END AS balance,
       CASE WHEN c_custkey % 23 = 0 THEN CAST(NULL AS INT) ELSE c_nationkey END AS nation_key,
       CASE WHEN c_custkey % 11 = 0 THEN CAST(NULL AS STRING) WHEN c_custkey % 13 = 0 THEN 'bad@'
            ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS contact_email,
       CASE c_custkey % 10 WHEN 0 THEN '15/02/2023' WHEN 1 THEN '2023/06/12' WHEN 2 THEN 'NOT_A_DATE'
            ELSE '2023-01-15' END AS signup_date,
       CASE WHEN c_custkey % 9 = 0 THEN CAST(c_custkey AS STRING)
            ELSE concat('SKU-', CAST(c_custkey AS STRING)) END AS code,
       CASE WHEN c_custkey % 19 = 0 THEN CAST(NULL AS BOOLEAN) ELSE c_custkey % 2 = 0 END AS is_active,
       c_mktsegment AS segment,
       0 AS zero_col,
       CAST(NULL AS DOUBLE) AS null_col
FROM (SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment, 0 AS copy_no FROM {customer}
      UNION ALL
      SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment, 1 AS copy_no FROM {customer}
      WHERE c_custkey % 25 = 0) u
"""

MESSY_EVENTS = """
SELECT event_id * 2 + copy_no AS row_id,
       user_id,
       CASE WHEN user_id % 7 <> 0 THEN ts END AS ts,
       CASE WHEN user_id % 5 <> 0 THEN event_type END AS event_type,
       CASE WHEN user_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 97 = 0 THEN value * -1000
            ELSE value END AS value,
       CASE WHEN user_id % 3 = 0 THEN CAST(NULL AS BOOLEAN) ELSE value > 50 END AS is_large,
       props,
       CASE event_id % 10
            WHEN 0 THEN CAST(event_id AS STRING)
            WHEN 1 THEN concat('  ', CAST(event_id AS STRING), ' ')
            WHEN 2 THEN concat(CAST(event_id AS STRING), 'e3')
            WHEN 3 THEN concat('1_', CAST(event_id AS STRING))
            WHEN 4 THEN concat('$', CAST(event_id AS STRING))
            WHEN 5 THEN 'n/a'
            WHEN 6 THEN concat('.', CAST(event_id AS STRING))
            WHEN 7 THEN concat(CAST(event_id AS STRING), '.')
            WHEN 8 THEN concat('-', CAST(event_id AS STRING), '.5E-2')
            ELSE concat(CAST(event_id AS STRING), 'd') END AS amount_text,
       CASE event_id % 6
            WHEN 0 THEN concat('u', CAST(user_id AS STRING), '@mail.example.org')
            WHEN 1 THEN concat('u', CAST(user_id AS STRING), '.x+y@example.co')
            WHEN 2 THEN concat('u', CAST(user_id AS STRING), '@example')
            WHEN 3 THEN concat('u ', CAST(user_id AS STRING), '@example.com')
            WHEN 4 THEN concat('u', CAST(user_id AS STRING), '@example.com', chr(10))
            ELSE CAST(NULL AS STRING) END AS user_email,
       CASE event_id % 14
            WHEN 0 THEN concat(y, '-', m, '-', d)
            WHEN 1 THEN concat(y, '/', m, '/', d)
            WHEN 2 THEN concat(d, '/', m, '/', y)
            WHEN 3 THEN concat(y, ' ', m, ' ', d)
            WHEN 4 THEN concat(y, '-', m, '-', d, ' 10:20:30')
            WHEN 5 THEN concat(y, '-', m, '-', d, 'T10:20:30.5')
            WHEN 6 THEN concat(y, '-02-', d)
            WHEN 7 THEN concat(y, '-', m)
            WHEN 8 THEN y
            WHEN 9 THEN '10:00:00'
            WHEN 10 THEN 'epoch'
            WHEN 11 THEN concat(y, '-', m, '-', d, ' abc')
            WHEN 12 THEN concat(y, '-', m, '-', d, ' 10:20:30Z')
            ELSE concat(y, '-', m, '/', d) END AS event_date
FROM (SELECT *, CAST(year(ts) AS STRING) AS y, CAST(month(ts) AS STRING) AS m, CAST(day(ts) AS STRING) AS d
      FROM (SELECT *, 0 AS copy_no FROM {events}
            UNION ALL
            SELECT *, 1 AS copy_no FROM {events} WHERE value > 120) c) u
"""


@dataclass(frozen=True)
class Audited:
    """A table under audit: its view, row id, and columns as (name, Spark type, type class)."""

    view: str
    row_id: str | None
    columns: tuple[tuple[str, str, str], ...]
    tables: tuple[str, ...]
    nan_columns: tuple[str, ...] = ()

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables}
        return spark.sql(self.view, **frames)

    def duckdb(self) -> str:
        """The view with NaN read as missing, as a subquery."""
        text = self.view.format(**{t: t for t in self.tables})
        if not self.nan_columns:
            return text
        cleaned = ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in self.nan_columns)
        return f"SELECT * REPLACE ({cleaned}) FROM ({text}) v"

    def numeric(self) -> list[str]:
        return [c for c, _, k in self.columns if k == "numeric"]


CUSTOMERS = Audited(
    MESSY_CUSTOMERS,
    "row_id",
    (
        ("cust_id", "bigint", "numeric"),
        ("balance", "double", "numeric"),
        ("nation_key", "int", "numeric"),
        ("contact_email", "string", "string"),
        ("signup_date", "string", "string"),
        ("code", "string", "string"),
        ("is_active", "boolean", "boolean"),
        ("segment", "string", "string"),
        ("zero_col", "int", "numeric"),
        ("null_col", "double", "numeric"),
    ),
    ("customer",),
)

EVENTS = Audited(
    MESSY_EVENTS,
    "row_id",
    (
        ("user_id", "bigint", "numeric"),
        ("ts", "timestamp_ntz", "temporal"),
        ("event_type", "string", "string"),
        ("value", "double", "numeric"),
        ("is_large", "boolean", "boolean"),
        ("props", "string", "string"),
        ("amount_text", "string", "string"),
        ("user_email", "string", "string"),
        ("event_date", "string", "string"),
    ),
    ("events",),
    ("value",),
)

LINEITEM = Audited(
    "SELECT * FROM {lineitem}",
    None,
    (
        ("l_orderkey", "bigint", "numeric"),
        ("l_partkey", "bigint", "numeric"),
        ("l_suppkey", "bigint", "numeric"),
        ("l_linenumber", "int", "numeric"),
        ("l_quantity", "double", "numeric"),
        ("l_extendedprice", "double", "numeric"),
        ("l_discount", "double", "numeric"),
        ("l_tax", "double", "numeric"),
        ("l_returnflag", "string", "string"),
        ("l_linestatus", "string", "string"),
        ("l_shipdate", "timestamp_ntz", "temporal"),
    ),
    ("lineitem",),
)

ORDERS = Audited(
    "SELECT * FROM {orders}",
    "o_orderkey",
    (
        ("o_custkey", "bigint", "numeric"),
        ("o_orderstatus", "string", "string"),
        ("o_totalprice", "double", "numeric"),
        ("o_orderdate", "timestamp_ntz", "temporal"),
        ("o_orderpriority", "string", "string"),
    ),
    ("orders",),
)

PART = Audited(
    "SELECT * FROM {part}",
    "p_partkey",
    (
        ("p_name", "string", "string"),
        ("p_brand", "string", "string"),
        ("p_type", "string", "string"),
        ("p_size", "int", "numeric"),
        ("p_retailprice", "double", "numeric"),
    ),
    ("part",),
)

DOCUMENTS = Audited(
    "SELECT * FROM {documents}",
    "doc_id",
    (
        ("text", "string", "string"),
        ("lang", "string", "string"),
        ("source", "string", "string"),
        ("n_chars", "bigint", "numeric"),
    ),
    ("documents",),
)

LABELS = Audited(
    "SELECT * FROM {labels}",
    "doc_id",
    (("quality", "int", "numeric"), ("toxic", "int", "numeric")),
    ("labels",),
)

PAGES = Audited(
    "SELECT * FROM {pages}",
    "page_id",
    (("url", "string", "string"), ("html", "string", "string")),
    ("pages",),
)

CONVERSATIONS = Audited(
    "SELECT * FROM {conversations}",
    None,
    (
        ("conv_id", "bigint", "numeric"),
        ("turn", "bigint", "numeric"),
        ("role", "string", "string"),
        ("text", "string", "string"),
    ),
    ("conversations",),
)

EMBEDDINGS = Audited(
    "SELECT * FROM {embeddings}",
    "vec_id",
    (("embedding", "array<float>", "other"), ("label", "int", "numeric")),
    ("embeddings",),
)

# Orders with keys that no double holds, some of them missing, and prices as decimals, short and long.
KEYS = Audited(
    """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       CASE WHEN o_orderkey % 7 <> 0 THEN 9007199254740993 + 2 * o_orderkey END AS big_key,
       CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_totalprice AS DECIMAL(15, 2)) END AS price,
       CAST(concat('1234567890123456789012', CAST(1000000 + o_orderkey * 7919 % 999983 AS STRING), '.25') AS DECIMAL(38, 3)) AS long_price
FROM {orders}
""",
    "o_orderkey",
    (*ORDERS.columns, ("big_key", "bigint", "numeric"), ("price", "decimal(15,2)", "numeric"), ("long_price", "decimal(38,3)", "numeric")),
    ("orders",),
)
EXACT_KEYS = ("o_custkey", "big_key", "price", "long_price")

# Orders without a customer: there are none, but both tables are read in full to find that out.
ORPHANED_ORDERS = Audited(
    "SELECT o.* FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = o.o_custkey)",
    "o_orderkey",
    ORDERS.columns,
    ("orders", "customer"),
)

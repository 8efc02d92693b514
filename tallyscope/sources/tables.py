"""S8 table source and the derived ``dirty_orders`` audit input (FIXTURES.md §2)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DAY_FIRST_FORMATS, FALLBACK_FORMATS, MONTH_FIRST_FORMATS, UNAMBIGUOUS_FORMATS

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# a total row order for lineitem: (l_orderkey, l_linenumber) alone is not unique
LINEITEM_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders re-rendered as messy text/numbers, plus every 50th order twice.

    Money text is built from integer cents so both engines print the same
    characters. Pure projection + union: its cost grows with ``orders``.
    """
    return dirty_orders_from(read_table(spark, sf_dir, "orders"))


def dirty_orders_from(orders: DataFrame, duplicate_every: int | None = 50) -> DataFrame:
    """The dirty_orders projection of any orders frame (batch or streaming)."""
    o = orders.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    o = o.withColumn("__cents", cents)
    c = F.col("__cents")
    money = F.concat(
        F.lit("$"), F.expr("__cents div 100000").cast("string"), F.lit(","),
        F.lpad(F.expr("(__cents div 100) % 1000").cast("string"), 3, "0"), F.lit("."),
        F.lpad((c % 100).cast("string"), 2, "0"),
    )
    base = o.select(
        k.alias("row_id"),
        F.when(k % 17 != 0, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("order_date_txt"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_date_txt"),
        F.concat(F.lit("0"), (1 + k % 9).cast("string"), F.lit("/0"),
                 (1 + F.expr("(o_orderkey div 7) % 9")).cast("string"), F.lit("/2024")).alias("ambiguous_date_txt"),
        F.when(k % 5 == 0, F.concat(F.lit("("), money, F.lit(")"))).otherwise(money).alias("amount_txt"),
        F.when(k % 4 == 0, F.concat(F.lit("0."), F.lpad((k % 100).cast("string"), 2, "0")))
        .otherwise(F.concat((k % 100).cast("string"), F.lit("%"))).alias("rate_txt"),
        F.when(k % 211 == 0, F.lit(999.0)).when(k % 97 == 0, F.lit(-5.0)).when(k % 13 == 0, F.lit(None))
        .otherwise((18 + k % 42).cast("double")).cast("double").alias("customer_age"),
        (k % 10).cast("double").alias("unit_count"),
        F.when(k % 307 == 0, F.lit(1.5)).otherwise((k % 11).cast("double") / 100).alias("discount_rate"),
        F.when(k % 29 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(k % 5 == 0, F.concat(F.lit("n"), (k % 7).cast("string"))).alias("sparse_note"),
        F.lit("web").alias("const_src"),
    )
    if not duplicate_every:
        return base
    return base.unionByName(base.where(F.col("row_id") % duplicate_every == 0))


def dirty_orders_sql(orders: str = "orders") -> str:
    """The same derivation for the DuckDB oracle, as a CTE body."""
    k = "o_orderkey"
    cents = "CAST(round(o_totalprice * 100) AS BIGINT)"
    money = (f"'$' || CAST(({cents}) // 100000 AS VARCHAR) || ',' || lpad(CAST((({cents}) // 100) % 1000 AS VARCHAR), 3, '0')"
             f" || '.' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0')")
    base = f"""SELECT {k} AS row_id,
  CASE WHEN {k} % 17 <> 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS order_date_txt,
  strftime(o_orderdate, '%m/%d/%Y') AS us_date_txt,
  '0' || CAST(1 + {k} % 9 AS VARCHAR) || '/0' || CAST(1 + ({k} // 7) % 9 AS VARCHAR) || '/2024' AS ambiguous_date_txt,
  CASE WHEN {k} % 5 = 0 THEN '(' || {money} || ')' ELSE {money} END AS amount_txt,
  CASE WHEN {k} % 4 = 0 THEN '0.' || lpad(CAST({k} % 100 AS VARCHAR), 2, '0') ELSE CAST({k} % 100 AS VARCHAR) || '%' END AS rate_txt,
  CAST(CASE WHEN {k} % 211 = 0 THEN 999 WHEN {k} % 97 = 0 THEN -5 WHEN {k} % 13 = 0 THEN NULL ELSE 18 + {k} % 42 END AS DOUBLE) AS customer_age,
  CAST({k} % 10 AS DOUBLE) AS unit_count,
  CASE WHEN {k} % 307 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST({k} % 11 AS DOUBLE) / 100 END AS discount_rate,
  CASE WHEN {k} % 29 <> 0 THEN o_orderstatus END AS status,
  CASE WHEN {k} % 5 = 0 THEN 'n' || CAST({k} % 7 AS VARCHAR) END AS sparse_note,
  'web' AS const_src
FROM {orders}"""
    return f"(SELECT * FROM ({base}) b UNION ALL SELECT * FROM ({base}) b2 WHERE row_id % 50 = 0)"


# ---------------------------------------------------------------------------
# orders with a MAP column, and orders with their date in every text format
# ---------------------------------------------------------------------------

def tagged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few different rows of status, a MAP whose entries come in either order, and zeros of either sign."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pri, mod = (F.lit("pri"), F.col("o_orderpriority")), (F.lit("mod"), (k % 5).cast("string"))
    tags = F.when(k % 2 == 0, F.create_map(*pri, *mod)).otherwise(F.create_map(*mod, *pri))
    zero = F.when(k % 3 == 0, F.lit(-0.0)).otherwise(F.lit(0.0))
    return o.select(F.col("o_orderstatus").alias("status"), tags.alias("tags"), F.array(zero).alias("zeros"))


#: Every date format of the cleaner, those of the fallback last.
ALL_FORMATS = (*DAY_FIRST_FORMATS, *MONTH_FIRST_FORMATS, *UNAMBIGUOUS_FORMATS, *FALLBACK_FORMATS)


def _padded(fmt: str) -> str:
    """A format with two digits for each day, month, hour, minute and second."""
    return re.sub(r"(?<![dMHms])([dMHms])(?![dMHms])", r"\1\1", fmt)


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_key`` and ``txt``: a time of the order's day in the format that its key picks, every
    other time round with two digits in each field."""
    o = read_table(spark, sf_dir, "orders")
    k, n = F.col("o_orderkey"), len(ALL_FORMATS)
    when = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * 37 % 86400).cast("decimal(18,6)"))
    txt = None
    for i, fmt in enumerate(ALL_FORMATS):
        cond = k % n == i
        text = F.when(F.expr(f"o_orderkey div {n} % 2 = 0"), F.date_format(when, fmt)).otherwise(F.date_format(when, _padded(fmt)))
        txt = F.when(cond, text) if txt is None else txt.when(cond, text)
    return o.select(k.alias("order_key"), txt.alias("txt"))


def duck_format(fmt: str, padded: bool) -> str:
    """A format as DuckDB's strftime writes it."""
    names = {"yyyy": "%Y", "yy": "%y", "MMM": "%b", "MMMM": "%B", "d": "d", "M": "m", "H": "H", "m": "M", "s": "S"}
    out = []
    for f in re.findall(r"y+|M+|d+|H+|m+|s+|.", fmt.replace("'T'", "T")):
        if f == "dd" or f == "MM":
            out.append({"dd": "%d", "MM": "%m"}[f])
        elif f in names:
            out.append(names[f] if names[f][0] == "%" else ("%" if padded else "%-") + names[f])
        else:
            out.append(f)
    return "".join(out)


def dated_orders_sql(orders: str = "orders") -> str:
    """The same derivation for the DuckDB oracle."""
    n = len(ALL_FORMATS)
    when = "CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey * 37 % 86400)"
    arms = "\n".join(f"WHEN {i} THEN CASE WHEN o_orderkey // {n} % 2 = 0 THEN strftime({when}, '{duck_format(f, False)}') ELSE strftime({when}, '{duck_format(f, True)}') END"
                     for i, f in enumerate(ALL_FORMATS))
    return f"(SELECT o_orderkey AS order_key, CASE o_orderkey % {n} {arms} END AS txt FROM {orders})"

"""Frequent and distinct values of many columns at once.

The frequency table (column, value, n) is one ``explode -> groupBy(column, value)``
shuffle with map-side combine. It is as large as the data for columns of
identifiers, so modes, top-k lists and the few-values test do without it:

* ``exact_top_k`` bounds all counts by a fixed number of counters a column, counts
  the values of the largest exactly and stops where the bound proves the rest
  smaller; columns whose values are all about equally frequent ship hashes;
* ``few_values`` proves "more than k" from a bitmap of 4 KB a column and task;
* ``distinct_by_key`` counts distinct 128-bit hashes instead of values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .kinds import NUMERIC_TYPES, q


def _value_struct(df: DataFrame, col: str):
    dt = df.schema[col].dataType
    c = F.col(q(col))
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0)  # fold -0.0 into 0.0 as a grouping key would
    num = c.cast("double") if isinstance(dt, NUMERIC_TYPES) else F.lit(None).cast("double")
    if isinstance(dt, T.MapType):  # entries in the order of their keys
        def by_key(a, b):
            return F.when(a.getField("key") < b.getField("key"), -1).when(a.getField("key") > b.getField("key"), 1).otherwise(0)

        text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c), by_key)))
    elif isinstance(dt, (T.ArrayType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.struct(F.lit(col).alias("column"), text.alias("value"), num.alias("sort_num"))


def frequency_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, value STRING, sort_num DOUBLE, n BIGINT) over non-null values.

    ``sort_num`` keeps numeric order for tie-breaks (text order otherwise).
    """
    cols = list(df.columns) if cols is None else list(cols)
    if not cols:
        schema = "column string, value string, sort_num double, n bigint"
        return df.sparkSession.createDataFrame([], schema)
    long = df.select(F.inline(F.array(*[_value_struct(df, c) for c in cols])))
    return (
        long.where(F.col("value").isNotNull())
        .groupBy("column", "value", "sort_num")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_counts(freq: DataFrame) -> DataFrame:
    """(column, n_unique) from a frequency table."""
    return freq.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))


def modes(freq: DataFrame) -> DataFrame:
    """(column, mode, mode_count): most frequent value, smallest on ties.

    ``min(struct(-n, sort_num, value))`` is an ordinary partial-aggregatable
    min, so no column's values are ever gathered into one place.
    """
    best = F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("sort_num"), F.col("value")))
    return (
        freq.groupBy("column")
        .agg(best.alias("b"))
        .select("column", F.col("b.value").alias("mode"), (-F.col("b.neg_n")).alias("mode_count"))
    )


def top_k(freq: DataFrame, k: int, by: str = "count") -> DataFrame:
    """(column, rank, value, n): the k most frequent values per column
    (``by="value"``: the k smallest values instead).

    Planned as a partial WindowGroupLimit before the shuffle, so at most k rows
    per column leave each map task.
    """
    if by == "value":
        w = Window.partitionBy("column").orderBy(F.col("value"))
    else:
        w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("sort_num").asc_nulls_last(), F.col("value"))
    return (
        freq.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("column", F.col("rank").cast("bigint").alias("rank"), "value", "n")
    )


# ---------------------------------------------------------------------------
# exact top-k without the frequency table
# ---------------------------------------------------------------------------

#: Counters that bound a column's counts from above, and how many of them are looked into for each value asked for.
COUNTERS, LOOKED_INTO = 1 << 15, 8


def _pairs(df: DataFrame, cols: list[str], places: set[int] | None = None) -> DataFrame:
    """(c, value, sort_num, h) of every non-null value; ``c`` is the column's place in ``cols``, ``h`` a hash of the value."""
    items = [F.struct(F.lit(i).alias("c"), s.getField("value").alias("value"), s.getField("sort_num").alias("sort_num"))
             for i, s in ((i, _value_struct(df, c)) for i, c in enumerate(cols) if places is None or i in places)]
    long = df.select(F.inline(F.array(*items))).where(F.col("value").isNotNull())
    return long.withColumn("h", F.xxhash64("value"))


def _ranked(pool: DataFrame, k: int) -> DataFrame:
    """The k first values of each column by count, then by value."""
    w = Window.partitionBy("c").orderBy(F.col("n").desc(), F.col("sort_num").asc_nulls_last(), F.col("value"))
    return pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _by_counters(pairs: DataFrame, cols: list[int], k: int) -> tuple[list, set]:
    """Top-k rows of the columns that counters settle, and those columns.

    A counter counts all values of one hash class, so it bounds each of them from above; counters add
    up over tasks like any sum. The values of the largest counters are counted exactly by a second
    scan. If the k-th of them beats every counter that was not looked into, no other value can."""
    counters = pairs.groupBy("c", F.pmod("h", F.lit(COUNTERS)).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    look = max(64, LOOKED_INTO * k)
    w = Window.partitionBy("c").orderBy(F.col("n").desc(), "slot")
    top = counters.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= look + 1).collect()  # a few hundred a column
    slots: dict[int, list[int]] = {}
    rest: dict[int, int] = {}
    for r in top:
        if r["__r"] <= look:
            slots.setdefault(r["c"], []).append(r["slot"])
        else:
            rest[r["c"]] = r["n"]
    empty = set(cols) - set(slots)  # columns without a value
    if not slots:
        return [], empty
    chosen = pairs.sparkSession.createDataFrame([(c, slot) for c, found in slots.items() for slot in found], "c int, slot int")
    slotted = pairs.withColumn("slot", F.pmod("h", F.lit(COUNTERS)).cast("int"))
    # a few hundred rows a column: broadcast
    exact = slotted.join(F.broadcast(chosen), ["c", "slot"], "left_semi").groupBy("c", "value", "sort_num").agg(F.count(F.lit(1)).alias("n"))
    best: dict[int, list] = {}
    for r in _ranked(exact, k).collect():
        best.setdefault(r["c"], []).append(r)
    # fewer counters than were to be looked into: all values are counted
    settled = {c for c, rows in best.items() if c not in rest or (len(rows) >= k and min(r["n"] for r in rows) > rest[c])}
    return [(r["c"], r["rank"], r["value"], r["n"]) for c in settled for r in best[c]], settled | empty


def _by_hashes(pairs: DataFrame, cols: list[int], k: int) -> tuple[list, set]:
    """Top-k rows of columns whose values are about equally frequent: 8-byte hashes are counted, not values.

    With c the k-th largest count of a hash, values of a larger count are fewer than k. If c is 1 the others are
    unique, and the smallest of them follow; else the values of every hash counted c or more are counted exactly. A
    hash shared by two values can only raise a count, so a result whose k-th count is c or more is proven."""
    spark = pairs.sparkSession
    counted = pairs.groupBy("c", "h").agg(F.count(F.lit(1)).alias("n"))
    with written(counted, "hash-counts") as hashes:
        w = Window.partitionBy("c").orderBy(F.col("n").desc(), "h")
        top = hashes.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).collect()
        least: dict[int, int] = {}
        for r in top:
            least[r["c"]] = min(int(r["n"]), least.get(r["c"], int(r["n"])))
        pools = []
        unique = [c for c, n in least.items() if n == 1]
        if unique:
            # fewer than k hashes a column occur more than once there, so these few rows are broadcast
            again = F.broadcast(spark.createDataFrame([(r["c"], r["h"]) for r in top if least[r["c"]] == 1 and r["n"] > 1], "c int, h bigint"))
            mine = pairs.where(F.col("c").isin(unique))
            pools.append(mine.join(again, ["c", "h"], "left_semi").groupBy("c", "value", "sort_num").agg(F.count(F.lit(1)).alias("n")))
            by_value = Window.partitionBy("c").orderBy(F.col("sort_num").asc_nulls_last(), "value")
            once = mine.join(again, ["c", "h"], "left_anti").withColumn("__r", F.row_number().over(by_value)).where(F.col("__r") <= k)
            pools.append(once.select("c", "value", "sort_num", F.lit(1).cast("bigint").alias("n")))
        common = [(c, n) for c, n in least.items() if n > 1]
        if common:
            bound = F.broadcast(spark.createDataFrame(common, "c int, least bigint"))  # a row a column
            wanted = hashes.join(bound, "c").where("n >= least").select("c", "h")
            pools.append(pairs.join(wanted, ["c", "h"], "left_semi").groupBy("c", "value", "sort_num").agg(F.count(F.lit(1)).alias("n")))
        ranked = [r for pool in pools for r in _ranked(pool, k).collect()]
    out, best = [], {}
    for r in ranked:
        best.setdefault(r["c"], []).append(r)
    settled = set()
    for c, rows in best.items():
        rows.sort(key=lambda r: (-r["n"], r["sort_num"] is None, r["sort_num"] or 0.0, r["value"].encode()))
        rows = rows[:k]
        if least[c] == 1 or min(r["n"] for r in rows) >= least[c]:
            settled.add(c)
            out += [(c, i + 1, r["value"], r["n"]) for i, r in enumerate(rows)]
    return out, settled


def exact_top_k(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """(column, rank, value, n): the k most frequent non-null values per column, ties by value.

    The same rows as ``top_k(frequency_table(df, cols), k)``, for columns of any size: counters first, hashes for the
    columns that these prove nothing about, and the frequency table only where hashes of different values met."""
    cols = list(cols)
    schema = "column string, rank bigint, value string, n bigint"
    spark = df.sparkSession
    rows: list = []
    left = set(range(len(cols)))
    for settle in (_by_counters, _by_hashes):
        if left:
            found, settled = settle(_pairs(df, cols, left), sorted(left), k)
            rows += found
            left -= settled
    out = spark.createDataFrame([(cols[c], int(r), v, int(n)) for c, r, v, n in rows], schema)
    if left:
        out = out.unionAll(top_k(frequency_table(df, [cols[c] for c in sorted(left)]), k).select("column", "rank", "value", "n"))
    return out


def few_values(df: DataFrame, cols: list[str], most: int) -> dict[str, int | None]:
    """Per column its number of distinct non-null values, or None if there are more than ``most``.

    Every task keeps 4 KB a column: a bit for each of 32,768 hash classes that a value was seen in.
    More than ``most`` bits prove more than ``most`` values; a column with fewer is counted exactly,
    which ships a few rows a task."""
    if not cols:
        return {}
    bits = []
    for i, c in enumerate(cols):
        v = _value_struct(df, c).getField("value")
        spot = F.when(v.isNotNull(), F.pmod(F.xxhash64(v), F.lit(COUNTERS)))
        bits.append(F.bitmap_count(F.bitmap_construct_agg(spot)).alias(f"b{i}"))
    row = {}
    for i in range(0, len(bits), 40):
        row.update(df.agg(*bits[i:i + 40]).first().asDict())
    out: dict[str, int | None] = {c: (None if row[f"b{i}"] > most else 0) for i, c in enumerate(cols)}
    few = [c for c, n in out.items() if n is not None]
    for r in distinct_counts(frequency_table(df, few)).collect() if few else []:
        out[r["column"]] = int(r["n_unique"]) if r["n_unique"] <= most else None
    return out


def distinct_by_key(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_unique): distinct non-null values, told apart by 128 bits of hashes instead of the values."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_unique bigint")
    pairs = _pairs(df, cols).select("c", "h", F.xxhash64(F.lit(1), "value").alias("g"))
    names = F.array(*[F.lit(c) for c in cols])
    return (pairs.groupBy("c", "h", "g").agg(F.lit(1)).groupBy("c").agg(F.count(F.lit(1)).alias("n_unique"))
            .select(F.get(names, F.col("c")).alias("column"), "n_unique"))

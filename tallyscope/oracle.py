"""DuckDB SQL for each registered query (the driver's correctness oracle).

The SQL is written against the fixed test schemas; helpers below only expand
per-column blocks so the text stays readable.
"""

from __future__ import annotations

from .sources.tables import dated_orders_sql, dirty_orders_sql

DO_COLS = [
    "row_id", "order_date_txt", "us_date_txt", "ambiguous_date_txt", "amount_txt", "rate_txt",
    "customer_age", "unit_count", "discount_rate", "status", "sparse_note", "const_src",
]
DO_TYPES = {
    "row_id": "bigint", "customer_age": "double", "unit_count": "double", "discount_rate": "double",
}
DO_NUMERIC = ["row_id", "customer_age", "unit_count", "discount_rate"]
DO_FLOATS = ["customer_age", "unit_count", "discount_rate"]
DO_TEXT = [c for c in DO_COLS if c not in DO_TYPES]

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
EVENTS_NUMERIC = ["event_id", "user_id", "value"]

SENTINELS = [-9999, -999, -99, 999, 9999, 99999, 999999]


def with_do(body: str) -> str:
    return f"WITH dirty_orders AS {dirty_orders_sql()}\n{body}"


def pct(k: str, n: str, d: int = 1) -> str:
    """100*k/n rounded half-up on the exact ratio; same integers as the Spark side."""
    s = 10 ** d
    return f"(CASE WHEN ({n}) > 0 THEN CAST(((({k}) * {200 * s} + ({n})) // (2 * ({n}))) AS DOUBLE) / {s} END)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def r(x: str, d: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {d})"


def g1(c: str) -> str:
    return (f"(CASE WHEN count({c}) < 3 THEN NULL WHEN var_pop({c}) = 0 THEN CAST(0 AS DOUBLE) "
            f"ELSE skewness({c}) END)")


def g2(c: str) -> str:
    return (f"(CASE WHEN count({c}) < 4 THEN NULL WHEN var_pop({c}) = 0 THEN CAST(0 AS DOUBLE) "
            f"ELSE kurtosis({c}) END)")


# ---------------------------------------------------------------------------
# profile
# ---------------------------------------------------------------------------

def _null_long(cols, table):
    return union([f"SELECT '{c}' AS \"column\", {i} AS position, count_if({c} IS NULL) AS n_null, count(*) AS n_rows FROM {table}"
                  for i, c in enumerate(cols)])


SQL: dict[str, str] = {}

SQL["overview"] = with_do(
    "SELECT count(*) AS n_rows, CAST(12 AS BIGINT) AS n_cols, CAST(4 AS BIGINT) AS n_numeric, "
    "CAST(8 AS BIGINT) AS n_categorical, CAST(0 AS BIGINT) AS n_datetime, CAST(0 AS BIGINT) AS n_other FROM dirty_orders")

SQL["null_profile"] = with_do(
    f"SELECT \"column\", n_null, {pct('n_null', 'n_rows', 2)} AS null_pct FROM ({_null_long(DO_COLS, 'dirty_orders')}) x "
    "WHERE n_null > 0")

SQL["null_table_sorted"] = with_do(
    f"SELECT \"column\", n_null, null_pct, row_number() OVER (ORDER BY null_pct DESC, \"column\") AS rank FROM ("
    f"SELECT \"column\", n_null, {pct('n_null', 'n_rows', 2)} AS null_pct FROM ({_null_long(DO_COLS, 'dirty_orders')}) x "
    "WHERE n_null > 0) y")

SQL["missing_overall"] = with_do(
    f"SELECT {pct('sum(n_null)', 'max(n_rows) * 12', 1)} AS missing_pct_overall, CAST(sum(n_null) AS BIGINT) AS null_cells, "
    f"{pct('sum(n_null)', 'max(n_rows) * 12', 1)} AS null_cells_pct, count_if(n_null > 0) AS n_null_cols "
    f"FROM ({_null_long(DO_COLS, 'dirty_orders')}) x")

SQL["duplicate_count"] = with_do(
    "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_duplicates "
    f"FROM (SELECT {', '.join(DO_COLS)}, count(*) AS n FROM dirty_orders GROUP BY ALL) g")


def _summary_part(c, i):
    dtype = DO_TYPES.get(c, "string")
    return (f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype, count({c}) AS non_null, "
            f"{pct('count(*) - count(' + c + ')', 'count(*)', 1)} AS null_pct, count(DISTINCT {c}) AS n_unique, "
            f"{pct('count(DISTINCT ' + c + ')', 'count(*)', 1)} AS cardinality_pct, "
            f"coalesce(substring(CAST(arg_min({c}, row_id) FILTER (WHERE {c} IS NOT NULL) AS VARCHAR), 1, 40), '—') AS sample_value "
            f"FROM dirty_orders")


SQL["column_summary"] = with_do(union([_summary_part(c, i) for i, c in enumerate(DO_COLS)]))

SQL["cardinality"] = with_do(union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM dirty_orders"
                                    for c in DO_TEXT]))

SQL["constant_columns"] = with_do(
    "SELECT \"column\", d AS n_distinct_with_null, d <= 1 AS is_constant FROM ("
    + union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + CASE WHEN count_if({c} IS NULL) > 0 THEN 1 ELSE 0 END AS d "
             f"FROM dirty_orders" for c in DO_COLS]) + ") x")

SQL["mode_values"] = with_do(union([
    f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS mode, count(*) AS mode_count FROM dirty_orders "
    f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in DO_COLS]))

SQL["describe_numeric"] = union([
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
    f"{r(f'min({c})')} AS min, {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS median, "
    f"{r(f'quantile_cont({c}, 0.75)')} AS q75, {r(f'max({c})')} AS max FROM lineitem" for c in LINEITEM_NUMERIC])

SQL["describe_small_band"] = SQL["describe_numeric"]

SQL["skew_kurtosis"] = union([
    f"SELECT '{c}' AS \"column\", {r(g1(c), 3)} AS skew, {r(g2(c), 3)} AS kurtosis FROM lineitem" for c in LINEITEM_NUMERIC])

SQL["skew_flags"] = (
    "SELECT \"column\", round(g, 3) AS skew, CASE WHEN g > 0 THEN 'right' ELSE 'left' END AS direction, "
    "CASE WHEN abs(round(g, 3)) > 2 THEN 'bad' ELSE 'warn' END AS severity FROM ("
    + union([f"SELECT '{c}' AS \"column\", count({c}) AS n, {g1(c)} AS g FROM events" for c in EVENTS_NUMERIC])
    + ") x WHERE n >= 10 AND abs(g) > 1")

SQL["audit_stats"] = union([
    f"SELECT '{c}' AS \"column\", {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, "
    f"{r(f'max({c})')} AS max FROM lineitem" for c in LINEITEM_NUMERIC])


def _iqr_block(cols, table):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM {table}) AS n_rows, "
            f"(SELECT count({c}) FROM {table}) AS n, b.q1, b.q3, "
            f"(SELECT count_if({c} < b.q1 - 1.5 * (b.q3 - b.q1) OR {c} > b.q3 + 1.5 * (b.q3 - b.q1)) FROM {table}) AS n_out "
            f"FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}) b")
    return f"(SELECT * FROM ({union(parts)}) u WHERE n >= 10 AND q3 - q1 <> 0)"


SQL["iqr_outliers"] = (
    f"SELECT \"column\", n_out AS n_outliers, {pct('n_out', 'n_rows', 1)} AS pct, "
    f"CASE WHEN {pct('n_out', 'n_rows', 1)} > 5 THEN 'bad' ELSE 'warn' END AS level "
    f"FROM {_iqr_block(EVENTS_NUMERIC, 'events')} i WHERE n_out > 0")

NAN_EVENTS = "nan_events AS (SELECT * REPLACE (CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(value AS DOUBLE) END AS value) FROM events)"

SQL["nan_describe"] = f"WITH {NAN_EVENTS}\n" + union([
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
    f"{r(f'min({c})')} AS min, {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS median, "
    f"{r(f'quantile_cont({c}, 0.75)')} AS q75, {r(f'max({c})')} AS max FROM nan_events" for c in EVENTS_NUMERIC])

SQL["nan_null_profile"] = (
    f"WITH {NAN_EVENTS}\nSELECT 'value' AS \"column\", count_if(value IS NULL) AS n_null, "
    f"{pct('count_if(value IS NULL)', 'count(*)', 2)} AS null_pct FROM nan_events")

SQL["nan_iqr_outliers"] = (
    f"WITH {NAN_EVENTS}\nSELECT \"column\", n_out AS n_outliers, {pct('n_out', 'n_rows', 1)} AS pct, "
    f"CASE WHEN {pct('n_out', 'n_rows', 1)} > 5 THEN 'bad' ELSE 'warn' END AS level "
    f"FROM {_iqr_block(EVENTS_NUMERIC, 'nan_events')} i WHERE n_out > 0")

SQL["whole_number_floats"] = with_do(union([
    f"SELECT '{c}' AS \"column\", bool_and({c} % 1 = 0) AS all_whole FROM dirty_orders" for c in DO_FLOATS]))


def _sentinel_rows(cols, table):
    parts = []
    for c in cols:
        for v in SENTINELS:
            parts.append(
                f"SELECT '{c}' AS \"column\", CAST({v} AS DOUBLE) AS sentinel, count_if({c} = {v}) AS n_hits, "
                f"quantile_cont({c}, 0.99) AS p99 FROM {table}")
    return f"(SELECT * FROM ({union(parts)}) u WHERE n_hits > 0 AND abs(sentinel) > abs(p99) * 1.5)"


SQL["sentinels"] = with_do(f"SELECT \"column\", sentinel, n_hits, CAST(p99 AS DOUBLE) AS p99 FROM {_sentinel_rows(DO_NUMERIC, 'dirty_orders')} s")

# name-implied domains of the dirty_orders numeric columns: (lo, hi, to_int)
DO_DOMAINS = {"customer_age": (0, 60, True), "unit_count": (0, None, True), "discount_rate": (0, 1, False)}


def _domain_part(c):
    lo, hi, to_int = DO_DOMAINS[c]
    hi_sql = "CAST(NULL AS DOUBLE)" if hi is None else f"CAST({hi} AS DOUBLE)"
    n_oor = f"count_if({c} < {lo})" + ("" if hi is None else f" + count_if({c} > {hi})")
    sents = f"(SELECT coalesce(sum(n_hits), 0) FROM {_sentinel_rows([c], 'dirty_orders')} s)"
    return (f"SELECT '{c}' AS \"column\", CAST({lo} AS DOUBLE) AS lo, {hi_sql} AS hi, {str(to_int).upper()} AS to_int, "
            f"{n_oor} AS n_oor, CAST({sents} AS BIGINT) AS n_sent FROM dirty_orders")


SQL["out_of_domain"] = with_do(union([_domain_part(c) for c in DO_DOMAINS]))

SQL["severity_cards"] = with_do(f"""
SELECT card, value, CASE
  WHEN card IN ('rows', 'columns') THEN 'ok'
  WHEN card = 'cells_missing_pct' THEN CASE WHEN value > 5 THEN 'bad' ELSE 'ok' END
  WHEN card = 'outlier_cols' THEN CASE WHEN value > 0 THEN 'warn' ELSE 'ok' END
  ELSE CASE WHEN value > 0 THEN 'bad' ELSE 'ok' END END AS level
FROM (
  SELECT 'rows' AS card, CAST(count(*) AS DOUBLE) AS value FROM dirty_orders
  UNION ALL SELECT 'columns', CAST(12 AS DOUBLE)
  UNION ALL SELECT 'cols_with_nulls', CAST(count_if(n_null > 0) AS DOUBLE) FROM ({_null_long(DO_COLS, 'dirty_orders')}) a
  UNION ALL SELECT 'cells_missing_pct', {pct('sum(n_null)', 'max(n_rows) * 12', 1)} FROM ({_null_long(DO_COLS, 'dirty_orders')}) b
  UNION ALL SELECT 'duplicates', CAST(sum(n - 1) AS DOUBLE) FROM (SELECT {', '.join(DO_COLS)}, count(*) AS n FROM dirty_orders GROUP BY ALL) g
  UNION ALL SELECT 'outlier_cols', CAST(count(*) AS DOUBLE) FROM {_iqr_block(DO_NUMERIC, 'dirty_orders')} i WHERE n_out > 0
) c""")


# ---------------------------------------------------------------------------
# text sniffing
# ---------------------------------------------------------------------------

DATE_RE = r"^(?:(\d{4}[-/]\d{1,2}[-/]\d{1,2})|(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}))"
NUMTXT_RE = r"^-?\d+(\.\d+)?$"
CASTABLE_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SLOTS_RE = r"^(\d{1,2})[-/](\d{1,2})[-/]\d{2,4}"


def strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def num_core(x):
    return f"regexp_replace(regexp_replace({strip(x)}, '^\\((.*)\\)$', '-\\1'), '[₹$€£,%\\s]', '', 'g')"


def text_to_number(x):
    core = num_core(x)
    val = f"(CASE WHEN regexp_matches({core}, '{CASTABLE_RE}') THEN CAST({core} AS DOUBLE) END)"
    return f"(CASE WHEN contains({strip(x)}, '%') THEN {val} / 100 ELSE {val} END)"


def _sniff(cols=DO_TEXT):
    parts = [f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM dirty_orders WHERE {c} IS NOT NULL" for c in cols]
    return f"""(SELECT "column", count(*) AS n_values,
  count_if(regexp_matches(v, '{DATE_RE}')) AS n_date,
  count_if(regexp_matches({num_core('v')}, '{NUMTXT_RE}')) AS n_num,
  count_if(contains({strip('v')}, '%')) AS n_pct
FROM ({union(parts)}) u GROUP BY "column")"""


SQL["date_pattern_rate"] = with_do(
    f"SELECT \"column\", n_values, n_date AS n_match, "
    f"round(CAST(n_date AS DOUBLE) / n_values, 6) AS rate FROM {_sniff()} s")

SQL["numeric_text_rate"] = with_do(
    f"SELECT \"column\", n_values, n_num AS n_match, "
    f"round(CAST(n_num AS DOUBLE) / n_values, 6) AS rate, n_pct, "
    f"round(CAST(n_pct AS DOUBLE) / n_values, 6) AS pct_share FROM {_sniff()} s")


def _slots(c):
    v = strip(f"CAST({c} AS VARCHAR)")
    a = f"TRY_CAST(NULLIF(regexp_extract({v}, '{SLOTS_RE}', 1), '') AS INTEGER)"
    b = f"TRY_CAST(NULLIF(regexp_extract({v}, '{SLOTS_RE}', 2), '') AS INTEGER)"
    return (f"SELECT '{c}' AS \"column\", coalesce(max(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END) > 12, FALSE) AS f, "
            f"coalesce(max(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END) > 12, FALSE) AS s FROM dirty_orders")


SQL["date_order"] = with_do(
    "SELECT \"column\", f AS first_gt12, s AS second_gt12, CASE WHEN f AND s THEN NULL WHEN f THEN 'dmy' "
    f"WHEN s THEN 'mdy' END AS convention FROM ({union([_slots(c) for c in DO_TEXT])}) x")

# ---------------------------------------------------------------------------
# rules R1-R8 on dirty_orders
# ---------------------------------------------------------------------------

# name hints of the dirty_orders columns (integer-like names for R8)
DO_INT_LIKE = {"customer_age", "unit_count"}


def _rules_sql():
    pos = {c: i for i, c in enumerate(DO_COLS)}
    sn = _sniff()
    null_rows = _null_long(DO_COLS, "dirty_orders")
    card = union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS u, count(*) AS n_rows FROM dirty_orders" for c in DO_TEXT])
    dist_null = union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + CASE WHEN count_if({c} IS NULL) > 0 THEN 1 ELSE 0 END AS d FROM dirty_orders" for c in DO_COLS])
    posmap = "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN {i}" for c, i in pos.items()) + " END"
    numeric_types = "(" + ", ".join(f"'{c}'" for c in DO_NUMERIC) + ")"
    dom_parts = []
    for c, (lo, hi, to_int) in DO_DOMAINS.items():
        hi_sql = "CAST(NULL AS DOUBLE)" if hi is None else f"CAST({hi} AS DOUBLE)"
        n_oor = f"count_if({c} < {lo})" + ("" if hi is None else f" + count_if({c} > {hi})")
        sents = f"(SELECT string_agg(CAST(sentinel AS VARCHAR), ',' ORDER BY sentinel) FROM {_sentinel_rows([c], 'dirty_orders')} s)"
        nsent = f"(SELECT coalesce(sum(n_hits), 0) FROM {_sentinel_rows([c], 'dirty_orders')} s)"
        dom_parts.append(f"SELECT '{c}' AS \"column\", CAST({lo} AS DOUBLE) AS lo, {hi_sql} AS hi, {str(to_int).upper()} AS to_int, "
                         f"{n_oor} AS n_oor, {nsent} AS n_sent, {sents} AS sentinels, count({c}) AS n FROM dirty_orders")
    whole = union([f"SELECT '{c}' AS \"column\", bool_and({c} % 1 = 0) AS w, count({c}) AS n FROM dirty_orders" for c in DO_FLOATS])
    return f"""sn AS {sn},
r1 AS (SELECT "column" FROM sn WHERE CAST(n_date AS DOUBLE) / n_values > 0.6),
r2 AS (SELECT "column", CAST(n_pct AS DOUBLE) / n_values > 0.5 AS is_pct FROM sn
       WHERE "column" NOT IN (SELECT "column" FROM r1) AND CAST(n_num AS DOUBLE) / n_values > 0.8),
nl AS (SELECT "column", n_null, n_rows, {pct('n_null', 'n_rows', 2)} AS p FROM ({null_rows}) x),
r6 AS (SELECT "column" FROM ({dist_null}) d WHERE d <= 1
       AND "column" NOT IN (SELECT "column" FROM r1) AND "column" NOT IN (SELECT "column" FROM r2)),
dom AS ({union(dom_parts)}),
r7 AS (SELECT * FROM dom WHERE n > 0 AND (n_oor > 0 OR n_sent > 0) AND "column" NOT IN (SELECT "column" FROM r6)),
wh AS ({whole}),
rules AS (
  SELECT 1 AS rule, {posmap} AS pos, 'to_datetime' AS type, "column" AS col, 'Validity' AS dim, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi,
         NULL::VARCHAR AS sentinels, NULL::BOOLEAN AS to_int, NULL::BOOLEAN AS is_percent FROM r1
  UNION ALL SELECT 2, {posmap}, 'to_numeric', "column", 'Validity', NULL, NULL, NULL, NULL, is_pct FROM r2
  UNION ALL SELECT 3, {posmap}, 'to_category', "column", 'Validity', NULL, NULL, NULL, NULL, NULL FROM ({card}) c
       WHERE u <= 25 AND n_rows >= 50 AND "column" NOT IN (SELECT "column" FROM r1) AND "column" NOT IN (SELECT "column" FROM r2)
  UNION ALL SELECT 4, 0, 'drop_duplicates', '_all_', 'Accuracy', NULL, NULL, NULL, NULL, NULL
       FROM (SELECT sum(n - 1) AS dups FROM (SELECT {', '.join(DO_COLS)}, count(*) AS n FROM dirty_orders GROUP BY ALL) g) x WHERE dups > 0
  UNION ALL SELECT 5, {posmap}, CASE WHEN p > 50 THEN 'drop_col' WHEN "column" IN {numeric_types} THEN 'fill_median' ELSE 'fill_mode' END,
       "column", 'Completeness', NULL, NULL, NULL, NULL, NULL FROM nl WHERE p > 0
  UNION ALL SELECT 6, {posmap}, 'drop_col', "column", 'Tidiness', NULL, NULL, NULL, NULL, NULL FROM r6
  UNION ALL SELECT 7, {posmap}, 'fix_range', "column", 'Accuracy', lo, hi, sentinels, to_int, NULL FROM r7
  UNION ALL SELECT 8, {posmap}, 'to_integer', "column", 'Validity', NULL, NULL, NULL, NULL, NULL FROM wh
       WHERE n > 0 AND w AND "column" IN ({', '.join(f"'{c}'" for c in sorted(DO_INT_LIKE))})
       AND "column" NOT IN (SELECT "column" FROM r6) AND "column" NOT IN (SELECT "column" FROM r7)
),
steps AS (SELECT row_number() OVER (ORDER BY rule, pos) AS step, * FROM rules)"""



# ---------------------------------------------------------------------------
# cleaning C1-C13 on dirty_orders
# ---------------------------------------------------------------------------

DMY = ["%d/%m/%Y", "%d-%m-%Y", "%d/%m/%y", "%d-%m-%y"]
MDY = ["%m/%d/%Y", "%m-%d-%Y", "%m/%d/%y", "%m-%d-%y"]
UNAMB = ["%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y"]
FALLBACK = ["%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%d/%m/%y", "%d-%m-%y", "%d.%m.%y",
            "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M",
            "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d %b %Y %H:%M:%S"]
# convention of each date column, as the A24 query finds it
DO_DATE_CONV = {"order_date_txt": DMY, "us_date_txt": MDY, "ambiguous_date_txt": []}


def parse_date(c, primary):
    v = strip(c)
    return "coalesce(" + ", ".join(f"try_strptime({v}, '{f}')" for f in primary + UNAMB + FALLBACK) + ")"


def _conv_cols():
    return {
        "order_date_txt": parse_date("order_date_txt", DO_DATE_CONV["order_date_txt"]),
        "us_date_txt": parse_date("us_date_txt", DO_DATE_CONV["us_date_txt"]),
        "ambiguous_date_txt": parse_date("ambiguous_date_txt", DO_DATE_CONV["ambiguous_date_txt"]),
        "amount_txt": text_to_number("amount_txt"),
        "rate_txt": text_to_number("rate_txt"),
    }


def _select(over: dict, cols=DO_COLS):
    return ", ".join(f"{over[c]} AS {c}" if c in over else c for c in cols)


def _mode(col, table):
    return f"(SELECT {col} FROM {table} WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)"


AGE_BAD = "(customer_age < 0 OR customer_age > 60 OR customer_age IN (999))"
DISC_BAD = "(discount_rate < 0 OR discount_rate > 1)"
KEPT = [c for c in DO_COLS if c not in ("sparse_note", "const_src")]

PIPELINE_CTES = f"""conv AS (SELECT {_select(_conv_cols())} FROM dirty_orders),
dd AS (SELECT DISTINCT * FROM conv),
fit1 AS (SELECT {_mode('order_date_txt', 'dd')} AS m_od, (SELECT quantile_cont(customer_age, 0.5) FROM dd) AS med_age,
                {_mode('status', 'dd')} AS m_status),
filled AS (SELECT {_select({'order_date_txt': 'coalesce(order_date_txt, m_od)', 'customer_age': 'coalesce(customer_age, med_age)',
                            'status': 'coalesce(status, m_status)'}, KEPT)} FROM dd, fit1),
fit2 AS (SELECT quantile_cont(CASE WHEN NOT {AGE_BAD} THEN customer_age END, 0.5) AS med_age2,
                quantile_cont(CASE WHEN NOT {DISC_BAD} THEN discount_rate END, 0.5) AS med_disc,
                count_if({AGE_BAD}) AS bad_age, count_if({DISC_BAD}) AS bad_disc FROM filled),
final AS (SELECT {_select({
    'customer_age': f'CAST(round_even(coalesce(CASE WHEN NOT {AGE_BAD} THEN customer_age END, med_age2), 0) AS BIGINT)',
    'discount_rate': f'coalesce(CASE WHEN NOT {DISC_BAD} THEN discount_rate END, med_disc)',
    'unit_count': 'CAST(round_even(unit_count, 0) AS BIGINT)'}, KEPT)} FROM filled, fit2)"""


def with_do_ctes(ctes: str, body: str) -> str:
    return f"WITH dirty_orders AS {dirty_orders_sql()},\n{ctes}\n{body}"


SQL["clean_pipeline"] = with_do_ctes(PIPELINE_CTES, "SELECT * FROM final")
SQL["suggestions"] = with_do_ctes(_rules_sql(), "SELECT step, type, col, dim, lo, hi, sentinels, to_int, is_percent FROM steps")

SQL["clean_to_datetime"] = with_do(
    f"SELECT row_id, {_select(_conv_cols(), ['order_date_txt', 'us_date_txt', 'ambiguous_date_txt'])} FROM dirty_orders")
SQL["clean_to_numeric"] = with_do(f"SELECT row_id, {_select(_conv_cols(), ['amount_txt', 'rate_txt'])} FROM dirty_orders")
SQL["clean_dedup"] = with_do("SELECT DISTINCT * FROM dirty_orders")


def _codes(c):
    return (f"(SELECT pos FROM (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS pos FROM "
            f"(SELECT DISTINCT {c} AS v FROM dirty_orders WHERE {c} IS NOT NULL) a) m WHERE m.v = d.{c})")


SQL["clean_category_codes"] = with_do(
    "SELECT row_id, status, " + _codes("status") + " AS status_code, sparse_note, " + _codes("sparse_note")
    + " AS sparse_note_code, const_src, " + _codes("const_src") + " AS const_src_code FROM dirty_orders d")
SQL["clean_drop_col"] = with_do(f"SELECT {', '.join(KEPT)} FROM dirty_orders")
SQL["clean_fill_median"] = with_do(
    "SELECT row_id, coalesce(customer_age, (SELECT quantile_cont(customer_age, 0.5) FROM dirty_orders)) AS customer_age FROM dirty_orders")
SQL["clean_fill_mode"] = with_do(
    f"SELECT row_id, coalesce(order_date_txt, {_mode('order_date_txt', 'dirty_orders')}) AS order_date_txt, "
    f"coalesce(status, {_mode('status', 'dirty_orders')}) AS status FROM dirty_orders")
SQL["clean_fix_range"] = with_do(
    f"SELECT row_id, CAST(round_even(coalesce(CASE WHEN NOT {AGE_BAD} THEN customer_age END, "
    f"(SELECT quantile_cont(CASE WHEN NOT {AGE_BAD} THEN customer_age END, 0.5) FROM dirty_orders)), 0) AS BIGINT) AS customer_age, "
    f"coalesce(CASE WHEN NOT {DISC_BAD} THEN discount_rate END, "
    f"(SELECT quantile_cont(CASE WHEN NOT {DISC_BAD} THEN discount_rate END, 0.5) FROM dirty_orders)) AS discount_rate FROM dirty_orders")
SQL["clean_to_integer"] = with_do("SELECT row_id, CAST(round_even(unit_count, 0) AS BIGINT) AS unit_count FROM dirty_orders")

SQL["before_after"] = with_do_ctes(PIPELINE_CTES, f"""
SELECT 'original' AS stage, count(*) AS n_rows, CAST(12 AS BIGINT) AS n_cols,
  CAST({' + '.join(f'count_if({c} IS NULL)' for c in DO_COLS)} AS BIGINT) AS n_nulls FROM dirty_orders
UNION ALL
SELECT 'cleaned', count(*), CAST({len(KEPT)} AS BIGINT), CAST({' + '.join(f'count_if({c} IS NULL)' for c in KEPT)} AS BIGINT) FROM final""")


def _cat_list(c):
    return f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM conv WHERE {c} IS NOT NULL) a)"


def _cat_n(c):
    return f"(SELECT count(DISTINCT {c}) FROM conv)"


SQL["cleaning_log"] = with_do_ctes(PIPELINE_CTES, f"""
SELECT CAST(step AS BIGINT) AS step, type, col, dim, CAST(n_affected AS BIGINT) AS n_affected,
       round(CAST(fitted_num AS DOUBLE), 6) AS fitted_num, fitted_text FROM (
  SELECT 1 AS step, 'to_datetime' AS type, 'order_date_txt' AS col, 'Validity' AS dim,
         (SELECT count_if(order_date_txt IS NOT NULL AND {_conv_cols()['order_date_txt']} IS NULL) FROM dirty_orders) AS n_affected,
         NULL AS fitted_num, 'dmy' AS fitted_text
  UNION ALL SELECT 2, 'to_datetime', 'us_date_txt', 'Validity',
         (SELECT count_if(us_date_txt IS NOT NULL AND {_conv_cols()['us_date_txt']} IS NULL) FROM dirty_orders), NULL, 'mdy'
  UNION ALL SELECT 3, 'to_datetime', 'ambiguous_date_txt', 'Validity',
         (SELECT count_if(ambiguous_date_txt IS NOT NULL AND {_conv_cols()['ambiguous_date_txt']} IS NULL) FROM dirty_orders), NULL, NULL
  UNION ALL SELECT 4, 'to_numeric', 'amount_txt', 'Validity', (SELECT count_if(contains(amount_txt, '%')) FROM dirty_orders), NULL, NULL
  UNION ALL SELECT 5, 'to_numeric', 'rate_txt', 'Validity', (SELECT count_if(contains(rate_txt, '%')) FROM dirty_orders), NULL, NULL
  UNION ALL SELECT 6, 'to_category', 'status', 'Validity', {_cat_n('status')}, NULL, {_cat_list('status')}
  UNION ALL SELECT 7, 'to_category', 'sparse_note', 'Validity', {_cat_n('sparse_note')}, NULL, {_cat_list('sparse_note')}
  UNION ALL SELECT 8, 'to_category', 'const_src', 'Validity', {_cat_n('const_src')}, NULL, {_cat_list('const_src')}
  UNION ALL SELECT 9, 'drop_duplicates', '_all_', 'Accuracy', (SELECT count(*) FROM conv) - (SELECT count(*) FROM dd), NULL, NULL
  UNION ALL SELECT 10, 'fill_mode', 'order_date_txt', 'Completeness', (SELECT count_if(order_date_txt IS NULL) FROM dd), NULL,
         (SELECT CAST(m_od AS VARCHAR) FROM fit1)
  UNION ALL SELECT 11, 'fill_median', 'customer_age', 'Completeness', (SELECT count_if(customer_age IS NULL) FROM dd),
         (SELECT med_age FROM fit1), NULL
  UNION ALL SELECT 12, 'fill_mode', 'status', 'Completeness', (SELECT count_if(status IS NULL) FROM dd), NULL, (SELECT m_status FROM fit1)
  UNION ALL SELECT 13, 'drop_col', 'sparse_note', 'Completeness', (SELECT count(sparse_note) FROM dd), NULL, NULL
  UNION ALL SELECT 14, 'drop_col', 'const_src', 'Tidiness', (SELECT count(const_src) FROM dd), NULL, NULL
  UNION ALL SELECT 15, 'fix_range', 'customer_age', 'Accuracy', (SELECT bad_age FROM fit2), (SELECT med_age2 FROM fit2), NULL
  UNION ALL SELECT 16, 'fix_range', 'discount_rate', 'Accuracy', (SELECT bad_disc FROM fit2), (SELECT med_disc FROM fit2), NULL
  UNION ALL SELECT 17, 'to_integer', 'unit_count', 'Validity', (SELECT count(unit_count) FROM filled), NULL, NULL
) l""")


# ---------------------------------------------------------------------------
# EDA (V1-V16)
# ---------------------------------------------------------------------------

Q = '"column"'


def _vals(cols, table, extra=""):
    return union([f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v{extra} FROM {table} WHERE {c} IS NOT NULL" for c in cols])


SQL["histogram"] = f"""WITH st AS ({union([f"SELECT '{c}' AS col, {i} AS pos, CAST(min({c}) AS DOUBLE) AS mn, CAST(max({c}) AS DOUBLE) AS mx, count({c}) AS n FROM events" for i, c in enumerate(EVENTS_NUMERIC)])}),
spec AS (SELECT col, mn, mx, least(40, greatest(10, CAST(floor(sqrt(n)) AS INTEGER))) AS b FROM st WHERE n >= 5),
grid AS (SELECT col, CAST(r.range AS BIGINT) AS bin, mn, mx, b FROM spec JOIN range(0, 40) r ON r.range < spec.b),
vals AS ({_vals(EVENTS_NUMERIC, 'events')}),
binned AS (SELECT vals.col, CASE WHEN mx > mn THEN least(floor(b * (v - mn) / (mx - mn)), b - 1) ELSE 0 END AS bin
           FROM vals JOIN spec ON vals.col = spec.col),
cnt AS (SELECT col, bin, count(*) AS n FROM binned GROUP BY col, bin)
SELECT g.col AS {Q}, g.bin, round(mn + (mx - mn) * g.bin / b, 6) AS lo, round(mn + (mx - mn) * (g.bin + 1) / b, 6) AS hi,
       coalesce(cnt.n, 0) AS count
FROM grid g LEFT JOIN cnt ON g.col = cnt.col AND g.bin = cnt.bin"""

SQL["distribution_stats"] = (
    f"SELECT {Q}, n, round(mean, 6) AS mean, round(median, 6) AS median, round(g, 2) AS skew, "
    "CASE WHEN round(g, 2) > 1 THEN 'right-skewed' WHEN round(g, 2) < -1 THEN 'left-skewed' ELSE 'symmetric' END AS shape FROM ("
    + union([f"SELECT '{c}' AS {Q}, count({c}) AS n, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, {g1(c)} AS g FROM events"
             for c in EVENTS_NUMERIC]) + ") x WHERE n >= 5")


def _z(c, table):
    return (f"(CASE WHEN (SELECT stddev_samp({c}) FROM {table}) > 0 THEN (CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM {table})) "
            f"/ (SELECT stddev_samp({c}) FROM {table}) ELSE CAST({c} AS DOUBLE) END)")


def _box(cols, table, key):
    zs = union([f"SELECT '{c}' AS col, {key} AS k, CAST({c} AS DOUBLE) AS v, {_z(c, table)} AS z FROM {table} WHERE {c} IS NOT NULL"
                for c in cols])
    return f"""zs AS ({zs}),
q AS (SELECT col, quantile_cont(z, 0.25) AS q1, quantile_cont(z, 0.5) AS med, quantile_cont(z, 0.75) AS q3 FROM zs GROUP BY col),
f AS (SELECT col, q1, med, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


SQL["zscore_box_stats"] = f"""WITH {_box(EVENTS_NUMERIC, 'events', 'event_id')}
SELECT f.col AS {Q}, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(lo, 6) AS lower_fence, round(hi, 6) AS upper_fence,
  round(min(CASE WHEN z >= lo AND z <= hi THEN z END), 6) AS whisker_lo, round(max(CASE WHEN z >= lo AND z <= hi THEN z END), 6) AS whisker_hi,
  count_if(z < lo OR z > hi) AS n_outliers
FROM f JOIN zs ON f.col = zs.col GROUP BY f.col, q1, med, q3, iqr, lo, hi"""

SQL["outlier_points"] = f"""WITH {_box(EVENTS_NUMERIC, 'events', 'event_id')}
SELECT zs.k AS event_id, zs.col AS {Q}, round(v, 6) AS value, round(z, 6) AS z FROM zs JOIN f ON zs.col = f.col
WHERE z < lo OR z > hi"""


def _pairs(cols, table):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i >= j:
                continue
            am = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
            bm = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            r = (f"CASE WHEN stddev_pop({am}) * stddev_pop({bm}) > 0 THEN covar_pop({am}, {bm}) / "
                 f"(stddev_pop({am}) * stddev_pop({bm})) END")
            parts.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS col_a, '{b}' AS col_b, {r} AS r, regr_slope({bm}, {am}) AS slope, "
                         f"regr_intercept({bm}, {am}) AS intercept, regr_count({bm}, {am}) AS n, min({am}) AS xmin, max({am}) AS xmax "
                         f"FROM {table}")
    return f"(SELECT * FROM ({union(parts)}) u WHERE r IS NOT NULL)"


LI_PAIRS = _pairs(LINEITEM_NUMERIC, "lineitem")
STRONGEST = f"(SELECT * FROM {LI_PAIRS} p ORDER BY abs(r) DESC, i, j LIMIT 1)"

SQL["correlation_matrix"] = f"""WITH p AS {LI_PAIRS},
d AS ({union([f"SELECT '{c}' AS col_a, '{c}' AS col_b, CASE WHEN stddev_pop({c}) > 0 THEN CAST(1 AS DOUBLE) END AS r FROM lineitem" for c in LINEITEM_NUMERIC])})
SELECT col_a, col_b, round(r, 6) AS r FROM p UNION ALL SELECT col_b, col_a, round(r, 6) FROM p
UNION ALL SELECT col_a, col_b, r FROM d"""

SQL["strongest_pair"] = f"SELECT col_a, col_b, round(r, 6) AS r FROM {STRONGEST} s"
SQL["top_correlations"] = (f"SELECT CAST(row_number() OVER (ORDER BY abs(r) DESC, i, j) AS BIGINT) AS rank, col_a, col_b, round(r, 3) AS r "
                           f"FROM {LI_PAIRS} p ORDER BY abs(r) DESC, i, j LIMIT 5")
SQL["ols_fit"] = (f"SELECT col_a AS x_col, col_b AS y_col, round(slope, 6) AS slope, round(intercept, 6) AS intercept, n, "
                  f"round(r, 6) AS r FROM {STRONGEST} s WHERE n >= 2 AND xmin < xmax")
SQL["ols_line"] = (f"SELECT CAST(g.range AS BIGINT) AS i, round(xmin + (xmax - xmin) * g.range / 99, 6) AS x, "
                   f"round(slope * (xmin + (xmax - xmin) * g.range / 99) + intercept, 6) AS y "
                   f"FROM {STRONGEST} s JOIN range(0, 100) g ON TRUE WHERE n >= 2 AND xmin < xmax")


def _pick(col_expr):
    return "CASE " + col_expr + " " + " ".join(f"WHEN '{c}' THEN CAST({c} AS DOUBLE)" for c in LINEITEM_NUMERIC) + " END"


LI_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

SQL["scatter_sample"] = f"""WITH s AS {STRONGEST},
pts AS (SELECT l.*, {_pick('s.col_a')} AS x, {_pick('s.col_b')} AS y FROM lineitem l JOIN s ON TRUE)
SELECT l_orderkey, l_linenumber, x, y, l_returnflag AS color FROM pts WHERE x IS NOT NULL AND y IS NOT NULL
ORDER BY md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || ':42'), {LI_ORDER} LIMIT 50000"""

SQL["random_sample"] = "SELECT * FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 10"
SQL["head_preview"] = f"SELECT * FROM lineitem ORDER BY {LI_ORDER} LIMIT 10"

PART_TEXT = ["p_name", "p_brand", "p_type"]


def _freq(cols, table, k):
    parts = [f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}"
             for c in cols]
    return (f"(SELECT col, value, n, CAST(row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS BIGINT) AS rank "
            f"FROM ({union(parts)}) u QUALIFY rank <= {k})")


SQL["category_frequency"] = (f"SELECT col AS {Q}, rank, value, n AS count, {pct('n', '(SELECT count(*) FROM part)', 1)} AS pct "
                             f"FROM {_freq(PART_TEXT, 'part', 20)} f")
SQL["dominant_share"] = (f"SELECT col AS {Q}, value AS dominant, {pct('n', '(SELECT count(*) FROM part)', 1)} AS dominant_pct, "
                         f"{pct('n', '(SELECT count(*) FROM part)', 1)} > 70 AS imbalanced FROM {_freq(PART_TEXT, 'part', 1)} f")
SQL["top_categories"] = f"SELECT col AS {Q}, rank, value, n AS count FROM {_freq(PART_TEXT, 'part', 5)} f"

TS_DOWN = f"""(SELECT idx, l_shipdate AS ts, CAST(l_extendedprice AS DOUBLE) AS value FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY {LI_ORDER}) - 1 AS BIGINT) AS idx FROM lineitem
  WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL) x,
  (SELECT CASE WHEN count(*) > 50000 THEN count(*) // 50000 + 1 ELSE 1 END AS k FROM lineitem
   WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL) kk WHERE idx % k = 0)"""

SQL["ts_downsample"] = f"SELECT * FROM {TS_DOWN} d"
def exact_mean_duck(sum_col, cnt_col, d=6, scale=10):
    """DuckDB twin of functions.scalar.exact_mean_sql (HUGEINT arithmetic)."""
    t = f"CAST({sum_col} * {10 ** scale} AS HUGEINT)"
    den = f"(CAST({cnt_col} AS HUGEINT) * {10 ** (scale - d)})"
    return f"(CAST(sign({t}) * ((abs({t}) * 2 + {den}) // ({den} * 2)) AS DOUBLE) / {10 ** d})"


SQL["ts_rolling_mean"] = f"""WITH d AS (SELECT CAST(row_number() OVER (ORDER BY idx) - 1 AS BIGINT) AS pos, ts, value FROM {TS_DOWN} x),
p AS (SELECT count(*) AS m, greatest(5, count(*) // 20) AS w FROM d)
SELECT pos, ts, round(value, 6) AS value,
  CASE WHEN (SELECT m FROM p) >= 20 THEN {exact_mean_duck('s', 'n')} END AS rolling_mean
FROM (SELECT *, sum(CAST(value AS DECIMAL(38,10))) OVER (ORDER BY pos ROWS BETWEEN (SELECT w FROM p) - 1 PRECEDING AND CURRENT ROW) AS s,
      count(value) OVER (ORDER BY pos ROWS BETWEEN (SELECT w FROM p) - 1 PRECEDING AND CURRENT ROW) AS n FROM d) d2
WHERE (SELECT m FROM p) >= 5"""

SQL["null_map"] = with_do_ctes(f"""h AS (SELECT *, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS row_idx FROM dirty_orders
        ORDER BY row_id LIMIT 250),
nc AS (SELECT col FROM ({union([f"SELECT '{c}' AS col, count_if({c} IS NULL) AS n FROM dirty_orders" for c in DO_COLS])}) u WHERE n > 0),
m AS ({union([f"SELECT row_idx, '{c}' AS col, CAST({c} IS NULL AS INTEGER) AS is_null FROM h" for c in DO_COLS])})""",
    f"SELECT row_idx, m.col AS {Q}, is_null FROM m JOIN nc ON m.col = nc.col")

# ---------------------------------------------------------------------------
# evidence (E1, E6, E7) and CSV round trips
# ---------------------------------------------------------------------------

SQL["numeric_evidence"] = union([
    f"SELECT '{c}' AS {Q}, {r(f'avg({c})')} AS mean, {r(f'quantile_cont({c}, 0.5)')} AS median, {r(f'stddev_samp({c})')} AS std, "
    f"{r(f'min({c})')} AS min, {r(f'max({c})')} AS max FROM lineitem" for c in LINEITEM_NUMERIC])

SQL["dialogue_context"] = """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
SELECT u.conv_id, u.turn, CAST(u.rn - p.rn AS BIGINT) AS ctx_offset, p.turn AS ctx_turn, p.role AS ctx_role, p.text AS ctx_text
FROM c u JOIN c p ON p.conv_id = u.conv_id AND p.rn BETWEEN u.rn - 6 AND u.rn - 1 WHERE u.role = 'user'"""

_DO_OUTLIERS = (f"(SELECT coalesce(string_agg(\"column\", ', ' ORDER BY pos), 'none') FROM "
                f"(SELECT u.*, CASE \"column\" " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(DO_COLS))
                + f" END AS pos FROM {_iqr_block(DO_NUMERIC, 'dirty_orders')} u WHERE n_out > 0) o)")

SQL["report_facts"] = with_do_ctes(_rules_sql(), f"""
SELECT 'n_rows' AS fact, CAST(count(*) AS VARCHAR) AS value FROM dirty_orders
UNION ALL SELECT 'n_cols', '12'
UNION ALL SELECT 'duplicates', CAST(sum(n - 1) AS VARCHAR) FROM (SELECT {', '.join(DO_COLS)}, count(*) AS n FROM dirty_orders GROUP BY ALL) g
UNION ALL SELECT 'cols_with_nulls', CAST(count_if(n_null > 0) AS VARCHAR) FROM ({_null_long(DO_COLS, 'dirty_orders')}) x
UNION ALL SELECT 'outlier_cols', {_DO_OUTLIERS}
UNION ALL SELECT 'cleaning_steps', CAST(count(*) AS VARCHAR) FROM steps""")

SQL["csv_roundtrip"] = ("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment "
                        "FROM customer")
LINEITEM_TEXT = ["l_returnflag", "l_linestatus"]
LINEITEM_DTYPES = {
    **{c: "bigint" for c in LINEITEM_NUMERIC[:3]}, "l_linenumber": "int", **{c: "double" for c in LINEITEM_NUMERIC[4:]},
    **{c: "string" for c in LINEITEM_TEXT}, "l_shipdate": "timestamp_ntz",
}
_ALL_NUMERIC = ",".join(LINEITEM_NUMERIC)
_ALL_LINEITEM = [*LINEITEM_NUMERIC, *LINEITEM_TEXT, "l_shipdate"]

SQL["chart_catalog"] = f"""WITH n AS (SELECT count(*) AS n_rows FROM lineitem),
c AS ({union([f"SELECT '{c}' AS c, {i} AS pos, count({c}) AS n, count(*) - count({c}) AS nulls FROM lineitem" for i, c in enumerate(_ALL_LINEITEM)])})
SELECT 'histogram' AS chart, c AS columns, n AS n_rows, 'How do the values of ' || c || ' spread?' AS question FROM c
  WHERE n >= 5 AND c IN ({', '.join(f"'{c}'" for c in LINEITEM_NUMERIC)})
UNION ALL SELECT 'zscore_box', '{_ALL_NUMERIC}', n_rows, 'Where do values lie far from the rest?' FROM n
UNION ALL SELECT 'scatter_fit', '{_ALL_NUMERIC}', n_rows, 'Does a line describe the closest pair?' FROM n
UNION ALL SELECT 'correlation_matrix', '{_ALL_NUMERIC}', n_rows, 'Which numbers rise and fall as one?' FROM n
UNION ALL SELECT 'category_frequency', c, n_rows, 'Which values of ' || c || ' are common?' FROM c, n
  WHERE c IN ({', '.join(f"'{c}'" for c in LINEITEM_TEXT)})
UNION ALL SELECT 'time_series', 'l_shipdate,{LINEITEM_NUMERIC[0]}', n_rows, 'How does {LINEITEM_NUMERIC[0]} change with l_shipdate?' FROM n
UNION ALL SELECT 'null_map', string_agg(c, ',' ORDER BY pos), least(max(n_rows), 250), 'Do nulls come in blocks?' FROM c, n
  WHERE nulls > 0 HAVING count(*) > 0"""

_FIELDS = {"count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "q25": "quantile_cont({c}, 0.25)",
           "median": "quantile_cont({c}, 0.5)", "q75": "quantile_cont({c}, 0.75)", "max": "max({c})"}

SQL["data_context_rows"] = union([
    "SELECT 'shape' AS section, 'rows' AS key, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS text, CAST(count(*) AS DOUBLE) AS value FROM lineitem",
    f"SELECT 'shape', 'columns', NULL, NULL, CAST({len(_ALL_LINEITEM)} AS DOUBLE)",
    *[f"SELECT 'dtypes', '{c}', NULL, '{t}', NULL" for c, t in LINEITEM_DTYPES.items()],
    *[f"SELECT 'describe', '{c}', '{k}', NULL, {r(x.format(c=c))} + 0.0 FROM lineitem" for c in LINEITEM_NUMERIC for k, x in _FIELDS.items()],
])

SQL["csv_latin1"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"


# ---------------------------------------------------------------------------
# rows of any type, every row, every format
# ---------------------------------------------------------------------------

# equal maps hold the same entries in any order: the entries themselves stand for the map
_TAGGED = "(SELECT o_orderstatus AS status, o_orderpriority AS pri, CAST(o_orderkey % 5 AS VARCHAR) AS mod FROM orders)"
SQL["duplicate_count_map"] = ("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_duplicates "
                              f"FROM (SELECT status, pri, mod, count(*) AS n FROM {_TAGGED} t GROUP BY ALL) g")
SQL["clean_dedup_map"] = f"SELECT DISTINCT status, pri, mod, CAST(0 AS DOUBLE) AS zero FROM {_TAGGED} t"

SQL["rolling_mean_all"] = f"""WITH d AS (SELECT CAST(row_number() OVER (ORDER BY {LI_ORDER}) - 1 AS BIGINT) AS idx, l_shipdate AS ts, CAST(l_extendedprice AS DOUBLE) AS value
  FROM lineitem WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL),
p AS (SELECT count(*) AS m, greatest(5, count(*) // 20) AS w, CASE WHEN count(*) > 50000 THEN count(*) // 50000 + 1 ELSE 1 END AS k FROM d)
SELECT idx, ts, round(value, 6) AS value, CASE WHEN (SELECT m FROM p) >= 20 THEN {exact_mean_duck('s', 'n')} END AS rolling_mean
FROM (SELECT *, sum(CAST(value AS DECIMAL(38,10))) OVER (ORDER BY idx ROWS BETWEEN (SELECT w FROM p) - 1 PRECEDING AND CURRENT ROW) AS s,
      count(value) OVER (ORDER BY idx ROWS BETWEEN (SELECT w FROM p) - 1 PRECEDING AND CURRENT ROW) AS n FROM d) x
WHERE (SELECT m FROM p) >= 5 AND idx % (SELECT k FROM p) = 0"""


def _first_parsed(v, formats):
    """The first format that reads a text; four digits of a year are four digits."""
    return "coalesce(" + ", ".join(
        f"(CASE WHEN year(try_strptime({v}, '{f}')) >= 1000 THEN try_strptime({v}, '{f}') END)" for f in formats) + ")"


SQL["date_formats"] = (f"SELECT order_key, txt, {_first_parsed('txt', DMY + UNAMB + FALLBACK)} AS day_first, "
                       f"{_first_parsed('txt', MDY + UNAMB + FALLBACK)} AS month_first, {_first_parsed('txt', UNAMB + FALLBACK)} AS undecided "
                       f"FROM {dated_orders_sql()} t")
SQL["constant_flags"] = with_do(union([
    f"SELECT '{c}' AS \"column\", count({c}) = 0 OR (count({c}) = count(*) AND min({c}) = max({c})) AS is_constant FROM dirty_orders" for c in DO_COLS]))
SQL["melt_events"] = union([f"SELECT event_id, '{c}' AS {Q}, CAST({c} AS DOUBLE) AS value FROM events WHERE {c} IS NOT NULL" for c in ("user_id", "value")])

_NOTES = {
    "to_datetime": "CASE fitted_text WHEN 'dmy' THEN 'day-first order detected' WHEN 'mdy' THEN 'month-first order detected' "
                   "ELSE 'order could not be determined; leftovers parsed day-first' END",
    "to_numeric": "'''%'' values divided by 100; symbols stripped'", "to_category": "'stored as text; category list recorded'",
    "drop_duplicates": "'exact duplicate rows removed'", "fill_median": "'nulls filled with the median'", "fill_mode": "'nulls filled with the mode'",
    "drop_col": "CASE dim WHEN 'Tidiness' THEN 'constant column' ELSE 'mostly null column' END",
    "fix_range": "'impossible values replaced by the median of valid ones' || CASE col WHEN 'customer_age' THEN '; rounded to whole numbers' ELSE '' END",
    "to_integer": "'rounded to whole numbers, nulls kept'",
}
SQL["log_sink"] = (
    "SELECT '#' || lpad(CAST(step AS VARCHAR), 2, '0') || ' ' || type || ' ''' || col || '''' || "
    "coalesce(' -> ' || coalesce(fitted_text, CAST(round(fitted_num, 4) AS VARCHAR)), '') || ' (' || CAST(n_affected AS VARCHAR) || ' affected) ' || "
    "CASE type " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in _NOTES.items()) + f" END || ' [' || dim || ']' AS line FROM ({SQL['cleaning_log']}) c")

SQL["step_isolation"] = """SELECT * FROM (VALUES
  (CAST(1 AS BIGINT), 'fill_median', 'o_orderdate', CAST(NULL AS BIGINT), 'skipped: not possible on timestamp_ntz'),
  (2, 'shout', 'o_orderstatus', NULL, 'skipped: unknown step type ''shout'''),
  (3, 'range_flag', 'o_totalprice', 0, 'flagged for manual review')) v(step, type, col, n_affected, note),
  (SELECT CAST(sum(CAST(round_even(o_totalprice, 0) AS BIGINT)) AS BIGINT) AS total_after FROM orders) t
UNION ALL SELECT 4, 'to_integer', 'o_totalprice', count(o_totalprice), 'rounded to whole numbers, nulls kept',
  CAST(sum(CAST(round_even(o_totalprice, 0) AS BIGINT)) AS BIGINT) FROM orders"""

_EVIDENCE_FIELDS = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})"}
_NONE = "CAST(NULL AS VARCHAR)"
SQL["evidence_rows"] = union([
    f"SELECT 'shape' AS section, 'rows' AS key, {_NONE} AS field, {_NONE} AS text, CAST(count(*) AS DOUBLE) AS value FROM lineitem",
    f"SELECT 'shape', 'columns', NULL, NULL, CAST({len(_ALL_LINEITEM)} AS DOUBLE)",
    "SELECT 'cleaning_steps', '01', 'to_category', 'l_returnflag', CAST(count(DISTINCT l_returnflag) AS DOUBLE) FROM lineitem",
    "SELECT 'cleaning_steps', '02', 'to_category', 'l_linestatus', CAST(count(DISTINCT l_linestatus) AS DOUBLE) FROM lineitem",
    "SELECT 'cleaning_steps', '03', 'to_integer', 'l_quantity', CAST(count(l_quantity) AS DOUBLE) FROM lineitem",
    f"SELECT 'outliers', \"column\", NULL, NULL, CAST(n_out AS DOUBLE) FROM {_iqr_block(LINEITEM_NUMERIC, 'lineitem')} i WHERE n_out > 0",
    "SELECT 'skewness', c, NULL, NULL, round(g, 3) FROM (" + union([f"SELECT '{c}' AS c, count({c}) AS n, {g1(c)} AS g FROM lineitem" for c in LINEITEM_NUMERIC])
    + ") s WHERE n >= 10 AND abs(g) > 1",
    *[f"SELECT 'numeric', '{c}', '{k}', NULL, {r(x.format(c=c))} + 0.0 FROM lineitem" for c in LINEITEM_NUMERIC for k, x in _EVIDENCE_FIELDS.items()],
    f"SELECT 'top_categories', col, CAST(rank AS VARCHAR), value, CAST(n AS DOUBLE) FROM {_freq(LINEITEM_TEXT, 'lineitem', 5)} f",
    "SELECT 'correlations', col_a, col_b, CAST(rank AS VARCHAR), r FROM (" + SQL["top_correlations"] + ") t",
])


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

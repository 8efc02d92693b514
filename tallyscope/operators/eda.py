"""Tables behind the exploratory charts.

Statistics always use the full table; only plotted points are sampled.
"""

from __future__ import annotations

import decimal
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig
from ..functions.scalar import exact_mean_sql, nan_as_null, pct, rnd
from ..session import materialize
from ..sources.preview import seeded_sample
from . import freq as freqmod
from .kinds import categorical_cols, datetime_cols, numeric_cols, q
from .profile import agg_row, column_stats
from .quantiles import exact_quantiles
from .rowindex import BUCKET, at_bucket, before_each, bucketed, with_row_index, with_tie

PLOT_SAMPLE_ROWS = 50_000


def _c(name):
    return F.col(q(name))


# ---------------------------------------------------------------------------
# V1/V2 histograms and distribution stats
# ---------------------------------------------------------------------------

def n_bins(n: int) -> int:
    return min(40, max(10, int(math.sqrt(n))))


@nan_as_null
def histogram(df: DataFrame, cols: list[str] | None = None, first: int | None = None, min_n: int = 5,
              decimals: int | None = 6) -> DataFrame:
    """V1: equal-width bins over [min, max], b = min(40, max(10, floor(sqrt(n)))), empty bins kept.

    One aggregate for the ranges, one explode + groupBy(column, bin) for the
    counts; the bin grid (<= 40 rows per column) is a literal table.
    """
    cols = numeric_cols(df, first) if cols is None else cols
    st = column_stats(df, cols)
    spec = {}
    for c in cols:
        n = st[c]["n"]
        if n < min_n:
            continue
        spec[c] = (float(st[c]["min"]), float(st[c]["max"]), n_bins(n))
    spark = df.sparkSession
    if not spec:
        return spark.createDataFrame([], "column string, bin bigint, lo double, hi double, count bigint")
    items = []
    for c, (mn, mx, b) in spec.items():
        v = _c(c).cast("double")
        if mx > mn:
            bin_ = F.least(F.floor(F.lit(b) * (v - F.lit(mn)) / F.lit(mx - mn)), F.lit(b - 1))
        else:
            bin_ = F.lit(0).cast("bigint")
        items.append(F.when(v.isNotNull(), F.struct(F.lit(c).alias("column"), bin_.cast("bigint").alias("bin"))))
    counts = (df.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))
              .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = spark.createDataFrame([(c, i, mn, mx, b) for c, (mn, mx, b) in spec.items() for i in range(b)],
                                 "column string, bin bigint, mn double, mx double, b int")
    lo = F.col("mn") + (F.col("mx") - F.col("mn")) * F.col("bin") / F.col("b")
    hi = F.col("mn") + (F.col("mx") - F.col("mn")) * (F.col("bin") + 1) / F.col("b")
    # the grid holds at most 40 rows per column: broadcast it
    return (F.broadcast(grid).join(counts, ["column", "bin"], "left")
            .select("column", "bin", rnd(lo, decimals).alias("lo"), rnd(hi, decimals).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


@nan_as_null
def distribution_stats(df: DataFrame, cols: list[str] | None = None, first: int | None = None, min_n: int = 5,
                       decimals: int | None = 6, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """V2: mean, median, skew (2 dp) and a shape label per histogram column."""
    cols = numeric_cols(df, first) if cols is None else cols
    st = column_stats(df, cols, probs=[0.5], cfg=cfg)
    cols = [c for c in cols if st[c]["n"] >= min_n]
    rows = [(c, st[c]["n"], st[c]["mean"], st[c]["q"][0], st[c]["g1"]) for c in cols]
    t = df.sparkSession.createDataFrame(rows, "column string, n bigint, mean double, median double, g1 double")
    sk = F.round("g1", 2)
    return t.select("column", "n", rnd(F.col("mean"), decimals).alias("mean"), rnd(F.col("median"), decimals).alias("median"),
                    sk.alias("skew"),
                    F.when(sk > 1, "right-skewed").when(sk < -1, "left-skewed").otherwise("symmetric").alias("shape"))


# ---------------------------------------------------------------------------
# V3-V5 z-scores and box statistics
# ---------------------------------------------------------------------------

def zscore_exprs(df: DataFrame, cols: list[str], stats: dict) -> dict:
    out = {}
    for c in cols:
        s = stats[c]
        x = _c(c).cast("double")
        if s.get("std") is not None and s["std"] > 0:
            out[c] = (x - F.lit(float(s["mean"]))) / F.lit(float(s["std"]))
        else:
            out[c] = x
    return out


@nan_as_null
def box_stats(df: DataFrame, cols: list[str] | None = None, k: float = 1.5, cfg: AuditConfig = DEFAULT) -> dict:
    """Quartiles of z = (x - mean) / std (a monotone linear map, so they are the
    z of x's exact quartiles), fences, whiskers inside the fences and outlier counts."""
    cols = numeric_cols(df) if cols is None else cols
    st = column_stats(df, cols, higher=False, probs=[0.25, 0.5, 0.75], cfg=cfg)
    z = zscore_exprs(df, cols, st)
    boxes = {}
    exprs = []
    for i, c in enumerate(cols):
        if st[c]["n"] == 0:
            continue
        s = st[c]
        scale = s["std"] is not None and s["std"] > 0
        q1, med, q3 = [((v - s["mean"]) / s["std"]) if scale else v for v in s["q"]]
        iqr = q3 - q1
        lo, hi = q1 - k * iqr, q3 + k * iqr
        boxes[c] = {"q1": q1, "median": med, "q3": q3, "iqr": iqr, "lo": lo, "hi": hi, "z": z[c]}
        inside = (z[c] >= F.lit(lo)) & (z[c] <= F.lit(hi))
        exprs += [F.min(F.when(inside, z[c])).alias(f"wl{i}"), F.max(F.when(inside, z[c])).alias(f"wh{i}"),
                  F.count_if((z[c] < F.lit(lo)) | (z[c] > F.lit(hi))).alias(f"o{i}")]
    row = agg_row(df, exprs) if exprs else {}
    for i, c in enumerate(cols):
        if c in boxes:
            boxes[c].update({"whisker_lo": row[f"wl{i}"], "whisker_hi": row[f"wh{i}"], "n_outliers": int(row[f"o{i}"])})
    return boxes


@nan_as_null
def zscore_box_stats(df: DataFrame, cols: list[str] | None = None, decimals: int | None = 6,
                     cfg: AuditConfig = DEFAULT) -> DataFrame:
    """V3/V4: box statistics of the z-scored numeric columns (quartiles exact, linear)."""
    cols = numeric_cols(df) if cols is None else cols
    b = box_stats(df, cols, cfg=cfg)
    rows = [(c, v["q1"], v["median"], v["q3"], v["iqr"], v["lo"], v["hi"], v["whisker_lo"], v["whisker_hi"], v["n_outliers"])
            for c, v in b.items()]
    t = df.sparkSession.createDataFrame(
        rows, "column string, q1 double, median double, q3 double, iqr double, lower_fence double, upper_fence double, "
              "whisker_lo double, whisker_hi double, n_outliers bigint")
    return t.select("column", *[rnd(F.col(x), decimals).alias(x) for x in
                                ("q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "whisker_lo", "whisker_hi")],
                    "n_outliers")


@nan_as_null
def outlier_points(df: DataFrame, key: list[str], cols: list[str] | None = None, decimals: int | None = 6,
                   cfg: AuditConfig = DEFAULT) -> DataFrame:
    """V5: every value outside its column's z-score fences, with its row key.

    The fences are literals, so this is a filter over one explode: no join."""
    cols = numeric_cols(df) if cols is None else cols
    b = box_stats(df, cols, cfg=cfg)
    items = []
    for c, v in b.items():
        zc = v["z"]
        items.append(F.when((zc < F.lit(v["lo"])) | (zc > F.lit(v["hi"])),
                            F.struct(F.lit(c).alias("column"), _c(c).cast("double").alias("value"), zc.alias("z"))))
    if not items:
        return df.sparkSession.createDataFrame([], ", ".join(f"{k} string" for k in key) + ", column string, value double, z double")
    return (df.select(*[_c(k) for k in key], F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))
            .select(*[_c(k) for k in key], "column", rnd(F.col("value"), decimals).alias("value"),
                    rnd(F.col("z"), decimals).alias("z")))


# ---------------------------------------------------------------------------
# V6-V9, E3 correlations and the line fit
# ---------------------------------------------------------------------------

#: Columns of one block of the product matrices.
_PRODUCT_BLOCK = 256
_PAIR_SUMS = "i int, j int, n bigint, sx double, sy double, xx double, yy double, xy double"


def _pair_sums(df: DataFrame, cols: list[str], centres: list[float]) -> DataFrame:
    """(i, j, n, sx, sy, xx, yy, xy) of every pair i < j over the rows that have both, centred.

    One scan for any number of columns: a task multiplies its rows' matrix and null mask with themselves
    in blocks of columns, adds the products up over its batches and puts out one row a pair; tasks add up
    by a sum. Every pair has the same formula, with nulls or without."""
    k, block, centre = len(cols), _PRODUCT_BLOCK, list(centres)

    def run(batches):
        starts = list(range(0, k, block))
        sums = {}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.empty((0, k))
            there = ~np.isnan(x)
            d = np.where(there, x - np.array(centre), 0.0)
            there, squares = there.astype(np.float64), d * d
            for a in starts:
                for b in starts:
                    if b < a:
                        continue
                    m, p = slice(a, a + block), slice(b, b + block)
                    new = [there[:, m].T @ there[:, p], d[:, m].T @ there[:, p], there[:, m].T @ d[:, p],
                           squares[:, m].T @ there[:, p], there[:, m].T @ squares[:, p], d[:, m].T @ d[:, p]]
                    old = sums.get((a, b))
                    sums[(a, b)] = new if old is None else [u + v for u, v in zip(old, new)]
        for (a, b), found in sums.items():
            i, j = np.nonzero(np.ones(found[0].shape, bool) if a != b else np.triu(np.ones(found[0].shape, bool), 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array((i + a).astype(np.int32)), pa.array((j + b).astype(np.int32)), pa.array(found[0][i, j].astype(np.int64)),
                 *[pa.array(f[i, j]) for f in found[1:]]], names=["i", "j", "n", "sx", "sy", "xx", "yy", "xy"])

    numbers = df.select(*[_c(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = numbers.mapInArrow(run, _PAIR_SUMS)
    return parts.groupBy("i", "j").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("sx", "sy", "xx", "yy", "xy")])


@nan_as_null
def correlations(df: DataFrame, cols: list[str] | None = None, stats: dict | None = None) -> dict:
    """Pairwise-complete Pearson r for every pair i<j, plus each column's std.

    Sums are centred by the columns' means (``stats``: those of an audit of the same frame). A column that is
    constant on the rows both have gives no r."""
    cols = numeric_cols(df) if cols is None else cols
    st = stats if stats is not None and all(c in stats for c in cols) else column_stats(df, cols, higher=False)
    res = {(i, j): None for i in range(len(cols)) for j in range(i + 1, len(cols))}
    if res:
        centres = [float(st[c]["mean"]) if st[c]["mean"] is not None else 0.0 for c in cols]
        for r in _pair_sums(df, cols, centres).toLocalIterator():   # one row per pair
            if not r["n"]:
                continue
            sxx = r["xx"] - r["sx"] * r["sx"] / r["n"]
            syy = r["yy"] - r["sy"] * r["sy"] / r["n"]
            sxy = r["xy"] - r["sx"] * r["sy"] / r["n"]
            a, b = cols[r["i"]], cols[r["j"]]
            if st[a]["min"] == st[a]["max"] or st[b]["min"] == st[b]["max"]:
                continue
            # constant on the rows both have: what is left is rounding
            if sxx <= 1e-12 * r["xx"] or syy <= 1e-12 * r["yy"]:
                continue
            res[(r["i"], r["j"])] = max(-1.0, min(1.0, sxy / (sxx * syy) ** 0.5))
    return {"cols": cols, "std": {c: st[c]["std"] for c in cols}, "const": {c: st[c]["min"] == st[c]["max"] for c in cols}, "r": res}


@nan_as_null
def correlation_matrix(df: DataFrame, cols: list[str] | None = None, decimals: int | None = 6) -> DataFrame:
    """V6: the full symmetric matrix in long form (col_a, col_b, r); diagonal 1 unless constant."""
    res = correlations(df, cols)
    cols = res["cols"]
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                r = None if res["const"][a] or res["std"][a] is None else 1.0
            else:
                r = res["r"][(min(i, j), max(i, j))]
            rows.append((a, b, r))
    t = df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double")
    return t.select("col_a", "col_b", rnd(F.col("r"), decimals).alias("r"))


def ranked_pairs(res: dict) -> list[tuple]:
    """Distinct pairs by |r| descending, then row-major position; NULL r dropped."""
    items = [(abs(r), i, j, r) for (i, j), r in res["r"].items() if r is not None]
    items.sort(key=lambda t: (-t[0], t[1], t[2]))
    return [(res["cols"][i], res["cols"][j], r) for _, i, j, r in items]


@nan_as_null
def strongest_pair(df: DataFrame, cols: list[str] | None = None, decimals: int | None = 6) -> DataFrame:
    """V7: the pair with the largest |r| (off-diagonal, unrounded)."""
    pairs = ranked_pairs(correlations(df, cols))[:1]
    t = df.sparkSession.createDataFrame(pairs, "col_a string, col_b string, r double")
    return t.select("col_a", "col_b", rnd(F.col("r"), decimals).alias("r"))


@nan_as_null
def top_correlations(df: DataFrame, cols: list[str] | None = None, k: int = 5, decimals: int | None = 3,
                     stats: dict | None = None) -> DataFrame:
    """The k strongest distinct pairs, signed r."""
    pairs = [(i + 1, a, b, r) for i, (a, b, r) in enumerate(ranked_pairs(correlations(df, cols, stats))[:k])]
    t = df.sparkSession.createDataFrame(pairs, "rank bigint, col_a string, col_b string, r double")
    return t.select("rank", "col_a", "col_b", rnd(F.col("r"), decimals).alias("r"))


@nan_as_null
def ols_fit_values(df: DataFrame, x: str, y: str) -> dict:
    both = _c(x).isNotNull() & _c(y).isNotNull()
    xv, yv = F.when(both, _c(x).cast("double")), F.when(both, _c(y).cast("double"))
    row = df.agg(F.regr_slope(yv, xv).alias("slope"), F.regr_intercept(yv, xv).alias("intercept"),
                 F.regr_count(yv, xv).alias("n"), F.min(xv).alias("xmin"), F.max(xv).alias("xmax")).first()
    ok = row["n"] >= 2 and row["xmin"] is not None and row["xmin"] < row["xmax"]
    return {"x": x, "y": y, "n": int(row["n"]), "slope": row["slope"] if ok else None,
            "intercept": row["intercept"] if ok else None, "xmin": row["xmin"], "xmax": row["xmax"], "ok": ok}


@nan_as_null
def ols_fit(df: DataFrame, cols: list[str] | None = None, decimals: int | None = 6) -> DataFrame:
    """V8: least-squares line y = slope*x + intercept for the strongest pair (full data)."""
    pairs = ranked_pairs(correlations(df, cols))
    rows = []
    if pairs:
        a, b, r = pairs[0]
        f = ols_fit_values(df, a, b)
        if f["ok"]:
            rows.append((a, b, f["slope"], f["intercept"], f["n"], r))
    t = df.sparkSession.createDataFrame(rows, "x_col string, y_col string, slope double, intercept double, n bigint, r double")
    return t.select("x_col", "y_col", *[rnd(F.col(c), decimals).alias(c) for c in ("slope", "intercept")], "n",
                    rnd(F.col("r"), decimals).alias("r"))


@nan_as_null
def ols_line(df: DataFrame, cols: list[str] | None = None, points: int = 100, decimals: int | None = 6) -> DataFrame:
    """V9: the fitted line at ``points`` evenly spaced x over the observed range."""
    pairs = ranked_pairs(correlations(df, cols))
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "i bigint, x double, y double")
    f = ols_fit_values(df, pairs[0][0], pairs[0][1])
    if not f["ok"]:
        return spark.createDataFrame([], "i bigint, x double, y double")
    mn, mx = f["xmin"], f["xmax"]
    x = F.lit(mn) + (F.lit(mx) - F.lit(mn)) * F.col("i") / F.lit(points - 1)
    t = spark.range(points).withColumnRenamed("id", "i").withColumn("x", x)
    y = F.lit(f["slope"]) * F.col("x") + F.lit(f["intercept"])
    return t.select("i", rnd(F.col("x"), decimals).alias("x"), rnd(y, decimals).alias("y"))


@nan_as_null
def scatter_sample(df: DataFrame, key: list[str], order_by: list[str], cols: list[str] | None = None,
                   n: int = PLOT_SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """Plotted points of the strongest pair, both present, coloured by the first
    text column; a seeded sample of n rows when there are more."""
    pairs = ranked_pairs(correlations(df, cols))
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "x double, y double, color string")
    a, b, _ = pairs[0]
    cats = categorical_cols(df)
    color = _c(cats[0]) if cats else F.lit(None).cast("string")
    sub = df.where(_c(a).isNotNull() & _c(b).isNotNull())
    sample = seeded_sample(sub, n, key, seed, order_cols=order_by)
    return sample.select(*[_c(k) for k in key], _c(a).cast("double").alias("x"), _c(b).cast("double").alias("y"),
                         color.alias("color"))


# ---------------------------------------------------------------------------
# V11/V12, E2 category frequencies
# ---------------------------------------------------------------------------

@nan_as_null
def category_frequency(df: DataFrame, cols: list[str] | None = None, first: int | None = None, k: int = 20,
                       decimals: int = 1) -> DataFrame:
    """Top-k values of the text columns (``first``: of so many only); % of all rows (nulls in the denominator)."""
    cols = categorical_cols(df, first) if cols is None else cols
    n = df.count()
    top = freqmod.exact_top_k(df, cols, k)
    return top.select("column", "rank", "value", F.col("n").alias("count"),
                      pct(F.col("n"), F.lit(n), decimals).alias("pct"))


@nan_as_null
def dominant_share(df: DataFrame, cols: list[str] | None = None, first: int | None = None, threshold: float = 70.0) -> DataFrame:
    """Share of the most frequent value and the imbalance flag (> 70 %)."""
    f = category_frequency(df, cols, first, k=1)
    return f.select("column", F.col("value").alias("dominant"), F.col("pct").alias("dominant_pct"),
                    (F.col("pct") > threshold).alias("imbalanced"))


@nan_as_null
def top_categories(df: DataFrame, cols: list[str] | None = None, first: int | None = None, k: int = 5) -> DataFrame:
    """The k most frequent values of the text columns (``first``: of so many only)."""
    cols = categorical_cols(df, first) if cols is None else cols
    return freqmod.exact_top_k(df, cols, k).select("column", "rank", "value", F.col("n").alias("count"))


# ---------------------------------------------------------------------------
# V13/V14 time series
# ---------------------------------------------------------------------------

@nan_as_null
def ts_downsample(df: DataFrame, ts: str, value: str, tiebreak: list[str] | None = None,
                  max_points: int = PLOT_SAMPLE_ROWS) -> DataFrame:
    """Rows sorted by time, every k-th kept (k = n // 50,000 + 1 above 50,000 rows).

    Positions come from the bucketed global row index, never a one-task sort.
    """
    order = [ts] + [c for c in (tiebreak or []) if c != ts]
    sub = df.where(_c(ts).isNotNull() & _c(value).isNotNull())
    n = sub.count()
    k = n // max_points + 1 if n > max_points else 1
    idx = with_row_index(sub, order, "idx", n_rows=n)
    return idx.where(F.col("idx") % k == 0).select("idx", _c(ts).alias("ts"), _c(value).cast("double").alias("value"))


def _decimal_scale(largest: float, n: int) -> tuple[int, int]:
    """(power of ten to divide values by, decimals to keep) so that no sum of ``n`` values of at most
    ``largest`` passes 31 digits; 21 of them at most stand before the point."""
    digits = math.ceil(math.log10(largest) + math.log10(n)) + 1 if largest > 0 else 1
    shift = max(0, digits - 21)
    return shift, min(30, 31 - (digits - shift))


def _rolling(df: DataFrame, order: list[str], ts: str, value: str, every: int, size: int, n: int, decimals: int | None,
             rows_per_bucket: int | None = None) -> DataFrame:
    """(idx, ts, value, rolling_mean) of every ``every``-th row: the mean of the ``size`` rows up to it.

    Prefix sums: rows are dealt to ranges of the key, sums up to a row are taken within its range and
    those of the ranges before it are added. A trailing sum is the difference of two prefix sums, so
    only plotted rows and those ``size`` before them leave the ranges, whatever the window's size.
    Sums are exact decimals, with as many places as the column's magnitude leaves."""
    rows = df.select(*[_c(c) for c in order], _c(ts).alias("__ts"), _c(value).cast("double").alias("__v"))
    shift, scale = _decimal_scale(df.agg(F.max(F.abs(_c(value).cast("double")))).first()[0] or 0.0, n)
    total, keys = with_tie(rows, order)
    tagged, counts = bucketed(total, keys, n, rows_per_bucket, write=True)
    kind = f"decimal(38,{scale})"
    exact = tagged.withColumn("__d", (F.col("__v") / F.lit(10.0 ** shift) if shift else F.col("__v")).cast(kind))
    sums = {r[BUCKET]: r["s"] for r in exact.groupBy(BUCKET).agg(F.sum("__d").alias("s")).collect()}
    sums = before_each([sums.get(b) or decimal.Decimal(0) for b in range(len(counts))], decimal.Decimal(0))
    w = Window.partitionBy(BUCKET).orderBy(*[_c(k) for k in keys])
    idx = F.row_number().over(w) - 1 + at_bucket(before_each(counts), "bigint")
    upto = F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0)) + at_bucket(sums, kind)
    marked = exact.select(idx.cast("bigint").alias("idx"), "__ts", "__v", upto.cast(kind).alias("__c"))
    # at most two rows a plotted point
    marked = materialize(marked.where((F.col("idx") % every == 0) | ((F.col("idx") + size) % every == 0)), "prefix-sums")
    points = marked.where(F.col("idx") % every == 0)
    before = marked.where((F.col("idx") + size) % every == 0).select((F.col("idx") + size).alias("idx"), F.col("__c").alias("__before"))
    both = points.join(before, "idx", "left").select(
        "idx", "__ts", "__v", (F.col("__c") - F.coalesce("__before", F.lit(0).cast(kind))).cast(kind).alias("__s"),
        F.least(F.col("idx") + 1, F.lit(size)).alias("__n"))
    if decimals is not None and not shift:
        mean = F.expr(exact_mean_sql("__s", "__n", decimals, scale))
    else:
        mean = rnd(F.col("__s").cast("double") / F.col("__n") * F.lit(10.0 ** shift), decimals)
    return both.select("idx", F.col("__ts").alias("ts"), rnd(F.col("__v"), decimals).alias("value"), mean.alias("rolling_mean"))


@nan_as_null
def rolling_mean(df: DataFrame, ts: str, value: str, tiebreak: list[str] | None = None, window: int | None = None,
                 max_points: int = PLOT_SAMPLE_ROWS, decimals: int | None = 6,
                 rows_per_bucket: int | None = None) -> DataFrame:
    """V14 over every row: (idx, ts, value, rolling_mean) in time order.

    The mean is that of the ``window`` rows up to each (default max(5, n // 20), from 20 rows on), none
    left out; only the plotted points are thinned (every k-th, k = n // max_points + 1 above max_points).
    Rows of one time are ordered by ``tiebreak``, then by a hash of the row."""
    order = [ts] + [c for c in (tiebreak or []) if c != ts]
    sub = df.where(_c(ts).isNotNull() & _c(value).isNotNull())
    n = sub.count()
    if n < 5:
        return df.sparkSession.createDataFrame([], df.select(F.lit(0).cast("bigint").alias("idx"), _c(ts).alias("ts"), F.lit(0.0).alias("value"), F.lit(0.0).alias("rolling_mean")).schema)
    every = n // max_points + 1 if n > max_points else 1
    out = _rolling(sub, order, ts, value, every, window or max(5, n // 20), n, decimals, rows_per_bucket)
    return out if n >= 20 or window else out.withColumn("rolling_mean", F.lit(None).cast("double"))


@nan_as_null
def ts_rolling_mean(df: DataFrame, ts: str, value: str, tiebreak: list[str] | None = None,
                    max_points: int = PLOT_SAMPLE_ROWS, decimals: int | None = 6) -> DataFrame:
    """V14, thinned first (the surveyed tool's form): trailing mean over max(5, m // 20) of the m points
    that ``ts_downsample`` keeps (m >= 20), plus these points (m >= 5). ``rolling_mean`` averages every row."""
    down = ts_downsample(df, ts, value, tiebreak, max_points)
    spark = df.sparkSession
    m = down.count()
    if m < 5:
        return spark.createDataFrame([], "pos bigint, ts timestamp_ntz, value double, rolling_mean double")
    out = _rolling(down, ["idx"], "ts", "value", 1, max(5, m // 20), m, decimals)
    return out.select(F.col("idx").alias("pos"), "ts", "value", F.when(F.lit(m >= 20), F.col("rolling_mean")).alias("rolling_mean"))


# ---------------------------------------------------------------------------
# V15 null map, V16 chart catalogue
# ---------------------------------------------------------------------------

@nan_as_null
def null_map(df: DataFrame, order_by: list[str], rows: int = 250) -> DataFrame:
    """Null indicator of the first 250 rows for the columns that hold nulls."""
    nulls = agg_row(df, [F.count_if(_c(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    cols = [c for i, c in enumerate(df.columns) if nulls[f"n{i}"] > 0]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "row_idx bigint, column string, is_null int")
    head = df.orderBy(*[_c(k) for k in order_by]).limit(rows)
    w = Window.orderBy(*[_c(k) for k in order_by])  # <= 250 rows
    head = head.withColumn("row_idx", (F.row_number().over(w) - 1).cast("bigint"))
    items = [F.struct(F.lit(c).alias("column"), _c(c).isNull().cast("int").alias("is_null")) for c in cols]
    return head.select("row_idx", F.inline(F.array(*items)))


@nan_as_null
def chart_catalog(df: DataFrame) -> DataFrame:
    """Which chart tables this schema supports, their columns and question."""
    st = column_stats(df)
    rows = st["_rows"]
    num, cat, dts = numeric_cols(df), categorical_cols(df), datetime_cols(df)
    out = []
    for c in num:
        if st[c]["n"] >= 5:
            out.append(("histogram", c, st[c]["n"], f"How do the values of {c} spread?"))
    if len(num) >= 2:
        out.append(("zscore_box", ",".join(num), rows, "Where do values lie far from the rest?"))
        out.append(("scatter_fit", ",".join(num), rows, "Does a line describe the closest pair?"))
    if len(num) >= 3:
        out.append(("correlation_matrix", ",".join(num), rows, "Which numbers rise and fall as one?"))
    for c in cat:
        out.append(("category_frequency", c, rows, f"Which values of {c} are common?"))
    if dts and num:
        out.append(("time_series", f"{dts[0]},{num[0]}", rows, f"How does {num[0]} change with {dts[0]}?"))
    if any(st[c]["nulls"] > 0 for c in df.columns):
        out.append(("null_map", ",".join(c for c in df.columns if st[c]["nulls"] > 0), min(rows, 250),
                    "Do nulls come in blocks?"))
    return df.sparkSession.createDataFrame(out, "chart string, columns string, n_rows bigint, question string")

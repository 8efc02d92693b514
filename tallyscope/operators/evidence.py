"""Evidence and report tables (E1-E7): the facts a write-up is built from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import AUDIT_PROBS, DEFAULT, AuditConfig
from ..functions.scalar import nan_as_null, rnd
from . import eda
from .kinds import numeric_cols, q
from .profile import column_stats, describe_numeric
from .quantiles import exact_quantiles
from .rowindex import BUCKET, at_bucket, bucketed, with_tie


@nan_as_null
def numeric_evidence(df: DataFrame, first: int | None = None, decimals: int | None = 3, cfg: AuditConfig = DEFAULT,
                     stats: dict | None = None, probs: tuple | None = None) -> DataFrame:
    """Mean, median, std, min, max of the numeric columns (``first``: of so many only; empty ones skipped).

    ``stats``/``probs`` reuse an audit's column statistics (same frame) instead of rescanning."""
    cols = numeric_cols(df, first)
    if stats is not None and probs is not None and 0.5 in probs and all(c in stats for c in cols):
        st, k = stats, list(probs).index(0.5)
    else:
        st, k = column_stats(df, cols, higher=False, probs=[0.5], cfg=cfg), 0
    cols = [c for c in cols if st[c]["n"] > 0]
    rows = [(c, st[c]["mean"], st[c]["q"][k], st[c]["std"], st[c]["min"], st[c]["max"]) for c in cols]
    t = df.sparkSession.createDataFrame(rows, "column string, mean double, median double, std double, min double, max double")
    return t.select("column", *[rnd(F.col(x), decimals).alias(x) for x in ("mean", "median", "std", "min", "max")])


def dialogue_context(conv: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                     text: str = "text", window: int = 6, current_role: str = "user",
                     rows_per_bucket: int | None = None) -> DataFrame:
    """For every ``current_role`` turn, the ``window`` turns before it in its conversation.

    Rows are dealt once to ranges of (conversation, turn), and each range gets the last ``window`` rows
    before it as well, so a range answers its own rows by lags: every text moves about once, and one
    huge conversation is spread over ranges like any other rows. Rows with an equal (conversation,
    turn) are ordered by a hash of the row; null turns come first.
    """
    rows, keys = with_tie(conv.select(F.col(key), F.col(turn), F.col(role), F.col(text)), [key, turn])
    tagged, sizes = bucketed(rows, keys, rows_per_bucket=rows_per_bucket)
    marked = tagged.withColumn("__halo", F.lit(False))
    if len(sizes) > 1:
        marked = marked.unionByName(_halo(tagged, keys, sizes, window))
    w = Window.partitionBy(BUCKET).orderBy(*[F.col(q(k)) for k in keys])
    said = F.struct(F.col(key).alias("k"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    lags = [F.struct(F.lit(i).cast("bigint").alias("offset"), F.lag(said, i).over(w).alias("said")) for i in range(1, window + 1)]
    asked = marked.select(F.col(key), F.col(turn), F.col(role), "__halo", F.array(*lags).alias("__ctx")).where(~F.col("__halo") & (F.col(role) == current_role))
    own = F.filter("__ctx", lambda c: c.getField("said").getField("k") == F.col(key))
    return (asked.select(F.col(key), F.col(turn), F.explode(own).alias("__c"))
            .select(F.col(key), F.col(turn), F.col("__c.offset").alias("ctx_offset"), F.col("__c.said.turn").alias("ctx_turn"),
                    F.col("__c.said.role").alias("ctx_role"), F.col("__c.said.text").alias("ctx_text")))


def _halo(tagged: DataFrame, keys: list[str], sizes: list[int], window: int) -> DataFrame:
    """The last ``window`` rows before each range, tagged with it: of the range before, or of more where those are short.

    A task ships ``window`` rows a range at most."""
    targets = []
    for b in range(len(sizes)):
        left, r, reach = window, b + 1, []
        while left > 0 and r < len(sizes):
            reach.append((r, left))
            left -= sizes[r]
            r += 1
        targets.append(reach)
    most = max(len(t) for t in targets)
    back = Window.partitionBy(BUCKET).orderBy(*[F.col(q(k)).desc() for k in keys])
    last = tagged.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= window)
    parts = []
    for i in range(most):  # 1, unless ranges hold less than a window
        to = at_bucket([t[i][0] if i < len(t) else -1 for t in targets], "int")
        room = at_bucket([t[i][1] if i < len(t) else 0 for t in targets], "int")
        parts.append(last.where(F.col("__back") <= room).withColumn(BUCKET, to))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("__back").withColumn("__halo", F.lit(True))


def report_facts(raw: DataFrame, assessment, plan=None) -> DataFrame:
    """Shape, duplicates, columns with nulls, IQR outlier columns (or 'none'), steps applied
    (without a fitted ``plan``: steps suggested)."""
    a = assessment
    rows = [
        ("n_rows", str(a.rows)),
        ("n_cols", str(len(a.columns))),
        ("duplicates", str(a.duplicate_count)),
        ("cols_with_nulls", str(len(a.missing))),
        ("outlier_cols", ", ".join(c for c in a.columns if c in a.outliers) or "none"),
        ("cleaning_steps", str(len(plan.log if plan is not None else a.suggestions))),
    ]
    return raw.sparkSession.createDataFrame(rows, "fact string, value string")


def _rows(df: DataFrame) -> list[dict]:
    """Collect a small (O(columns)) result table."""
    return [r.asDict() for r in df.collect()]


@nan_as_null
def data_context(df: DataFrame, first: int | None = None, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Compact JSON context - shape, dtypes, describe of the first eight numeric columns."""
    desc = _rows(describe_numeric(df, numeric_cols(df, first), decimals=3, cfg=cfg))
    n = df.count()
    doc = {"shape": [n, len(df.columns)],
           "dtypes": {f.name: f.dataType.simpleString() for f in df.schema.fields},
           "describe": desc}
    return df.sparkSession.createDataFrame([(json.dumps(doc, default=str),)], "context string")


@nan_as_null
def data_context_rows(df: DataFrame, first: int | None = None, cfg: AuditConfig = DEFAULT, decimals: int | None = 3) -> DataFrame:
    """E4 as rows: (section, key, field, text, value) of shape, dtypes and describe."""
    rows = [("shape", "rows", None, None, float(df.count())), ("shape", "columns", None, None, float(len(df.columns)))]
    rows += [("dtypes", f.name, None, f.dataType.simpleString(), None) for f in df.schema.fields]
    for d in _rows(describe_numeric(df, numeric_cols(df, first), decimals=decimals, cfg=cfg)):
        rows += [("describe", d["column"], k, None, None if v is None else float(v) + 0.0) for k, v in d.items() if k != "column"]  # no negative zero
    return df.sparkSession.createDataFrame(rows, "section string, key string, field string, text string, value double")


@nan_as_null
def evidence_pack(df: DataFrame, assessment, plan=None, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """E5: one JSON document with shape, cleaning steps, outliers, skews, E1-E3."""
    a = assessment
    doc = {
        "shape": [a.rows, len(a.columns)],
        "cleaning_steps": plan.log_lines() if plan is not None else [],
        "outliers": {k: int(v) for k, v in a.outliers.items()},
        "skewness": {k: round(float(v), 3) for k, v in a.skewness.items()},
        "numeric": _rows(numeric_evidence(df, cfg=cfg, stats=a.stats, probs=AUDIT_PROBS)),
        "top_categories": _rows(eda.top_categories(df)),
        "correlations": _rows(eda.top_correlations(df, stats=a.stats)),
    }
    return df.sparkSession.createDataFrame([(json.dumps(doc, default=str),)], "evidence string")


@nan_as_null
def evidence_rows(df: DataFrame, assessment, plan=None, cfg: AuditConfig = DEFAULT, decimals: int | None = 3) -> DataFrame:
    """E5 as rows: (section, key, field, text, value) of what ``evidence_pack`` holds."""
    a = assessment
    rows = [("shape", "rows", None, None, float(a.rows)), ("shape", "columns", None, None, float(len(a.columns)))]
    rows += [("cleaning_steps", f"{r.step:02d}", r.type, r.col, None if r.n_affected is None else float(r.n_affected)) for r in (plan.log if plan is not None else [])]
    rows += [("outliers", c, None, None, float(n)) for c, n in a.outliers.items()]
    rows += [("skewness", c, None, None, round(float(g), 3)) for c, g in a.skewness.items()]
    for d in _rows(numeric_evidence(df, decimals=decimals, cfg=cfg, stats=a.stats, probs=AUDIT_PROBS)):
        rows += [("numeric", d["column"], k, None, None if v is None else float(v) + 0.0) for k, v in d.items() if k != "column"]
    rows += [("top_categories", d["column"], str(d["rank"]), d["value"], float(d["count"])) for d in _rows(eda.top_categories(df))]
    rows += [("correlations", d["col_a"], d["col_b"], str(d["rank"]), d["r"]) for d in _rows(eda.top_correlations(df, stats=a.stats))]
    return df.sparkSession.createDataFrame(rows, "section string, key string, field string, text string, value double")

"""CSV source with encoding fallback and a pandas-like type ladder (S1-S3), and sinks.

* Encoding and layout: one scan of the raw lines tells, file by file, whether all
  bytes are valid UTF-8 and whether a quoted value runs over a line end. Files
  that are not valid UTF-8 are ISO-8859-1, which decodes every byte - so the
  third fallback of the audited tool (cp1252) is never reached there either.
  Without such values the files are split for reading like any text.
* A table with files of both encodings is read once, as ISO-8859-1, and the values
  of the UTF-8 files are decoded again; file names are only compared with each
  other, never handed back to a reader, so any path that Spark opens will do.
* Types: every column is read as text; NA tokens become NULL; each value is put
  into a lattice of boolean, whole, decimal and text, and one scan of (column,
  place in the lattice) pairs, joined by bit-or with map-side combine, decides all
  columns however many there are. Dates stay text (the audit's date rule handles
  them), unlike Spark's ``inferSchema``. Repeated header names get Spark's
  suffixes (``a0``, ``a1``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NA_TOKENS
from ..operators.kinds import q

_TRUE = ("True", "TRUE", "true")
_FALSE = ("False", "FALSE", "false")
_INT = r"^[+-]?\d+$"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|Inf|INF|infinity|Infinity)$"
#: Places of a value in the type lattice, as bits.
_BOOL, _WHOLE, _DECIMAL, _TEXT = 1, 2, 4, 8
#: Files of the rarer encoding that may be broadcast by name.
_BROADCAST_FILES = 100_000
_FILE = "__file"


def _line_facts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, utf8, open) of every file: are all bytes valid UTF-8, does a quoted value run over a line end."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias(_FILE), "value")
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return lines.groupBy(_FILE).agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("open"))


def file_encodings(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """file -> 'UTF-8' or 'ISO-8859-1' (one aggregate; one row per file comes back)."""
    return {r[_FILE]: ("UTF-8" if r["utf8"] else "ISO-8859-1") for r in _line_facts(spark, path).collect()}


def _read_text(spark, path, encoding, multiline, sep):
    return (spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
            .option("quote", '"').option("sep", sep).option("encoding", encoding).option("inferSchema", False)
            .option("mode", "PERMISSIVE").csv(path))


def na_to_null(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    toks = list(tokens)
    return df.select(*[F.when(~F.col(q(c)).isin(toks), F.col(q(c))).alias(c) for c in df.columns])


def _place(v: Column) -> Column:
    """Where a value stands in the type lattice; null has no place."""
    whole = v.rlike(_INT) & v.try_cast("decimal(38,0)").between(-(2 ** 63), 2 ** 63 - 1)
    return (F.when(v.isNull(), F.lit(None)).when(v.isin(list(_TRUE + _FALSE)), _BOOL)
            .when(F.coalesce(whole, F.lit(False)), _WHOLE).when(v.rlike(_FLOAT), _DECIMAL).otherwise(_TEXT)).cast("int")


def column_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type that holds all values of each text column: boolean, bigint, double or string
    (double for a column without a value). One scan for any number of columns."""
    if not df.columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(q(c)).alias("v")) for i, c in enumerate(df.columns)])
    long = df.select(F.inline(pairs)).where("v is not null").select("i", _place(F.col("v")).alias("place"))
    found = {r["i"]: r["bits"] for r in long.groupBy("i").agg(F.bit_or("place").alias("bits")).collect()}
    names = {0: "double", _BOOL: "boolean", _WHOLE: "bigint", _DECIMAL: "double", _WHOLE | _DECIMAL: "double"}
    return {c: names.get(found.get(i, 0), "string") for i, c in enumerate(df.columns)}


def infer_types(df: DataFrame) -> DataFrame:
    """The reader's type ladder over all-text columns, decided by one scan."""
    out: list[Column] = []
    for c, kind in column_types(df).items():
        v = F.col(q(c))
        if kind == "boolean":
            out.append(F.when(v.isin(list(_TRUE)), F.lit(True)).when(v.isin(list(_FALSE)), F.lit(False)).alias(c))
        else:
            out.append((v if kind == "string" else v.cast(kind)).alias(c))
    return df.select(*out) if out else df


def _both_encodings(spark: SparkSession, path, facts: DataFrame, latin: int, multiline: bool, sep: str) -> DataFrame:
    """Files of both encodings in one read: as bytes, decoded again where the file is UTF-8."""
    raw = _read_text(spark, path, "ISO-8859-1", multiline, sep)
    names = raw.columns
    other = facts.where("not utf8").select(_FILE, F.lit(True).alias("__latin"))
    other = F.broadcast(other) if latin <= _BROADCAST_FILES else other
    marked = raw.withColumn(_FILE, F.col("_metadata.file_path")).join(other, _FILE, "left")
    again = [F.when(F.col("__latin"), F.col(q(c))).otherwise(F.decode(F.encode(F.col(q(c)), "ISO-8859-1"), "UTF-8")) for c in names]
    header = [c.encode("latin-1", "replace").decode("utf-8", "replace") for c in names]
    safe = [h if "�" not in h else c for h, c in zip(header, names)]
    return marked.select(*[e.alias(h) for e, h in zip(again, safe)])


def read_csv(spark: SparkSession, path: str | list[str], infer: bool = True, multiline: bool | None = None,
             sep: str = ",", na_tokens=NA_TOKENS) -> DataFrame:
    """Header CSV(s) -> typed DataFrame, per-file encoding fallback.

    ``multiline``: read quoted values over line ends, a file a task (default: only where the files hold any).
    """
    facts = _line_facts(spark, path)
    row = facts.agg(F.count("*").alias("files"), F.count_if(~F.col("utf8")).alias("latin"), F.bool_or("open").alias("open")).first()
    if not row["files"]:
        raise ValueError(f"no CSV data at {path}")
    multiline = bool(row["open"]) if multiline is None else multiline
    if 0 < row["latin"] < row["files"]:
        df = _both_encodings(spark, path, facts, row["latin"], multiline, sep)
    else:
        df = _read_text(spark, path, "ISO-8859-1" if row["latin"] else "UTF-8", multiline, sep)
    df = na_to_null(df, na_tokens)
    return infer_types(df) if infer else df


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", mode: str = "overwrite") -> None:
    """Cleaned data as header CSV (RFC-4180 quoting, whitespace kept)."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("quote", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("encoding", encoding).csv(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def log_line() -> Column:
    """A row of the cleaning log as text."""
    fitted = F.coalesce(F.col("fitted_text"), F.round("fitted_num", 4).cast("string"))
    return F.concat(
        F.lit("#"), F.lpad(F.col("step").cast("string"), 2, "0"), F.lit(" "), F.col("type"), F.lit(" '"), F.col("col"), F.lit("'"),
        F.coalesce(F.concat(F.lit(" -> "), fitted), F.lit("")),
        F.coalesce(F.concat(F.lit(" ("), F.col("n_affected").cast("string"), F.lit(" affected)")), F.lit("")),
        F.coalesce(F.concat(F.lit(" "), F.col("note")), F.lit("")), F.lit(" ["), F.col("dim"), F.lit("]"))


def write_log_text(log_df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One line per cleaning step with its fitted value and count, or a single
    default line when nothing ran.

    The log holds one row per step, so one output file is fine."""
    spark = log_df.sparkSession
    lines = log_df.orderBy("step").select(log_line().alias("value"))
    if log_df.limit(1).count() == 0:
        lines = spark.createDataFrame([("No cleaning steps were applied.",)], "value string")
    lines.coalesce(1).write.mode(mode).text(path)

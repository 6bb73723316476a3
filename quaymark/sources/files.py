"""File sources and sinks: candle, funding and mark CSVs, position JSON, report bundles."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.operators.asof import backward_asof

CANDLE_SCHEMA = "timestamp string, open double, high double, low double, close double, volume double"
POSITION_SCHEMA = (
    "account_id string, "
    "collateral array<struct<symbol:string,amount:double,price:double,ltv:double,liquidation_threshold:double>>, "
    "debt array<struct<symbol:string,amount:double,price:double>>, "
    "actions array<struct<type:string,symbol:string,amount:double,price:double,cash_delta:double>>"
)


def _path() -> str:
    return "_metadata.file_path"


def by_header(spark: SparkSession, pattern: str) -> DataFrame | None:
    """Header CSVs read by column name, all as strings, with `path`; None without files.

    Files that share a header are read together and the groups are united by
    name, so files may order their columns differently or lack some.  Only the
    distinct headers, a handful of layouts, reach the driver with their paths.
    """
    try:
        lines = spark.read.text(pattern).select(F.col(_path()).alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    except AnalysisException:
        return None
    # the header is the first line of the block that starts a file
    numbered = lines.withColumn("line", F.monotonically_increasing_id()).filter("at = 0")
    first = numbered.groupBy("path").agg(F.min_by("value", "line").alias("header"))
    layouts = first.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    out = None
    for layout in layouts:
        part = spark.read.option("header", True).csv(sorted(layout.paths)).withColumn("path", F.col(_path()))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def typed(rows: DataFrame, schema: str) -> DataFrame:
    """Columns of a schema by name, null where a file lacks them, with `path`."""
    fields = [part.strip().split(" ") for part in schema.split(",")]
    cols = [(F.col(n) if n in rows.columns else F.lit(None)).try_cast(t).alias(n) for n, t in fields]
    return rows.select("path", *cols)


def read_candles(spark: SparkSession, pattern: str, latest_file_only: bool = False) -> DataFrame:
    """Candle CSVs named `<SYM>_USDT_<tf>_....csv`; times without a zone are UTC.

    Columns go by their header.  `latest_file_only` keeps, per symbol, the rows
    of its last file by name.
    """
    found = by_header(spark, pattern)
    if found is None:
        found = spark.createDataFrame([], "path string")
    rows = typed(found, CANDLE_SCHEMA)
    rows = rows.withColumn("symbol", F.regexp_extract("path", r"([A-Za-z0-9]+)_USDT_[^/]*\.csv$", 1))
    if latest_file_only:
        last = rows.groupBy("symbol").agg(F.max("path").alias("path"))
        rows = rows.join(last, ["symbol", "path"])
    return rows.select(
        "symbol", F.col("timestamp").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume"
    )


def read_funding(spark: SparkSession, path: str) -> DataFrame:
    return _series(spark, path, "funding_rate")


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    return _series(spark, path, "mark_price")


def _series(spark: SparkSession, path: str, value: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    if not {"timestamp", value} <= set(rows.columns):
        raise ValueError(f"{path} must have the columns timestamp and {value}")
    return rows.select(F.col("timestamp").cast("timestamp").alias("ts"), F.col(value).cast("double").alias(value))


def attach_funding(rows: DataFrame, funding: DataFrame) -> DataFrame:
    """Rate of exactly this timestamp, else 0."""
    return rows.join(funding, "ts", "left").fillna(0.0, ["funding_rate"])


def attach_marks(rows: DataFrame, marks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Latest mark at or before each row."""
    if keys:
        return backward_asof(rows, marks, keys, ["mark_price"])
    one = lambda df: df.withColumn("__one", F.lit(1))
    return backward_asof(one(rows), one(marks), ["__one"], ["mark_price"]).drop("__one")


def read_accounts(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Account JSON to (positions, actions); list order becomes `pos_no` and `action_no`.

    Records without an account id take the file name.  Debt borrow factors are
    not part of the format and become 1.
    """
    docs = spark.read.schema(POSITION_SCHEMA).option("multiLine", multi_line).json(path)
    stem = F.regexp_extract(F.col(_path()), r"([^/]+?)(\.[^./]*)?$", 1)
    return account_tables(docs.withColumn("account_id", F.coalesce("account_id", stem)))


def parsed_accounts(texts: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Account JSON held in a string column, as `read_accounts` takes it from files; text that is none gives no rows."""
    return account_tables(texts.select(F.from_json(column, POSITION_SCHEMA).alias("d")).select("d.*"))


def account_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, actions) of account documents."""
    one = F.lit(1.0)
    none = F.lit(None).cast("double")

    def side(column: str, name: str) -> DataFrame:
        rows = docs.select("account_id", F.posexplode(column).alias("pos_no", "p"))
        coll = name == "collateral"
        return rows.select(
            "account_id", "pos_no", F.lit(name).alias("side"), "p.symbol", "p.amount", "p.price",
            (F.col("p.ltv") if coll else none).alias("ltv"),
            (F.col("p.liquidation_threshold") if coll else none).alias("liq_threshold"),
            one.alias("borrow_factor"),
        )

    positions = side("collateral", "collateral").unionByName(side("debt", "debt"))
    actions = docs.select("account_id", F.posexplode("actions").alias("action_no", "a")).select(
        "account_id", "action_no", "a.type", "a.symbol",
        F.coalesce("a.amount", F.lit(0.0)).alias("amount"), "a.price", F.coalesce("a.cash_delta", F.lit(0.0)).alias("cash_delta"),
    )
    return positions, actions


def _reports(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """CSVs of all report folders, or an empty frame with the schema where none exist."""
    wanted = spark.createDataFrame([], schema).schema
    rows = by_header(spark, pattern)
    if rows is None:
        return spark.createDataFrame([], schema)
    rows = rows.withColumn("report_id", F.element_at(F.split("path", "/"), -2)).withColumnRenamed("path", "__file")
    cols = []
    for f in wanted.fields:
        if f.name in rows.columns:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        elif f.name == "name":
            stem = F.regexp_extract("__file", r"([^/]+)\.csv$", 1)
            cols.append(F.regexp_replace(stem, "_?history$", "").alias("name"))
        elif f.name == "ts":
            first = rows.columns[0] if rows.columns[0].startswith("_c") or rows.columns[0] == "timestamp" else "timestamp"
            cols.append(F.col(first).cast("timestamp").alias("ts"))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return rows.select(*cols)


def read_report_bundle(spark: SparkSession, root: str, summary_schema: str, regime_schema: str,
                       history_schema: str) -> dict[str, DataFrame]:
    """Summaries, regime tables and histories of every report folder under `root`.

    Columns a file lacks come back null; a history is named by its file without
    the `_history` ending.
    """
    return {
        "summary": _reports(spark, f"{root}/*/summary.csv", summary_schema),
        "regimes": _reports(spark, f"{root}/*/regime_summary.csv", regime_schema),
        "histories": _reports(spark, f"{root}/*/*history.csv", history_schema),
    }


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write a result table so that it can be written again.

    With partition columns, only the partitions that df has are replaced: a
    rerun of one run leaves the others, and an empty df changes nothing.
    Without, the new table is written beside the old one and takes its place
    once it is complete.  Either way a write that fails leaves what was there.
    """
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).save(path)
        return
    context = df.sparkSession.sparkContext
    to_path = context._jvm.org.apache.hadoop.fs.Path
    at = to_path(path)
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    at = files.makeQualified(at)
    new, old = (to_path(at.getParent(), f"_{at.getName()}-{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    try:
        writer.save(new.toString())
    except Exception:
        files.delete(new, True)
        raise
    replaced = files.exists(at)
    if replaced and not files.rename(at, old):
        raise OSError(f"cannot move {path} away")
    if not files.rename(new, at):
        raise OSError(f"cannot publish {path}; the new table is in {new.toString()}")
    if replaced:
        files.delete(old, True)


def write_sweep_tables(rows: DataFrame, root: str) -> None:
    """Summary, valid, near-valid and family-best tables of a sweep with gate columns."""
    best = W.partitionBy("family").orderBy(F.desc("valid"), F.desc("near_valid"), "max_drawdown_pct", F.desc("final_sol_equiv"))
    write_table(rows, f"{root}/summary", "csv")
    write_table(rows.filter("valid"), f"{root}/valid_configs", "csv")
    write_table(rows.filter("near_valid"), f"{root}/near_valid_configs", "csv")
    write_table(rows.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r"), f"{root}/family_best", "csv")


def write_perp_report(signals: DataFrame, history: DataFrame, summary: DataFrame, root: str) -> None:
    """Signals and history by run as CSV, summary as JSON."""
    write_table(signals, f"{root}/signals", "csv")
    write_table(history, f"{root}/history", "csv", ["run_id"])
    write_table(summary, f"{root}/summary", "json")

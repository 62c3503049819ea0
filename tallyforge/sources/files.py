"""Table scans and sinks: declared schemas, pruned columns, tolerant readers, append logs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan(df: DataFrame, columns: Sequence[str | Column], where: Column | None = None) -> DataFrame:
    """Filter and project at the source, so both reach the file reader."""
    return (df if where is None else df.where(where)).select(*columns)


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", pattern: str | None = None) -> DataFrame:
    """Sharded delimited files under a folder; a byte-order mark before the first header name is ignored."""
    reader = spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).option("quote", '"').option("escape", '"').option("multiLine", False)
    return (reader if pattern is None else reader.option("pathGlobFilter", pattern)).schema(schema).csv(path)


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_json_lines(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a column of JSON texts; rows that do not parse are left out."""
    parsed = df.withColumn("__json", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    fields = [f.name for f in parsed.schema["__json"].dataType.fields]
    bad = F.forall(F.array(*[F.col("__json")[f].isNull() for f in fields]), lambda x: x)
    return parsed.where(F.col("__json").isNotNull() & ~bad).select(*df.columns, "__json.*")


def ensure_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c.lower() not in have})


def first_present(df: DataFrame, aliases: Sequence[str], default: object = None) -> Column:
    """First non-null of the aliases that exist."""
    have = {c.lower() for c in df.columns}
    found = [F.col(c) for c in aliases if c.lower() in have]
    return F.coalesce(*found, F.lit(default)) if found else F.lit(default)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def write_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.option("header", True).option("escape", '"') if form == "csv" else writer).format(form).save(path)


def write_progress(spark: SparkSession, path: str, record: Mapping[str, object]) -> None:
    """Replaces a small JSON record as a whole: readers see the old one or the new one, on any store that can rename."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(dict(record), sort_keys=True, default=str).encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf).rename(part, target, overwrite)


def read_progress(spark: SparkSession, path: str) -> dict | None:
    """The last record, or None before the first."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


#: What the table of an external scorer holds; a row counts with at least two known statistics.
SCORER = "raterParticipantId string, coreRaterIntercept double, coreRaterFactor1 double, internalRaterIntercept double, internalRaterFactor1 double, crhCrnhRatioDifference double, meanNoteScore double, raterAgreeRatio double, aboveHelpfulnessThreshold boolean"


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """An external scorer's tab-separated output."""
    return read_delimited(spark, path, SCORER).where("raterParticipantId IS NOT NULL")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def split_by(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and the others (null counts as not met)."""
    met = F.coalesce(good, F.lit(False))
    return df.where(met), df.where(~met)

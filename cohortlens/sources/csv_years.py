"""Yearly CSV sources (survey A1-A3).

Files are read with every column as text (no inference pass inside the
reader), missing-value tokens become NULL, and one aggregate decides per
column whether all non-null values are integers, numbers or text -- the
same outcome as a dataframe-library CSV reader, decided with one scan.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Text tokens read as missing by default in dataframe CSV readers.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
_INT_RE = r"^[+-]?[0-9]+$"
_NUM_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def read_csv_text(spark: SparkSession, path: str, sep: str = ";", encoding: str = "utf-8",
                  multi_line: bool = True) -> DataFrame:
    """All columns as strings; NA tokens -> NULL.

    Fields may be quoted, with doubled quotes and line breaks inside. Files
    without line breaks in fields can be split with ``multi_line=False``.
    """
    raw = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
           .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
           .option("inferSchema", False).option("mode", "PERMISSIVE").csv(path))
    return raw.select(*[F.when(F.col(f"`{c}`").isin(NA_TOKENS) | F.col(f"`{c}`").isNull(), F.lit(None))
                        .otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast each text column to bigint / double when every non-null value fits.

    A column without values has no type of its own (void), so that the type of
    other years' values decides in a union.
    """
    cols = df.columns
    aggs = []
    for i, c in enumerate(cols):
        v = F.trim(F.col(f"`{c}`"))
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(v.rlike(_INT_RE)).alias(f"i{i}"),
                 F.count_if(v.rlike(_NUM_RE)).alias(f"f{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        n, ni, nf = row[f"n{i}"], row[f"i{i}"], row[f"f{i}"]
        col = F.col(f"`{c}`")
        if n > 0 and ni == n:
            out.append(F.trim(col).cast("bigint").alias(c))
        elif n > 0 and nf == n:
            out.append(F.trim(col).cast("double").alias(c))
        elif n == 0:
            out.append(F.lit(None).alias(c))
        else:
            out.append(col.alias(c))
    return df.select(*out)


_BROKEN = "__broken_record"
REJECTS = "file string, text string, reason string, first_field string"


def read_csv_checked(spark: SparkSession, path: str, sep: str = ";", encoding: str = "utf-8",
                     multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows with as many fields as the header, rejects): rejects have the file, the record's text, why, and its first field.

    The reader keeps a record that does not fit the header in a column of its
    own. The file is parsed once, into a table in the shared folder that both
    results read.
    """
    from cohortlens.session import materialize
    options = {"header": True, "sep": sep, "encoding": encoding, "quote": '"', "escape": '"', "multiLine": multi_line}
    names = spark.read.options(**options).option("inferSchema", False).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in [*(f"c{k}" for k in range(len(names))), _BROKEN])
    raw = (spark.read.options(**options).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN)
           .schema(schema).csv(path))
    raw = materialize(raw, "csv-records")
    broken = F.col(_BROKEN)
    rows = raw.where(broken.isNull()).select(*[
        F.when(F.col(f"c{k}").isin(NA_TOKENS), F.lit(None)).otherwise(F.col(f"c{k}")).alias(c) for k, c in enumerate(names)])
    bare = F.regexp_replace(broken, '"([^"]|"")*"', "")                # separators inside quotes do not count
    fields = F.lit(1) + ((F.char_length(bare) - F.char_length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep)).cast("int")
    kind = F.when(fields < len(names), "too few fields").when(fields > len(names), "too many fields")
    reason = F.coalesce(F.concat(kind, F.lit(": "), fields.cast("string"), F.lit(f" of {len(names)}")), F.lit("malformed"))
    rejects = raw.where(broken.isNotNull()).select(F.lit(path).alias("file"), broken.alias("text"), reason.alias("reason"),
                                                   F.col("c0").alias("first_field"))
    return rows, rejects


def load_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str = "utf-8", multi_line: bool = True,
             reject_table: str | None = None) -> DataFrame:
    """A1: header CSV with inferred column types; raises if the file is absent.

    With ``reject_table`` records that have too few or too many fields are
    appended to that Parquet table and left out; without it, missing fields
    are NULL and fields beyond the header are dropped.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    if reject_table is None:
        return infer_types(read_csv_text(spark, path, sep, encoding, multi_line))
    rows, rejects = read_csv_checked(spark, path, sep, encoding, multi_line)
    rejects.write.mode("append").parquet(reject_table)
    return infer_types(rows)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop FileSystem of the path (local, HDFS, S3...)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def load_years(spark: SparkSession, paths: Mapping[int, str], sep: str = ";", encoding: str = "utf-8",
               multi_line: bool = True, reject_table: str | None = None) -> dict[int, DataFrame]:
    """A2/A3: the years whose file exists; missing files are logged and skipped.

    Any other failure is raised: a lost executor or a broken file must not
    silently take a year out of the panel.
    """
    out: dict[int, DataFrame] = {}
    for year, path in sorted(paths.items()):
        if not path_exists(spark, path):
            log.warning("file not found for %s: %s", year, path)
            continue
        out[year] = load_csv(spark, path, sep, encoding, multi_line, reject_table)
    return out

"""Readers with explicit schemas; numbers arrive as text and are coerced, never inferred."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finescale.functions.physics import nan_to_null, to_number, wrap_longitude
from finescale.operators.series import keep_first

OBS_COLUMNS = ("dt_regis", "md_valor", "md_final")
META_COLUMNS = ("Estacao", "Altitude", "Longitude", "Latitude")
STATION_FILE = r"^(.+)_[^_]*\.csv$"        # <id>_<yyyymm>.csv; the id may hold underscores
STEM = r"^(.*?)(?:\.csv)?$"               # a name without underscore is the id

# Variables of the three coarse source families, and which of them accumulate.
COARSE_FAMILIES = {
    "termico": ("t2m", "skt", "stl1", "sshf", "slhf"),
    "umid_vento_sp": ("d2m", "u10", "v10", "sp"),
    "radiacao": ("ssr", "str"),
}
COARSE_VARIABLES = tuple(v for family in COARSE_FAMILIES.values() for v in family)
ACCUMULATED = ("sshf", "slhf", "ssr", "str")


def _by_header(lines: DataFrame, columns: Sequence[str], sep: str) -> DataFrame:
    """Fields of the named columns of delimited text, each file by its own header line: any order, any further columns. A file
    without one of them fails.

    Files are grouped by header: the driver reads the distinct header lines (as many as there are layouts, not files) and Spark's CSV parser
    reads the lines of each. Fields may be quoted, then hold separators and doubled quotes, but no line break.
    """
    clean = lines.withColumn("value", F.regexp_replace("value", "^\ufeff|\r$", ""))
    head = clean.filter("_first").select(F.col("_file").alias("_of"), F.col("value").alias("_head"))      # a row per file
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    fields = F.lit(None).cast("array<string>")
    for (layout,) in head.select("_head").distinct().collect():
        names = [n.strip() for n in next(csv.reader([layout], delimiter=sep, skipinitialspace=True))] if len(sep) == 1 else layout.split(sep)
        lost = [c for c in columns if c not in names]
        if lost:
            raise ValueError(f"columns {lost} are missing below the header {layout!r}")
        parsed = F.from_csv("value", ", ".join(f"_c{k} STRING" for k in range(len(names))), options)
        fields = F.when(F.col("_head") == layout, F.array(*[parsed[f"_c{names.index(c)}"] for c in columns])).otherwise(fields)
    rows = clean.filter("NOT _first AND value <> ''").join(head, F.col("_file") == F.col("_of")).withColumn("_f", fields)
    return rows.select("_file", "_line", *[F.nullif(F.col("_f")[k], F.lit("")).alias(c) for k, c in enumerate(columns)])


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines with their file, their place in it (``_line``: comparable within a file), and whether they are its first."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).alias("_line"))
    first = raw.groupBy(F.col("_file").alias("_of")).agg(F.min("_line").alias("_least"))
    return raw.join(first, F.col("_file") == F.col("_of")).select("value", "_file", "_line", (F.col("_line") == F.col("_least")).alias("_first"))


def read_observations(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """Monthly station CSVs: ``station, ts`` (local), ``md_valor, md_final`` (text).

    The station id comes from the file name (all of it where it has no underscore). Columns are found by
    header name in every file; a file without one of them fails at read time.
    """
    raw = _by_header(_lines(spark, path), OBS_COLUMNS, sep)
    name = F.url_decode(F.regexp_extract("_file", "[^/]*$", 0))
    station = F.coalesce(F.nullif(F.regexp_extract(name, STATION_FILE, 1), F.lit("")), F.regexp_extract(name, STEM, 1))
    return raw.select(station.alias("station"), F.col("dt_regis").cast("timestamp_ntz").alias("ts"), "md_valor", "md_final")


def read_station_meta(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Station metadata, text key; of a repeated station the first row in order of file names and lines is kept."""
    raw = _by_header(_lines(spark, path), META_COLUMNS, sep)
    rows = raw.select(F.col("Estacao").alias("station"), to_number("Altitude").alias("altitude"),
                      to_number("Longitude").alias("longitude"), to_number("Latitude").alias("latitude"), "_file", "_line")
    return keep_first(rows, ["station"], ["_file", "_line"]).drop("_file", "_line")


def read_semicolon_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Side tables separated by semicolons, with an explicit schema."""
    return spark.read.schema(schema).options(header=True, sep=";").csv(path)


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    return class_map(read_semicolon_csv(spark, path, "code INT, grupo STRING"))


def class_map(raw: DataFrame) -> DataFrame:
    """Code to thermal group, keeping groups that start with ``T``."""
    return raw.filter(F.col("grupo").startswith("T")).select(F.col("code").cast("int"), "grupo").distinct()


def codes_per_group(lookup: DataFrame) -> DataFrame:
    """One sorted code list per group (a lookup holds a few dozen codes)."""
    return lookup.groupBy("grupo").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def normalize_coarse(df: DataFrame) -> DataFrame:
    """Canonical names, helper columns dropped, longitudes in -180..180, missing as NULL."""
    if "valid_time" in df.columns:
        df = df.withColumnRenamed("valid_time", "ts")
    elif "time" in df.columns:
        df = df.withColumnRenamed("time", "ts")
    df = df.drop("expver", "number")
    for long, short in (("latitude", "lat"), ("longitude", "lon")):
        if long in df.columns:
            df = df.withColumnRenamed(long, short)
    floats = [c for c, t in df.dtypes if t in ("double", "float") and c not in ("lat", "lon")]
    return df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in floats}
                          | {"lon": F.when(F.col("lon") > 180, wrap_longitude("lon")).otherwise(F.col("lon"))})


def merge_families(parts: Sequence[DataFrame], keys: Sequence[str] = ("ts", "lat", "lon")) -> DataFrame:
    """Disjoint variable sets on the same keys, side by side.

    Union then one aggregation: a single shuffle for any number of parts.
    """
    values = [c for p in parts for c in p.columns if c not in keys]
    if len(values) != len(set(values)):
        raise ValueError("the parts must hold disjoint variables")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def load_span(spark: SparkSession, path: str, start: date, end: date) -> DataFrame:
    """Months of ``[start, end]`` of a table partitioned by ``year, month`` (partitions are pruned)."""
    first, last = start.year * 12 + start.month, end.year * 12 + end.month
    key = F.col("year") * 12 + F.col("month")
    return spark.read.parquet(path).filter(key.between(first, last))


def read_lz_by_hour(spark: SparkSession, path: str) -> DataFrame:
    """``(hora, lz_m)`` from the tuning record, a JSON object holding a map of 24 entries."""
    raw = spark.read.schema("lz_por_hora MAP<STRING, DOUBLE>").json(path, multiLine=True)
    return raw.select(F.explode("lz_por_hora").alias("h", "lz_m")).select(F.col("h").cast("int").alias("hora"), "lz_m")


def read_model_meta(spark: SparkSession, path: str) -> DataFrame:
    """Model record: features, lapse rate, cut points and branches, one row."""
    schema = ("features ARRAY<STRING>, lapse_rate DOUBLE, tipo STRING, "
              "corte STRUCT<var: STRING, q_lo: DOUBLE, q_hi: DOUBLE, t_lo_K: DOUBLE, t_hi_K: DOUBLE>, "
              "ramos MAP<STRING, STRUCT<modelo: STRING, saida_var: STRING>>, saida_vars MAP<STRING, STRING>")
    return spark.read.schema(schema).json(path, multiLine=True)

"""Reading and writing: tables with checked columns, flexible text encodings, task logs, vendor files, timelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_table(spark: SparkSession, path: str, required: Sequence[str] = (), ids: Sequence[str] = ()) -> DataFrame:
    """A Parquet or CSV table with its required columns; CSV columns and named ids are text."""
    df = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    return require(df, required).withColumns({c: F.col(c).cast("string") for c in ids})


def decode_flexible(content: Column) -> Column:
    """Text of bytes in UTF-8 (with or without a mark), or GB18030 where they are no UTF-8.

    Spark's own ``decode`` knows no GB18030, so this is an Arrow-batched function.
    """
    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            try:
                return b.decode("utf-8-sig")
            except UnicodeDecodeError:
                return b.decode("gb18030", "replace")

        return raw.map(one)

    return decode(content.cast("binary"))


def read_text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and text of whole files, decoded flexibly."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", decode_flexible(F.col("content")).alias("text"))


def inventory(spark: SparkSession, root: str, pattern: str = "*", id_pattern: str = r"([A-Za-z]\d{5})", excluded: str = r"/(tmp|__pycache__)/|~\$") -> DataFrame:
    """path, size and ids found in the path of every file below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"), F.transform(F.regexp_extract_all("path", F.lit(id_pattern), F.lit(1)), F.upper).alias("ids")).filter(~F.col("path").rlike(excluded))


def read_trial_csv(rows: DataFrame, marker: str, columns: Mapping[str, str], numbers: Sequence[str]) -> DataFrame:
    """Tidy trials from wide log rows: those with a marker, columns renamed, numbers read where they are numbers."""
    kept = rows.filter(F.trim(F.coalesce(marker, F.lit(""))) != "")
    return kept.select(*[(F.trim(F.col(c)).try_cast("double") if name in numbers else F.trim(F.col(c))).alias(name) for name, c in columns.items()])


def parse_frame_log(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, frame (from 1), fields of each block between ``*** LogFrame Start ***`` and ``*** LogFrame End ***``."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)\*\*\* LogFrame Start \*\*\*(.*?)\*\*\* LogFrame End \*\*\*"), F.lit(1))
    t = texts.select(key, F.posexplode(blocks).alias("frame", "_block"))
    pairs = F.transform(F.filter(F.split("_block", r"\r?\n"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    first = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, p: F.when(F.exists(acc, lambda a: a["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))))
    return t.select(key, (F.col("frame") + 1).alias("frame"), F.map_from_entries(first).alias("fields"))


def frames_to_trials(frames: DataFrame, key: str, suffix: str = ".RESP") -> DataFrame:
    """One trial per frame: response and reaction time (seconds; NULL without a response) of the object whose key ends in the suffix; block is the order in which the objects first appear."""
    name = F.filter(F.map_keys("fields"), lambda k: k.endswith(suffix))
    t = frames.withColumn("_key", F.try_element_at(name, F.lit(1))).filter("_key IS NOT NULL").withColumn("object", F.regexp_replace("_key", "\\" + suffix + "$", ""))
    first = F.min("frame").over(Window.partitionBy(key, "object"))
    get = lambda s: F.try_element_at("fields", F.concat("object", F.lit(s)))
    response = F.trim(F.coalesce(get(suffix), F.lit("")))
    t = t.withColumn("_first", first).withColumn("block", F.dense_rank().over(Window.partitionBy(key).orderBy("_first")) - 1)
    return t.select(key, "frame", "object", "block", response.alias("response"), F.when(response != "", get(".RT").try_cast("double") / 1000).alias("rt_sec"), (get(".OnsetTime").try_cast("double") / 1000).alias("onset_sec"))


def read_preamble_csv(texts: DataFrame, header: str, key: str = "path", text: str = "text") -> DataFrame:
    """key, sample, column, value, mark of a vendor file: lines before the one that starts with ``header`` are skipped; what is no number is NULL."""
    lines = texts.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line", "row"))
    at = F.min(F.when(F.col("row").startswith(header), F.col("line"))).over(Window.partitionBy(key))
    t = lines.withColumn("_h", at).filter("line >= _h AND trim(row) <> ''").withColumn("cells", F.split(F.regexp_replace("row", r",+$", ""), ","))
    names = t.filter("line = _h").select(key, F.col("cells").alias("names"))
    cells = t.filter("line > _h").join(names, key).select(key, (F.col("line") - F.col("_h") - 1).alias("sample"), F.posexplode("cells").alias("_p", "cell"), "names")
    named = cells.withColumn("column", F.try_element_at("names", F.col("_p") + 1))
    return named.select(key, "sample", "column", F.trim("cell").try_cast("double").alias("value"), F.when(F.col("column") == "Mark", F.trim("cell")).alias("mark"))


TIMELINE = T.StructType([
    T.StructField("media", T.MapType(T.StringType(), T.StringType())),
    T.StructField("segments", T.ArrayType(T.StructType([T.StructField("media_id", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))),
])


def explode_timeline_json(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, media, index (by start), start_ms, end_ms of each segment, with the media id resolved to its name."""
    t = df.select(key, F.from_json(json, TIMELINE).alias("t")).select(key, "t.media", F.explode("t.segments").alias("s"))
    t = t.select(key, F.coalesce(F.try_element_at("media", F.col("s.media_id")), F.col("s.media_id")).alias("media"), F.col("s.start").alias("start_ms"), F.col("s.end").alias("end_ms"))
    return t.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy("start_ms", "end_ms", "media")) - 1)


def read_jobs(spark: SparkSession, root: str, excluded: str = r"(diagnostics|embeddings)\.csv$") -> DataFrame:
    """All job files below root but the excluded ones; a missing device is empty."""
    t = spark.read.option("header", True).option("recursiveFileLookup", True).csv(root).withColumn("_file", F.input_file_name()).filter(~F.col("_file").rlike(excluded)).drop("_file")
    return t.fillna("", ["device"]) if "device" in t.columns else t


def write_result(df: DataFrame, path: str, partition_by: Sequence[str] = ("cv_protocol",)) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_union(frames: Sequence[DataFrame], path: str) -> None:
    """One CSV table with all columns of all frames, NULL as empty."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def attach_meta(features: DataFrame, split: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    return split.select(key, *keep).join(features, key)


def columns_by_role(df: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns with one of the prefixes and none of the excluded ones."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [c for c, t in df.dtypes if t in numeric and c.startswith(tuple(include)) and not (exclude and c.startswith(tuple(exclude)))]


def prefix_features(df: DataFrame, role: str, task: str) -> DataFrame:
    """role_x renamed to role_task_x; the mark contrast_ stays in front."""
    def name(c: str) -> str:
        if not c.startswith(f"{role}_"):
            return c
        rest = c[len(role) + 1 :]
        return f"{role}_contrast_{task}_{rest[9:]}" if rest.startswith("contrast_") else f"{role}_{task}_{rest}"
    return df.toDF(*[name(c) for c in df.columns])

"""Files in and out: JSON lines (lenient, audited, strict), JSON arrays and envelopes, text trees, split writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Blank and undecodable lines are skipped."""
    return jsonl_audited(spark, path, schema).where("valid").drop("raw", "valid")


def jsonl_audited(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All non-blank lines: the columns of ``schema``, ``raw`` and ``valid`` (an object that parses)."""
    lines = spark.read.text(path).withColumnRenamed("value", "raw").where("trim(raw) != ''")
    parsed = lines.withColumn("_v", F.try_parse_json("raw")).withColumn("valid", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    return parsed.withColumn("_j", F.from_json("raw", schema if isinstance(schema, str) else schema.simpleString())).select("_j.*", "raw", "valid")


def jsonl_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_auto(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """An array if the first character that isn't blank is ``[``, else lines."""
    first = spark.read.text(path).where("trim(value) != ''").limit(1).collect()
    return json_array(spark, path, schema) if first and first[0].value.lstrip().startswith("[") else jsonl(spark, path, schema)


def json_envelope(spark: SparkSession, path: str, item: str, field: str = "data") -> DataFrame:
    """Rows of ``{"data": [...]}``."""
    return spark.read.schema(f"`{field}` array<struct<{item}>>").option("multiLine", True).json(path).select(F.explode(field).alias("_x")).select("_x.*")


def references(df: DataFrame, source: str, ids: list[str], doi: str = "doi") -> DataFrame:
    """(id, doi, source) of one source, without rows that miss id or DOI."""
    return df.select(F.coalesce(*(F.col(c).cast("string") for c in ids)).alias("id"), F.col(doi).cast("string").alias("doi"), F.lit(source).alias("source")).dropna(subset=["id", "doi"])


#: How each kind of reference list is read: format, columns that may hold the id.
REFERENCE_KINDS = {"array": ("id",), "lines": ("id",), "envelope": ("id", "other_id"), "titles": ("title",), "registry": ("registry_id",)}


def tagged_references(spark: SparkSession, lists: list[tuple[str, str, str]], names: dict[str, str] | None = None) -> DataFrame:
    """(id, doi, source) of all lists, given as (kind, path, source); a path that isn't there gives no rows.

    Kinds: ``array`` and ``lines`` (JSON objects with id and doi), ``envelope`` (such objects under ``data``; the id may have
    another name), ``titles`` and ``registry`` (Parquet, by title or by registry id). ``names`` renames id columns.
    """
    names, out = names or {}, spark.createDataFrame([], "id string, doi string, source string")
    for kind, path, source in lists:
        if not exists(spark, path):
            continue
        ids = [names.get(c, c) for c in REFERENCE_KINDS[kind]]
        fields = ", ".join(f"`{c}` string" for c in [*ids, "doi"])
        if kind == "array":
            df = json_array(spark, path, fields)
        elif kind == "lines":
            df = jsonl(spark, path, fields)
        elif kind == "envelope":
            df = json_envelope(spark, path, ", ".join(f"`{c}`:string" for c in [*ids, "doi"]))
        else:
            df = spark.read.parquet(path)
        out = out.unionByName(references(df, source, ids))
    return out


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """In whatever store Spark reads."""
    p, store = _path(spark, path)
    return store.exists(p)


def to_do(files: DataFrame, done: DataFrame, root: str, out: str, suffix: str) -> DataFrame:
    """(file_path, target): files below ``root`` whose mirrored file below ``out`` isn't among ``done`` (file_path)."""
    base = root.rstrip("/") + "/"
    tail = F.regexp_replace(F.substring_index("file_path", base, -1), r"\.[^./]*$", suffix)
    planned = files.select("file_path", F.concat(F.lit(out.rstrip("/") + "/"), tail).alias("target"))
    return planned.join(done.select(F.col("file_path").alias("target")), "target", "left_anti").select("file_path", "target")


def text_tree(spark: SparkSession, path: str, suffix: str = ".md") -> DataFrame:
    """(doc_id, file_path, text) of all files below a folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
    name = F.regexp_replace(F.col("_metadata.file_name"), f"\\Q{suffix}\\E$", "")
    return files.select(name.alias("doc_id"), F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def binary_tree(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if lack := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lack)}")
    return df


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_shards(df: DataFrame, path: str, rows: int = 10_000) -> None:
    df.write.option("maxRecordsPerFile", rows).json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A bounded result (one row per group) as one JSON document, an array in the order of its rows, in place of what was there."""
    rows = F.to_json(F.collect_list(F.struct(F.col("*"))), {"pretty": "true", "ignoreNullFields": "false"})
    replace(df.coalesce(1).agg(rows.alias("value")), path, "text")


def write_sample(df: DataFrame, key: str, n: int, path: str, seed: int = 0) -> None:
    """At most n rows as CSV with a header, the same ones on every run."""
    from ..operators.dedupe import hash_sample

    hash_sample(df, key, n, seed).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def replace(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write beside the old table, and only then put the new one in its place; readers of the old path see one or the other."""
    spark, fresh = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.write.format(fmt).save(fresh)
    new, store = _path(spark, fresh)
    old, _ = _path(spark, path)
    aside, _ = _path(spark, f"{fresh}.old")
    had = store.exists(old) and store.rename(old, aside)
    if not store.rename(new, old):
        if had:
            store.rename(aside, old)
        raise OSError(f"{path} could not be replaced")
    if had:
        store.delete(aside, True)


def append_manifest(df: DataFrame, path: str) -> None:
    """Add rows to a manifest; a key may have several, of which :func:`manifest` takes the best."""
    df.write.mode("append").parquet(path)


def manifest(spark: SparkSession, path: str, key: str, schema: str, done: str = "downloaded") -> DataFrame:
    """One row per key: one that is done if there is one, else the last. An empty one where no manifest is yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    best = F.max_by(F.struct(F.col("*")), F.struct((F.col("status") == done).alias("d"), F.col("ts")))
    return rows.groupBy(F.col(key).alias("_k")).agg(best.alias("_r")).select("_r.*")


def write_split(df: DataFrame, column: str, path: str) -> None:
    """Each row to the folder of its bucket, in one pass."""
    df.write.partitionBy(column).parquet(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").write.text(path)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the schema in its order, missing ones null, others kept behind them."""
    have = set(df.columns)
    known = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*known, *(c for c in df.columns if c not in schema.names))

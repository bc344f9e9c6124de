"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's regular expression for the six ASCII white-space characters of the contracts.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, ``spark.checkpoint.dir`` or the one set on the context.

    Only a session that runs in one process (a test) gets a temporary folder where none is
    set; on a cluster other machines wouldn't see that, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_where(docs: DataFrame, text_col: str, keep: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """The rows of ``docs`` for whose texts a function, made once per task, says true; all columns unchanged, whatever their names."""
    names, at = docs.columns, docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = keep()
        for batch in batches:
            yield batch.filter(test(batch.column(at)))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there: for many narrow rows, which columns pack better."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column name for ``F.col`` and DDL, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class BitFilter:
    """Which 64-bit keys may be in a set: two bits each in an array of at most ``MAX_BITS`` bits (8 MB).

    The size bound holds for any set; a set that is too large for it only makes the filter
    pass more keys, so what it passes must be joined exactly afterwards.
    """

    MIN_BITS, MAX_BITS = 1 << 10, 1 << 26

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def build(keys: DataFrame, key: str, count: int) -> BitFilter:
        bits = min(BitFilter.MAX_BITS, max(BitFilter.MIN_BITS, 1 << (16 * max(count, 1) - 1).bit_length()))
        k = F.col(key)
        at = F.explode(F.array(k.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(k, 32).bitwiseAND(F.lit(bits - 1))))
        rows = keys.select(at.alias("_p")).groupBy(F.shiftright("_p", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_p & 63 as int)))").alias("_m")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[rows["_w"].to_numpy()] = rows["_m"].to_numpy().astype(np.int64).view(np.uint64)
        return BitFilter(words)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        k, last = keys.view(np.uint64), np.uint64(len(self.words) * 64 - 1)
        ok = np.ones(len(k), bool)
        for p in (k & last, (k >> np.uint64(32)) & last):
            ok &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return ok

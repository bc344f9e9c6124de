"""Exact dedup with two Bloom passes; only rows whose hash may repeat are shuffled.

Texts are equal when they are identical after deleting ASCII white space.

Pass 1 puts two bits per row into a bit array and keeps the positions that at
least two rows set. Pass 2 looks both positions of each row up: a row that misses
one of them is unique and goes straight to the output, the others are grouped on
the SHA-256 of their text. The bit array has at most ``MAX_BITS`` bits, so the
broadcast table has at most ``MAX_BITS / 64`` rows whatever the input is; beyond
some ten million rows it lets more unique rows through to the exact stage, which
sees digests of about 60 bytes and never a text.

Everything here is built from DataFrame functions.

Edge cases: a null text counts as empty and all empty texts are equal; repeated
rows (same id and text) form one group of which exactly one row is kept; null ids
sort before others; columns other than the id and the text are neither read nor
returned by :func:`exact_dedup`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut, quoted, table, text_or_empty

MIN_BITS, MAX_BITS = 1 << 10, 1 << 26
#: A group is hot from this size, and from a thousandth of all rows: at most 1,000 such groups exist.
HOT_ROWS, HOT_SHARE = 1000, 1000


def normalised_sha256(text: str = "text") -> Column:
    return F.sha2(F.regexp_replace(text_or_empty(text), ASCII_SPACE, ""), 256)


def _positions(sha: str, bits: int) -> tuple[Column, Column]:
    h = F.xxhash64(F.col(sha))
    return h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))


def bits_for(rows: int) -> int:
    """A power of two with 16 bits a row at least, between the two bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (16 * max(rows, 1) - 1).bit_length()))


def repeated_bits(rows: DataFrame, sha: str, bits: int) -> DataFrame:
    """Pass 1: words (_word, _mask) of the bits that two rows or more set; at most bits / 64 rows."""
    p1, p2 = _positions(sha, bits)
    return (
        rows.select(F.explode(F.array_distinct(F.array(p1, p2))).alias("_p"))
        .groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        .where("_n >= 2")
        .groupBy(F.shiftright("_p", 6).alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(_p & 63 as int)))").alias("_mask"))
    )


def flag_possible_repeats(rows: DataFrame, sha: str, words: DataFrame, bits: int) -> DataFrame:
    """Pass 2: ``rows`` with the boolean ``_maybe``, false only for unique hashes."""
    p1, p2 = _positions(sha, bits)
    out = rows.withColumns({"_p1": p1, "_p2": p2})
    for k in ("1", "2"):
        side = F.broadcast(words.select(F.col("_word").alias(f"_w{k}"), F.col("_mask").alias(f"_m{k}")))
        out = out.join(side, F.shiftright(f"_p{k}", 6) == F.col(f"_w{k}"), "left")
    hit = [F.coalesce(F.expr(f"(shiftright(_m{k}, cast(_p{k} & 63 as int)) & 1L) = 1L"), F.lit(False)) for k in ("1", "2")]
    return out.withColumn("_maybe", hit[0] & hit[1]).drop("_p1", "_p2", "_w1", "_w2", "_m1", "_m2")


def _decide(rows: DataFrame, n: int) -> DataFrame:
    """Exact stage over the possibly repeated rows (_id, _len, _row, _sha)."""
    groups = cut(
        rows.groupBy("_sha").agg(
            F.min(F.struct((-F.col("_len")).alias("l"), F.col("_id").alias("i"), F.col("_row").alias("r"))).alias("_best"),
            F.count(F.lit(1)).alias("_size"),
        )
    )
    hot = F.col("_size") >= max(HOT_ROWS, n // HOT_SHARE)
    first = rows.join(F.broadcast(groups.where(hot)), "_sha", "left")
    rest = first.where(F.col("_size").isNull()).drop("_best", "_size").join(groups.where(~hot), "_sha")
    return first.where(F.col("_size").isNotNull()).unionByName(rest)


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return cut(
        docs.select(
            F.col(quoted(id_col)).alias("_id"),
            F.char_length(text_or_empty(text_col)).alias("_len"),
            normalised_sha256(text_col).alias("_sha"),
        ).withColumn("_row", F.monotonically_increasing_id())
    )


def _run(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int, int]:
    rows = _digests(docs, id_col, text_col)
    n = rows.count()
    bits = bits_for(n)
    words = cut(repeated_bits(rows, "_sha", bits))
    flagged = flag_possible_repeats(rows, "_sha", words, bits)
    exact = _decide(flagged.where("_maybe"), n).select(
        "_id", "_len", F.col("_best.i").alias("_keep"), "_size", (F.col("_row") == F.col("_best.r")).alias("_kept"), "_sha"
    )
    alone = flagged.where(~F.col("_maybe")).select(
        "_id", "_len", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"), "_sha"
    )
    return alone.unionByName(exact), words, bits, n


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points stays, then the smallest id.
    """
    rows, *_ = _run(docs, id_col, text_col)
    return rows.select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged: the one that :func:`exact_dedup` keeps.

    Rows that can't repeat are read, tested and written without a shuffle. The row that stays is told
    by id, hash and length; of rows equal in all three (repeated rows, say) one stays.
    """
    decisions, words, bits, n = _run(docs, id_col, text_col)
    best = cut(decisions.where("_kept and _size > 1").select(F.col("_sha").alias("_best_sha"), F.col("_id").alias("_best_id"), F.col("_len").alias("_best_len"), "_size"))
    length = F.char_length(text_or_empty(text_col))
    packed = docs.select(F.struct(F.col("*")).alias("row"), F.col(quoted(id_col)).alias("id"), length.alias("len"), normalised_sha256(text_col).alias("_sha"))
    seen = flag_possible_repeats(packed, "_sha", words, bits)
    same, one = F.col("_sha") == F.col("_best_sha"), F.col("id").eqNullSafe(F.col("_best_id")) & (F.col("len") == F.col("_best_len"))
    hot = F.col("_size") >= max(HOT_ROWS, n // HOT_SHARE)
    first = seen.where("_maybe").join(F.broadcast(best.where(hot)), same, "left")
    rest = first.where("_size is null").select("row", "id", "len", "_sha").join(best.where(~hot), same, "left")
    alone = rest.where("_size is null")  # unique hashes that the filter let through
    several = first.where("_size is not null").select(*rest.columns).unionByName(rest.where("_size is not null")).where(one)
    stays = several.groupBy("_sha").agg(F.first("row").alias("row"))
    return seen.where(~F.col("_maybe")).select("row.*").unionByName(alone.select("row.*")).unionByName(stays.select("row.*"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS r,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM w
"""

"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

``MERGERS`` frequent-items sketches of the Misra-Gries family (``approx_top_k``: every
digest with more than 1/(0.75 * ``tracked``) of a sketch's rows is in it) name candidates;
an exact count verifies them.  The verified winners, at most ``max_winners * MERGERS``
rows, are broadcast and resolve their copies map-side; the remaining digests, none of
them frequent, take one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import WHITESPACE, stored, without

#: Tasks that merge the sketches of the input's tasks.
MERGERS = 64


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ").cast("binary"), 256)


def winners(digests: DataFrame, max_winners: int, tracked: int, least: int) -> DataFrame:
    """Verified frequent digests of ``least`` rows or more: key, keep_id, group_size."""
    top = digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("m")).agg(F.expr(f"approx_top_k(key, {max_winners}, {tracked})").alias("top"))
    # An estimate is never below the count, and a digest of ``least`` rows has its share of them in some sketch.
    names = top.select(F.explode("top").alias("t")).where(F.col("t.count") >= -(-least // MERGERS)).select(F.col("t.item").alias("key")).distinct()
    return (
        digests.join(F.broadcast(names), "key", "left_semi").groupBy("key")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).where(F.col("group_size") >= least)
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_winners: int = 1000, tracked: int = 4000, least: int = 128) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty.  The smallest id of equal texts stays; null ids are never
    smallest, and a group of null ids alone keeps them all.  Rows repeated with the same
    id share one decision.  An empty table gives no rows; other columns are not read.
    """
    digests = stored(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("key")), "digests")
    hot = stored(winners(digests, max_winners, tracked, least), "winners")
    light = digests.join(F.broadcast(hot.select("key")), "key", "left_anti")
    group = Window.partitionBy("key")
    parts = [
        digests.join(F.broadcast(hot), "key").select("id", "key", "keep_id", "group_size"),
        light.select("id", "key", F.min("id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size")),
    ]
    return parts[0].unionByName(parts[1]).select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("key").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Rows with a null id can't be named and all stay; rows repeated with one id stay or
    go together.
    """
    return without(docs, id_col, exact_groups(docs, id_col, text_col, **how).where(~F.col("kept")).select(id_col))

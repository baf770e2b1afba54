"""Queries that exercise sources and sinks over the driver's tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators.joins import densify
from ..sources import files
from ..sources.tables import table
from .registry import query


def scratch(spark) -> str:
    """A folder that driver and executors share: the session's checkpoint folder; a temporary one where all run in one JVM."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/fluxpanel-{uuid.uuid4().hex}"


@query("SELECT count(*) AS rows, sum(l_quantity)::BIGINT AS quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def pruned_range_scan(spark, sf):
    low, high = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz")
    df = files.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_quantity"], ("l_shipdate", low, high))
    return df.agg(F.count("*").alias("rows"), F.sum("l_quantity").cast("bigint").alias("quantity"))


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    path = scratch(spark)
    kind = "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string"
    files.write_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path)
    return files.read_csv(spark, path, kind)


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def csv_dates(spark, sf):
    """Two of four columns, a date among them, out of a CSV."""
    path = scratch(spark)
    files.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus"), path)
    return files.read_csv(spark, path, "o_orderkey bigint, o_custkey bigint, day date, o_orderstatus string", ["o_orderkey", "day"])


@query("SELECT strftime(o_orderdate, '%Y%m%d') AS day, count(*) AS orders FROM orders GROUP BY 1")
def csv_without_header(spark, sf):
    path = scratch(spark)
    days = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyyMMdd").alias("day")).agg(F.count("*").alias("orders"))
    files.write_csv(days, path, header=False)
    return files.read_csv(spark, path, "day string, orders bigint", header=False)


@query("SELECT id, s::DATE AS \"start\", e::DATE AS \"end\" FROM (VALUES ('a', '1997-09-01', '1997-09-30'), ('b', '1997-10-01', '1997-10-30')) t(id, s, e)")
def window_config(spark, sf):
    """Windows out of a JSON file."""
    path = scratch(spark)
    spark.sql("SELECT array(named_struct('id', 'a', 'start', '1997-09-01', 'end', '1997-09-30'), named_struct('id', 'b', 'start', '1997-10-01', 'end', '1997-10-30')) AS windows").coalesce(1).write.json(path)
    return files.read_windows(spark, path)


@query("SELECT 'r' || r_regionkey AS file, CASE r_regionkey WHEN 0 THEN 'missing' WHEN 1 THEN 'changed' ELSE 'PASS' END AS status FROM region UNION ALL SELECT 'r9', 'extra'")
def inventory_check(spark, sf):
    """A list of hashes, written and read as text, against what is found."""
    path = scratch(spark)
    known = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("file"), F.sha2(F.col("r_name").cast("binary"), 256).alias("sha256"), F.length("r_name").cast("long").alias("bytes"), "r_regionkey", "r_name")
    known.select(F.concat_ws("  ", "sha256", "file").alias("value")).unionByName(spark.sql("SELECT 'no hash' AS value")).write.text(path)
    expected = files.read_hashes(spark, path).join(known.select("file", "bytes"), "file")
    found = known.where("r_regionkey > 0").select("file", "bytes", F.when(F.col("r_regionkey") == 1, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return files.verify_inventory(expected, found.unionByName(spark.sql("SELECT 'r9' AS file, 1L AS bytes, 'x' AS sha256")))


@query("SELECT o_orderdate::DATE AS day, count(*) AS orders, sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT))::BIGINT AS cents FROM orders GROUP BY 1")
def parquet_clustered_round_trip(spark, sf):
    path = scratch(spark)
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint").alias("c"))
    files.write_parquet(o.groupBy("day").agg(F.count("*").alias("orders"), F.sum("c").alias("cents")), path, sort=["day"], range_by="day")
    return files.read_parquet(spark, path)


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS record FROM nation""")
def json_records(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return files.json_records(n).select(F.get_json_object("record", "$.n_nationkey").cast("int").alias("n_nationkey"), "record")


@query("SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(n, 0) AS events FROM (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS d FROM events) LEFT JOIN (SELECT ts::DATE AS d, count(*) AS n FROM events GROUP BY 1) USING (d)")
def event_calendar(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
    return densify(days, "day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("events", F.lit(0)).alias("events"))


@query("SELECT ts::DATE AS day, event_type, count(*) AS events, sum(CAST(floor(value * 100 + 0.5) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1, 2")
def streamed_daily_totals(spark, sf):
    from ..streaming.daily import daily_totals

    return daily_totals(spark, f"{sf}/events.parquet", scratch(spark))


@query(None)
def parquet_footer(spark, sf):
    return files.describe_parquet(spark, f"{sf}/orders.parquet")


@query(None)
def file_hashes(spark, sf):
    return files.file_hashes(spark, f"{sf}/nation.parquet")

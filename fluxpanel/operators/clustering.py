"""Robust scaling, a K-means grid with stability metrics, and the hybrid label."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations
from multiprocessing.pool import ThreadPool
from statistics import median

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quantiles import group_quantiles
from .segments import STRUCTURAL, adjusted_rand
from .series import average_rank

#: Amounts enter by log1p, recency by quarters of a year.
LOGGED = ("end_balance_life", "direct_90", "consume_90", "transfer_90")
INPUTS = (
    "log_end_balance_life", "log_direct_90", "log_consume_90", "log_transfer_90", "active_recency_90", "active_days_per_30", "roundtrip_90", "net_flow_share_90",
    "consume_share_90", "transfer_share_90", "bank_share_90", "positive_balance_ratio",
)
#: Fits and metrics that run at once: each is a chain of short jobs, which alone leaves most cores idle.
AT_ONCE = 8


def eligible(users: DataFrame) -> DataFrame:
    return users.where(((F.col("active_flow_days_90") > 0) | (F.col("end_balance_life") > 0)) & ~F.col("no_active_history") & ~F.col("history_insufficient"))


def inputs(users: DataFrame) -> DataFrame:
    return users.withColumns({f"log_{c}": F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in LOGGED} | {"active_recency_90": F.col("active_recency") / 90.0})


def scale_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Of each column: median, interquartile range, population deviation and the scale that divides it; quantiles by ranges."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])))
    three = long.select(F.inline(F.array(*[F.struct("column", F.lit(n).alias("q"), F.lit(p).alias("p"), F.col("v")) for n, p in (("low", 0.25), ("median", 0.5), ("high", 0.75))])))
    q = group_quantiles(three, ["column", "q"]).groupBy("column").agg(*[F.max(F.when(F.col("q") == n, F.col("quantile"))).alias(n) for n in ("low", "median", "high")])
    spread = long.groupBy("column").agg(F.stddev_pop("v").alias("deviation"))
    out = q.join(F.broadcast(spread), "column").withColumn("iqr", F.col("high") - F.col("low"))  # a row a column
    return out.select("column", "median", "iqr", "deviation", F.when(F.col("iqr") > 0, F.col("iqr")).when(F.col("deviation") > 0, F.col("deviation")).otherwise(1.0).alias("scale"))


def robust_scale(df: DataFrame, columns: Sequence[str], limit: float = 6.0) -> DataFrame:
    """(x - median) / IQR, clipped; population deviation where the IQR is zero, 1 where that is too."""
    rows = {r["column"]: r for r in scale_table(df, columns).collect()}  # a row a column
    bounded = lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x))
    return df.withColumns({c: bounded((F.col(c) - F.lit(rows[c].median)) / F.lit(rows[c].scale)) for c in columns if c in rows})


def separation(points: DataFrame, features: str = "features", label: str = "prediction") -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin indices of one clustering, from per-cluster sums."""
    long = points.select(F.col(label).alias("c"), F.posexplode(vector_to_array(features)).alias("d", "x"))
    cells = long.groupBy("c", "d").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    grand = cells.groupBy("d").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    spread = cells.join(F.broadcast(grand), "d").groupBy("c").agg(F.first("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("w"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), F.lit(2.0))).alias("b"))
    totals = spread.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("w").alias("w"), F.sum("b").alias("b"))
    ch = totals.select(F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1)).alias("calinski_harabasz"))
    near = points.join(F.broadcast(cells.groupBy(F.col("c").alias(label)).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("center"))), label)
    dist = F.sqrt(F.aggregate(F.zip_with(vector_to_array(features), "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    scatter = near.groupBy(F.col(label).alias("c")).agg(F.avg(dist).alias("s"))
    a = cells.select(F.col("c").alias("a"), "d", F.col("m").alias("ma"))
    b = cells.select(F.col("c").alias("b"), "d", F.col("m").alias("mb"))
    gap = a.join(b, "d").where("a != b").groupBy("a", "b").agg(F.sqrt(F.sum(F.pow(F.col("ma") - F.col("mb"), F.lit(2.0)))).alias("gap"))  # k x k rows
    pairs = gap.join(F.broadcast(scatter.select(F.col("c").alias("a"), F.col("s").alias("sa"))), "a").join(F.broadcast(scatter.select(F.col("c").alias("b"), F.col("s").alias("sb"))), "b")
    db = pairs.groupBy("a").agg(F.max(F.try_divide(F.col("sa") + F.col("sb"), "gap")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    return ch.crossJoin(db)


def _at_once(spark: SparkSession, f: Callable, items: Sequence) -> list:
    """``f`` of each item, in order."""
    with ThreadPool(max(1, min(AT_ONCE, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(f), items, chunksize=1)


def _metrics(points: DataFrame, fits: Sequence, labels: DataFrame) -> tuple[float, float, float, float]:
    """Calinski-Harabasz, Davies-Bouldin, stability of ``fits`` and the smallest cluster's share of ``labels``."""
    sep = separation(labels).first()
    k = fits[0].getK()
    shares = labels.groupBy("prediction").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    runs = points
    for i, m in enumerate(fits):
        runs = m.copy().setPredictionCol(f"run_{i}").transform(runs)
    pairs = [F.struct(F.lit(f"{i}-{j}").alias("pair"), F.col(f"run_{i}").alias("a"), F.col(f"run_{j}").alias("b")) for i, j in combinations(range(len(fits)), 2)]
    rand = [r.adjusted_rand for r in adjusted_rand(runs.select(F.inline(F.array(*pairs))), "a", "b", ["pair"]).collect()] if pairs else []
    return sep.calinski_harabasz, sep.davies_bouldin, median(rand) if rand else 1.0, shares.least / shares.n if shares.k == k else 0.0


def fit_grid(scaled: DataFrame, columns: Sequence[str] = INPUTS, ks: Sequence[int] = range(3, 9), seeds: Sequence[int] = range(5), key: str = "user_id"):
    """For each k the restart of least cost, its metrics and stability; and the labels of the chosen k.

    Stability is the median adjusted Rand index over all pairs of restarts.  The k with the
    smallest sum of ranks wins (Calinski-Harabasz high, Davies-Bouldin low, stability and
    the smallest cluster's share high), ties to the smaller k.
    """
    spark = scaled.sparkSession
    points = VectorAssembler(inputCols=list(columns), outputCol="features").transform(scaled).select(key, "features")
    points = points.coalesce(max(1, spark.sparkContext.defaultParallelism)).cache()  # a fit goes through all partitions in every iteration
    points.count()
    fitted = _at_once(spark, lambda run: KMeans(k=run[0], seed=run[1], maxIter=100, tol=1e-7).fit(points), [(k, s) for k in ks for s in seeds])
    runs = {k: fitted[i * len(seeds) : (i + 1) * len(seeds)] for i, k in enumerate(ks)}
    best = {k: min(fits, key=lambda m: m.summary.trainingCost) for k, fits in runs.items()}
    labels = {k: m.transform(points).select(key, "features", "prediction") for k, m in best.items()}
    rows = _at_once(spark, lambda k: (k, best[k].summary.trainingCost, *_metrics(points, runs[k], labels[k])), list(ks))
    points.unpersist()  # later reads of the labels run through the models again
    table = spark.createDataFrame(rows, "k int, inertia double, calinski_harabasz double, davies_bouldin double, stability double, smallest_share double")
    labels = {k: df.select(key, "prediction") for k, df in labels.items()}
    chosen = rank_sum(table, {"calinski_harabasz": False, "davies_bouldin": True, "stability": False, "smallest_share": False}, "k").first().k
    return table, labels[chosen].select(key, F.concat(F.lit("cluster_"), F.col("prediction").cast("string")).alias("auto_cluster")), chosen


def rank_sum(table: DataFrame, ascending: dict[str, bool], tie: str) -> DataFrame:
    """Rows by the sum of their average ranks in each column, best first, ties by ``tie``; a small table."""
    signed = table.withColumns({f"__{c}": F.col(c) if up else -F.col(c) for c, up in ascending.items()})
    ranked = signed.withColumns({f"{c}_rank": average_rank(f"__{c}") for c in ascending}).drop(*[f"__{c}" for c in ascending])
    total = sum((F.col(f"{c}_rank") for c in ascending), F.lit(0.0))
    return ranked.withColumn("rank_sum", total).orderBy("rank_sum", tie)


def hybrid(users: DataFrame, clusters: DataFrame, key: str = "user_id") -> DataFrame:
    """The rule label where it is structural, else the cluster, else the rule label."""
    joined = users.join(clusters, key, "left")
    return joined.withColumn("hybrid_segment", F.when(F.col("segment").isin(*STRUCTURAL), F.col("segment")).otherwise(F.coalesce("auto_cluster", "segment")))


def cluster_profile(users: DataFrame, columns: Sequence[str], label: str = "auto_cluster") -> DataFrame:
    """Size and medians of each cluster; medians by ranges of values."""
    own = users.where(F.col(label).isNotNull())
    long = own.select(label, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))).withColumn("p", F.lit(0.5))
    medians = group_quantiles(long, [label, "column"]).groupBy(label).agg(*[F.max(F.when(F.col("column") == c, F.col("quantile"))).alias(f"median_{c}") for c in columns])
    return own.groupBy(label).agg(F.count("*").alias("users")).join(medians, label)


def first_by(table: DataFrame, order: Sequence) -> DataFrame:
    """The first row under an order of several keys, each up or down."""
    return table.withColumn("__rn", F.row_number().over(Window.orderBy(*order))).where("__rn = 1").drop("__rn")

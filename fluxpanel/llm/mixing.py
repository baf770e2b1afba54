"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree, say domain, language, source.  Every node has a weight among
its siblings.  The token budget goes down from the root in proportion to the weights; a
node never gets more than its leaves can give (their tokens times the epochs allowed), and
what one node can't take goes to its siblings, in proportion to theirs; only what a whole
family can't take is shared among the family's own siblings.  A leaf takes its budget
from seeded epochs: whole epochs first, then a token-prefix of one more epoch's order.

The tree alone reaches the driver, and its size is checked.  A leaf is never sorted in one
task: its epoch's order is cut into ``BUCKETS`` ranges of a hash, whose token sums say in
which range the prefix ends; only that range is sorted.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of an epoch's order, as hexadecimal digits of the hash.
DIGITS = 3
MAX_LEAVES = 100_000


def token_count(text: str = "text"):
    """Words between ASCII white space; zero for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def share(total: int, wants: list[tuple[Fraction, int]]) -> list[int]:
    """``total`` in proportion to the weights, none above its capacity; whole tokens.

    What a capacity leaves over goes to those with room, until none is left or no one has
    room.  Children without weight take no part.  Fractions go to the largest remainders.
    """
    out = [0] * len(wants)
    open_ = [i for i, (w, cap) in enumerate(wants) if w > 0 and cap > 0]
    left = min(total, sum(wants[i][1] for i in open_))
    while open_:
        weight = sum(wants[i][0] for i in open_)
        full = [i for i in open_ if Fraction(left) * wants[i][0] / weight >= wants[i][1]]
        if not full:
            exact = {i: Fraction(left) * wants[i][0] / weight for i in open_}
            for i in open_:
                out[i] = int(exact[i])
            rest = left - sum(out[i] for i in open_)
            for i in sorted(open_, key=lambda i: (-(exact[i] - int(exact[i])), i))[:rest]:
                out[i] += 1
            break
        for i in full:
            out[i] = wants[i][1]
            left -= wants[i][1]
        open_ = [i for i in open_ if i not in full]
    return out


def budgets(leaves: Mapping[tuple, int], weights: Mapping[tuple, float], total: int) -> dict[tuple, int]:
    """A budget for each leaf path.  ``weights`` is by path prefix; a missing one counts as 1."""
    out: dict[tuple, int] = dict.fromkeys(leaves, 0)
    weight = lambda path: Fraction(str(weights.get(path, 1)))

    def families(prefix: tuple, below: list[tuple]) -> dict[tuple, list[tuple]]:
        found: dict[tuple, list[tuple]] = {}
        for path in below:
            if weight(path[: len(prefix) + 1]) > 0:
                found.setdefault(path[: len(prefix) + 1], []).append(path)
        return found

    def room(prefix: tuple, below: list[tuple]) -> int:
        """What the node's leaves can give, without those of no weight."""
        return leaves[prefix] if below == [prefix] else sum(room(n, paths) for n, paths in families(prefix, below).items())

    def down(prefix: tuple, budget: int, below: list[tuple]) -> None:
        if below == [prefix]:
            out[prefix] = budget
            return
        own = families(prefix, below)
        names = sorted(own, key=lambda p: tuple((x is not None, str(x)) for x in p))
        for name, given in zip(names, share(budget, [(weight(n), room(n, own[n])) for n in names])):
            down(name, given, own[name])

    if leaves:
        down((), total, list(leaves))
    return out


def _chosen(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, float], fraction: float | None, tokens: int | None, id_col: str, size: Column, epochs: int, seed: int) -> DataFrame:
    """Leaf columns l0, l1, ..., id, tokens, epoch, leaf_budget, whole (epochs taken whole), and the key where a prefix chose the row."""
    leaf = [f"l{i}" for i in range(len(levels))]
    base = docs.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in zip(leaf, levels.values())], size.alias("tokens"))
    base = stored(base, "token-counts").where("tokens > 0")
    sums = base.groupBy(*leaf).agg(F.sum("tokens").alias("have"))
    rows = sums.limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"the tree has over {MAX_LEAVES} leaves")
    have = {tuple(r[c] for c in leaf): r.have for r in rows}
    total = tokens if tokens is not None else int(Fraction(str(1.0 if fraction is None else fraction)) * sum(have.values()))
    given = budgets({p: t * epochs for p, t in have.items()}, weights, total)
    kinds = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in leaf)
    table = docs.sparkSession.createDataFrame([(*p, b, b // have[p], b % have[p]) for p, b in given.items()], f"{kinds}, leaf_budget long, whole long, part long")
    same = [base[c].eqNullSafe(table[c]) for c in leaf]
    rows = base.join(F.broadcast(table), same).select(*[base[c] for c in leaf], "id", "tokens", "leaf_budget", "whole", "part")  # MAX_LEAVES rows at most
    columns = [*leaf, "id", "tokens", "epoch", "leaf_budget", "whole", "key"]
    whole = rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1))).withColumn("key", F.lit(None).cast("string")).select(*columns)
    last = rows.where("part > 0").withColumns({"key": place(seed, "id"), "epoch": F.col("whole").cast("int")}).withColumn("bucket", F.substring("key", 1, DIGITS))
    by_bucket = last.groupBy(*leaf, "bucket").agg(F.sum("tokens").alias("sum"), F.first("part").alias("part"))
    upto = Window.partitionBy(*leaf).orderBy("bucket")
    cut = by_bucket.withColumn("end", F.sum("sum").over(upto)).select(
        *[F.col(c).alias(f"b_{c}") for c in leaf], F.col("bucket").alias("b_bucket"), (F.col("end") - F.col("sum")).alias("start"), "end"
    )
    inside = last.join(cut, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in leaf] + [F.col("bucket") == F.col("b_bucket")]).where("start < part")
    sure = inside.where("end <= part")
    order = Window.partitionBy(*leaf, "bucket").orderBy("key", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = inside.where("end > part").withColumn("upto", F.col("start") + F.sum("tokens").over(order)).where("upto <= part")
    return whole.unionByName(sure.select(*columns)).unionByName(edge.select(*columns))


def place(seed: int, id_col: str, whole: str = "whole") -> Column:
    """Where a document stands in the order of the epoch after ``whole`` epochs."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(whole).cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)


def mix(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, float], *, fraction: float | None = None, tokens: int | None = None,
    id_col: str = "doc_id", tokens_expr: Column | None = None, epochs: int = 1, seed: int = 42,
) -> DataFrame:
    """One row per chosen document and epoch: id, the levels, tokens, epoch, leaf_budget.

    ``levels`` names the tree's levels from the root down, each with its column.  The budget
    is ``tokens``, or ``fraction`` of all tokens there are.  ``epochs`` bounds how often a
    document can be taken.  A document is in the prefix if it ends within the budget, so a
    leaf gives its budget less a part of one document.  Null levels are a node of their own;
    null texts and texts without a token take no part.  Rows repeated with one id stand side
    by side in the order and count each; null ids are ordered as empty ones.  An empty table
    gives no rows.  Other columns of ``docs`` are not returned; a level with the name of
    another output column raises.
    """
    names = [id_col, *levels, "tokens", "epoch", "leaf_budget"]
    if len(set(names)) < len(names):
        raise ValueError(f"output columns clash: {names}")
    size = token_count() if tokens_expr is None else tokens_expr
    out = _chosen(docs, levels, weights, fraction, tokens, id_col, size, epochs, seed)
    return out.select(F.col("id").alias(id_col), *[F.col(f"l{i}").alias(n) for i, n in enumerate(levels)], "tokens", "epoch", "leaf_budget")


def taken(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, float], *, fraction: float | None = None, tokens: int | None = None,
    id_col: str = "doc_id", tokens_expr: Column | None = None, seed: int = 42,
) -> DataFrame:
    """The rows of ``docs`` that ``mix`` takes in its first epoch, with their columns and texts where they are.

    A leaf's prefix ends at one place of its order, so a row a leaf says which documents stay.
    Rows repeated with one id and size stay or go together.
    """
    size = token_count() if tokens_expr is None else tokens_expr
    found = _chosen(docs, levels, weights, fraction, tokens, id_col, size, 1, seed)
    leaf = [f"l{i}" for i in range(len(levels))]
    cuts = stored(found.groupBy(*leaf).agg(F.max("whole").alias("whole"), F.max(F.struct("key", "tokens")).alias("last")), "cuts")
    cuts = cuts.select(*[F.col(c).alias(f"__{c}") for c in leaf], F.col("whole").alias("__whole"), F.col("last").alias("__last"))
    rows = docs.withColumns({f"__m{n}": c for n, c in zip(leaf, levels.values())} | {"__tokens": size}).where("__tokens > 0")
    joined = rows.join(F.broadcast(cuts), [F.col(f"__m{c}").eqNullSafe(F.col(f"__{c}")) for c in leaf])  # MAX_LEAVES rows at most
    own = F.struct(place(seed, id_col, "__whole").alias("key"), F.col("__tokens").alias("tokens"))
    return joined.where((F.col("__whole") > 0) | (own <= F.col("__last"))).select(*[F.col(f"`{c}`") for c in docs.columns])

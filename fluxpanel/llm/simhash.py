"""SimHash near-deduplication with pivot distance tables.

Fingerprints are made in one pass over whole texts.  Distinct fingerprints alone are
searched for links (``radius`` differing bits or fewer):

1.  The bits are cut into ``radius + agree`` blocks.  Two linked fingerprints agree in
    ``agree`` blocks at least (pigeonhole), so each choice of blocks gives a group key.
2.  Within a group the Hamming distances to ``PIVOTS`` reference fingerprints are
    tabulated.  By the triangle inequality a linked pair differs by ``radius`` at most in
    every coordinate: members are sorted by the first coordinate, only pairs within its
    reach are looked at, pairs whose maximum coordinate difference is larger are
    discarded, and survivors are verified on all 64 bits.
3.  A group of more than ``SWEEP`` distinct fingerprints is so dense that most pairs
    survive.  There, members that agree after clearing any ``radius`` of the bits in which
    a group can differ are linked by sorting: the same links, without pairs.  Beyond a
    radius of ``DENSE`` those choices are too many; then a few members gather what is near
    them, and only members outside of the largest gathering are compared with the rest.
4.  A group of more than ``SHARD`` fingerprints does not go to one task: step 3 is done
    by a distributed aggregation over the cleared fingerprints (radius up to ``DENSE``).

A group gives a spanning forest of its links, never all pairs.  Components come from
alternating star contraction over those edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import discard, few, release, stored, without
from .words import blocks as text_blocks
from .words import mixed, shingles

PIVOTS = np.random.default_rng(20_240_601).integers(0, 2**64, 16, dtype=np.uint64, endpoint=False)
SWEEP = 4096
SHARD = 1_000_000
#: Up to this radius a group can be linked by clearing bits.
DENSE = 2
#: Pairs looked at at once.
PAIRS = 1_000_000
_SEEDS = np.random.default_rng(20_240_602).integers(0, 2**64, (512, 3), dtype=np.uint64, endpoint=False) | np.uint64(1)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit i is 1 if set in over half the XXH64 (seed 42) of the shingles, repeats included.

    Fewer words than ``width``: the whole sequence is the one shingle; none: zero.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist())], dtype="<u8")
    columns = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id and fp (the 64 bits as a long) of every row; no shuffle."""

    @F.pandas_udf("long")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(np.array([fingerprint(t, width) for t in part], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), made(F.col(text_col)).alias("fp"))


def blocks(n: int) -> list[int]:
    """Masks of ``n`` disjoint blocks of the 64 bits."""
    cuts = np.linspace(0, 64, n + 1).astype(int)
    return [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def group_masks(radius: int, agree: int = 2) -> list[int]:
    """Masks of ``agree`` of ``radius + agree`` blocks: linked fingerprints are equal under one at least."""
    return [sum(c) for c in combinations(blocks(radius + agree), agree)]


def cleared(mask: int, radius: int) -> list[int]:
    """Masks that keep all but ``radius`` of the bits outside of ``mask``."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [((1 << 64) - 1) ^ sum(1 << i for i in c) for c in combinations(free, radius)]


class Forest:
    """Union-find over 0..n-1; a root is the smallest of its set."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        while True:
            ra, rb = up[a], up[b]
            if not (open_ := ra != rb).any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(up, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
            while (flat := up[up] != up).any():
                up[flat] = up[up[flat]]


def sweep(x: np.ndarray, radius: int, forest: Forest, group: np.ndarray | None = None) -> None:
    """Link all pairs of ``x`` within ``radius``, and of one group, by the pivot table."""
    table = np.bitwise_count(x[:, None] ^ PIVOTS).astype(np.int16)
    place = table[:, 0].astype(np.int64) if group is None else group.astype(np.int64) * 256 + table[:, 0]
    order = np.argsort(place, kind="stable")
    table, x, place = table[order], x[order], place[order]
    reach = np.searchsorted(place, place + radius, side="right") - np.arange(len(x)) - 1
    at, upto = 0, np.concatenate(([0], np.cumsum(reach)))
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
        n = reach[at:to]
        left = np.repeat(np.arange(at, to), n)
        right = left + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for p in range(1, len(PIVOTS)):
            near = np.abs(table[left, p] - table[right, p]) <= radius
            left, right = left[near], right[near]
        near = np.bitwise_count(x[left] ^ x[right]) <= radius
        forest.link(order[left[near]], order[right[near]])
        at = to


def crowd(x: np.ndarray, radius: int, forest: Forest, leaders: int = 64) -> None:
    """The same links for one large group, most of which is close together.

    A few members are compared with all and gather what is near them; after that only
    members outside of the largest gathering need to be compared with the others.
    """
    for _ in range(leaders):
        alone = np.flatnonzero(forest.up == np.arange(len(x)))
        sizes = np.bincount(forest.up, minlength=len(x))[alone]
        fresh = alone[sizes == 1]
        if not len(fresh):
            break
        near = np.flatnonzero(np.bitwise_count(x ^ x[fresh[0]]) <= radius)
        forest.link(np.full(len(near), fresh[0]), near)
    largest = np.bincount(forest.up).argmax()
    outside = np.flatnonzero(forest.up != largest)
    each = max(1, PAIRS // len(x))
    for at in range(0, len(outside), each):
        part = outside[at : at + each]
        i, j = np.nonzero(np.bitwise_count(x[part, None] ^ x[None, :]) <= radius)
        forest.link(part[i], j)


def dense(x: np.ndarray, mask: int, radius: int, forest: Forest) -> None:
    """The same links as ``sweep``, for one group of many fingerprints that agree on ``mask``."""
    for keep in cleared(mask, radius):
        part = x & np.uint64(keep)
        order = np.argsort(part, kind="stable")
        same = part[order][1:] == part[order][:-1]
        forest.link(order[1:][same], order[:-1][same])


def _links(masks: list[int], radius: int):
    """Rows sorted by (band, key) to edges between the reps of a group; the last group waits for the next batch."""

    def edges(band, fp, rep, bounds):
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.flatnonzero((sizes > 1)[group] & (sizes <= SWEEP)[group])
        forest = Forest(len(small))
        if len(small):
            sweep(fp[small], radius, forest, group[small])
        child = np.flatnonzero(forest.up != np.arange(len(small)))
        out_a, out_b = [rep[small[child]]], [rep[small[forest.up[child]]]]
        for a, b in zip(bounds[:-1][sizes > SWEEP], bounds[1:][sizes > SWEEP]):
            forest = Forest(int(b - a))
            dense(fp[a:b], masks[band[a]], radius, forest) if radius <= DENSE else crowd(fp[a:b], radius, forest)
            child = np.flatnonzero(forest.up != np.arange(b - a))
            out_a.append(rep[a:b][child])
            out_b.append(rep[a:b][forest.up[child]])
        return np.concatenate(out_a), np.concatenate(out_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit(columns, whole):
            band, key, fp, rep = columns
            starts = np.flatnonzero(np.concatenate(([True], (band[1:] != band[:-1]) | (key[1:] != key[:-1]))))
            bounds = np.append(starts, len(band))
            if not whole:
                bounds = bounds[:-1]
            a, b = edges(band, fp, rep, bounds) if len(bounds) > 1 else (rep[:0], rep[:0])
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}), tuple(c[bounds[-1] :] for c in columns)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "key", "fp", "rep"))
            new = (new[0], new[1], new[2].view(np.uint64), new[3])
            held.append(new)
            if new[0][-1] == held[0][0][0] and new[1][-1] == held[0][1][0] and len(held) > 1:
                continue  # still the group that is waiting
            out, rest = emit(tuple(np.concatenate(c) for c in zip(*held)), False)
            held = [rest]
            yield out
        if held:
            yield emit(tuple(np.concatenate(c) for c in zip(*held)), True)[0]

    return run


def links(reps: DataFrame, radius: int = 2, agree: int = 2) -> DataFrame:
    """Edges (a, b) between ids of ``reps`` (distinct fp, rep): a spanning forest of each group."""
    masks = group_masks(radius, agree)
    keys = reps.select(
        "fp", "rep",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("band", "key"),
    )
    vast = None
    if radius <= DENSE:
        vast = stored(keys.groupBy("band", "key").count().where(F.col("count") > SHARD).select("band", "key"), "vast")
    if vast is None or vast.isEmpty():
        rest, more = keys, None
    else:
        rest = keys.join(vast, ["band", "key"], "left_anti")
        table = reps.sparkSession.createDataFrame(
            [(i, [signed(k) for k in cleared(m, radius)]) for i, m in enumerate(masks)], "band int, keeps array<long>"
        )
        part = (
            keys.join(vast, ["band", "key"], "left_semi").join(F.broadcast(table), "band")
            .select("band", "fp", "rep", F.posexplode("keeps").alias("k", "keep")).withColumn("key", F.col("fp").bitwiseAND(F.col("keep")))
        )
        least = part.groupBy("band", "k", "key").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1")
        more = part.join(least, ["band", "k", "key"]).where("rep != b").select(F.col("rep").alias("a"), "b")
    found = (
        rest.select("band", "key", "fp", "rep").repartition("band", "key").sortWithinPartitions("band", "key")
        .mapInArrow(_links(masks, radius), "a long, b long")
    )
    return (found if more is None else found.unionByName(more)).where("a != b").distinct()


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, root): the smallest id reachable, for ids with an edge; star contraction until nothing changes.

    ``most`` is about the number of edges at most, where it is known; then they go to few files.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges", most)
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.least("v", "m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.greatest("u", "m").alias("v"), F.least("u", "m").alias("u")).where("v != u")
        new = stored(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct(), "edges", before[0] if most is not None else None)
        after = mark(new)
        discard(now)
        now = new
        if after == before:
            break
        before = after
    return now.select(F.col("v").alias("id"), F.col("u").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, radius: int = 2, agree: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest linked id).

    Null and empty texts have fingerprint zero and are linked like any other.  A row with
    a null id has the component of its fingerprint, or null where no row of that
    fingerprint has an id.  Ids are whole numbers; rows repeated with one id are kept.  An
    empty table gives no rows.  Other columns are not read, whatever their names; texts of any
    length are read whole.  Of equal texts the smallest id stands for all.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    reps = stored(prints.groupBy("fp").agg(F.min("id").alias("rep")).where("rep is not null"), "reps")
    roots = components(links(reps, radius, agree))
    owner = reps.join(roots, F.col("rep") == F.col("id"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(owner, "fp", "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def shingle_links(sets: list[np.ndarray], similarity: float, forest: Forest, leaders: int = 64) -> None:
    """Link all pairs of shingle sets whose Jaccard similarity is ``similarity`` or more; empty sets are alike.

    As in ``crowd``, some sets are compared with all, then those outside of the largest gathering.
    """
    sizes = np.array([len(s) for s in sets])
    forest.link(np.flatnonzero(sizes == 0)[1:], np.full(max(0, int((sizes == 0).sum()) - 1), int(np.argmin(sizes)) if len(sizes) else 0))
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    order = np.argsort(flat, kind="stable")
    keys, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]

    def compare(i: int) -> None:
        lo, n = np.searchsorted(keys, sets[i]), np.searchsorted(keys, sets[i], side="right")
        n = n - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shared = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((shared > 0) & (shared >= similarity * (sizes[i] + sizes - shared)))
        forest.link(np.full(len(near), i), near)

    done = np.zeros(len(sets), bool)
    for _ in range(leaders):
        fresh = np.flatnonzero((np.bincount(forest.up, minlength=len(sets))[forest.up] == 1) & ~done)
        if not len(fresh):
            break
        done[fresh[0]] = True
        compare(int(fresh[0]))
    largest = np.bincount(forest.up, minlength=1).argmax()
    for i in np.flatnonzero((forest.up != largest) & ~done):
        compare(int(i))


def _alike(width: int, similarity: float):
    """Rows sorted by (component, salt, id) to (id, component, root): root is the smallest id that verified links reach in the part."""

    def found(ids: list, component: int, sets: list[np.ndarray]) -> pa.RecordBatch:
        forest = Forest(len(sets))
        shingle_links(sets, similarity, forest)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([component] * len(ids), pa.int64()), pa.array([ids[i] for i in forest.up.tolist()], pa.int64())], ["id", "component", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("id", "component", "salt"))))
            for start, texts in text_blocks(batch.column("text")):
                keys, bounds = shingles(texts, width)
                for i, (one, component, salt) in enumerate(names[start : start + len(texts)]):
                    if now != (component, salt):
                        if ids:
                            yield found(ids, now[0], sets)
                        now, ids, sets = (component, salt), [], []
                    ids.append(one)
                    sets.append(np.unique(keys[bounds[i] : bounds[i + 1]]))
        if ids:
            yield found(ids, now[0], sets)

    return run


def band_keys(keys: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each text a key of each band: of the least values of ``rows`` hashes of its shingles.  No shingle gives zeros."""
    n, half = len(bounds) - 1, (keys >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((n, bands), np.uint64)
    for band in range(bands):
        key = np.full(len(full), band, np.uint64)
        for one, two, three in _SEEDS[band * rows : (band + 1) * rows].astype(np.uint32):
            x = (half ^ one) * (two | np.uint32(1))
            x ^= x >> np.uint32(15)
            x *= three | np.uint32(1)
            if len(full):
                key = mixed(key, np.minimum.reduceat(x, bounds[full]).astype(np.uint64))
        out[full, band] = key
    return out


def band_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, bands: int = 32, rows: int = 6) -> DataFrame:
    """Edges (a, b) of rows with an id: those that have all ``rows`` MinHashes of one of ``bands`` bands in common are linked.

    A pair of similarity j meets in one band at least with chance 1 - (1 - j^rows)^bands: 0.99994 at 0.8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for start, texts in text_blocks(batch.column("text")):
                keys = band_keys(*shingles(texts, shingle), bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[start : start + len(texts)], bands)), pa.array(keys.ravel().view(np.int64))], ["id", "key"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    keys = stored(texts.mapInArrow(run, "id long, key long"), "band-keys")
    n = keys.count() // bands
    least = stored(keys.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("most")).where("b != most").select("key", "b"), "bands", n)
    edges = stored(keys.join(few(least), "key").where("id != b").select(F.col("id").alias("a"), "b").distinct(), "candidates", n)
    for spent in (keys, least):
        discard(spent)
    return edges


def band_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, component) of rows with an id that ``band_links`` reach."""
    return components(band_links(docs, id_col, text_col, **how)).select("id", F.col("root").alias("component"))


def similar_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, radius: int = 7, agree: int = 2, shingle: int = 5, similarity: float = 0.8, part: int = 1000, bands: int = 0) -> DataFrame:
    """Ids (column ``lost``) of all documents of a group of near duplicates but the smallest id.

    Fingerprints within ``radius`` bits name the components to look at, and where ``bands``
    isn't zero so do as many bands of MinHashes beside them; within one, documents
    whose Jaccard similarity is ``similarity`` or more are linked (whole texts, shingles of
    ``shingle`` words), and a group is what links reach.  A component of more than ``part``
    documents is looked at in parts, then the first documents of what was linked in the parts;
    at last the documents outside of its largest group are compared with every part, so that
    the parts don't change the groups.  Texts without a word are copies of each other.
    Documents with a null id are not looked at; rows repeated with one id stay or go together
    (they are linked by any of their texts).  An empty table gives no rows.  Other columns are
    not read, whatever their names.
    """
    if bands:
        # What fingerprints and bands reach together is looked at as one: both kinds of links, contracted once.
        prints = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
        n = prints.count()  # of this many rows there are at most so many links of each kind, but for a few
        reps = stored(prints.groupBy("fp").agg(F.min("id").alias("rep")).where("rep is not null"), "reps", n)
        same = prints.join(reps, "fp").where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        edges = links(reps, radius, agree).unionByName(same).unionByName(band_links(docs, id_col, text_col, shingle=shingle, bands=bands))
        named = components(edges, 2 * n).select("id", F.col("root").alias("component"))
    else:
        named = near_groups(docs, id_col, text_col, width=width, radius=radius, agree=agree).select(F.col(id_col).alias("id"), F.col("component_id").alias("component")).where("id is not null").distinct()
        n = None
    groups = stored(named, "groups", n)
    n = groups.count()
    named = groups.select("id", "component").unionByName(groups.select(F.col("component").alias("id"), "component")).distinct()  # a component's smallest id may have no row of its own
    sizes = stored(named.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "sizes", n)
    salted = lambda df, seed: df.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("n") / part)))
    members = stored(salted(named.join(few(sizes), "component"), 0), "members", 2 * n)
    release(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = "id long, component long, root long"
    look = lambda df: texts.join(few(df.select("id", "component", "salt")), "id").repartition("component", "salt").sortWithinPartitions("component", "salt", "id").mapInArrow(_alike(shingle, similarity), kind)
    edge = lambda df: df.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    first = stored(look(members), "first-look")
    edges = edge(first)
    large = stored(sizes.where(F.col("n") > part), "large")
    if not large.isEmpty():
        firsts = first.join(few(large.select("component")), "component").where("id = root").select("id", "component").distinct()
        firsts = stored(salted(firsts.join(firsts.groupBy("component").agg(F.count("*").alias("n")), "component"), 1), "firsts", n)
        edges = stored(edges.unionByName(edge(look(firsts))), "edges-of-parts")
        every = members.join(few(large.select("component")), "component")
        rooted = stored(every.join(components(edges, 2 * n), "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted", 2 * n)
        most = rooted.groupBy("component", "root").agg(F.count("*").alias("m")).groupBy("component").agg(F.max_by("root", F.struct("m", "root")).alias("largest"))
        outside = rooted.join(most, "component").where("root != largest").select("id", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / part) - 1)).alias("salt"))
        busy = outside.select("component").distinct()
        parts = every.join(busy, "component", "left_semi").select("id", "component", F.col("salt").cast("long").alias("salt"))
        edges = edges.unionByName(edge(look(stored(parts.unionByName(outside).distinct(), "parts"))))
    return components(edges, 2 * n).where("id != root").select(F.col("id").alias("lost")).distinct()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without the ``similar_copies``; rows with a null id stay."""
    return without(docs, id_col, similar_copies(docs, id_col, text_col, **how).select("lost"))

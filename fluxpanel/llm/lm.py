"""Language-model scoring with a weighted backoff automaton of all n-grams.

Every token of the training texts is counted, and so is every n-gram of any words; no text is
sampled or cut.  N-grams seen ``least`` times or more are smoothed by absolute discounting and
are the automaton's states: a state's arcs have p(w | h) of the kept n-grams, its failure arc
the backoff weight of h.  (With a count of ``least`` or more an n-gram's prefix and suffix have
one too, so both are states.)

The automaton does not fit one machine, so it is kept in pushed form, as one weight a state:
log p(w | h) - log bow(h) - log p(w | shorter h) for its last arc and log bow for its failure
arc.  Going through a text from left to right adds up the weights of all states that its places
pass, longest first or not: every failure arc that is not taken is paid back by the arc that
is.  So the weights of a text can be gathered in any order, and from a table of any size.

Only helpers that don't change results are broadcast: the commonest ``words`` tokens and ``hot``
weights are looked up in place, and bits (a Bloom filter) keep n-grams that have no weight from
being shuffled.  All other tokens and n-grams get their counts and weights by a join.

Texts are cut into words and hashed for a whole block of texts at once, without an object
for each word.  A word is known by 128 bits, an n-gram by 64 bits of its prefix and suffix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .packed import PIECE, SHORT, bucket_bits, by_bucket, dealt, opened, pieces, short, whole
from .util import discard, release, stored
from .words import blocks, mixed, tokens

#: Pairs that a counting task holds before it passes them on.
HELD = 2_000_000
#: Keys that a task holds on their way to a filter before it passes them on.
FILTERED = 1_000_000
#: The filter has at most two to this power bits, in blocks of two to the power ``BLOCK``.
MOST_BITS, BLOCK = 28, 20
_U = np.uint64


class Lookup:
    """Sorted 64-bit hashes; their first bits say where to look."""

    def __init__(self, keys: np.ndarray):
        self.keys, wide = keys, max(1, len(keys).bit_length() - 2)  # some two to four keys for each number of first bits
        self.shift = _U(64 - wide)
        self.first = np.append(np.searchsorted(keys, np.arange(1 << wide, dtype=np.uint64) << self.shift), len(keys)).astype(np.int32)

    def __reduce__(self):
        return Lookup, (self.keys,)  # where to look is found again, not sent

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each key (of equal ones the first), or -1."""
        top = (wanted >> self.shift).astype(np.int64)
        at, end, out = self.first[top], self.first[top + 1], np.full(len(wanted), -1, np.int64)
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], wanted[left]
        while len(left):
            same = self.keys[at] == wanted
            out[left[same]] = at[same]
            more = ~same & (at + 1 < end)
            left, at, end, wanted = left[more], at[more] + 1, end[more], wanted[more]
        return out


def _places(keys: np.ndarray, size: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key, both in the block that its first bits name."""
    mask, base = _U((1 << block) - 1), keys >> _U(64 - size + block) << _U(block)
    return (base | keys & mask).astype(np.int64), (base | keys >> _U(block) & mask).astype(np.int64)


@dataclass
class Filter:
    """A Bloom filter of two to the power ``size`` bits, in blocks of two to the power ``block``."""

    bits: np.ndarray = field(repr=False)  # as bytes
    size: int
    block: int

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Whether it has the keys; never wrongly false."""
        one, two = _places(keys, self.size, self.block)
        test = lambda at: self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1
        return (test(one) & test(two)).astype(bool)

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """The filter over the column ``gram``: about eight bits a key, within bounds."""
        block = BLOCK
        size = min(MOST_BITS, max(block + 1, (8 * keys.count()).bit_length()))

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def out() -> pa.RecordBatch:
                own = np.concatenate([*held, np.zeros(0, np.uint64)])
                held.clear()
                return pa.RecordBatch.from_arrays([*pieces(own, (own,), size - block)], ["bucket", "data"])

            for batch in batches:
                held.append(batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64))
                if sum(map(len, held)) >= FILTERED:
                    yield out()
            yield out()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, bits = None, np.zeros(1 << block, bool)
            made = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])
            for batch in batches:
                buckets, data = batch.column("bucket").to_numpy(zero_copy_only=False), batch.column("data")
                cuts = sorted({0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), *range(0, len(buckets), PIECE), len(buckets)})
                for start, end in zip(cuts, cuts[1:]):
                    if now != buckets[start]:
                        if now is not None:
                            yield made()
                        now, bits = int(buckets[start]), np.zeros(1 << block, bool)
                    for at in _places(*opened(data.slice(start, end - start).to_pylist(), ("<u8",)), size, block):
                        bits[at & (1 << block) - 1] = True
            if now is not None:
                yield made()

        each = dealt(keys.select("gram").mapInArrow(sent, "bucket int, data binary")).mapInArrow(run, "block long, bits binary")
        bits, wide = np.zeros(1 << size - 3, np.uint8), 1 << block - 3
        for r in each.toArrow().to_pylist():  # a row for each block
            bits[r["block"] * wide : (r["block"] + 1) * wide] = np.frombuffer(r["bits"], np.uint8)
        return cls(bits, size, block)


def _counting(pairs: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], held: int):
    """Counts pairs of 64-bit keys that ``pairs`` finds in blocks of texts: a, b, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def out() -> pa.RecordBatch:
            nonlocal kept, size
            a, b = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, np.uint64),) * 2
            kept, size = [], 0
            by = np.argsort(mixed(a, b))
            a, b = a[by], b[by]
            starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else by
            n = np.diff(starts, append=len(a))  # pairs that a collision has mixed give several rows, which are added up
            return pa.RecordBatch.from_arrays([pa.array(a[starts].view(np.int64)), pa.array(b[starts].view(np.int64)), pa.array(n, pa.int64())], ["a", "b", "c"])

        for batch in batches:
            for _, texts in blocks(batch.column("text")):
                kept.append(pairs(texts))
                size += len(kept[-1][0])
                if size >= held:
                    yield out()
        yield out()

    return run


def counted(texts: DataFrame, pairs) -> DataFrame:
    return texts.mapInArrow(_counting(pairs, HELD), "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


def _grams(shared, order: int, bits: int, held: int):
    """Counts the n-grams of ``order`` whose prefix and suffix may be kept: pieces of (prefix, suffix, count)."""

    def found(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        levels = shared.value
        rows, keys, _ = tokens(texts)
        fine = levels[0].may_hold(keys)
        for n in range(2, order + 1):
            both = fine[:-1] & fine[1:] & (rows[:-1] == rows[1:])  # a place's n-gram ends in its row; it began there too if it is fine
            if n == order:
                break
            keys, rows, fine = mixed(keys[:-1], keys[1:]), rows[1:], both
            fine[both] = levels[n - 1].may_hold(keys[both])
        return keys[:-1][both], keys[1:][both]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _counting(found, held)(batches):
            a, b, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("a", "b", "c"))
            buckets, data = pieces(mixed(a.view(np.uint64), b.view(np.uint64)), (a, b, c.astype("<u4")), bits)
            yield pa.RecordBatch.from_arrays([buckets, data], ["bucket", "data"])

    return run


def _summed(least: int):
    """Pieces of counts to the n-grams with ``least`` or more: gram, prefix, suffix, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in by_bucket(batches):
            a, b, c = opened(data, ("<u8", "<u8", "<u4"))
            gram = mixed(a, b)
            by = np.argsort(gram)
            gram = gram[by]
            starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            total = np.add.reduceat(c[by].astype(np.int64), starts)
            kept = total >= least
            at = by[starts[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram[starts[kept]].view(np.int64), a[at].view(np.int64), b[at].view(np.int64), total[kept])], ["gram", "prefix", "suffix", "c"])

    return run


def frequent(counts: DataFrame, most: int, least: int) -> Column:
    """Which rows have the highest ``c``, at most ``most`` of them: those from a threshold that a histogram gives."""
    step = F.floor(F.log2("c") * 16).cast("int")
    bins = counts.where(F.col("c") >= least).groupBy(step.alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect()  # 16 for each doubling
    kept, low = 0, None
    for r in bins:
        if kept + r.n > most:
            break
        kept, low = kept + r.n, r.bin
    return (F.col("c") >= least) & (step >= low) if low is not None else F.lit(False)


@dataclass
class Model:
    """What scoring needs; ``table`` and ``counts`` may have any size, the rest is bounded and broadcast."""

    order: int
    total: int
    kinds: int
    counts: DataFrame  # a, b, c: the counts of all words
    words: Lookup = field(repr=False)  # of the commonest words, by the first hash
    word_values: tuple[np.ndarray, np.ndarray] = field(repr=False)  # their second hash and log10 probability
    table: DataFrame | None = None  # gram, v: the weights of the n-grams and contexts that aren't hot; a gram can have two
    hot: Lookup = field(default_factory=lambda: Lookup(np.zeros(0, np.uint64)), repr=False)
    hot_values: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)
    bits: Filter | None = None
    bucket_bits: int = 1


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.select(*names).toArrow()
    return [table.column(n).to_numpy() for n in names]


def train(docs: DataFrame, text_col: str = "text", *, order: int = 3, words: int = 400_000, hot: int = 4_000_000, least: int = 2, discount: float = 0.75) -> Model:
    """The model of all texts.  Nulls and empty texts are an end alone; repeated rows count each; other columns are not read.

    ``words`` and ``hot`` bound what is broadcast and change no result.
    """
    spark, texts = docs.sparkSession, docs.select(F.col(text_col).alias("text"))
    counts = stored(counted(texts, lambda t: tokens(t)[1:]), "token-counts")
    total, kinds = map(int, counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first())
    low = total + 0.5 * (kinds + 1)
    a, b, c = _columns(counts.where(frequent(counts, words, 1)), "a", "b", "c")
    by = np.argsort(a.view(np.uint64))
    model = Model(order, total, kinds, counts, Lookup(a.view(np.uint64)[by]), (b.view(np.uint64)[by], np.log10((c[by] + 0.5) / low)))
    if order < 2:
        return model
    before = counts.select(F.col("a").alias("gram"), "c", ((F.col("c") + 0.5) / low).alias("p"))
    bits = model.bucket_bits = bucket_bits(total)
    levels, weights = [Filter.of(before.where(F.col("c") >= least))], []
    for n in range(2, order + 1):
        release(spark)
        shared = spark.sparkContext.broadcast(levels)
        every = dealt(texts.mapInArrow(_grams(shared, n, bits, HELD), "bucket int, data binary"))
        kept = stored(every.mapInArrow(_summed(least), "gram long, prefix long, suffix long, c long"), "kept")
        release(spark)
        shared.unpersist()
        lower = kept.join(before.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        seen = lower.join(before.select(F.col("gram").alias("prefix"), F.col("c").alias("seen")), "prefix")
        own = Window.partitionBy("prefix")  # the join has dealt and sorted them by it
        rest = lambda c: F.greatest(F.lit(1e-300), 1.0 - F.sum(c).over(own))
        smoothed = seen.withColumn("p", (F.col("c") - discount) / F.col("seen"))
        bows = smoothed.withColumns({"bow": F.log10(rest("p") / rest("lower")), "first": F.min("gram").over(own)})
        once = lambda c: F.when(F.col("gram") == F.col("first"), F.col(c)).alias(c)  # noqa: E731  # a context's weight stands at one of its arcs
        level = stored(bows.select("gram", "c", "seen", (F.log10("p") - F.log10("lower") - F.col("bow")).alias("v"), once("prefix"), once("bow")), "arcs")
        discard(kept)
        release(spark)
        weights += [level.select("gram", "v", "c"), level.where("prefix is not null").select(F.col("prefix").alias("gram"), F.col("bow").alias("v"), F.col("seen").alias("c"))]
        before = level.select("gram", "c", ((F.col("c") - discount) / F.col("seen")).alias("p"))
        if n < order:
            levels = [*levels, Filter.of(before)]
    every = weights[0]
    for w in weights[1:]:
        every = every.unionByName(w)
    release(spark)
    model.bits = Filter.of(every)
    common = frequent(every, hot, least)
    keys, values = _columns(every.where(common), "gram", "v")  # both weights of a gram have its count, so both are here or none
    model.table = every.where(~common)
    keys, own = np.unique(keys.view(np.uint64), return_inverse=True)
    model.hot, model.hot_values = Lookup(keys), np.bincount(own, weights=values, minlength=len(keys))
    release(spark)
    return model


#: Kinds of rows on their way to the buckets: weights, questions, documents, and the answers that come back.
WEIGHTS, QUESTIONS, DOCUMENTS, ANSWERS = range(4)
#: Questions and documents that a scoring task holds before it passes them on; a question names its document by 16 bits.
ASKED, GROUP = 1_000_000, 60_000
#: Documents whose sums an answering task holds before it passes them on.
SUMS = 2_000_000


def _offered(bits: int, columns: list[tuple[str, pa.DataType]], most: int):
    """The table of weights as pieces, beside empty columns of documents; ``most`` weights are held, so that pieces are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            gram, v = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.uint64), np.zeros(0))
            held.clear()
            return _sent(WEIGHTS, 0, *pieces(gram, (short(gram, bits), v), bits), columns)

        for batch in batches:
            held.append((batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("v").to_numpy(zero_copy_only=False).astype("<f8")))
            if sum(len(g) for g, _ in held) >= most:
                yield out()
        yield out()

    return run


def _sent(kind: int, base: int, buckets: pa.Array, data: pa.Array, columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    n = len(buckets)
    made = [*(pa.nulls(n, t) for _, t in columns), buckets, pa.array(np.full(n, kind, np.int8)), pa.array(np.full(n, base, np.int64)), data]
    return pa.RecordBatch.from_arrays(made, [*(c for c, _ in columns), "bucket", "kind", "base", "data"])


def _scoring(shared, columns: list[tuple[str, pa.DataType]]):
    """Adds up what is known in place: a row a document, with the words (a, b) that a join has to add, and questions for weights."""

    def lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))), pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (order, words, (second, logs), hot, weights, filter_, bits), part = shared.value, TaskContext.get().partitionId()
        row = base = part << 40
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def questions() -> pa.RecordBatch:
            nonlocal asked, size
            owner, grams = (np.concatenate(x) for x in zip(*asked)) if asked else (np.zeros(0, np.uint16), np.zeros(0, np.uint64))
            asked, size = [], 0
            return _sent(QUESTIONS, base, *pieces(grams, (short(grams, bits), owner), bits), columns)

        for batch in batches:
            for start, texts in blocks(batch.column("text"), GROUP // 2):
                n = len(texts)
                if size >= ASKED or row + n - base > GROUP:
                    yield questions()
                    base = row
                rows, keys, other = tokens(texts)
                sizes = np.bincount(rows, minlength=n)
                at = words.find(keys)
                at[at >= 0] = np.where(second[at[at >= 0]] == other[at >= 0], at[at >= 0], -1)
                here, rest = at >= 0, np.flatnonzero(at < 0)
                known = np.bincount(rows[here], minlength=n)
                sure = np.bincount(rows[here], weights=logs[at[here]], minlength=n)
                unknown = lists(rows[rest], n, pa.StructArray.from_arrays([pa.array(x[rest].view(np.int64)) for x in (keys, other)], ["a", "b"]))
                more, fine = np.zeros(n), np.ones(len(keys), bool)
                for level in range(1, order + 1 if filter_ is not None else 1):
                    if level > 1:  # a kept n-gram's prefix and suffix are kept, so places without them need no look
                        fine = fine[:-1] & fine[1:] & (rows[:-1] == rows[1:])
                        keys, rows = mixed(keys[:-1], keys[1:]), rows[1:]
                    left = np.flatnonzero(fine)
                    left = left[filter_.may_hold(keys[left])]
                    at = hot.find(keys[left])
                    hit, cold = left[at >= 0], left[at < 0]
                    more += np.bincount(rows[hit], weights=weights[at[at >= 0]], minlength=n)
                    asked.append(((rows[cold] + (row - base)).astype(np.uint16), keys[cold]))
                    size += len(cold)
                    if level > 1:
                        fine[:] = False
                        fine[left] = True
                made = [
                    pa.array(range(row, row + n), pa.int64()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(sure, pa.float64()), pa.array(sure + more, pa.float64()), unknown,
                    pa.array(np.full(n, -1 - part % 4096), pa.int32()), pa.array(np.full(n, DOCUMENTS, np.int8)), pa.array(np.full(n, base), pa.int64()), pa.nulls(n, pa.binary()),
                ]
                row += n
                own = batch.slice(start, n)
                given = [c for c in own.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([own.column(c) for c in given] + made, [*(c for c, _ in columns), "bucket", "kind", "base", "data"])
        yield questions()

    return run


def _answering(columns: list[tuple[str, pa.DataType]], most: int):
    """Documents as they are; of each bucket the weights first, then the questions: sums of weights by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, offered, keys, values = None, [], np.zeros(0, np.uint64), np.zeros(0)
        sums: dict[int, np.ndarray] = {}
        held = 0

        def answers() -> Iterator[pa.RecordBatch]:
            for base, total in sums.items():
                at = np.flatnonzero(total)
                for a in range(0, len(at), PIECE):
                    part = at[a : a + PIECE]
                    yield _sent(ANSWERS, base, pa.nulls(1, pa.int32()), pa.array([part.astype("<u2").tobytes() + total[part].astype("<f8").tobytes()], pa.binary()), columns)
            sums.clear()

        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            if (kinds == DOCUMENTS).any():
                yield batch.filter(pa.array(kinds == DOCUMENTS))
            for i in np.flatnonzero(kinds != DOCUMENTS).tolist():
                bucket, data = batch.column("bucket")[i].as_py(), batch.column("data")[i].as_py()
                if bucket != now:
                    now, offered, keys = bucket, [], np.zeros(0, np.uint64)
                if kinds[i] == WEIGHTS:
                    offered.append(data)
                    continue
                if offered:
                    keys, v = opened(offered, (SHORT, "<f8"))
                    keys, own = np.unique(whole(keys), return_inverse=True)
                    values, offered = np.bincount(own, weights=v, minlength=len(keys)), []
                grams, owner = opened([data], (SHORT, "<u2"))
                grams = whole(grams)
                at = np.searchsorted(keys, grams)
                hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == grams) if len(keys) else at[:0]
                if not len(hit):
                    continue
                base = batch.column("base")[i].as_py()
                if base not in sums:
                    if held >= most:
                        yield from answers()
                        held = 0
                    sums[base] = np.zeros(1 << 10)
                top = int(owner[hit].max()) + 1
                if top > len(sums[base]):
                    sums[base] = np.append(sums[base], np.zeros(max(top - len(sums[base]), len(sums[base]))))
                held += top
                sums[base][:top] += np.bincount(owner[hit], weights=values[at[hit]], minlength=top)
        yield from answers()

    return run


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of one group of documents after the other to a row a document."""
    for base, data in by_bucket(batches):
        owner, v = np.zeros(0, np.int64), np.zeros(0)
        for piece in data:
            one, two = opened([piece], ("<u2", "<f8"))
            owner, v = np.append(owner, one), np.append(v, two)
            if len(owner) > 1 << 20:
                v = np.bincount(owner, weights=v)
                owner = np.arange(len(v))
        total = np.bincount(owner, weights=v)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(base, base + len(total)), pa.int64()), pa.array(total, pa.float64())], ["__row", "__cold"])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """id, the ``extra`` columns, n_tokens, n_known, train_tokens, base_score, score of each row.

    A null or empty text is the end alone.  Repeated rows are scored each; ids may be null.
    With nothing to learn from, every token counts as unseen; an empty table gives no rows.
    An ``extra`` column can't have the name of another output column: that raises.
    """
    extra = extra or {}
    names = [id_col, *extra, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if len(set(names)) < len(names):
        raise ValueError(f"output columns clash: {names}")
    shared = docs.sparkSession.sparkContext.broadcast((model.order, model.words, model.word_values, model.hot, model.hot_values, model.bits, model.bucket_bits))
    given = docs.select(F.col(id_col).alias("__id"), *[c.alias(f"__x{i}") for i, c in enumerate(extra.values())], F.col(text_col).alias("text"))
    made = "__row long, __tokens long, __in long, __base double, __score double, __rest array<struct<a: bigint, b: bigint>>"
    schema = StructType([f for f in given.schema if f.name != "text"] + _parse_datatype_string(made).fields)
    columns = list(zip(schema.names, [f.type for f in to_arrow_schema(schema)]))
    sent = StructType([*schema, *_parse_datatype_string("bucket int, kind byte, base long, data binary").fields])
    asked = given.mapInArrow(_scoring(shared, columns), sent)
    if model.table is not None:
        offered = model.table.select("gram", "v").mapInArrow(_offered(model.bucket_bits, columns, ASKED), sent)
        asked = dealt(offered.unionByName(asked), "kind").mapInArrow(_answering(columns, SUMS), sent)
    both = stored(asked, "answered")
    release(docs.sparkSession)
    part = both.where(F.col("kind") == DOCUMENTS)
    answers = dealt(both.where(F.col("kind") == ANSWERS).select(F.col("base").alias("bucket"), "data")).mapInArrow(_collected, "__row long, __cold double")
    rest = part.select("__row", F.inline("__rest")).join(model.counts, ["a", "b"], "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(model.total + 0.5 * (model.kinds + 1)))
    sums = rest.groupBy("__row").agg(F.sum(log).alias("__more"), F.count("c").alias("__known"))
    joined = part.drop("__rest", "data").join(sums, "__row", "left").join(answers, "__row", "left")
    more, cold = F.coalesce("__more", F.lit(0.0)), F.coalesce("__cold", F.lit(0.0))
    return joined.select(
        F.col("__id").alias(id_col), *[F.col(f"__x{i}").alias(n) for i, n in enumerate(extra)], F.col("__tokens").alias("n_tokens"), (F.col("__in") + F.coalesce("__known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("__base") + more).alias("base_score"), (F.col("__score") + cold + more).alias("score"),
    )

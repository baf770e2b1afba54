"""Best-fit packing with exact-complement hashing.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens in one pass
over the texts.  Packing itself sees only how many pieces there are of each length, a
table of at most ``capacity`` rows, so its plan is made on the driver whatever the number
of documents.  For the longest piece still there, combinations of one, two or three other
pieces that fill its gap exactly are looked up in the sums of single, pair and triple
lengths that are available, and used as often as the counts allow.  What has no exact
complement is packed by best fit: each gap takes the longest piece that fits.

The plan says, for each length, which ranks of its pieces go where.  Pieces are ranked by
(input partition, place within it), which needs counts per partition and length but no
sort and no task for all pieces of one length.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import few, stored

#: Words whose ids a worker remembers before it starts anew.
MEMO = 500_000
LONGEST_REMEMBERED = 64
#: Texts encoded at once.
BLOCK = 500
#: Ranks of one length that a key leaves room for.
_SPAN = 1 << 48
PIECES = "id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def ids_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes, equal to the tokenizer's own.

    Where the tokenizer cuts text by white space first and forms no token across it, each
    distinct run is encoded once and remembered.  ``by_word`` says whether it does: true
    for a tokenizer whose normaliser makes white space one space and whose pre-tokeniser
    then drops it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: Names of special tokens: a text that holds one is encoded whole, by the tokenizer alone.
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = self._cuts_at_spaces()
        self.model = self.tokenizer.model
        self.bytes_as_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.folds = self.by_word and self._folds()
        self.memo: dict[str, bytes] = {}

    def _folds(self) -> bool:
        probe = ("Ab.c", "ÀB, d", "x1:y", "q?!z")
        if any(self.bare(w) != self.plain(w) for w in ("abc", "zzqx", "\u00e9t\u00e9", "\u4f60\u597d")):
            return False
        return all(self.plain(t) == b"".join(self.plain(w) for w in _MARK.sub(" ", t.lower()).split()) for t in probe)

    def _cuts_at_spaces(self) -> bool:
        if self.tokenizer.normalizer is None or self.tokenizer.pre_tokenizer is None:
            return False
        probe = "ab  cd\n\te1 'll x"
        cut = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(probe))]
        alone = [w for part in probe.split() for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))]
        return cut == alone

    def plain(self, text: str) -> bytes:
        return ids_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def bare(self, word: str) -> bytes | None:
        """Of a lower-case run of letters, which the tokenizer hands to its model whole; else None."""
        if not word.isalpha() or word != word.lower():
            return None
        if not word.isascii():
            if not unicodedata.is_normalized("NFC", word):
                return None
            word = self.bytes_as_letters.pre_tokenize_str(word)[0][0]
        return ids_bytes([t.id for t in self.model.tokenize(word)])

    def loosened(self, text: str) -> str:
        """The same tokens with fewer distinct runs: lower case, and a mark cut off the word before it.

        Only where the tokenizer does the same itself: it lower-cases letter by letter
        after composing them, and a mark always ends a run of letters.
        """
        if not self.folds:
            return text
        if text.isascii():
            return _MARK.sub(" ", text.lower())
        low = text.lower()
        if "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
            return _MARK.sub(" ", low)
        return text

    def many(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return [self.plain(t) if t else b"" for t in texts]
        get, out = self.memo.get, []
        for text in texts:
            if text and self.holds_special(text):
                out.append(self.plain(text))
                continue
            words = self.split(text) if text else []
            found = list(map(get, words))
            if None in found:
                for i, ids in enumerate(found):
                    if ids is None:
                        found[i] = self.word(words[i])
            out.append(b"".join(found))
        return out

    def holds_special(self, text: str) -> bool:
        if not self.special:
            return False
        low = text.lower()
        return any(t in low for t in self.special)

    def word(self, word: str) -> bytes:
        ids = self.memo.get(word)
        if ids is None:
            ids = self.bare(word) if self.folds else None
            if ids is None:
                ids = self.plain(word) if word else b""
            if len(word) <= LONGEST_REMEMBERED:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def split(self, text: str) -> list[str]:
        """Runs between white space; Python's own splitting also takes four separators that aren't."""
        text = self.loosened(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return _SPACE.split(text)
        return text.split()

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


#: Unicode white space that no normal form changes or joins with what stands beside it.
_SPACE = re.compile(r"[ \n\t\r\x0b\x0c]+")
#: Where a mark (no apostrophe) follows a letter: the end of a run of letters for the tokenizer, too.
_MARK = re.compile(r"(?<=[^\W\d_])(?=[!-&(-/:-@\[-`{-~])")
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _cut(locate, id_col: str, text_col: str, end_id: int, capacity: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, ranks = encoder(locate()), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            encoded = (ids for at in range(0, batch.num_rows, BLOCK) for ids in encode.many(batch.column(text_col).slice(at, BLOCK).to_pylist()))
            for key, ids in zip(batch.column(id_col).to_pylist(), encoded):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[start * 4 : (start + capacity) * 4]
                    n = len(own) // 4
                    rows.append((key, piece, start, n, zlib.crc32(own), part, int(ranks[n])))
                    ranks[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def pieces(docs: DataFrame, locate, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its input partition.

    ``locate`` is called on the workers and gives the tokenizer file's place there.
    """
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_cut(locate, "id", "text", end_id, capacity), PIECES)


@dataclass
class Plan:
    """For each run of ranks of one length: where its pieces go."""

    key: np.ndarray  # length * _SPAN + first rank, ascending
    sequence: np.ndarray  # of the first copy of the pattern
    each: np.ndarray  # pieces of the run in one copy
    offset: np.ndarray  # of the run in a copy
    sequences: int


class Sums:
    """Available lengths by the sums of one, two or three of them.

    For every sum there is a place in the list of its pairs (by the shorter length, ascending),
    for every triple sum one in the list of its longest members (descending).  Lengths only ever
    become unavailable, so a place moves past a combination once and never goes back.
    """

    def __init__(self, have: list[int]):
        self.have = have
        self.pair_at = [1] * len(have)
        self.triple_at = list(range(-2, len(have) - 2))  # the longest of three: two more have one token at least each

    def _enough(self, lengths: tuple[int, ...], held: int = 0) -> bool:
        """Whether the counts allow the lengths, one piece of length ``held`` being taken already."""
        return all(self.have[x] - (x == held) >= lengths.count(x) for x in set(lengths))

    def pair(self, total: int, more: tuple[int, ...] = (), held: int = 0) -> tuple[int, int] | None:
        """The pair with the longest member for ``total`` that is there beside ``more`` and ``held``."""
        have, at, fast = self.have, self.pair_at[total], True
        while 2 * at <= total:
            two = (total - at, at)
            if have[at] and have[total - at] and self._enough(two):
                fast = False  # there, though perhaps not beside the others: the place stays
                if self._enough((*two, *more), held):
                    return two
            at += 1
            if fast:
                self.pair_at[total] = at
        return None

    def exact(self, gap: int, held: int) -> list[int] | None:
        """One, two or three lengths whose sum is ``gap``; the longest first."""
        if self._enough((gap,), held):
            return [gap]
        if found := self.pair(gap, held=held):
            return list(found)
        a, fast = self.triple_at[gap], True
        while 3 * a >= gap:
            if self.have[a] > 0:
                fast = False
                if self._enough((a,), held) and (found := self.pair(gap - a, (a,), held)) and found[0] <= a:
                    return [a, *found]
            a -= 1
            if fast:
                self.triple_at[gap] = a
        return None


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Patterns of lengths and how often each is used, from the counts of lengths alone.

    First every length, the longest first, uses up its exact complements; what is left then is
    packed by best fit.
    """
    have = [counts.get(length, 0) for length in range(capacity + 1)]
    patterns: list[tuple[int, list[tuple[int, int]]]] = []

    def use(lengths: list[int]) -> None:
        parts = sorted(((length, lengths.count(length)) for length in set(lengths)), reverse=True)
        times = min(have[length] // n for length, n in parts)
        for length, n in parts:
            have[length] -= times * n
        patterns.append((times, parts))

    if have[capacity]:
        use([capacity])
    sums = Sums(have)
    for longest in range(capacity - 1, 0, -1):
        while have[longest] > 0 and (found := sums.exact(capacity - longest, longest)):
            use([longest, *found])
    for longest in range(capacity - 1, 0, -1):
        _best_fit(have, longest, capacity, use)
    order, first, used = [], 0, np.zeros(capacity + 1, dtype=np.int64)
    for times, parts in patterns:
        offset = 0
        for length, n in parts:
            order.append((length * _SPAN + int(used[length]), first, n, offset))
            used[length] += times * n
            offset += length * n
        first += times
    columns = np.array(sorted(order), dtype=np.int64).reshape(-1, 4).T
    return Plan(*columns, sequences=first)


def _best_fit(have: list[int], longest: int, capacity: int, use) -> None:
    """Use up ``longest``: each gap takes the longest piece that fits, again and again."""
    while have[longest] > 0:
        rest, lengths = np.array(have), [longest]
        rest[longest] -= 1
        gap = capacity - longest
        while gap > 0:
            fit = np.flatnonzero(rest[: gap + 1])
            if not len(fit):
                break
            length = int(fit[-1])
            n = min(int(rest[length]), gap // length)
            lengths += [length] * n
            rest[length] -= n
            gap -= n * length
        use(lengths)


def pack(docs: DataFrame, locate, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone.  Repeated rows give repeated pieces, each
    with a place of its own; a null id stays null.  An empty table gives no rows.  Other
    columns of ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, locate, id_col=id_col, text_col=text_col, end_id=end_id, capacity=capacity), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")  # at most `capacity` rows for each input partition
    counts = {r.length: r.n for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    shared = spark.sparkContext.broadcast(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(made.key, length * _SPAN + rank, side="right") - 1 if len(rank) else rank
            within = length * _SPAN + rank - made.key[at]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(made.sequence[at] + within // made.each[at], pa.int64()), pa.array(made.offset[at] + within % made.each[at] * length, pa.int64())],
                [*names, "sequence_id", "offset"],
            )

    ranked = cut.join(few(base.select("length", "part", "base")), ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank")
    )
    out = ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)

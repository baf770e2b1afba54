"""Language identification by word-first backoff.

A word of the text that the model knows is scored by its smoothed log frequency in
each language.  An unseen word is scored by its longest known character n-grams:
the longest order that has a known n-gram counts, shorter orders are not looked at.
The text's language has the largest sum over all words of the whole text.

The classifier is fitted on a bounded sample of labelled rows (``max_docs`` of each
language, chosen by a hash of the id), so its tables are bounded too and may be
broadcast: ``max_entries`` words and n-grams in all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import discard, stored

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Unseen words whose scores a worker remembers before it starts anew.
MEMO = 100_000
LONGEST_REMEMBERED = 64


@dataclass
class LanguageModel:
    languages: list[str]
    orders: tuple[int, ...]
    index: dict[tuple[int, str] | str, int] = field(repr=False)
    scores: np.ndarray = field(repr=False)  # entries x languages, log frequencies


def words(text: str) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(c.isalpha() for c in w)]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]


def _count(orders: tuple[int, ...], text_col: str, lang_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(text_col).to_pylist(), batch.column(lang_col).to_pylist()):
                seen.setdefault(lang, Counter()).update(words(text))
        for lang, counts in seen.items():
            out: Counter = Counter()
            for word, c in counts.items():
                out[0, word] += c
                for n in orders:
                    for g in grams(word, n):
                        out[n, g] += c
            keys = list(out)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(keys), pa.string()), "n": pa.array([k[0] for k in keys], pa.int32()),
                "gram": pa.array([k[1] for k in keys], pa.string()), "c": pa.array(list(out.values()), pa.int64()),
            })

    return run


def sample(rows: DataFrame, id_col: str, lang_col: str, max_docs: int, max_languages: int) -> DataFrame:
    """At most ``max_docs`` rows of each language; more than ``max_languages`` labels are an error.

    The rows with the smallest hashes of the id are taken.  Only ids and labels are
    ranked (Spark limits each group before the shuffle); texts are read for the chosen.
    """
    named = rows.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    common = named.groupBy(lang_col).count().limit(max_languages + 1).collect()
    if not common:
        return named.limit(0)
    if len(common) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    # Hashes are even, so about four times the rows wanted are ranked, however many there are.
    reach = F.create_map(*[F.lit(x) for r in common for x in (r[0], min(1.0, 4.0 * max_docs / r[1]))])
    place = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) / float(1 << 30)
    order = Window.partitionBy("__lang").orderBy(F.xxhash64("__id"), "__id")
    chosen = (
        named.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang")).where(place < reach[F.col("__lang")])
        .withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= max_docs)
        .select("__id").distinct()
    )
    return named.join(F.broadcast(chosen), F.col(id_col) == F.col("__id"), "left_semi")


def fit(
    rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", *,
    orders: tuple[int, ...] = (4, 3, 2, 1), max_docs: int = 3000, max_languages: int = 200, max_entries: int = 400_000,
    smoothing: float = 0.5,
) -> LanguageModel:
    """Learn from rows with a text and a label; null texts and null labels are left out.

    A table without such rows gives a model without languages, which predicts ``und``.  Rows
    repeated with one id are taken or left together; of equally common words and n-grams the
    first in order are kept.  Other columns are not read.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    part = sample(rows.where(F.col("text").isNotNull()), "id", "lang", max_docs, max_languages)
    counts = stored(
        part.select("text", "lang").mapInArrow(_count(orders, "text", "lang"), "lang string, n int, gram string, c long")
        .groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")), "language-counts"
    )
    each = max_entries // (len(orders) + 1)
    whole = counts.groupBy("lang", "n").agg(F.sum("c").alias("all"), F.count("*").alias("kinds")).toPandas()
    languages = sorted(whole["lang"].unique())
    per_group = each // max(1, len(languages))
    top = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram")
    kept = counts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= per_group).select("n", "gram").distinct()
    table = counts.join(F.broadcast(kept), ["n", "gram"], "left_semi").select("lang", "n", "gram", "c").toPandas()
    discard(counts)
    index: dict = {}
    for n, gram in zip(table["n"], table["gram"]):
        index.setdefault(gram if n == 0 else (int(n), gram), len(index))
    totals = {(r.lang, r.n): (r.all, r.kinds) for r in whole.itertuples()}
    at = {lang: i for i, lang in enumerate(languages)}
    floor = {n: [np.log(smoothing / (totals.get((lang, n), (0, 0))[0] + smoothing * (totals.get((lang, n), (0, 0))[1] + 1))) for lang in languages] for n in (0, *orders)}
    scores = np.zeros((len(index), len(languages)))
    for key, i in index.items():
        scores[i] = floor[0 if isinstance(key, str) else key[0]]
    for r in table.itertuples():
        total, kinds = totals[r.lang, r.n]
        scores[index[r.gram if r.n == 0 else (int(r.n), r.gram)], at[r.lang]] = np.log((r.c + smoothing) / (total + smoothing * (kinds + 1)))
    return LanguageModel(languages, tuple(sorted(orders, reverse=True)), index, scores)


class Scorer:
    """Scores texts; remembers the vectors of unseen words up to ``MEMO`` of them."""

    def __init__(self, model: LanguageModel):
        self.model, self.base = model, len(model.index)
        self.rows = np.zeros((self.base + MEMO, len(model.languages)))
        self.rows[: self.base] = model.scores
        self.known = {w: i for w, i in model.index.items() if isinstance(w, str)}
        self.at: dict[str, int] = dict(self.known)  # with the unseen words that are remembered
        self.used = self.base

    def unseen(self, word: str) -> np.ndarray:
        index = self.model.index
        for n in self.model.orders:
            known = [i for g in grams(word, n) if (i := index.get((n, g))) is not None]
            if known:
                return np.add.reduce(self.model.scores[known]) / len(known)
        return np.zeros(len(self.model.languages))

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words(text)) if text else None
        if not counts or not self.model.languages:
            return UNKNOWN, 0.0
        if self.used + len(counts) > len(self.rows):
            self.at, self.used = dict(self.known), self.base
        at = list(map(self.at.get, counts))
        weights = list(counts.values())
        total = np.zeros(len(self.model.languages))
        if None in at:
            for k, (i, word) in enumerate(zip(at, counts)):
                if i is None:
                    vector = self.unseen(word)
                    if len(word) > LONGEST_REMEMBERED or self.used >= len(self.rows):
                        total += weights[k] * vector
                        at[k] = weights[k] = 0
                        continue
                    self.rows[self.used] = vector
                    at[k] = self.at[word] = self.used
                    self.used += 1
        total += np.asarray(weights, dtype=float) @ self.rows[at]
        best = int(np.argmax(total))  # of equal sums the first language in order
        return self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def scorer_of(model: LanguageModel) -> Scorer:
    """The model's own scorer.  It goes with the model: workers live on through later stages, and that memory is theirs."""
    if (own := model.__dict__.get("_scorer")) is None:
        own = model.__dict__["_scorer"] = Scorer(model)
    return own


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its posterior share (0 to 1).

    Null texts and texts without a letter give ``und`` and 0.  Columns of ``docs`` with
    the output names are replaced.  Repeated rows are judged each; an empty table gives no
    rows.  Of equally likely languages the first in order is named.  No shuffle: one pass over
    the texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of(shared.value)
        for part in texts:
            yield pd.DataFrame([scorer(t) for t in part], columns=["lang", "score"])

    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in out])
    return rest.withColumn("__lid", score(F.col(text_col))).select(
        *[F.col(f"`{c}`") for c in rest.columns], F.col("__lid.lang").alias(out[0]), F.col("__lid.score").alias(out[1])
    )

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fluxpanel.llm import lm, queries, util
from fluxpanel.llm import words as words_


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        text, word = [], rng.choice(names)
        for _ in range(rng.randint(0, 40)):
            text.append(word)
            word = names[(names.index(word) * 3 + rng.choice([0, 1, 7])) % 40] if rng.random() < 0.9 else f"rare{rng.randint(0, 500)}"
            if word not in names:
                text.append(word)
                word = rng.choice(names)
        out.append((i, " ".join(text)))
    return out


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [""]


class Brute:
    """The same backoff model straight from its definition, without states."""

    def __init__(self, texts, order, discount=0.75):
        self.order, self.c = order, Counter(t for x in texts for t in split(x))
        self.total, self.kinds = sum(self.c.values()), len(self.c)
        grams = Counter()
        for x in texts:
            found = split(x)
            for n in range(2, order + 1):
                grams.update(tuple(found[i : i + n]) for i in range(len(found) - n + 1))
        self.grams = {g: c for g, c in grams.items() if c >= 2}
        self.discount = discount
        self.next = {}
        for g in self.grams:
            self.next.setdefault(g[:-1], []).append(g[-1])

    def p(self, h, w):
        if not h:
            return (self.c[w] + 0.5) / (self.total + 0.5 * (self.kinds + 1))
        if (*h, w) in self.grams:
            return (self.grams[*h, w] - self.discount) / self.seen(h)
        return self.bow(h) * self.p(h[1:], w)

    def seen(self, h):
        return self.c[h[0]] if len(h) == 1 else self.grams[h]

    def bow(self, h):
        if h not in self.next:
            return 1.0
        return (1 - sum(self.p(h, w) for w in self.next[h])) / (1 - sum(self.p(h[1:], w) for w in self.next[h]))

    def score(self, text):
        found = split(text)
        return sum(math.log10(self.p(tuple(found[max(0, i - self.order + 1) : i]), w)) for i, w in enumerate(found))

    def base(self, text):
        return sum(math.log10(self.p((), w)) for w in split(text))


ODD = [(500, None), (501, ""), (502, "  W1\tw4 NEW é"), (503, "w1 " * 30_000), (None, "w1 w4"), (502, "  W1\tw4 NEW é"), (504, "z" * 5000 + " " + "Z" * 256 + " w1"), (505, "\x0b\x1c x\x85y\u2003z\r\n")]


@pytest.mark.parametrize("words,order,held,slice_", [(200_000, 3, 2_000_000, 1 << 20), (20, 3, 50, 100), (200_000, 1, 2_000_000, 1 << 20), (0, 4, 2_000_000, 5000)])
def test_equals_brute_force(spark, monkeypatch, words, order, held, slice_):
    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(words_, "SLICE", slice_)
    for name in ("ASKED", "GROUP", "SUMS"):
        monkeypatch.setattr(lm, name, min(getattr(lm, name), held))
    rows = corpus() + ODD
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    model = lm.train(df.where("doc_id < 100 or doc_id >= 504"), order=order, words=words)
    texts = [t for i, t in rows if i is not None and (i < 100 or i >= 504)]
    brute = Brute(texts, order)
    assert sorted(r.c for r in model.counts.collect()) == sorted(brute.c.values())
    assert len(model.words.keys) <= words
    out = lm.score(df, model, extra={"odd": df.doc_id % 2 == 1})
    assert out.columns == ["doc_id", "odd", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = out.collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = sorted(((i, len(split(t)), sum(brute.c[w] > 0 for w in split(t)), brute.total, brute.base(t), brute.score(t)) for i, t in rows), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)
    if order > 1:
        held = [r for r in got if r[0] is not None and 100 <= r[0] < 120]
        assert sum(r[5] for r in held) > sum(r[4] for r in held)


def test_each_context_adds_up_to_one():
    brute = Brute([t for _, t in corpus()], 3)
    names = sorted(brute.c)
    for h in list(brute.next)[::7]:
        assert sum(brute.p(h, w) for w in names) + brute.p(h, "never seen") == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = lm.train(df.limit(0))
    got = {r.doc_id: r for r in lm.score(df, model).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0
    assert got[1].score == pytest.approx(0.0) and got[2].n_tokens == 1
    assert lm.score(df.limit(0), model).count() == 0


@pytest.mark.parametrize("hot,block,most", [(0, 20, 28), (50, 4, 10), (300_000, 20, 28)])
def test_all_words_have_their_ngrams(spark, monkeypatch, hot, block, most):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "MOST_BITS", most)
    rows = corpus() + [(200, "seldom heard phrase"), (201, "seldom heard phrase " + "y" * 80), (202, "seldom heard phrase")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lm.train(df, words=20, hot=hot)  # a dictionary of twenty words bounds no n-gram
    brute = Brute([t for _, t in rows], 3)
    got = {r.doc_id: r.score for r in lm.score(df, model).collect()}
    assert got == pytest.approx({i: brute.score(t) for i, t in rows}, rel=1e-9)


def test_words_and_hashes():
    texts = [t or "" for _, t in ODD]
    rows, a, b = words_.tokens([t.encode() for t in texts])
    want = [(i, w) for i, t in enumerate(texts) for w in split(t)]
    assert rows.tolist() == [i for i, _ in want]
    keys = {}
    for (_, w), x, y in zip(want, a.tolist(), b.tolist(), strict=True):
        assert keys.setdefault(w, (x, y)) == (x, y)
    assert len({x for x, _ in keys.values()}) == len({y for _, y in keys.values()}) == len(keys)
    assert len(words_.tokens([])[0]) == 0


def test_lookup_and_filter():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    for n in (0, 1, 2, len(keys)):
        found = lm.Lookup(keys[:n]).find(keys)
        assert found[:n].tolist() == list(range(n)) and (found[n:] == -1).all()


def test_output_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        lm.score(df, lm.train(df), extra={"n_tokens": df.doc_id})


def test_an_order_is_written_once_after_its_counts(spark, monkeypatch):
    # Arcs and backoff weights come from one pass over what the joins have dealt by prefix.
    labels, stored = [], lm.stored
    monkeypatch.setattr(lm, "stored", lambda df, label, *a: labels.append(label) or stored(df, label, *a))
    lm.train(spark.createDataFrame([(1, "a b c a b c a b"), (2, "a b c")], "doc_id long, text string"))
    assert labels == ["token-counts", "kept", "arcs", "kept", "arcs"]


def test_filter_has_the_bits_of_its_keys(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 8)
    monkeypatch.setattr(lm, "FILTERED", 700)
    keys = np.random.default_rng(4).integers(0, 2**64, 3000, dtype=np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "gram long").repartition(3)
    for n in (df, df.limit(0)):
        found = lm.Filter.of(n)
        want = np.zeros(1 << found.size, bool)
        if n is df:
            for at in lm._places(keys, found.size, found.block):
                want[at] = True
        assert (np.unpackbits(found.bits, bitorder="little").astype(bool) == want).all()


def test_query_sends_small_batches(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.createDataFrame([(1, "a b a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    try:
        spark.conf.set(key, "67108864")
        assert queries.op9_lm_score(spark, str(tmp_path)).count() == 1
        assert int(spark.conf.get(key)) == util.BATCH
    finally:
        spark.conf.set(key, before)

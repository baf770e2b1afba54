import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from fluxpanel.llm import mixing


def test_share_redistributes_to_siblings_with_room():
    one = Fraction(1)
    assert mixing.share(30, [(one, 100), (one, 100), (one, 100)]) == [10, 10, 10]
    assert mixing.share(30, [(one, 4), (one, 100), (one, 100)]) == [4, 13, 13]
    assert mixing.share(30, [(one, 4), (2 * one, 14), (one, 100)]) == [4, 14, 12]
    assert mixing.share(1000, [(one, 4), (one, 5), (0 * one, 9)]) == [4, 5, 0]
    assert mixing.share(10, [(one, 100), (one, 100), (one, 100)]) == [4, 3, 3]
    assert mixing.share(0, [(one, 3)]) == [0] and mixing.share(5, []) == []


def test_siblings_come_before_ancestors():
    leaves = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}
    assert mixing.budgets(leaves, {}, 100) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    assert mixing.budgets({("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 100}, {}, 100) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 70}
    assert mixing.budgets(leaves, {("a",): 3, ("a", "y"): 0}, 40) == {("a", "x"): 10, ("a", "y"): 0, ("b", "z"): 30}
    assert mixing.budgets({}, {}, 7) == {}


def brute(rows, weights, fraction, epochs, seed):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves = defaultdict(list)
    for doc_id, text, lang, source in rows:
        if count(text):
            leaves[lang, source].append((doc_id, count(text)))
    have = {p: sum(n for _, n in docs) for p, docs in leaves.items()}
    given = mixing.budgets({p: n * epochs for p, n in have.items()}, weights, int(Fraction(str(fraction)) * sum(have.values())))
    out = []
    for path, docs in leaves.items():
        whole, part = divmod(given[path], have[path])
        for e in range(whole):
            out += [(i, *path, n, e) for i, n in docs]
        key = lambda d: (hashlib.sha256(f"{seed}:{whole}:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[1])  # noqa: B023, E731
        upto = 0
        for i, n in sorted(docs, key=key):
            upto += n
            if upto <= part:
                out.append((i, *path, n, whole))
    return out, given


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", " \t", " a b\nc ", "w " * rng.randint(1, 90)]), rng.choice(["en", "de", None]), rng.choice(["s0"] * 5 + ["s1", None])) for i in range(400)]
    rows += [(None, "x y z", "en", "s0"), (7, "same row twice", "en", "s0"), (7, "same row twice", "en", "s0"), (9999, "long " * 20_000, "de", "s1")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, tokens int")
    weights = {("en",): 0.7, ("de",): 0.3, ("en", "s1"): 4}
    for digits, fraction, epochs in ((3, 0.6, 1), (1, 1.7, 3), (3, 0.0, 1)):
        monkeypatch.setattr(mixing, "DIGITS", digits)
        out = mixing.mix(df, {"lang": F.col("lang"), "source": F.col("source")}, weights, fraction=fraction, epochs=epochs, seed=9)
        assert out.columns == ["doc_id", "lang", "source", "tokens", "epoch", "leaf_budget"]
        want, given = brute(rows, weights, fraction, epochs, 9)
        key = lambda r: tuple((x is not None, str(x)) for x in r)
        assert sorted((tuple(r)[:5] for r in out.collect()), key=key) == sorted(want, key=key)
        used = defaultdict(int)
        for r in want:
            used[r[1:3]] += r[3]
        assert all(used[p] <= given[p] for p in given)
    assert mixing.mix(df.limit(0), {"lang": F.col("lang")}, {}, fraction=0.5).count() == 0

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from fluxpanel.llm import simhash, words


def brute_fingerprint(text, width=3):
    import re

    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        ones.update(i for i in range(64) if h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def brute_components(prints, radius):
    up = {k: k for k in prints}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                ra, rb = sorted((root(a), root(b)))
                up[rb] = ra
    return {k: root(k) for k in ids}


TEXTS = [None, "", " \t\n", "One", "one two", "One  two\tthree", "a b c d " * 50, "ÀB çd É f g", "x" * 10_000, "the cat sat on the mat " * 2000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_equals_definition(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def clustered(n, seed):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(max(1, n // 20))]
    out = []
    for _ in range(n):
        x = rng.choice(seeds)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("radius", [2, 7])
@pytest.mark.parametrize("path", ["sweep", "dense", "crowd"])
def test_group_forest_equals_all_pairs(path, radius):
    if path == "dense" and radius > simhash.DENSE:
        return
    mask = simhash.group_masks(2)[3]
    rng = random.Random(5)
    x = sorted({sum(1 << b for b in rng.sample([i for i in range(64) if not mask >> i & 1], rng.randrange(5))) for _ in range(300)})
    forest = simhash.Forest(len(x))
    array = np.array(x, dtype=np.uint64)
    if path == "crowd":
        simhash.crowd(array, radius, forest, leaders=3)
    elif path == "sweep":
        simhash.sweep(array, radius, forest)
    else:
        simhash.dense(array, mask, radius, forest)
    assert dict(enumerate(forest.up.tolist())) == brute_components(dict(enumerate(x)), radius)


def test_sweep_keeps_groups_apart():
    x = np.array([1, 1, 3, 3, 7, 15 << 60], dtype=np.uint64)
    forest = simhash.Forest(len(x))
    simhash.sweep(x, 2, forest, np.array([0, 1, 0, 1, 0, 0]))
    assert forest.up.tolist() == [0, 1, 0, 1, 0, 5]


@pytest.mark.parametrize("limits,radius,agree", [((4096, 1_000_000), 2, 2), ((3, 1_000_000), 2, 2), ((4096, 4), 2, 2), ((4096, 1_000_000), 5, 2), ((3, 1_000_000), 5, 3)])
def test_components_equal_brute_force(spark, monkeypatch, limits, radius, agree):
    monkeypatch.setattr(simhash, "SWEEP", limits[0])
    monkeypatch.setattr(simhash, "SHARD", limits[1])
    prints = dict(enumerate(clustered(400, 7)))
    reps = {}
    for k, fp in prints.items():
        reps.setdefault(fp, k)
    df = spark.createDataFrame([(simhash.signed(fp), k) for fp, k in reps.items()], "fp long, rep long")
    got = {r.id: r.root for r in simhash.components(simhash.links(df, radius, agree)).collect()}
    want = brute_components(prints, radius)
    assert {k: got.get(k, k) for k in reps.values()} == {k: want[k] for k in reps.values()}


def test_near_groups_whole_operator(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS + TEXTS)] + [(None, "one two", 1), (None, "alone here", 2), (3, "One", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    out = simhash.near_groups(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    got = out.collect()
    assert len(got) == len(rows)
    want = brute_components({i: brute_fingerprint(t) for i, t, _ in rows if i is not None}, 2)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    assert sorted((r.component_id is None) for r in got if r.doc_id is None) == [False, True]
    assert simhash.near_groups(df.limit(0)).count() == 0


def brute_kept(rows, radius=7, similarity=0.8, width=5):
    """Ids that stay, from the definition: components of fingerprints, then in order of ids."""
    texts = {i: t for i, t in rows if i is not None}
    roots = brute_components({i: brute_fingerprint(t) for i, t in texts.items()}, radius)

    def shingles(t):
        found = (t or "").lower().split()
        return {tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()

    kept = []
    for i in sorted(texts):
        own = shingles(texts[i])
        near = [k for k in kept if roots[k] == roots[i]]
        if not any((not own and not shingles(texts[k])) or (own and len(own & (o := shingles(texts[k]))) / len(own | o) >= similarity) for k in near):
            kept.append(i)
    return set(kept)


def edited(seed=3):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(12):
        base = [rng.choice(names) for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 12, 40])):
                text[rng.randrange(len(text))] = rng.choice(names)
            rows.append((len(rows), " ".join(text)))
    return rows


def test_similar_copies_go_and_others_stay(spark):
    rows = edited() + [(900, None), (901, " "), (902, "lone"), (903, "lone"), (None, "lone")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, salt string, lost int").repartition(3)
    out = simhash.drop_near_copies(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == brute_kept(rows) | {None}
    assert simhash.drop_near_copies(df.limit(0)).count() == 0


def test_large_components_in_parts(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, base.replace(f"w{i * 2} ", "changed ")) for i in range(60)] + [(100 + i, f"own words {i} " + " ".join(f"v{i}x{k}" for k in range(40))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_copies(df, part=7).collect()}
    assert kept == {0} | {100 + i for i in range(10)}


def chain(n, step, words=200):
    """Texts whose neighbours alone are 0.8 similar: each has ``step`` more words replaced than the one before."""
    return [" ".join([f"new{k}" for k in range(i * step)] + [f"w{k}" for k in range(i * step, words)]) for i in range(n)]


def test_one_document_of_a_chain_stays(spark):
    a, b, c = chain(3, 15)
    rows = [(5, b), (1, a), (3, c), (7, " ".join(f"v{k}" for k in range(50)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(df, radius=40, agree=1).collect()} == {1, 7}


def test_parts_do_not_change_groups(spark):
    rows = [(i, t) for i, t in enumerate(chain(12, 15) + [f"alone {i} " + " ".join(f"v{i}x{k}" for k in range(60)) for i in range(6)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (1000, 5):
        assert {r.doc_id for r in simhash.drop_near_copies(df, radius=40, agree=1, part=part).collect()} == {0, *range(12, 18)}, part


def test_shingle_links_equal_all_pairs():
    keys, at = words.shingles([t.encode() for _, t in edited(4)] + [b"", b" \n", b""], 5)
    sets = [np.unique(keys[a:b]) for a, b in zip(at, at[1:])]
    want = {}
    for leaders in (0, 2, 64):
        forest = simhash.Forest(len(sets))
        simhash.shingle_links(sets, 0.8, forest, leaders)
        got = simhash.Forest(len(sets))
        for i, x in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(x, sets[j]))
                if (not len(x) and not len(sets[j])) or (both and both / (len(x) + len(sets[j]) - both) >= 0.8):
                    got.link(np.array([i]), np.array([j]))
        assert forest.up.tolist() == got.up.tolist()


def test_bands_find_pairs_at_the_threshold(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(base)
        for k in range(4):
            other[25 + 50 * k] = f"x{i}y{k}"  # isolated edits: 176 of 216 shingles in common
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    rows += [(900, None), (901, " "), (None, "lone"), (903, "lone"), (904, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = simhash.drop_near_copies(df, bands=32)
    assert {r.doc_id for r in out.collect()} == {*range(0, 120, 2), 900, 903, None}
    assert simhash.drop_near_copies(df.limit(0), bands=32).count() == 0


def test_pipeline_names_candidates_by_bands(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(simhash, "drop_near_copies", lambda docs, **how: how)
    assert corpus_pipeline.drop_near_copies(spark, None, "")["bands"] == 32


def test_rows_repeated_with_one_id(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = base.replace("w30 ", "edited ")
    rows = [(1, base), (1, base), (2, other), (3, "some words of its own here"), (4, "x y z"), (4, base.replace("w9 ", "q "))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for part in (1000, 2, 1):
        assert sorted(r.doc_id for r in simhash.drop_near_copies(df, bands=32, part=part).collect()) == [1, 1, 3], part


def test_fingerprints_name_candidates_beside_bands(spark):
    rng = random.Random(12)
    rows = []
    for i in range(80):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        other = list(base)
        other[200] = f"x{i}"  # 391 of 401 shingles in common
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    close = {b for (_, x), (b, y) in zip(rows[::2], rows[1::2]) if bin(simhash.fingerprint(x) ^ simhash.fingerprint(y)).count("1") <= 2}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lost = {r.lost for r in simhash.similar_copies(df, radius=2, bands=1).collect()}
    by_bands = {r.id for r in simhash.band_groups(df, bands=1).collect()} & {i for i, _ in rows[1::2]}
    assert close - by_bands and lost == close | by_bands  # each way finds pairs that the other does not
    assert by_bands - close

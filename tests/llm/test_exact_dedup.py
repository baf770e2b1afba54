import hashlib
import random
import re

import pytest

from fluxpanel.llm import exact_dedup


def brute(rows):
    out, groups = [], {}
    for i, text in rows:
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()
        groups.setdefault(key, []).append(i)
        out.append((i, key))
    least = {k: min([i for i in ids if i is not None], default=None) for k, ids in groups.items()}
    return sorted(((i, least[k], len(groups[k]), i == least[k], k) for i, k in out), key=str)


@pytest.mark.parametrize("least", [2, 20, 10**6])
def test_equals_brute_force(spark, least):
    rng = random.Random(6)
    texts = [None, "", " ", "\t\n ", "a b", "a  b", "a\x0bb", " a b", "é x", "A b", "y" * 30_000]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(1000 + i, "hot text") for i in range(150)] + [(2000 + i, f"own {i}") for i in range(50)]
    rows += [(None, "a b"), (None, "nameless"), (None, "nameless"), (2001, "own 1")]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, key string, kept boolean").repartition(5)
    out = exact_dedup.exact_groups(df, least=least)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)
    kept = exact_dedup.drop_copies(df, least=least)
    assert kept.columns == df.columns
    want = sorted((str(r[0]) for r in brute(rows) if r[3] or r[0] is None))
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0
    assert exact_dedup.exact_groups(df.where("doc_id is null").limit(1)).count() == 1


def test_frequent_digests_are_resolved_without_a_shuffle_of_theirs(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(3000)], "id long, key string")
    found = exact_dedup.winners(df, 1000, 4000, 128).collect()
    assert [(r.key, r.keep_id, r.group_size) for r in found] == [("hot", 1, 2000)]

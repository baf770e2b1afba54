import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from fluxpanel.llm import packing
from fluxpanel.llm.queries import word_bpe


def bins(made, counts):
    """The pieces of each sequence as (offset, length), from the plan alone."""
    out = {}
    for length, n in counts.items():
        for rank in range(n):
            key = length * packing._SPAN + rank
            at = int(np.searchsorted(made.key, key, side="right")) - 1
            within = key - int(made.key[at])
            each = int(made.each[at])
            out.setdefault(int(made.sequence[at]) + within // each, []).append((int(made.offset[at]) + within % each * length, length))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_once_without_gaps(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 64, 300])
    counts = dict(Counter(min(capacity, 1 + int(rng.expovariate(1) * capacity / 3)) for _ in range(rng.choice([1, 30, 500]))))
    made = packing.plan(counts, capacity)
    got = bins(made, counts)
    assert sorted(got) == list(range(made.sequences))
    for parts in got.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert Counter(n for parts in got.values() for _, n in parts) == Counter(counts)


def test_exact_complements_come_first():
    # 5 + 5, 6 + 3 + 1, 7 + 1 + 1 + 1: each gap of 10 is filled exactly
    assert packing.plan({5: 2, 6: 1, 3: 1, 1: 4, 7: 1}, 10).sequences == 3
    assert packing.Sums([0, 3, 0, 0, 0, 0]).exact(2, 5) == [1, 1]
    assert packing.Sums([0, 1, 0, 0, 0, 0]).exact(2, 5) is None
    assert packing.Sums([0, 1, 1, 1, 0, 0, 0]).exact(6, 4) == [3, 2, 1]
    assert packing.Sums([0, 0, 2, 0, 0]).exact(2, 2) == [2]
    assert packing.Sums([0, 0, 1, 0, 0]).exact(2, 2) is None
    assert packing.plan({}, 10).sequences == 0


TEXTS = ["", None, "Hello, world! it's I'LL don't...", "ÀÉ ΣΑΣ İstanbul é x́y 你好　世界 ٣٤½²", "a\x1cb\x85c d 'S 'll.", "<|endoftext|> x<|startoftext|>", "ab " * 9000, "z" * 20_000, "?!a.b,c:d;e -- (f) \"g\""]


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(word_bpe())
    own = Tokenizer.from_file(word_bpe())
    for t in TEXTS[2:] + ["a <|ENDOFTEXT|>b", "<|endoftext|", "x<|startoftext|><|endoftext|>"]:
        assert e(t) == packing.ids_bytes(own.encode(t, add_special_tokens=False).ids), t
    assert e.by_word and e.folds
    for block in (TEXTS, TEXTS[::-1]):
        assert e.many(block) == [e.plain(t) if t else b"" for t in block]
    for t in TEXTS:
        assert e(t) == (e.plain(t) if t else b"")


def test_encoder_with_a_full_memory(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 2)
    e = packing.Encoder(word_bpe())
    assert e.many(TEXTS) == [e.plain(t) if t else b"" for t in TEXTS]


def test_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 3)] + [(None, "no id", "x"), (0, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    out = packing.pack(df, word_bpe, capacity=512)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = out.collect()
    e = packing.Encoder(word_bpe())
    want = Counter()
    for key, text, _ in rows:
        ids = (e.plain(text) if text else b"") + b"\x01\0\0\0"
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[key, piece, at // 4, len(ids[at : at + 2048]) // 4, zlib.crc32(ids[at : at + 2048])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 512
    assert len(by) <= -(-sum(r.length for r in got) // 512) + 1
    assert packing.pack(df.limit(0), word_bpe).count() == 0


def brute_exact(have, gap, held):
    """Whether one, two or three available lengths fill the gap, by trying all."""
    left = Counter({i: n for i, n in enumerate(have) if n})
    left[held] -= 1
    names = sorted(left.elements())
    return any(sum(c) == gap for k in (1, 2, 3) for c in combinations(names, k))


@pytest.mark.parametrize("seed", range(6))
def test_sums_find_a_complement_wherever_there_is_one(seed):
    rng = random.Random(seed)
    have = [0] + [rng.choice([0, 0, 0, 1, 2]) for _ in range(24)]
    sums = packing.Sums(have)
    for held in range(24, 0, -1):
        while have[held]:
            found = sums.exact(25 - held, held)
            assert (found is not None) == brute_exact(have, 25 - held, held)
            if found is None:
                break
            assert sum(found) == 25 - held
            for x in (held, *found):
                have[x] -= 1
            assert min(have) >= 0


def fewest(pieces, capacity):
    """The least number of sequences, by trying every place of every piece."""
    best = len(pieces)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + pieces[i] <= capacity:
                put(i + 1, bins[:k] + [bins[k] + pieces[i]] + bins[k + 1 :])
        put(i + 1, [*bins, pieces[i]])

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_few_more_sequences_than_the_least(seed):
    rng = random.Random(seed)
    pieces = sorted((rng.randint(1, 12) for _ in range(9)), reverse=True)
    assert packing.plan(dict(Counter(pieces)), 12).sequences <= fewest(pieces, 12) + 1

"""The registered queries, column by column, against plain definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from fluxpanel.llm import licenses, queries, secrets

from .test_langid import corpus
from .test_lm import Brute, split
from .test_scans import LICENCES, TEXTS, brute_base, brute_spans

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def rows():
    given = [(t, lang) for _, t, lang in corpus(15)] + [(t, None) for t in LICENCES + TEXTS] + [("the der", "en"), ("", "de"), (None, "fr"), ("12 !?", "en"), ("schaftung eauxt", None)]
    given.append(given[0])
    return [(7 * i, t, lang, f"src{i % 3}", len(t or ""), 0.5) for i, (t, lang) in enumerate(given)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows(), COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def remainder(key, n):
    return zlib.crc32(str(key).encode()) % n


def run(spark, folder, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}


def words_of(text):
    return [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(c.isalpha() for c in w)]


def grams_of(word, n):
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]


def brute_language(texts, text):
    """Word-first backoff by definition; texts: (text, language) to learn from."""
    counts = {}
    for t, lang in texts:
        for w in words_of(t):
            for n, g in [(0, w), *((n, g) for n in (1, 2, 3, 4) for g in grams_of(w, n))]:
                counts.setdefault((n, lang), Counter())[g] += 1
    names = sorted({lang for _, lang in counts})
    known = {n: {g for (m, _), c in counts.items() if m == n for g in c} for n in range(5)}

    def log(n, g, lang):
        c = counts.get((n, lang), Counter())
        return math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * (len(c) + 1)))

    found = words_of(text)
    if not found:
        return "und", 0.0
    total = dict.fromkeys(names, 0.0)
    for w in found:
        for lang in names:
            if w in known[0]:
                total[lang] += log(0, w, lang)
                continue
            for n in (4, 3, 2, 1):
                own = [g for g in grams_of(w, n) if g in known[n]]
                if own:
                    total[lang] += sum(log(n, g, lang) for g in own) / len(own)
                    break
    best = max(names, key=lambda x: (total[x], [-ord(c) for c in x]))
    return best, 1.0 / sum(math.exp(v - total[best]) for v in total.values())


def test_language_query(spark, folder):
    got = run(spark, folder, "op1_language_id")
    learn = [(r[1], r[2]) for r in rows() if remainder(r[0], 3) != 1 and r[1] is not None and r[2] is not None]
    for key, text, *_ in rows():
        name, score = brute_language(learn, text)
        assert got[key].held_out == (remainder(key, 3) == 1)
        assert got[key].score == pytest.approx(score, abs=1e-9)
        assert got[key].lang_pred == name or score < 0.34  # a tie of three


def test_licence_query(spark, folder):
    got = run(spark, folder, "op6_license_scan")
    for key, text, *_ in rows():
        r, (n, places, first, last, base) = got[key], brute_base(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, places, first, last, ",".join(base))
        notices = [x.split(":") for x in r.notices.split(",") if x]
        assert notices == [[x[0], str(x[1]), str(x[2]), str(x[3])] for x in licenses.fuzzy(licenses.words_joined(text)[0])]
        assert r.labels == ",".join(sorted({*base, *(x[0] for x in notices)}))
        assert 0 <= r.score <= 1 and (r.score == 1) >= (places > 0) and (r.score > 0) == bool(r.labels)


def test_model_query(spark, folder):
    got = run(spark, folder, "op9_lm_score")
    brute = Brute([r[1] for r in rows() if remainder(r[0], 5) != 1], 3)
    for key, text, *_ in rows():
        r = got[key]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (remainder(key, 5) == 1, len(split(text)), brute.total)
        assert r.n_known == sum(brute.c[w] > 0 for w in split(text))
        assert (r.base_score, r.score) == pytest.approx((brute.base(text), brute.score(text)), rel=1e-9)


def test_secret_query(spark, folder):
    got = run(spark, folder, "op10_secret_scan")
    for key, text, *_ in rows():
        r, base = got[key], brute_spans(text)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secrets.BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [tuple(int(x) if x.isdigit() else x for x in s.split(":")) for s in r.spans.split(",") if s]
        assert [s for s in spans if s[0] in secrets.BASE] == base
        assert {s[0] for s in spans} - set(secrets.BASE) <= {"pem", "der", "ssh", "jwt"}


@pytest.mark.parametrize("name", ["op4_exact_dedup", "base_license_places", "base_secret_counts", "base_lm_score"])
def test_equals_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    write = lambda r: tuple(repr(v) for v in r)
    assert sorted(map(write, df.select(*columns).collect())) == sorted(map(write, found.fetchall()))

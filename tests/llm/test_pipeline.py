import hashlib
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import pyarrow as pa
from fluxpanel.llm import mixing, packing, simhash, util
from fluxpanel.llm.queries import word_bpe
from fluxpanel.llm.util import BATCH, small_batches, stored

from .test_exact_dedup import brute as brute_exact
from .test_langid import corpus
from .test_simhash import brute_kept

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    base = [(i, text, lang, f"src{i % 3}") for i, text, lang in corpus(40)]
    top = max(r[0] for r in base) + 1
    copies = [(top + k, base[k % 5][1] + ("  " if k % 2 else ""), base[k % 5][2], "src0") for k in range(30)]
    copies = [(i, t.replace("  ", " "), lang, s) for i, t, lang, s in copies]
    junk = [(top + 100, None, "en", "src1"), (top + 101, "12 !? _", "en", None), (top + 102, "", None, "src0"), (None, base[3][1], "en", "src2")]
    return [(*r, len(r[1] or "")) for r in base + copies + junk]


def test_every_stage_against_brute_force(spark):
    docs = spark.createDataFrame(rows(), COLUMNS).repartition(3)
    given = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        before = {r.doc_id: r.text for r in docs.collect()}
        got = out.collect()
        seen.append(len(got))
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r == given[r.doc_id] for r in got)
            kept = {r.doc_id for r in got}
        if name == "language":
            assert {i for i, t in before.items() if not any(c.isalpha() for c in t or "")}.isdisjoint(kept)
            assert {i for i, r in given.items() if r.text and any(c.isalpha() for c in r.text)} == kept
        elif name == "exact_dedup":
            assert kept == {r[0] for r in brute_exact(before.items()) if r[3] or r[0] is None}
        elif name == "near_dedup":
            assert kept == brute_kept(list(before.items())) | {i for i in before if i is None}
        elif name == "mixing":
            leaves = [(i, given[i].text, "crawl" if given[i].source == "src0" else "curated", given[i].lang, given[i].source) for i in before]
            assert kept == set(brute_mix(leaves))
        else:
            e = packing.Encoder(word_bpe())
            assert Counter(r.doc_id for r in got) == Counter({i: -(-(len(e.plain(t)) // 4 + 1) // 4096) for i, t in before.items()})
            assert sum(r.length for r in got) == sum(len(e.plain(t)) // 4 + 1 for t in before.values())
        docs = spark.createDataFrame(got, out.schema) if name != "packing" else docs
    assert seen[0] > seen[1] >= seen[2] > seen[3] > 0


def brute_mix(leaves):
    size = {i: len((t or "").split()) for i, t, *_ in leaves}
    have = {}
    for i, _, *path in leaves:
        have[tuple(path)] = have.get(tuple(path), 0) + size[i]
    how = corpus_pipeline.MIX
    given = mixing.budgets(have, corpus_pipeline.MIX_WEIGHTS, int(Fraction(str(how["fraction"])) * sum(have.values())))
    out = []
    for path in have:
        whole, part = divmod(given[path], have[path])
        own = [i for i, _, *p in leaves if tuple(p) == path]
        if whole:
            out += own
            continue
        upto = 0
        for i in sorted(own, key=lambda i: hashlib.sha256(f"{how['seed']}:{whole}:{'' if i is None else i}".encode()).hexdigest()):
            upto += size[i]
            if upto <= part:
                out.append(i)
    return out


def test_run_and_empty_table(spark, tmp_path):
    spark.createDataFrame(rows(), COLUMNS).write.parquet(f"{tmp_path}/a/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_texts_go_to_workers_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        small_batches(spark)
        docs = spark.range(0, 12_000, 1, 1).selectExpr("id", "repeat('word ', 400) AS text")
        sizes = [r.n for r in docs.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()]
        assert sum(sizes) == 12_000 and max(sizes) < 3_000  # 10,000 by default
        spark.conf.set(key, "1000000")
        small_batches(spark)
        assert spark.conf.get(key) == "1000000"
        spark.conf.set(key, "67108864")
        corpus_pipeline.identify_language(spark, spark.createDataFrame(rows(), COLUMNS), "")
        assert int(spark.conf.get(key)) == BATCH
    finally:
        spark.conf.set(key, before)


def test_small_tables_go_to_few_files(spark, monkeypatch):
    # Two processes are started for each file: 211 partitions of a few rows aren't as many files.
    most = 4 * spark.sparkContext.defaultParallelism
    numbers = spark.range(500).repartition(211, "id")
    files = lambda df: len(df.inputFiles())
    small = stored(numbers, "small", 500)
    assert files(small) <= most < files(stored(numbers, "as-dealt"))
    assert sorted(r.id for r in small.collect()) == list(range(500))
    monkeypatch.setattr(util, "FILE_ROWS", 10)
    assert most < files(stored(numbers, "large", 500)) <= 50
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60, 2)] + [(70, 4), (70, 9)], "a long, b long")
    assert sorted(simhash.components(edges, 40).collect()) == sorted(simhash.components(edges).collect())

"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, licenses, lm, mixing, packing, secrets, simhash, urlfilter, vectors
from .util import documents, remainder, small_batches


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.where(remainder("doc_id", 3) != 1))
    scored = langid.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


# The rules (host, path, verdict) that the query applies.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Hosts that the method blocks of its own accord where no rule fits, beside a numbered series of them.
URL_SERIES = 200_000
URL_BLOCKLIST = (
    "ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net",
    "free-bets.example.net", "spam-farm.example.org",
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(*r, False) for r in URL_RULES] + [(h, "", "block", True) for h in URL_BLOCKLIST]
    series = spark.range(URL_SERIES).select(F.format_string("host%d.blocked.example", "id").alias("host"), F.lit("").alias("path"), F.lit("block").alias("verdict"), F.lit(True).alias("listed"))
    entries = spark.createDataFrame(rows, urlfilter.ENTRY).unionByName(series)
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, entries).drop("url")


OP2_SQL = f"""
WITH r(host, path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
b(host) AS (SELECT * FROM (VALUES {", ".join(f"('{h}')" for h in URL_BLOCKLIST)}) UNION ALL SELECT 'host' || i || '.blocked.example' FROM range({URL_SERIES}) t(i)),
u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), m AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id
), x AS (
  SELECT DISTINCT page_id FROM (SELECT page_id, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS host FROM p) JOIN b USING (host)
)
SELECT p.page_id, p.host, p.path, m.rule,
  coalesce(m.verdict, CASE WHEN x.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id LEFT JOIN x ON p.page_id = x.page_id
"""


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def word_bpe() -> str:
    """Where the tokenizer's file is on this machine; asked anew on each worker."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), word_bpe)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"), out="found").drop("text")
    labels = F.array_union("found.base_labels", F.col("found.matches.label"))
    best = F.array_max(F.col("found.matches.similarity"))
    return found.select(
        "doc_id", *[F.col(f"found.{c}") for c in ("n_words", "n_base", "first_word", "last_word")],
        F.array_join("found.base_labels", ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("found.n_base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.array_join(F.transform("found.matches", lambda m: F.concat_ws(":", m["label"], m["first_word"].cast("string"), m["last_word"].cast("string"), m["edits"].cast("string"))), ",").alias("notices"),
    )


def mix_levels() -> dict[str, Column]:
    """The tree over documents: the largest source is a crawl, the others are curated."""
    domain = F.when(F.col("source") == "src0", "crawl").otherwise("curated")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


#: Target weights by path prefix; what isn't named has weight 1 among its siblings.
MIX_WEIGHTS = {
    ("crawl",): 0.4, ("curated",): 0.6,
    ("crawl", "en"): 0.7, ("crawl", "de"): 0.1, ("crawl", "es"): 0.1, ("crawl", "fr"): 0.1,
    ("curated", "en"): 0.55, ("curated", "de"): 0.15, ("curated", "es"): 0.15, ("curated", "fr"): 0.15,
}
MIX = {"fraction": 0.8, "epochs": 2, "seed": 42}


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), mix_levels(), MIX_WEIGHTS, **MIX)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.top_k(rows, rows.where("vec_id % 100 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = lm.train(docs.where(remainder("doc_id", 5) != 1))
    return lm.score(docs, model, extra={"held_out": remainder("doc_id", 5) == 1})


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"), out="found").drop("text")
    return found.select("doc_id", *[c.alias(name) for name, c in secrets.summary("found").items()])


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

def base_license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can say."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BASE_LICENSE_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), p AS (
  SELECT doc_id, len(ws) AS n_words, list_filter(range(len(ws)), lambda i: ws[i + 1] = 'mit' AND ws[i + 2] = 'license') AS mit,
    list_filter(range(len(ws)), lambda i: ws[i + 1] = 'apache' AND ws[i + 2] = 'license') AS apache,
    list_filter(range(len(ws)), lambda i: ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license') AS gpl FROM w
)
SELECT doc_id, n_words::BIGINT AS n_words, (len(mit) + len(apache) + len(gpl))::BIGINT AS n_base, list_min(mit || apache || gpl)::BIGINT AS first_word, list_max(mit || apache || gpl)::BIGINT AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels FROM p
"""


def base_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base spans op10 finds; SQL can't give their places."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


BASE_SECRET_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: len(x) >= 24))::BIGINT AS n_hex FROM d
"""


def base_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can say; the score to two places."""
    return op9_lm_score(spark, sf_dir).select("doc_id", "n_tokens", "n_known", "train_tokens", (F.round("base_score", 2) + 0.0).alias("base_score"))


#: DuckDB has no CRC-32, so the training rows' remainder is made from its bits.
_CRC = """(WITH RECURSIVE c(doc_id, s, i, h) AS (
    SELECT doc_id, coalesce(doc_id::VARCHAR, ''), 1, 4294967295::BIGINT FROM documents
    UNION ALL SELECT doc_id, s, i + 1, list_reduce([xor(h, ascii(s[i]))::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FROM c WHERE i <= length(s)
  ) SELECT doc_id, xor(h, 4294967295) AS crc FROM c WHERE i = length(s) + 1)"""
BASE_LM_SQL = rf"""
WITH crc AS {_CRC}, d AS (
  SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+'), '') AS ws FROM documents
), t AS (SELECT doc_id, unnest(ws) AS w FROM d), k AS (SELECT w, count(*) AS c FROM t JOIN crc USING (doc_id) WHERE crc % 5 <> 1 GROUP BY 1),
z AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM k)
SELECT doc_id, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)))), 2) + 0.0 AS base_score FROM t LEFT JOIN k USING (w), z GROUP BY 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_license_scan": op6_license_scan,
    "op7_source_mixing": op7_source_mixing,
    "op8_top_k": op8_top_k,
    "op9_lm_score": op9_lm_score,
    "op10_secret_scan": op10_secret_scan,
    "base_license_places": base_license_places,
    "base_secret_counts": base_secret_counts,
    "base_lm_score": base_lm_score,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op8_top_k": OP8_SQL, "base_license_places": BASE_LICENSE_SQL, "base_secret_counts": BASE_SECRET_SQL, "base_lm_score": BASE_LM_SQL,
}

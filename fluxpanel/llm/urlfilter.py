"""URL filtering with a sorted digest array.

Entries (host, path prefix) are stored as one byte string each, host and path joined, in
the order of their 64-bit XXH64 digests.  The digest array is memory-mapped on each
worker; a url's candidates (each parent host with each prefix length that an entry has)
are probed by one vectorised binary search for a whole batch, and a hit counts only if
the stored string is equal, so digests that collide do no harm.

The array is broadcast, so its size is checked.  A list beyond ``max_bytes`` is probed by
a join of the candidates on digest and string instead, with the same results.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An allow or block entry wins over the list by which the method itself judges.
ENTRY = "host string, path string, verdict string, listed boolean"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class DigestIndex:
    """Sorted digests, the strings they stand for, and a number for each."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, text: np.ndarray, values: np.ndarray):
        self.keys, self.ends, self.text, self.values = keys, ends, text, values

    @staticmethod
    def digest(entry: bytes) -> int:
        return xxhash.xxh64_intdigest(entry)

    @classmethod
    def build(cls, entries: list[bytes], values: list[int]) -> bytes:
        """The index as bytes: count, digests, ends of strings, values, strings."""
        digests = np.array([cls.digest(e) for e in entries], dtype="<u8")
        order = np.argsort(digests, kind="stable")
        held = [entries[i] for i in order]
        ends = np.cumsum([len(e) for e in held], dtype="<u8") if held else np.zeros(0, "<u8")
        return b"".join([np.uint64(len(held)).astype("<u8").tobytes(), digests[order].tobytes(), ends.tobytes(), np.array(values, dtype="<u8")[order].tobytes(), *held])

    @classmethod
    def mapped(cls, data: bytes) -> DigestIndex:
        """Memory-map the bytes from a file that is gone from its folder once it is open."""
        with tempfile.NamedTemporaryFile(delete=False) as file:
            file.write(data)
        try:
            whole = np.memmap(file.name, dtype=np.uint8, mode="r")
        finally:
            os.unlink(file.name)
        n = int(whole[:8].view("<u8")[0])
        part = lambda k: whole[8 + 8 * n * k : 8 + 8 * n * (k + 1)].view("<u8")
        return cls(part(0), part(1), whole[8 + 24 * n :], part(2))

    def entry(self, i: int) -> bytes:
        return self.text[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """For each candidate the place of its entry, or -1."""
        found = np.full(len(candidates), -1, dtype=np.int64)
        if not len(self.keys) or not candidates:
            return found
        digests = np.array([self.digest(c) for c in candidates], dtype=np.uint64)
        at = np.searchsorted(self.keys, digests)
        inside = at < len(self.keys)
        for i in np.flatnonzero(inside & (self.keys[np.where(inside, at, 0)] == digests)):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:
                if self.entry(j) == candidates[i]:
                    found[i] = j
                    break
                j += 1
        return found


def parents(host: str, labels: frozenset[int]) -> list[str]:
    """The host and each parent that has as many labels as some entry."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts)) if len(parts) - i in labels]


_INDEXES: dict[int, tuple[object, DigestIndex]] = {}


def _probing(shared, lengths: list[int], labels: frozenset[int]):
    key = id(shared)

    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        data = shared.value
        if key not in _INDEXES or _INDEXES[key][0] is not data:
            _INDEXES.clear()
            _INDEXES[key] = (data, DigestIndex.mapped(data))
        index = _INDEXES[key][1]
        owners, candidates = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            for parent in parents(host, labels):
                for n in lengths:
                    if n > len(path):
                        break
                    owners.append(i)
                    candidates.append((parent + path[:n]).encode("utf-8", "surrogatepass"))
        rule, verdict = [None] * len(hosts), ["allow"] * len(hosts)
        for c in np.flatnonzero((at := index.probe(candidates)) >= 0):
            i, value, text = owners[c], int(index.values[at[c]]), candidates[c].decode("utf-8", "surrogatepass")
            blocks, listed = bool(value & 1), bool(value & 2)
            if listed:
                if rule[i] is None and blocks:
                    verdict[i] = "block"
            elif rule[i] is None or len(text) > len(rule[i]):
                rule[i], verdict[i] = text, "block" if blocks else "allow"
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    return judge


def judge(pages: DataFrame, entries: DataFrame, url_col: str = "url", *, max_bytes: int = 64_000_000) -> DataFrame:
    """``pages`` with host, path, rule and verdict; no shuffle while the list is small.

    ``entries`` has host, path, verdict (allow or block) and listed.  An entry fits its host
    and all subdomains where the url's path starts with the entry's path, which is empty or
    starts with a slash; the longest entry that isn't ``listed`` wins (of equally long ones that
    with the longer host, of entries given twice a block).  Where none fits, the verdict is block if any listed block entry fits, else
    allow.  A null url or one without ``://`` has an empty host and path and is allowed.
    Columns of ``pages`` with the output names are replaced; repeated rows stay; urls of any
    length are judged whole; an empty table gives no rows.
    """
    made = ("host", "path", "rule", "verdict")
    rest = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in made], F.col(url_col).alias("__url"))
    keep = [F.col(f"`{c}`") for c in rest.columns if c != "__url"]
    rest = rest.withColumns({"__host": host_of(F.col("__url")), "__path": path_of(F.col("__url"))})
    entries = (
        entries.where("host is not null and verdict is not null")
        .select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict", F.coalesce("listed", F.lit(False)).alias("listed"))
        .groupBy("host", "path", "listed").agg(F.max("verdict").alias("verdict"))
    )
    size = entries.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 24), F.lit(0))).first()[0]
    if size > max_bytes:
        found = _by_join(rest, entries)
        return found.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), "rule", "verdict")
    rows = entries.collect()  # its size has been checked
    texts = {}
    for r in rows:  # a list entry beside a rule of the same host and path can't change a verdict
        if not r.listed or (r.host, r.path) not in texts:
            texts[r.host, r.path] = (r.verdict == "block") + 2 * r.listed
    shared = pages.sparkSession.sparkContext.broadcast(DigestIndex.build([(h + p).encode("utf-8", "surrogatepass") for h, p in texts], list(texts.values())))
    lengths, labels = sorted({len(p) for _, p in texts}), frozenset(h.count(".") + 1 for h, _ in texts)
    probe = F.pandas_udf(_probing(shared, lengths, labels), "rule string, verdict string")
    return rest.withColumn("__j", probe("__host", "__path")).select(
        *keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__j.rule").alias("rule"), F.col("__j.verdict").alias("verdict")
    )


def _by_join(rest: DataFrame, entries: DataFrame) -> DataFrame:
    """The same for a list that is too large to broadcast."""
    lengths = [r[0] for r in entries.select(F.length("path")).distinct().collect()]  # at most a url's length
    parts = F.split("__host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    paths = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("__path")), lambda n: F.substring(F.col("__path"), F.lit(1), n))
    wanted = (
        rest.select("__host", "__path").distinct().withColumn("host", F.explode(hosts)).withColumn("path", F.explode(paths))
        .withColumn("digest", F.xxhash64(F.concat("host", "path")))
    )
    best = (
        wanted.join(entries.withColumn("digest", F.xxhash64(F.concat("host", "path"))), ["digest", "host", "path"])
        .withColumn("key", F.concat("host", "path")).groupBy("__host", "__path").agg(
            F.max_by(F.when(~F.col("listed"), F.struct("key", "verdict")), F.when(~F.col("listed"), F.struct(F.length("key"), F.length("host")))).alias("best"),
            F.max(F.col("listed") & (F.col("verdict") == "block")).alias("blocked"),
        )
    )
    own = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return rest.join(best, ["__host", "__path"], "left").withColumns({"rule": F.col("best.key"), "verdict": F.coalesce("best.verdict", own)})

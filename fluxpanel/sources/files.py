"""File sources and sinks: typed CSV, Parquet, hashes, snapshots, manifests and text tables."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import shutil
import stat
import tempfile
import time
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import set_gaps


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, date_format: str = "yyyyMMdd", header: bool = True) -> DataFrame:
    """CSV with a fixed schema: a header that differs or a malformed row is an error, not a null."""
    df = spark.read.schema(schema).option("header", header).option("enforceSchema", "false" if header else "true").option("mode", "FAILFAST").option("dateFormat", date_format).csv(path)
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, between: tuple[str, object, object] | None = None, schema=None) -> DataFrame:
    """Parquet with column pruning and a range that reaches the row groups.

    With a known ``schema`` no job reads footers before the query does.
    """
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    if between:
        name, low, high = between
        df = df.where(F.col(name).between(low, high))
    return df.select(*columns) if columns else df


def describe_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Of each file: bytes, rows, row groups, least and most rows of one, compression, writer and schema; only footers are read, on the driver."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = []
    for name in sorted(spark.read.parquet(path).inputFiles()):
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        size = place.getFileSystem(conf).getFileStatus(place).getLen()
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(place, conf))
        try:
            footer = reader.getFooter()
            meta, groups = footer.getFileMetaData(), list(footer.getBlocks())
            counts = [g.getRowCount() for g in groups]
            codecs = sorted({c.getCodec().toString() for g in groups for c in g.getColumns()})
            columns = [(f.getName(), str(f)) for f in meta.getSchema().getFields()]
            rows.append((name.rpartition("/")[2], size, sum(counts), len(groups), min(counts, default=0), max(counts, default=0), ",".join(codecs), meta.getCreatedBy(), [t for _, t in columns]))
        finally:
            reader.close()
    return spark.createDataFrame(rows, "file string, bytes long, rows long, row_groups int, least_rows long, most_rows long, compression string, created_by string, columns array<string>")


def write_parquet(df: DataFrame, path: str, sort: Sequence[str] = (), range_by: str | None = None, mode: str = "errorifexists") -> None:
    """Zstandard Parquet, clustered by ``range_by`` and sorted within files so that ranges skip row groups.

    An existing folder is not overwritten; readers see files once the job has committed.
    """
    if range_by:
        df = df.repartitionByRange(range_by)
    if sort:
        df = df.sortWithinPartitions(*sort)
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, date_format: str = "yyyyMMdd", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", header).option("dateFormat", date_format).csv(path)


def write_small_csv(df: DataFrame, path: str, bom: bool = False, header: bool = True, encoding: str = "utf-8", most: int = 1_000_000) -> int:
    """One local file of a small table, with a byte-order mark if asked for; more rows than ``most`` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    with open(path, "w", encoding="utf-8-sig" if bom else encoding, newline="") as f:
        out = csv.writer(f)
        if header:
            out.writerow(df.columns)
        out.writerows([["" if v is None else v for v in r] for r in rows])
    return len(rows)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of the files below a path; hashed where they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    """A list of ``hash  file`` lines; lines of another shape are left out."""
    line = r"^([0-9a-fA-F]{64})\s+\*?(.+)$"
    return spark.read.text(path).where(F.col("value").rlike(line)).select(F.lower(F.regexp_extract("value", line, 1)).alias("sha256"), F.regexp_extract("value", line, 2).alias("file"))


def verify_inventory(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Of each file of either side: PASS, changed, missing or extra.  Both have file, bytes and sha256."""
    a, b = expected.alias("a"), found.alias("b")
    joined = a.join(b, F.col("a.file") == F.col("b.file"), "full_outer")
    same = F.col("a.sha256").eqNullSafe(F.col("b.sha256")) & F.col("a.bytes").eqNullSafe(F.col("b.bytes"))
    state = F.when(F.col("b.file").isNull(), "missing").when(F.col("a.file").isNull(), "extra").when(same, "PASS").otherwise("changed")
    return joined.select(F.coalesce("a.file", "b.file").alias("file"), state.alias("status"))


def same_hashes(left: DataFrame, right: DataFrame) -> bool:
    return set_gaps(left, right, ["file", "sha256"]).isEmpty()


def sha256(path: str | Path, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(chunk):
            digest.update(data)
    return digest.hexdigest()


def snapshot(source: str | Path, target: str | Path, expected: Mapping[str, str]) -> dict[str, str]:
    """Copy files whose hashes are known, checked before and after; a target that agrees is used as it is."""
    source, target = Path(source), Path(target)
    for name, digest in expected.items():
        if sha256(source / name) != digest:
            raise ValueError(f"{name} is not the expected file")
    if target.exists():
        if {n: sha256(target / n) for n in expected if (target / n).exists()} == dict(expected):
            return dict(expected)
        raise FileExistsError(target)
    with publish(target) as folder:
        for name in expected:
            shutil.copyfile(source / name, folder / name)
            if sha256(folder / name) != expected[name]:
                raise OSError(f"{name} changed while it was copied")
    return dict(expected)


class publish:
    """A folder that appears under its name only when all went well, and never replaces another."""

    def __init__(self, target: str | Path):
        self.target = Path(target)

    def __enter__(self) -> Path:
        if self.target.exists():
            raise FileExistsError(self.target)
        self.target.parent.mkdir(parents=True, exist_ok=True)
        self.made = Path(tempfile.mkdtemp(prefix=f".{self.target.name}-", dir=self.target.parent))
        return self.made

    def __exit__(self, kind, *_) -> None:
        if kind is None and not self.target.exists():
            os.rename(self.made, self.target)
        else:
            shutil.rmtree(self.made, ignore_errors=True)
            if kind is None:
                raise FileExistsError(self.target)


def seal(paths: Sequence[str | Path]) -> None:
    """Take the right to write from files."""
    for p in paths:
        os.chmod(p, stat.S_IRUSR | stat.S_IRGRP | stat.S_IROTH)


def runtime(folder: str | Path = ".") -> dict:
    """Versions that a result was made with, and the state of the git folder it was made from."""
    import platform
    import subprocess

    import pyspark

    def git(*words: str) -> str | None:
        done = subprocess.run(["git", "-C", str(folder), *words], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else None

    status = git("status", "--porcelain")
    return {"python": platform.python_version(), "platform": platform.platform(), "pyspark": pyspark.__version__, "git_commit": git("rev-parse", "HEAD"), "git_changed": None if status is None else bool(status)}


def write_manifest(folder: str | Path, extra: Mapping | None = None, name: str = "manifest.json") -> dict:
    """Bytes and hash of every file of a folder, the runtime, and what else is given."""
    folder = Path(folder)
    files = {str(p.relative_to(folder)): {"bytes": p.stat().st_size, "sha256": sha256(p)} for p in sorted(folder.rglob("*")) if p.is_file() and p.name != name}
    made = {"files": files, "runtime": runtime(), **(extra or {})}
    (folder / name).write_text(json.dumps(made, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    return made


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Windows (id, start, end) of a JSON file with a list under ``windows``; raises if one ends before it starts."""
    rows = spark.read.schema("windows array<struct<id:string,start:date,end:date>>").option("multiLine", "true").json(path).select(F.inline("windows"))
    if not rows.where("start > end or start is null or end is null").isEmpty():
        raise ValueError("a window ends before it starts")
    return rows


def json_records(df: DataFrame) -> DataFrame:
    """Each row as JSON text: dates as text, NaN as null."""
    kinds = dict(df.dtypes)
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("string").alias(c) if kinds[c] == "date" else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("record"))


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None, decimals: int = 4, labels: Mapping[str, str] | None = None, most: int = 1000) -> str:
    """A small table as Markdown; formatted by Spark; more than ``most`` rows are refused."""
    columns, labels, kinds = list(columns or df.columns), labels or {}, dict(df.dtypes)
    text = [F.coalesce(F.format_number(c, decimals) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit("")) for c in columns]
    lines = [r[0] for r in df.limit(most + 1).select(F.concat(F.lit("| "), F.concat_ws(" | ", *text), F.lit(" |"))).collect()]
    if len(lines) > most:
        raise ValueError(f"more than {most} rows for a Markdown table")
    head = "| " + " | ".join(labels.get(c, c) for c in columns) + " |"
    return "\n".join([head, "|" + " --- |" * len(columns), *lines]) + "\n"


def timed_reads(reads: Mapping[str, Callable[[], DataFrame]], trials: int = 3) -> list[dict]:
    """Median, least and most seconds of full reads, without a sink's cost."""
    out = []
    for name, read in reads.items():
        took = []
        for _ in range(trials):
            began = time.perf_counter()
            read().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        out.append({"read": name, "median_s": median(took), "min_s": min(took), "max_s": max(took), "trials": trials})
    return out


def scaffold(root: str | Path, name: str) -> Path:
    """A folder for a new version, ``v`` and three digits, perhaps with a name; nothing is overwritten."""
    import re

    if not re.fullmatch(r"v\d{3}(_[a-z0-9]+)*", name):
        raise ValueError(f"{name!r} is no name of a version")
    with publish(Path(root) / name) as folder:
        for part in ("src", "configs", "artifacts"):
            (folder / part).mkdir()
        (folder / "README.md").write_text(f"# {name}\n", encoding="utf-8")
    return Path(root) / name


def save_model(spark: SparkSession, model: Mapping, path: str) -> None:
    """A fitted model of a few numbers as one JSON row in Parquet."""
    spark.createDataFrame([(json.dumps(model),)], "model string").write.parquet(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(path).first().model)


def csv_text(rows: Sequence[Sequence]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()

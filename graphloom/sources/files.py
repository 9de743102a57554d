"""Source trees, configuration, logs, history and databases as tables."""

from __future__ import annotations

import sqlite3
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.resolve import enclosing

# What is code, what is skipped, what defines configuration.
CODE_SUFFIXES = ("py", "js", "jsx", "ts", "tsx", "mjs", "cjs", "rb", "go", "java", "kt", "cs", "php", "scala")
SKIPPED_DIRS = (".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".tox", ".mypy_cache")
CONFIG_A = r"^(\.env|\.env\.[^/]*|[^/]*\.env|docker-compose[^/]*\.ya?ml|Dockerfile[^/]*|[^/]*\.tf|[^/]*\.tfvars)$|^\.github/workflows/[^/]*\.ya?ml$|^k8s/[^/]*\.ya?ml$|^helm/(.*/)?[^/]*\.yaml$"
CONFIG_B = (
    (r"(^|/)(\.env|\.env\.[^/]*|[^/]*\.env)$", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*="),
    (r"(^|/)Dockerfile(\.[^/]*)?$", r"^\s*(?:ENV|ARG)\s+([A-Za-z_][A-Za-z0-9_]*)"),
    (r"(^|/)docker-compose[^/]*\.ya?ml$", r"^\s*-?\s*([A-Z][A-Z0-9_]{2,})\s*[:=]"),
    (r"(^|/)\.github/workflows/[^/]*\.ya?ml$", r"^\s*([A-Z][A-Z0-9_]{2,})\s*:"),
    (r"\.ya?ml$", r"^\s*-?\s*name:\s*([A-Z][A-Z0-9_]{2,})\s*$"),
    (r"\.tf$", r'^\s*variable\s+"([A-Za-z_][A-Za-z0-9_]*)"'),
    (r"\.tfvars$", r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*="),
    (r"\.properties$", r"^\s*([A-Za-z_][A-Za-z0-9_.]*)\s*="),
)


def _hidden_paths(spark: SparkSession, root: str) -> list[str]:
    """Files whose names begin with ``.`` or ``_``, which Spark's file sources leave out, and files in such folders.

    Folders are walked one level at a time with globs, so that the file system
    lists a whole level in one call; only hidden names come to the driver, and
    configuration files are few.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = lambda pattern: system.globStatus(jvm.org.apache.hadoop.fs.Path(top, pattern)) or ()
    found, level, inside = [], "", []
    while True:
        for status in listed(f"{level}[._]*"):
            name = status.getPath().getName()
            if status.isDirectory():
                if name not in SKIPPED_DIRS:
                    inside.append(status.getPath())
            elif not name.endswith(".crc"):
                found.append(status.getPath().toString())
        if not any(s.isDirectory() for s in listed(f"{level}*")):
            break
        level += "*/"
    for folder in inside:
        todo = system.listFiles(folder, True)
        while todo.hasNext():
            found.append(todo.next().getPath().toString())
    return sorted({p for p in found if not p.endswith(".crc")})


def _read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, content`` of files by name, opened on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            content = []
            for p in b.path:
                system, at = fs.FileSystem.from_uri(p if "://" in p else "file://" + p.removeprefix("file:"))
                with system.open_input_stream(at) as f:
                    content.append(f.read())
            yield pd.DataFrame({"path": b.path, "content": content})

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // 64)).mapInPandas(run, "path string, content binary")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``file, text, md5`` of every file under ``root`` outside skipped directories; paths are relative and posix."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    if hidden := _hidden_paths(spark, root):
        raw = raw.unionByName(_read_paths(spark, hidden))
    plain = lambda p: F.regexp_replace(X.posix(p), r"^[a-z]+:/+", "/")
    at, base = plain(F.col("path")), plain(F.lit(root.rstrip("/") + "/"))
    file = F.when(at.startswith(base), F.substr(at, F.length(base) + 1)).otherwise(at)
    skipped = F.exists(F.split(F.col("file"), "/"), lambda s: s.isin(*SKIPPED_DIRS))
    return raw.select(file.alias("file"), F.decode("content", "UTF-8").alias("text"), F.md5("content").alias("md5")).where(~skipped)


def code(files: DataFrame) -> DataFrame:
    return files.where(X.suffix(F.col("file")).isin(*CODE_SUFFIXES))


def env_reads(files: DataFrame, any_case: bool = False) -> DataFrame:
    """``file, line, key`` of every read of an environment variable, one row a match."""
    rows = code(files).select("file", F.inline(X.lines(F.col("text"))))
    found = X.all_matches(F.col("text"), X.ENV_READS_B if any_case else X.ENV_READS_A)
    return rows.select("file", "line", F.explode(found).alias("key")).where("key <> ''")


def env_definitions(files: DataFrame, per_format: bool = False) -> DataFrame:
    """``file, line, key`` of every definition in configuration files; ``per_format`` has one rule a format."""
    rows = files.select("file", F.inline(X.lines(F.col("text"))))
    if not per_format:
        key = F.regexp_extract("text", X.ENV_DEFINITION, 1)
        return rows.where(F.col("file").rlike(CONFIG_A)).select("file", "line", key.alias("key")).where("key <> ''")
    found: Column = F.array().cast("array<string>")
    for where, what in CONFIG_B:
        found = F.concat(found, F.when(F.col("file").rlike(where), F.regexp_extract_all("text", F.lit(what), F.lit(1))).otherwise(F.array().cast("array<string>")))
    return rows.select("file", "line", F.explode(F.array_distinct(found)).alias("key")).where("key <> ''")


def table_refs(files: DataFrame) -> DataFrame:
    """``file, line, table`` of SQL tables named in code."""
    rows = code(files).select("file", F.inline(X.lines(F.col("text"))))
    return rows.select("file", "line", F.explode(F.array_distinct(X.all_matches(F.col("text"), X.TABLE_REFS))).alias("table"))


def grep(files: DataFrame, words: DataFrame) -> DataFrame:
    """``query_id, file, line`` where a word (query_id, word) stands as a whole identifier."""
    rows = files.select("file", F.inline(X.lines(F.col("text"))))
    named = rows.select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({X.IDENTIFIER})"), F.lit(1)))).alias("word"))
    return named.join(words, "word").select("query_id", "file", "line")


def grep_symbols(files: DataFrame, words: DataFrame, defs: DataFrame) -> DataFrame:
    """``query_id, file, name`` of the smallest definitions (file, name, start, end, def_line) around the lines that name a word; lines outside all of them drop out."""
    hits = grep(files, words).select(F.struct("query_id", "file", "line").alias("query_id"), "file", "line").distinct()
    extents = defs.where("start is not null").select("file", "name", "start", "end", F.struct("def_line", "name").alias("pos"))
    return enclosing(hits, extents).select("query_id.query_id", "file", "name").distinct()


def changed_old_lines(diffs: DataFrame) -> DataFrame:
    """``diff_id, file, line, kind`` of a ``-U0`` diff (diff_id, text): old lines that were modified, and anchors of pure insertions."""
    rows = diffs.select("diff_id", F.inline(X.lines(F.col("text"))))
    w = Window.partitionBy("diff_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("text").startswith("--- "), F.regexp_replace("text", r"^--- (a/)?", ""))
    hunk = r"^@@ -(\d+)(?:,(\d+))? \+"
    rows = rows.withColumn("file", F.last(named, ignorenulls=True).over(w)).where(F.col("text").rlike(hunk))
    count = F.when(F.regexp_extract("text", hunk, 2) == "", 1).otherwise(F.regexp_extract("text", hunk, 2).try_cast("int"))
    rows = rows.withColumn("at", F.regexp_extract("text", hunk, 1).cast("int")).withColumn("n", count).where("file <> '/dev/null'")
    edits = rows.where("n > 0").select("diff_id", "file", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("line"), F.lit("modified").alias("kind"))
    return edits.unionByName(rows.where("n = 0").select("diff_id", "file", F.col("at").alias("line"), F.lit("inserted").alias("kind")))


def git(repo: str, *args: str) -> str | None:
    """Output of a git command in a repository on the driver's disk; null if it fails or there is no git."""
    try:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, errors="replace", timeout=300)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def git_state(spark: SparkSession, repo: str, base: str | None = None) -> DataFrame:
    """One row: ``root, branch`` (null if detached), ``previous`` branch, ``head``, ``year`` of it, and whether ``base`` is an ancestor."""
    one = lambda *args: (git(repo, *args) or "").strip() or None
    branch = one("symbolic-ref", "--short", "-q", "HEAD")
    ancestor = None if base is None else git(repo, "merge-base", "--is-ancestor", base, "HEAD") is not None
    row = (one("rev-parse", "--show-toplevel"), branch, one("rev-parse", "--abbrev-ref", "@{-1}"), one("rev-parse", "HEAD"), one("show", "-s", "--format=%cs", "HEAD"), ancestor)
    df = spark.createDataFrame([row], "root string, branch string, previous string, head string, day string, base_is_ancestor boolean")
    return df.select("root", "branch", "previous", "head", F.year(F.to_date("day")).alias("year"), "base_is_ancestor")


def git_log(spark: SparkSession, repo: str, *args: str) -> DataFrame:
    """``commits`` of a repository on the driver's disk, newest first."""
    text = git(repo, "log", "--format=%H%x00%s%x00%b%x01", *args)
    return commits(spark.createDataFrame([(text or "",)], "text string"))


def commits(log: DataFrame) -> DataFrame:
    """``commit, subject, body, pos`` of a history (one ``text``) whose fields end in NUL and records in SOH."""
    each = log.select(F.posexplode(F.split("text", "\x01")).alias("pos", "r")).where(F.col("r").rlike(r"\S"))
    f = F.split(F.ltrim(F.col("r")), "\x00")
    return each.select(F.regexp_replace(f[0], r"^\s+", "").alias("commit"), F.get(f, F.lit(1)).alias("subject"), F.get(f, F.lit(2)).alias("body"), "pos")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Lines of JSON; a bad line is skipped, or with ``strict`` stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def running(log: DataFrame, idle_minutes: float = 30.0) -> DataFrame:
    """``key, since`` of runs in a log (ts seconds, key, text) that began and have not ended, while the log is not idle."""
    began, ended = F.col("text").contains("agent running"), F.col("text").contains("resolved=")
    last = log.groupBy("key").agg(F.max(F.when(began, F.col("ts"))).alias("since"), F.max(F.when(ended, F.col("ts"))).alias("until"), F.max("ts").alias("seen"))
    newest = log.agg(F.max("ts").alias("now"))
    return last.join(F.broadcast(newest)).where((F.col("since").isNotNull()) & (F.col("until").isNull() | (F.col("until") < F.col("since"))) & (F.col("now") - F.col("seen") < idle_minutes * 60)).select("key", "since")


def union_first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of several corpora; of one key the first corpus's row."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("_src", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_src"))
    return out.withColumn("_first", first).where("_first = 1").drop("_first", "_src")


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", ...).option("table", ...).schema(...)``: a database opened read-only.

    ``partitions`` splits the table into ranges of its rowid, which is its order on disk.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, [f.name for f in schema.fields])


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.table, self.columns, self.parts = options["path"], options["table"], columns, int(options.get("partitions", "1"))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        from pyspark.sql.datasource import InputPartition

        if self.parts == 1:
            return [InputPartition(None)]
        with self._open() as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [InputPartition((0, 0))]
        step = -(-(high - low + 1) // self.parts)
        return [InputPartition((at, min(at + step, high + 1))) for at in range(low, high + 1, step)]

    def read(self, partition) -> Iterator[tuple]:
        with self._open() as db:
            where = "" if partition.value is None else " where rowid >= ? and rowid < ?"
            yield from db.execute(f"select {', '.join(map(_quoted, self.columns))} from {_quoted(self.table)}{where}", partition.value or ())


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).schema(schema).load()


def by_path(rows: DataFrame, paths: DataFrame, column: str = "file_path") -> DataFrame:
    """Rows whose path equals a wanted one, or, where none does, ends with it: ``query_id`` and the row."""
    want = paths.select("query_id", X.posix(F.col("path")).alias("want"))
    r = rows.withColumn("_p", X.posix(F.col(column)))
    exact = r.join(want, F.col("_p") == F.col("want")).select("query_id", *rows.columns)
    left = want.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    # the last part of the path is an equi-join key; the whole ending is compared behind it
    tail = r.withColumn("_base", X.basename(F.col("_p"))).join(left.withColumn("_base", X.basename(F.col("want"))), "_base").where(F.col("_p").endswith(F.concat(F.lit("/"), F.col("want"))))
    return exact.unionByName(tail.select("query_id", *rows.columns))

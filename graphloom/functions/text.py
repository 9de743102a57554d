"""Column functions over labels, paths, locations and source text."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SEVERITY_SCORE, OTHER_SEVERITY

# What marks a test path.
TEST_DIRS = ("tests", "test", "spec", "specs", "__tests__")
TEST_FILE_ANY_CASE = r"(?i)^(test_.*|.*_test\..+|.*\.test\..+|.*\.spec\..+|.*_spec\..+|.*\.tests\.ps1)$"
TEST_FILE_EXACT_CASE = r"^(.*Test\.java|.*Tests\.java|.*Tests\.cs)$"
# Reads of environment variables, upper-case names only (A) and any case (B).
ENV_READS_A = (
    r"""(?:os\.environ(?:\.get)?\s*[\[\(]|os\.getenv\s*\()\s*['"]([A-Z][A-Z0-9_]+)['"]""",
    r"""process\.env\.([A-Z][A-Z0-9_]+)""",
    r"""process\.env\[\s*['"]([A-Z][A-Z0-9_]+)['"]\s*\]""",
    r"""ENV(?:\.fetch)?\s*[\[\(]\s*['"]([A-Z][A-Z0-9_]+)['"]""",
    r"""os\.(?:Getenv|LookupEnv)\s*\(\s*"([A-Z][A-Z0-9_]+)\"""",
    r"""System\.getenv\s*\(\s*"([A-Z][A-Z0-9_]+)"\s*\)""",
)
ENV_READS_B = (
    r"""(?:os\.)?environ(?:\.get)?\s*[\[(]\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]""",
    r"""os\.getenv\s*\(\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]""",
    r"""process\.env\.([A-Za-z_][A-Za-z0-9_]*)""",
    r"""process\.env\[\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]\s*\]""",
    r"""os\.(?:Getenv|LookupEnv)\s*\(\s*"([A-Za-z_][A-Za-z0-9_]*)""",
    r"""System\.getenv\s*\(\s*"([A-Za-z_][A-Za-z0-9_]*)""",
    r"""Environment\.GetEnvironmentVariable\s*\(\s*"([A-Za-z_][A-Za-z0-9_]*)""",
    r"""ENV(?:\.fetch)?\s*[\[(]\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]""",
    r"""getenv\s*\(\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]""",
    r"""\$_ENV\[\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]\s*\]""",
)
ENV_DEFINITION = r"^\s*(?:export\s+|ENV\s+|ARG\s+)?([A-Z][A-Z0-9_]+)\s*[=:]"
# References to SQL tables in code.
TABLE_REFS = (
    r"""(?i)\bFROM\s+["'`\[]?([A-Za-z_][A-Za-z0-9_]*)""",
    r"""(?i)\bJOIN\s+["'`\[]?([A-Za-z_][A-Za-z0-9_]*)""",
    r"""(?i)\bINSERT\s+INTO\s+["'`\[]?([A-Za-z_][A-Za-z0-9_]*)""",
    r"""(?i)\bUPDATE\s+["'`\[]?([A-Za-z_][A-Za-z0-9_]*)\s+SET\b""",
    r"""(?i)\bDELETE\s+FROM\s+["'`\[]?([A-Za-z_][A-Za-z0-9_]*)""",
    r"""__tablename__\s*=\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]""",
)
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def bare(label: Column) -> Column:
    """A label without one trailing ``()``."""
    return F.regexp_replace(label, r"\(\)$", "")


def leaf(label: Column) -> Column:
    """``bare`` without leading dots."""
    return F.regexp_replace(bare(label), r"^\.+", "")


def leaf_any_parens(label: Column) -> Column:
    """Trimmed, without leading dots and without any run of parentheses at the end."""
    return F.regexp_replace(F.regexp_replace(F.trim(label), r"^\.+", ""), r"[()]+$", "")


def location_line(location: Column) -> Column:
    """The number in a location that is exactly ``L<n>``, else null."""
    return F.when(location.rlike(r"^L[0-9]+$"), F.substring(location, 2, 12).cast("int"))


def loose_line(location: Column) -> Column:
    """The number after the first ``L``, wherever it stands, else null."""
    return F.when(location.rlike(r"L[0-9]+"), F.regexp_extract(location, r"L([0-9]+)", 1).cast("int"))


def file_and_line(text: Column) -> Column:
    """``struct<file, line>`` of ``path.ext:12`` or ``path.ext:L12``; null otherwise."""
    found = r"^([^:\n]+?\.[A-Za-z0-9_]+):L?([0-9]+)$"
    return F.when(text.rlike(found), F.struct(F.regexp_extract(text, found, 1).alias("file"), F.regexp_extract(text, found, 2).cast("int").alias("line")))


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(posix(path), "/", -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def is_test_path(path: Column) -> Column:
    """A directory or file name of the path is one that tests use; null and empty paths are not."""
    p = posix(path)
    dirs = F.exists(F.split(p, "/"), lambda s: F.lower(s).isin(*TEST_DIRS))
    name = basename(path)
    return F.coalesce((p != "") & (dirs | name.rlike(TEST_FILE_ANY_CASE) | name.rlike(TEST_FILE_EXACT_CASE)), F.lit(False))


def is_callable(flag: Column, label: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(label.endswith("()"), F.lit(False))


def is_file_node(file: Column, location: Column, label: Column, flag: Column) -> Column:
    """Stands for the file itself: at line 1, not callable, named as the file or the end of its path."""
    p = posix(file)
    named = (label == basename(file)) | p.endswith(F.concat(F.lit("/"), label)) | (label == p)
    return F.coalesce(file.isNotNull() & (file != "") & (location == "L1") & ~is_callable(flag, label) & named, F.lit(False))


def label_kind(label: Column) -> Column:
    """``function`` if the label ends in ``()``, ``file`` if it ends in a suffix, else null."""
    return F.when(label.endswith("()"), "function").when(label.rlike(r"[^/.]\.[A-Za-z0-9]+$"), "file")


def slot_name(branch: Column) -> Column:
    """A name fit for a partition value: other characters become ``-``; a hash tells changed names apart."""
    clean = F.regexp_replace(F.regexp_replace(branch, r"[^A-Za-z0-9._-]", "-"), r"^\.+|\.+$", "")
    return F.when(clean == branch, branch).otherwise(F.concat(clean, F.lit("-"), F.substring(F.sha1(branch), 1, 8)))


def severity_score(severity: Column) -> Column:
    out = F.lit(OTHER_SEVERITY)
    for name, score in SEVERITY_SCORE.items():
        out = F.when(F.upper(severity) == name, F.lit(score)).otherwise(out)
    return out


def all_matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """First groups of all matches of all patterns, pattern by pattern."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])


def lines(text: Column) -> Column:
    """``array<struct<line, text>>``, counted from 1; a final line break opens no further line."""
    parts = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    return F.transform(parts, lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("text")))


def _between(parts: Column, start: Column, end: Column) -> Column:
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(parts, first, F.greatest(end - first + 1, F.lit(0))), "\n")


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, both counted from 1 and both included."""
    return _between(F.split(text, r"\r?\n"), start, end)


def line_slices(text: Column, ranges: Column) -> Column:
    """``array<struct<start, end, text>>``: ``line_slice`` of each of ``ranges`` (start, end); the text is split once, however many they are."""
    # as the one element of an array the parts are a variable, which is not computed again for each range
    each = lambda parts: F.transform(ranges, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), _between(parts, r["start"], r["end"]).alias("text")))
    return F.flatten(F.transform(F.array(F.split(text, r"\r?\n")), each))


def token_count(text: Column) -> Column:
    """Four characters a token, one at least; the method is always this one and is reported as ``chars/4``."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def clean_key(key: Column) -> Column:
    """A key without its quotes; null if empty, computed, starting with a digit, or holding space or brackets that a name cannot."""
    k = F.regexp_replace(F.trim(key), r"""^['"`]|['"`]$""", "")
    return F.when((k != "") & ~k.rlike(r"^[\[0-9]|[\t\n(){}]"), k)


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFC and full case folding, which differ from ``lower`` (ß folds to ss)."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())


def with_folded(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with each column folded. Only rows that hold letters beyond ASCII go through Python; for all others folding is ``lower``."""
    df = df.select("*", *[c.alias(name) for name, c in columns.items()])
    plain = F.lit(True)
    for name in columns:
        plain = plain & F.coalesce(~F.col(name).rlike(r"[^\x00-\x7F]"), F.lit(True))
    put = lambda rows, f: rows.withColumns({name: f(F.col(name)) for name in columns})
    return put(df.where(plain), F.lower).unionByName(put(df.where(~plain), folded))


def slug_text(text: str) -> str:
    """Case folding and NFKC until nothing changes, then word characters joined by single ``_``."""
    for _ in range(6):
        text, before = unicodedata.normalize("NFKC", text.casefold()), text
        if text == before:
            break
    return re.sub(r"_+", "_", re.sub(r"\W+", "_", text)).strip("_")


@F.pandas_udf(T.StringType())
def slug(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else slug_text(x))


@F.pandas_udf(T.LongType())
def json_cost(text: pd.Series) -> pd.Series:
    """Tokens of a value given as JSON text, as a quarter of its length with the usual separators."""
    return text.map(lambda x: len(json.dumps(json.loads(x))) // 4 if x is not None else None).astype("Int64")


@F.pandas_udf(T.DoubleType())
def rounded(value: pd.Series, digits: pd.Series) -> pd.Series:
    """Half to even on the exact binary value, as Python rounds."""
    return pd.Series([None if v is None or v != v else round(v, int(d)) for v, d in zip(value, digits)], dtype="float64")

"""URL rules in a sorted digest array.

The rules' 64-bit xxhash keys are sorted in one file, which every executor
fetches through Spark's file server and memory-maps. A url is judged by probing
the digest of each (parent domain, path prefix) it could match with a vectorised
binary search; the full rule string beside a key that matches is compared, so a
collision of digests never decides. The longest matching rule wins.

Defined results: a null url or one without ``://`` has empty host and path, no
rule and the default verdict; an empty page table gives an empty result; with
no rules all pages get the default; repeated pages are judged alike; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches

_UPPER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path from there up to ``? #``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "#?":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


class DigestArray:
    """Keys ascending in a memory map; offsets, strings and verdicts in the same order beside them."""

    def __init__(self, path: str) -> None:
        n, k = (int(x) for x in np.fromfile(path, dtype=np.int64, count=2))
        self.at = 16
        self.keys, self.offsets = self._next(path, np.uint64, n), self._next(path, np.int64, n + 1)
        self.lengths, self.block = self._next(path, np.int64, k), self._next(path, np.bool_, n)
        self.bytes = self._next(path, np.uint8, int(self.offsets[-1]))

    def _next(self, path: str, dtype, count: int) -> np.ndarray:
        start, self.at = self.at, self.at + np.dtype(dtype).itemsize * count
        return np.memmap(path, dtype=dtype, mode="r", offset=start, shape=(count,)) if count else np.array([], dtype=dtype)

    @staticmethod
    def write(rules: Iterable[tuple[str, bool]], path: str) -> None:
        """``rules``: (host/path, block?); a rule given twice with both verdicts blocks."""
        merged: dict[str, bool] = {}
        for rule, block in rules:
            merged[rule] = merged.get(rule, False) or block
        rows = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), b) for r, b in merged.items())
        # The distinct path lengths of the rules are all that a url's path has to be cut to.
        lengths = np.unique(np.array([len(r) - r.index(b"/") for _, r, _ in rows], dtype=np.int64))
        parts = [
            np.array([len(rows), len(lengths)], dtype=np.int64), np.array([k for k, _, _ in rows], dtype=np.uint64), np.cumsum([0, *(len(r) for _, r, _ in rows)]).astype(np.int64),
            lengths, np.array([b for _, _, b in rows], dtype=np.bool_), np.frombuffer(b"".join(r for _, r, _ in rows), dtype=np.uint8),
        ]
        with open(path, "wb") as f:
            for x in parts:
                f.write(x.tobytes())

    def text(self, k: int) -> bytes:
        return self.bytes[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Position of each probe among the rules, -1 where it is none."""
        out = np.full(len(probes), -1, dtype=np.int64)
        if not probes or not len(self.keys):
            return out
        keys = np.array([xxhash.xxh64_intdigest(p) for p in probes], dtype=np.uint64)
        at = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        for i in hit:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:  # equal digests stand side by side
                if self.text(k) == probes[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def judge(self, urls: list[str | None]) -> tuple[list, list, list, list]:
        hosts, paths, probes, owner = [], [], [], []
        lengths = [int(x) for x in self.lengths]
        for n, url in enumerate(urls):
            host, path = host_and_path(url)
            hosts.append(host)
            paths.append(path)
            raw, at = path.encode(errors="surrogatepass"), 0
            cuts = [raw[:x] for x in lengths if x <= len(raw)]
            while host and cuts:
                tail = host[at:].encode(errors="surrogatepass")
                probes += [tail + c for c in cuts]
                owner += [n] * len(cuts)
                if (at := host.find(".", at) + 1) == 0:
                    break
        rules: list[bytes | None] = [None] * len(urls)
        block: list[bool | None] = [None] * len(urls)
        found = self.find(probes)
        for i in np.flatnonzero(found >= 0):
            n = owner[i]
            if rules[n] is None or len(probes[i]) > len(rules[n]):
                rules[n], block[n] = probes[i], bool(self.block[found[i]])
        return hosts, paths, [r and r.decode() for r in rules], block


_OPEN: dict[str, DigestArray] = {}


_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession, rules: Iterable[tuple[str, bool]]) -> str:
    """Write the array into a folder of this process alone and hand it to Spark's file server; the file's name depends on its content."""
    rules = sorted(set(rules))
    name = f"url-rules-{hashlib.sha256(repr(rules).encode()).hexdigest()[:24]}.bin"
    if name not in _SHIPPED:
        path = str(Path(tempfile.mkdtemp(prefix="url-rules-"), name).resolve())
        DigestArray.write(rules, path)
        _SHIPPED[name] = path
    spark.sparkContext.addFile(_SHIPPED[name])
    return name


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, bool]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for each page. Only the two columns are read; no shuffle.

    A rule is ``host/path`` and fits its host and all subdomains where the
    url's path starts with its path. The array listing no rule for a url means
    ``default``.
    """
    name = ship(pages.sparkSession, rules)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _OPEN:
            _OPEN.clear()
            _OPEN[name] = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths, found, block = _OPEN[name].judge(batch.column(1).to_pylist())
            verdicts = [default if b is None else "block" if b else "allow" for b in block]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts))], [id_col, "host", "path", "rule", "verdict"])

    return map_batches(pages.select(F.col(id_col), F.col(url_col)), run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")

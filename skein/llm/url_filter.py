"""Judge URLs by host and path rules held in sorted digest arrays.

A rule is a host and a path prefix; its key is the 64-bit xxhash of ``host + path``. The keys of a slice of rules stand
in one sorted array, which tasks memory-map and probe by binary search; a hit counts only if the stored string is equal.
Rule lists of any size are cut into slices of ``SLICE_RULES``; every slice is shipped once and probed by one pass over
the URLs, which carries the best rule so far.

Defined results: a null URL or one without ``://`` has empty host and path, so no rule fits it; a rule with a null host
or path is no rule; if a rule occurs with several verdicts, ``block`` holds; of fitting rules the longest wins, and of
equally long ones the one with the longer host; a URL without a rule gets the default verdict. Repeated rows are judged
alike, empty tables give empty results, and other columns of the input are kept.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import small_batches
from skein.session import cut_lineage

SLICE_RULES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def keys_of(strings: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(s) for s in strings), np.uint64, len(strings))


class DigestArray:
    """A file of sorted keys, verdicts and strings, opened by memory mapping."""

    @staticmethod
    def write(path: str, rules: list[tuple[str, str, bool]]) -> None:
        """``rules``: host, path, blocked."""
        strings = [h + p for h, p, _ in rules]
        keys = keys_of(strings)
        order = np.argsort(keys, kind="stable")
        blobs = [strings[i].encode() for i in order]
        ends = np.cumsum([len(b) for b in blobs], dtype=np.int64)
        hosts = np.array([len(rules[i][0].encode()) for i in order], np.int32)
        head = json.dumps({"n": len(rules), "lengths": sorted({len(p) for _, p, _ in rules})}).encode()
        with open(path, "wb") as f:
            for part in (np.int64(len(head)).tobytes(), head, keys[order].tobytes(), ends.tobytes(), hosts.tobytes(),
                         np.array([rules[i][2] for i in order], np.uint8).tobytes(), *blobs):
                f.write(part)

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        size = int(np.frombuffer(self.map, np.int64, 1)[0])
        head = json.loads(self.map[8:8 + size])
        n, at = head["n"], 8 + size
        self.lengths = head["lengths"]
        self.keys = np.frombuffer(self.map, np.uint64, n, at)
        self.ends = np.frombuffer(self.map, np.int64, n, at + 8 * n)
        self.hosts = np.frombuffer(self.map, np.int32, n, at + 16 * n)
        self.blocked = np.frombuffer(self.map, np.uint8, n, at + 20 * n)
        self.text = at + 21 * n

    def string(self, i: int) -> bytes:
        return self.map[self.text + (int(self.ends[i - 1]) if i else 0):self.text + int(self.ends[i])]

    def find(self, strings: list[str], hosts: np.ndarray) -> np.ndarray:
        """Index of the rule with this string and this length of host in bytes, or -1."""
        keys = keys_of(strings)
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(strings), -1, np.int64)
        for k in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)):
            i, wanted = int(at[k]), strings[k].encode()
            while i < len(self.keys) and self.keys[i] == keys[k]:  # equal keys stand together
                if self.hosts[i] == hosts[k] and self.string(i) == wanted:
                    out[k] = i
                    break
                i += 1
        return out


def _suffixes(host: str) -> list[str]:
    return [host, *(host[i + 1:] for i, c in enumerate(host) if c == ".")]


def _probe(name: str):
    def judge(batches):
        index = DigestArray(SparkFiles.get(name))
        for pdf in batches:
            strings, hosts, owner, rank = [], [], [], []
            for row, (host, path) in enumerate(zip(pdf["host"], pdf["path"])):
                for suffix in _suffixes(host) if host else ():
                    size = len(suffix.encode())
                    for n in index.lengths:
                        if n <= len(path):
                            strings.append(suffix + path[:n])
                            hosts.append(size)
                            owner.append(row)
                            rank.append((len(suffix) + n) * 4096 + min(len(suffix), 4095))
            found = index.find(strings, np.array(hosts, np.int64))
            best, rule, blocked = pdf["_best"].to_numpy(copy=True), pdf["rule"].to_numpy(object, copy=True), pdf["_blocked"].to_numpy(copy=True)
            for k in np.flatnonzero(found >= 0):
                if rank[k] > best[owner[k]]:
                    best[owner[k]], rule[owner[k]] = rank[k], strings[k]
                    blocked[owner[k]] = bool(index.blocked[found[k]])
            yield pdf.assign(_best=best, rule=pd.Series(rule, index=pdf.index, dtype=object), _blocked=blocked)
    return judge


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule and verdict. ``rules``: host, path, verdict (``allow`` or ``block``).

    Columns of ``urls`` with these names are replaced.
    """
    spark = urls.sparkSession
    small_batches(spark)
    clean = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
             .groupBy("host", "path").agg(F.max((F.col("verdict") == "block")).alias("blocked")))
    slices = max(1, -(-clean.count() // SLICE_RULES))
    cut = cut_lineage(clean.withColumn("_slice", F.pmod(F.xxhash64("host", "path"), F.lit(slices)))) if slices > 1 else clean
    taken = {"host", "path", "rule", "verdict", "_best", "_blocked", "_url"}
    others = [c for c in urls.columns if c not in taken]
    out = urls.select(*others, F.col(url).alias("_url"))
    host, path = split_url(F.col("_url"))
    out = out.select(*others, host.alias("host"), path.alias("path"), F.lit(-1).cast("bigint").alias("_best"),
                     F.lit(None).cast("string").alias("rule"), F.lit(False).alias("_blocked"))
    for k in range(slices):
        part = cut.where(F.col("_slice") == k) if slices > 1 else cut
        held = [(r["host"], r["path"], bool(r["blocked"])) for r in part.select("host", "path", "blocked").toLocalIterator()]
        name = f"rules-{uuid.uuid4().hex}.bin"
        folder = os.path.join(SparkFiles.getRootDirectory(), "slices")  # served from here as long as the session lives
        os.makedirs(folder, exist_ok=True)
        DigestArray.write(os.path.join(folder, name), held)
        spark.sparkContext.addFile(os.path.join(folder, name))
        out = out.mapInPandas(_probe(name), out.schema)
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).otherwise(F.when(F.col("_blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("verdict", verdict).drop("_best", "_blocked")

"""URL rules in a sorted digest array.

Rule hosts and whole rules (host + path) are hashed to 64 bits with xxhash and
kept in one sorted array each, in a file that executors map into memory. A
batch of URLs is probed by vectorised binary search; every digest that is found
is confirmed against the stored full string, so collisions never decide.

A rule (host, path, verdict) fits its host and all subdomains, if the URL's
path starts with the rule's path; the longest rule (host and path) wins. URLs
that no rule fits get the default verdict.

Defined results: a null url, or one without ``://``, has empty host and path
and gets the default verdict; repeated rows each give a row; an empty table
gives an empty result; an empty rule table gives the default everywhere; a rule
with a null part is ignored, and of equal rules ``block`` wins. Only named
columns are read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import lean, send, stage

#: Rules whose strings take more than this are dealt out by digest range
#: instead of being sent to every executor.
BROADCAST_BYTES = 64 << 20
OUT = "key {key}, url string, host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host's A-Z lower-cased, the path up to ? or #."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def digests(items: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in items), dtype=np.uint64, count=len(items))


class DigestArray:
    """Sorted 64-bit keys with their full strings, in a memory-mapped file that
    is unlinked at once (it goes with the process)."""

    def __init__(self, items: list[bytes], keys: np.ndarray | None = None):
        keys = digests(items) if keys is None else keys
        order = np.argsort(keys, kind="stable")
        self.values = order
        size = np.array([len(items[i]) for i in order], dtype=np.int64)
        self.off = np.concatenate([[0], np.cumsum(size)])
        with tempfile.TemporaryFile() as f:
            f.write(keys[order].tobytes())
            f.write(b"".join(items[i] for i in order) + b"\0")
            f.flush()
            self.file = np.memmap(os.fdopen(os.dup(f.fileno()), "rb"), dtype=np.uint8, mode="r")
        self.keys = self.file[:8 * len(keys)].view(np.uint64)
        self.text = self.file[8 * len(keys):]

    def find(self, items: list[bytes], keys: np.ndarray | None = None) -> np.ndarray:
        """Number of the equal stored item for each probe, else -1."""
        out = np.full(len(items), -1, dtype=np.int64)
        if not len(self.keys) or not items:
            return out
        keys = digests(items) if keys is None else keys
        at = np.searchsorted(self.keys, keys)
        todo = np.arange(len(items))
        while len(todo):  # one round, and one more for each collision
            todo = todo[at[todo] < len(self.keys)]
            todo = todo[self.keys[at[todo]] == keys[todo]]
            same = np.array([bytes(self.text[self.off[at[i]]:self.off[at[i] + 1]]) == items[i] for i in todo], dtype=bool)
            out[todo[same]] = self.values[at[todo[same]]]
            todo = todo[~same]
            at[todo] += 1
        return out


class RuleSet:
    """Two digest arrays: rule hosts, each with the path lengths that its
    rules have, and whole rules."""

    def __init__(self, rules: list[tuple[str, str, str]], default: str = "allow"):
        best: dict[tuple[str, str], str] = {}
        for host, path, verdict in rules:
            host = host.translate(_LOWER)
            best[host, path] = "block" if "block" in (verdict, best.get((host, path))) else verdict
        self.rules = [(h, p, v) for (h, p), v in sorted(best.items())]
        self.default = default
        lengths: dict[str, set] = {}
        for h, p, _ in self.rules:
            lengths.setdefault(h, set()).add(len(p))
        self.hosts = sorted(lengths)
        self.lengths = [sorted(lengths[h], reverse=True) for h in self.hosts]
        self.longest = max(map(len, self.hosts), default=0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("host_array", "rule_array")}

    def load(self) -> RuleSet:
        if "host_array" not in self.__dict__:
            self.host_array = DigestArray([h.encode() for h in self.hosts])
            self.rule_array = DigestArray([f"{h}\0{p}".encode() for h, p, _ in self.rules])
        return self

    def judge(self, hosts: list[str], paths: list[str]) -> list[int]:
        """Number of the longest fitting rule of each URL, else -1; of equally
        long ones that with the longer host."""
        self.load()
        of, names = [], []
        for i, h in enumerate(hosts):
            if h:
                for s in suffixes(h, self.longest):
                    of.append(i)
                    names.append(s)
        known = {x: k for k, x in enumerate(dict.fromkeys(names))}
        found = self.host_array.find([x.encode("utf-8", errors="replace") for x in known])[np.array([known[x] for x in names], dtype=int)]
        owner, probe, size = [], [], []
        for k in np.flatnonzero(found >= 0):
            i = of[k]
            for n in self.lengths[found[k]]:
                if n <= len(paths[i]):
                    owner.append(i)
                    probe.append(f"{names[k]}\0{paths[i][:n]}".encode("utf-8", errors="replace"))
                    size.append(len(names[k]) + n)
        hit = self.rule_array.find(probe)
        best, length = [-1] * len(hosts), [-1] * len(hosts)
        for i, r, n in zip(owner, hit.tolist(), size, strict=True):
            if r >= 0 and n > length[i]:
                best[i], length[i] = r, n
        return best


def suffixes(host: str, longest: int) -> Iterator[str]:
    """The host and its parents (a.b.com, b.com, com), longest first, as far
    as they have at most ``longest`` characters: no rule fits a longer one."""
    if len(host) <= longest:
        yield host
    at = host.find(".", max(len(host) - longest - 1, 0))
    while at >= 0:
        if at + 1 < len(host):
            yield host[at + 1:]
        at = host.find(".", at + 1)


def _filter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value.load()
        for b in lean(batches):
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            hosts, paths = [p[0] for p in parts], [p[1] for p in parts]
            hit = rules.judge(hosts, paths)
            name = [None if r < 0 else "".join(rules.rules[r][:2]) for r in hit]
            verdict = [rules.default if r < 0 else rules.rules[r][2] for r in hit]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.string()) for x in (hosts, paths, name, verdict))],
                                             names=["key", "url", "host", "path", "rule", "verdict"])
    return run


def url_verdicts(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Verdict of every URL under ``rules`` (host, path, verdict). A rule table
    up to ``broadcast_bytes`` goes to every executor; a larger one is joined
    by digest, with the same outcome."""
    spark = urls.sparkSession
    rules = rules.select(*(F.col(c).cast("string") for c in ("host", "path", "verdict"))).dropna()
    src = urls.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"))
    kind = src.schema["key"].dataType.simpleString()
    size = rules.agg(F.sum(F.length("host") + F.length("path") + 64)).first()[0] or 0
    if size > broadcast_bytes:
        return _by_range(src, rules, default, kind).withColumnRenamed("key", id_col)
    shared = send(spark, RuleSet([tuple(r) for r in rules.collect()], default))
    out = src.mapInArrow(_filter(shared), OUT.format(key=kind))
    return out.withColumnRenamed("key", id_col)


def _probes(lengths: list[int], longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            rows = []
            for k, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host, path = split_url(u)
                for s in suffixes(host, longest) if host else ():
                    rows += [(k, f"{s}\0{path[:n]}", len(s) + n) for n in lengths if n <= len(path)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32()))], names=["row", "probe", "size"])
    return run


def _by_range(src, rules, default, kind):
    """Rules too many for one executor: their digest array is spread over the
    cluster by ranges of the 64-bit key, and distinct probes go to the range
    that would hold them; equal strings confirm the match."""
    src = stage(src.withColumn("row", F.monotonically_increasing_id()), "urls")
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    table = (rules.withColumn("host", lower).groupBy("host", "path").agg(F.min_by("verdict", F.col("verdict") != "block").alias("verdict"))
             .withColumn("probe", F.concat("host", F.lit("\0"), "path")).withColumn("digest", F.xxhash64("probe")))
    lengths = sorted(r[0] for r in table.select(F.length("path")).distinct().collect())
    longest = table.agg(F.max(F.length("host"))).first()[0] or 0
    probes = src.select("row", "url").mapInArrow(_probes(lengths, longest), "row long, probe string, size int")
    known = probes.select("probe").distinct().withColumn("digest", F.xxhash64("probe")).join(table, ["digest", "probe"])
    best = (probes.join(known, "probe").groupBy("row").agg(F.max_by(F.struct("host", "path", "verdict"), F.struct("size", F.length("host"))).alias("hit")))
    found = src.join(best, "row", "left").select(
        "key", "url", F.concat("hit.host", "hit.path").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))

    def hosts(batches):
        for b in lean(batches):
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()),
                                              b.column(2), b.column(3)], names=["key", "url", "host", "path", "rule", "verdict"])
    return found.mapInArrow(hosts, OUT.format(key=kind))


#: Rules of the contract query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op2_url_filter(spark, sf_dir):
    """Contract query: host, path, rule and verdict of every page's url."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_OP2 = """
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
c AS (SELECT page_id, regexp_extract(coalesce(r, ''), '^[^?#]*') AS r FROM p),
s AS (SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '/.*$', 0, 's') AS path FROM c),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                          ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT s.page_id, s.host, s.path, h || p AS rule, v, row_number() OVER (PARTITION BY s.page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
      FROM s LEFT JOIN rules ON (s.host = h OR s.host LIKE '%.' || h) AND starts_with(s.path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1
"""

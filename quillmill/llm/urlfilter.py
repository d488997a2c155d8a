"""URL verdicts from ordered host/path rules and a sorted digest array of blocked names.

The digest array is one file: sorted 64-bit xxhash keys, offsets and the full strings. Each Python worker
memory-maps it, probes whole batches by vectorised binary search, and compares the stored string of each hit, so
that two strings with one key are told apart. A list too long to be shipped whole is cut to shards by its keys; each
shard is such a file for the time of one task, and the distinct names that urls ask for are probed in theirs.
"""

import atexit
import hashlib
import mmap
import os
import tempfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F

#: Rules of the contract, as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: What unwanted sites are called, by trade: any word of the first row, a hyphen, any of the second; and the domains they are registered under.
TRADES = (
    ("bet bets casino free lottery lotto lucky poker roulette slots", "bets bonus jackpot now online royal spins vip win"),
    ("cheap discount online rx", "meds pharmacy pills viagra"),
    ("adult cam nude porn sex xxx", "cams chat girls tube videos x"),
    ("ads click link popup spam", "bait exchange farm network server track"),
    ("crack keygen nulled torrent warez", "downloads files hub serials zone"),
    ("fake replica", "bags ids watches"),
    ("free instant payday", "cash gifts iphones loans"),
)
DOMAINS = ("example.com", "example.net", "example.org")
#: A digest file up to this size is shipped to every executor; a longer list goes in shards of about this size.
MAX_SHIPPED_BYTES = 256 << 20
#: Names that are probed in one shard, about.
PROBED = 5_000_000


def default_blocklist() -> list[str]:
    """Names by the trades above: an example list; pass one of your own for real use."""
    return [f"{a}-{b}.{domain}" for first, second in TRADES for a in first.split() for b in second.split() for domain in DOMAINS]


class DigestArray:
    """Layout, little endian: n, n sorted uint64 keys, n + 1 uint64 offsets, the strings in UTF-8."""

    def __init__(self, buffer) -> None:
        self.n = n = int(np.frombuffer(buffer, "<u8", 1)[0])
        self.keys = np.frombuffer(buffer, "<u8", n, 8)
        self.offsets = np.frombuffer(buffer, "<u8", n + 1, 8 + 8 * n)
        self.start, self.buffer = 16 + 16 * n, buffer

    @staticmethod
    def pack(strings: Iterable[str], key=xxhash.xxh64_intdigest) -> bytes:
        names = sorted({s.encode() if isinstance(s, str) else s for s in strings})
        keys = np.fromiter(map(key, names), "<u8", len(names))
        by = np.argsort(keys, kind="stable")
        sizes = np.fromiter(map(len, names), "<u8", len(names))[by]
        offsets = np.concatenate([np.zeros(1, "<u8"), np.cumsum(sizes, dtype="<u8")])
        return b"".join((np.array([len(names)], "<u8").tobytes(), keys[by].tobytes(), offsets.tobytes(), *(names[i] for i in by)))

    @classmethod
    def mapped(cls, packed: bytes) -> "DigestArray":
        """The same from a nameless file of this task, which goes with it."""
        with tempfile.TemporaryFile() as f:
            f.write(packed)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @classmethod
    def open(cls, path: str) -> "DigestArray":
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def string(self, i: int) -> bytes:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return bytes(self.buffer[self.start + a : self.start + b])

    def contains(self, strings: Sequence[bytes], key=xxhash.xxh64_intdigest) -> np.ndarray:
        found = np.zeros(len(strings), bool)
        if not self.n or not strings:
            return found
        wanted = np.fromiter((key(s) for s in strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, wanted)
        for j in np.flatnonzero((at < self.n) & (self.keys[np.minimum(at, self.n - 1)] == wanted)):
            i = int(at[j])
            while i < self.n and self.keys[i] == wanted[j] and not found[j]:
                found[j] = self.string(i) == strings[j]
                i += 1
        return found


def names_to_probe(host: str, path: str) -> list[bytes]:
    """The host, each parent domain, and the host with its path."""
    if not host:
        return []
    labels = host.split(".")
    return [".".join(labels[i:]).encode() for i in range(len(labels))] + [(host + path).encode()] * bool(path)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    from quillmill.llm.common import lower_ascii

    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    values = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in ordered]
    return F.coalesce(*(F.when(f, v) for f, v in zip(fits, values, strict=True)))


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, blocklist: Sequence[str] | DataFrame | None = None, max_bytes: int = MAX_SHIPPED_BYTES) -> DataFrame:
    """df with host, path, rule and verdict in place of columns of those names.

    blocklist: names, or a table of any size with a column name; null names block nothing. A list whose digest file stays
    within max_bytes is shipped to the workers and memory-mapped; a longer one is probed shard by shard, with equal results.
    Null urls and urls without :// have empty host and path, no rule, and are allowed. Empty tables stay empty;
    repeated rows are judged alike, each in its own row; long urls are judged whole; other columns pass through.
    """
    spark = df.sparkSession
    out = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    out = out.withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    if not isinstance(blocklist, DataFrame):
        names = default_blocklist() if blocklist is None else list(blocklist)
        if sum(len(x) * 4 + 16 for x in names) > max_bytes:
            blocklist = spark.createDataFrame([(x,) for x in names], "name string")
    if isinstance(blocklist, DataFrame):
        blocklist = blocklist.select("name").where("name IS NOT NULL").distinct()
        n_bytes = blocklist.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0
        if n_bytes > max_bytes:
            return _with_verdict(_sharded(out, blocklist, -(-n_bytes // max(1, max_bytes))))
        names = [r.name for r in blocklist.toLocalIterator()]  # max_bytes at most
    return _with_verdict(out.withColumn("__blocked", _probe(spark, DigestArray.pack(names))(F.col("host"), F.col("path"))))


def _with_verdict(out: DataFrame) -> DataFrame:
    own = F.when(F.col("__blocked"), "block").otherwise("allow")
    return out.withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce(F.col("__rule.verdict"), own)}).drop("__rule", "__blocked")


def _probe(spark, packed: bytes):
    name = f"digests-{hashlib.sha1(packed).hexdigest()[:16]}.bin"
    if not any(x.endswith("/" + name) for x in spark.sparkContext.listFiles):
        folder = tempfile.TemporaryDirectory()
        atexit.register(folder.cleanup)
        staged = os.path.join(folder.name, name)
        with open(staged, "wb") as f:
            f.write(packed)
        spark.sparkContext.addFile(staged)  # the driver serves it to executors as long as it lives; each maps its own read-only copy

    @F.pandas_udf("boolean")
    def blocked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        digests = DigestArray.open(SparkFiles.get(name))
        for hosts, paths in batches:
            names = [names_to_probe(h, p) for h, p in zip(hosts, paths, strict=True)]
            hit = digests.contains([x for xs in names for x in xs])
            ends = np.cumsum([0, *map(len, names)])
            total = np.concatenate([[0], np.cumsum(hit)])
            yield pd.Series(total[ends[1:]] > total[ends[:-1]])

    return blocked


def _probe_shard(asked: pa.Table, listed: pa.Table) -> pa.Table:
    names = [x.as_buffer().to_pybytes() for x in asked.column("name")]
    digests = DigestArray.mapped(DigestArray.pack(x.as_buffer().to_pybytes() for x in listed.column("name")))
    return pa.table({"name": asked.column("name").filter(pa.array(digests.contains(names)))})


def _sharded(out: DataFrame, blocklist: DataFrame, shards: int) -> DataFrame:
    """out with __blocked. Only distinct names meet the shards, so no host weighs more than another there."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = F.when(F.col("host") != "", F.array_distinct(F.concat(suffixes, F.array(F.concat("host", "path")))))
    urls = out.select("host", "path").distinct().withColumn("name", F.explode(names))
    asked = urls.select("name").distinct()
    shards = max(shards, -(-asked.count() // PROBED))
    shard = F.pmod(F.xxhash64("name"), F.lit(shards)).alias("shard")
    sides = [x.select("name", shard).groupBy("shard") for x in (asked, blocklist)]
    hits = urls.join(sides[0].cogroup(sides[1]).applyInArrow(_probe_shard, "name string"), "name").select(F.col("host").alias("__h"), F.col("path").alias("__p")).distinct()
    found = out.join(hits.withColumn("__blocked", F.lit(True)), (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left")
    return found.withColumn("__blocked", F.coalesce("__blocked", F.lit(False))).drop("__h", "__p")


def query(spark, sf_dir: str) -> DataFrame:
    from quillmill.llm.common import read

    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


UNWANTED = "|".join(f"({'|'.join(a.split())})-({'|'.join(b.split())})" for a, b in TRADES)
ORACLE = f"""
WITH cut AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS raw,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
named AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM named)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '^(.*\\.)?({UNWANTED})\\.example\\.(com|net|org)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

"""URL rules in sorted digest arrays: memory-mapped 64-bit keys, binary search, confirmed strings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from llm.shared import shared_folder

SEED = 42
#: Rules of one array, which the driver writes at once; more rules make more arrays.
BLOCK_RULES = 500_000
#: Candidate keys that are searched at once.
PROBES = 200_000


def _rules(rules: DataFrame) -> DataFrame:
    """key, host_chars, path_chars, blocked: each rule once; a rule that both allows and blocks blocks."""
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce("path", F.lit(""))
    fits = (F.col("host") != "") & ~F.col("host").rlike("[/?#]") & F.col("verdict").isin("allow", "block") & ((path == "") | path.startswith("/"))
    return rules.where(fits).groupBy(host.alias("host"), path.alias("path")).agg(
        F.max(F.col("verdict") == "block").alias("blocked")).select(
        F.concat("host", "path").alias("key"), F.char_length("host").alias("host_chars"),
        F.octet_length("host").alias("host_bytes"), F.char_length("path").alias("path_chars"), "blocked")


def _image(rows: list) -> bytes:
    """The file of one array: a count, then digests, string ends, lengths, verdicts, and the strings."""
    texts = [r["key"].encode() for r in rows]
    digests = np.array([xxh64_intdigest(t, SEED) for t in texts], "<u8")
    order = np.argsort(digests, kind="stable")
    texts = [texts[i] for i in order]
    ends = np.cumsum([len(t) for t in texts]).astype("<i8")
    flags = np.array([(r["host_chars"] << 32) + (r["path_chars"] << 1) + r["blocked"] for r in rows], "<i8")[order]
    return b"".join([np.array([len(rows)], "<i8").tobytes(), digests[order].tobytes(), ends.tobytes(), flags.tobytes(), *texts])


def _write(spark: SparkSession, data: bytes) -> str:
    """Write one array to the shared folder and hand it to Spark, which copies it to every executor; its name there."""
    name = f"url-rules-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(path)
    try:
        for at in range(0, len(data), 8 << 20):
            out.write(bytearray(data[at:at + (8 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(system.makeQualified(path).toString())
    return name


class DigestArray:
    """One memory-mapped array: sorted digests that lead to the strings they stand for."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n = int(data[:8].view("<i8")[0])
        self.digests = data[8:8 + 8 * n].view("<u8")
        self.ends = data[8 + 8 * n:8 + 16 * n].view("<i8")
        self.flags = data[8 + 16 * n:8 + 24 * n].view("<i8")
        self.strings = data[8 + 24 * n:]

    def find(self, digests: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Probes that name a stored string, and the place of each; a digest met alone is not enough."""
        first = np.searchsorted(self.digests, digests)
        last = np.searchsorted(self.digests, digests, "right")
        at = np.flatnonzero(last > first)
        probes, places = [], []
        for i in at.tolist():
            for k in range(int(first[i]), int(last[i])):
                start = int(self.ends[k - 1]) if k else 0
                if self.strings[start:int(self.ends[k])].tobytes() == texts[i]:
                    probes.append(i)
                    places.append(k)
        return np.array(probes, np.int64), np.array(places, np.int64)


@cache
def _mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    _, mark, rest = (url or b"").partition(b"://")
    if not mark:
        return b"", b""
    cut = min((p for p in map(rest.find, (b"/", b"?", b"#")) if p >= 0), default=len(rest))
    path = rest[cut:]
    end = min((p for p in map(path.find, (b"?", b"#")) if p >= 0), default=len(path))
    return rest[:cut].lower(), path[:end]


def candidates(host: bytes, path: bytes, longest: int, lengths: list[int]) -> Iterator[bytes]:
    """Every rule that could fit: the host and its parents of at most ``longest`` bytes, each with the path's start of each length that rules have."""
    text = path.decode()
    starts = [text[:n].encode() for n in lengths if n <= len(text)]
    at = 0 if len(host) <= longest else host.find(b".", len(host) - longest - 1) + 1
    if not at and len(host) > longest:
        return
    while at < len(host):
        for start in starts:
            yield host[at:] + start
        at = host.find(b".", at) + 1 or len(host)


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", block_rules: int = BLOCK_RULES) -> DataFrame:
    """row (all columns of ``urls``), host, path, rule, verdict for every row of ``urls``.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule fits its host and all
    subdomains if the URL's path starts with its path; of those that fit, the one of most characters
    wins, then the one of the longer host. Without one, ``rule`` is null and the verdict is ``default``:
    what no array holds is not listed.

    Rules are dealt by hash into arrays of about ``block_rules``, which the driver writes one by one, so
    that it never holds more. Workers map the files, search all candidate keys of a batch at once and compare the
    strings found. Rows stay where they are: no shuffle.

    A null URL, or one without ``://``, has empty host and path and no rule. Rules without host or of
    another verdict are left out, as are hosts with ``/``, ``?`` or ``#`` and paths that do not begin with ``/``, which no URL has; a null
    path is empty; of equal rules the blocking one counts. Repeated rows stay, columns of any name are
    kept inside ``row``; an empty table gives no rows, no rules give the default.
    """
    spark = urls.sparkSession
    listed = _rules(rules)
    size, longest = listed.agg(F.count("*"), F.coalesce(F.max("host_bytes"), F.lit(0))).first()
    lengths = sorted(r[0] for r in listed.select("path_chars").distinct().collect())
    blocks = -(-size // block_rules)
    names = []
    for i in range(blocks):
        some = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i)
        if rows := some.collect():
            names.append(_write(spark, _image(rows)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [_mapped(n) for n in names]
        for batch in batches:
            parts = [split_url(u.as_buffer().to_pybytes() if u.is_valid else None) for u in batch.column("url_")]
            best = [(0, 0, None, None)] * len(parts)
            texts: list[bytes] = []
            owner: list[int] = []

            def search() -> None:
                digests = np.array([xxh64_intdigest(t, SEED) for t in texts], np.uint64)
                for array in arrays:
                    for probe, place in zip(*(x.tolist() for x in array.find(digests, texts))):
                        flag = int(array.flags[place])
                        host, path = flag >> 32, (flag & 0xFFFFFFFF) >> 1
                        new = (host + path, host, texts[probe].decode(), "block" if flag & 1 else "allow")
                        if new[:2] > best[owner[probe]][:2]:
                            best[owner[probe]] = new
                texts.clear()
                owner.clear()

            for i, (host, path) in enumerate(parts):
                for text in candidates(host, path, longest, lengths):
                    texts.append(text)
                    owner.append(i)
                if len(texts) >= PROBES:
                    search()
            if texts:
                search()
            found = [
                pa.array([p[0].decode() for p in parts], pa.string()), pa.array([p[1].decode() for p in parts], pa.string()),
                pa.array([b[2] for b in best], pa.string()), pa.array([b[3] or default for b in best], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *found], ["row", "host", "path", "rule", "verdict"])

    row = F.struct(*(F.col(f"`{c}`") for c in urls.columns))
    sent = urls.select(row.alias("row"), F.col(f"`{url}`").alias("url_"))
    schema = sent.select("row", *(F.lit("").alias(c) for c in ("host", "path")), *(F.lit(None).cast("string").alias(c) for c in ("rule", "verdict"))).schema
    return sent.mapInArrow(look, schema)


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``urls`` whose verdict is ``allow``, with all their columns."""
    return judge(urls, rules, url, default).where(F.col("verdict") == "allow").select("row.*")


def verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    found = judge(pages.select("page_id", "url"), rules)
    return found.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


#: host, path, verdict of the rules that the registered query applies.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def rule_table(spark: SparkSession, rules: list = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _values(rules: list) -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)


SQL = rf"""
WITH r(rh, rp, v) AS (VALUES {_values(RULES)}),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM c JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM c LEFT JOIN f USING (page_id)
"""

"""URL rules by a sorted array of 64-bit digests, memory-mapped in each worker.

A rule is a host and the beginning of a path. Its key, host and path joined, is digested;
digests are kept sorted beside the offsets of the full keys. A URL's candidates are its
host and every parent domain, each with the beginnings of its path that have the length
of some rule's path. All candidates of a batch are looked up together by binary search, and
a digest that is found counts only if the stored key equals the candidate.
"""

from __future__ import annotations

import atexit
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from billweave.llm.tables import texts, with_python_columns, without

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def split_url(url: bytes) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = url.partition(b"://")
    if not mark:
        return b"", b""
    rest = rest.partition(b"#")[0].partition(b"?")[0]
    host, slash, path = rest.partition(b"/")
    return host.lower(), slash + path


def pack_rules(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """Rules (host, path, verdict) as one binary: counts, the longest host and path lengths, sorted digests, offsets,
    verdict numbers, then the keys and the names of verdicts. Of two rules with the same key, the
    lesser verdict name stays, so ``allow`` goes before ``block``."""
    best: dict[bytes, str] = {}
    for host, path, verdict in rules:
        key = (host or "").lower().encode() + (path or "").encode()
        best[key] = min(verdict, best.get(key, verdict))
    lengths = sorted({len((path or "").encode()) for _, path, _ in rules})
    longest = max((len((host or "").encode()) for host, _, _ in rules), default=0)
    names = sorted(set(best.values()))
    keys = sorted(best, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    offsets = np.cumsum([0, *map(len, keys)])
    tail = "\n".join(names).encode()
    return b"".join([
        struct.pack("<4Q", len(keys), len(lengths), len(tail), longest), np.array(lengths, "<u8").tobytes(),
        np.array([xxhash.xxh64_intdigest(k) for k in keys], "<u8").tobytes(), offsets.astype("<u8").tobytes(),
        np.array([names.index(best[k]) for k in keys], "<u4").tobytes(), tail, b"".join(keys)])


class Rules:
    """The packed rules, mapped from a file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        count, lengths, tail, self.longest = struct.unpack("<4Q", data[:32].tobytes())
        at = 32

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            size = np.dtype(kind).itemsize * n
            found = data[at:at + size].view(kind) if at % np.dtype(kind).itemsize == 0 else np.frombuffer(
                data[at:at + size].tobytes(), kind)
            at += size
            return found

        self.lengths = part("<u8", lengths).tolist()
        self.digests, self.offsets = part("<u8", count), part("<u8", count + 1)
        self.verdicts = part("<u4", count)
        self.names = part("u1", tail).tobytes().decode().split("\n")
        self.keys = data[at:]

    def key(self, at: int) -> bytes:
        return self.keys[int(self.offsets[at]):int(self.offsets[at + 1])].tobytes()

    def candidates(self, host: bytes, path: bytes) -> list[bytes]:
        """Longest key first: the order in which rules win. Domains longer than the host of any rule can't fit one."""
        domains, at = [host] if len(host) <= self.longest else [], max(0, len(host) - self.longest - 1)
        while at := host.find(b".", at) + 1:
            domains.append(host[at:])
        starts = [path[:n] for n in self.lengths if n <= len(path)]
        return sorted((d + s for d in domains if d for s in starts), key=len, reverse=True)

    def match(self, urls: list[tuple[bytes, bytes]]) -> list[int]:
        """Place of each URL's winning rule, or -1."""
        wanted = [self.candidates(*url) for url in urls]
        flat = [c for own in wanted for c in own]
        if not flat or not len(self.digests):
            return [-1] * len(urls)
        digests = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat))
        first = np.searchsorted(self.digests, digests)
        hit = self.digests[np.minimum(first, len(self.digests) - 1)] == digests
        out, begin = [], 0
        for own in wanted:
            end, won = begin + len(own), -1
            for at in np.flatnonzero(hit[begin:end]).tolist():
                place = int(first[begin + at])
                while won < 0 and place < len(self.digests) and self.digests[place] == digests[begin + at]:
                    if self.key(place) == own[at]:
                        won = place
                    place += 1
                if won >= 0:
                    break
            out.append(won)
            begin = end
        return out


FIELDS = [StructField(n, StringType()) for n in ("host", "path", "rule", "verdict")]


def judge_urls(
    df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", file_bytes: int = 256 << 20,
) -> DataFrame:
    """Verdict of the longest rule that fits each URL.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the path of
    the URL begins with the rule's. Adds ``host``, ``path``, ``rule`` (host and path joined) and
    ``verdict``; without a fitting rule these are null and ``default``. A null URL or one
    without ``://`` has an empty host and path and fits no rule. Equal URLs get equal
    results, however often they occur; an empty table gives an empty one. Of two equal rules with
    different verdicts the lesser name holds. Input columns with the new names are replaced.

    The array goes to every machine as a file if its rules have up to ``file_bytes`` in all;
    longer lists are joined on the candidates' digests instead.
    """
    spark = df.sparkSession
    clean = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                         "verdict")
    size = clean.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    if size > file_bytes:
        return judged_by_join(df, clean, url, default)
    name = f"rules-{uuid.uuid4().hex}.bin"
    # the driver serves this file to executors while the application runs
    folder = tempfile.mkdtemp(prefix="rules-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as file:
        file.write(pack_rules([(r.host, r.path, r.verdict) for r in clean.toLocalIterator()]))
    spark.sparkContext.addFile(path)

    def start():
        held = Rules(SparkFiles.get(name))

        def columns(column: pa.Array) -> list[pa.Array]:
            urls = [split_url(u) for u in texts(column)]
            won = held.match(urls)
            made = [
                [h for h, _ in urls], [p for _, p in urls], [None if w < 0 else held.key(w) for w in won],
                [default.encode() if w < 0 else held.names[held.verdicts[w]].encode() for w in won]]
            return [pa.array(cells, pa.binary()).cast(pa.string()) for cells in made]

        return columns

    return with_python_columns(df, url, FIELDS, start)


def judged_by_join(df: DataFrame, rules: DataFrame, url: str, default: str) -> DataFrame:
    """The same for any number of rules: candidates of the distinct URLs meet the rules by digest."""
    rest = F.regexp_extract(F.coalesce(df[url], F.lit("")), r"(?s)^.*?://([^?#]*)", 1)
    parts = without(df, [f.name for f in FIELDS]).withColumn("__url", F.coalesce(df[url], F.lit("")))
    parts = parts.withColumn("host", F.translate(F.substring_index(rest, "/", 1), UPPER, LOWER))
    parts = parts.withColumn("path", rest.substr(F.length("host") + 1, F.length(rest)))
    keys = rules.select(F.concat(F.translate("host", UPPER, LOWER), "path").alias("key"),
                        F.length("path").alias("n"), "verdict")
    keys = keys.groupBy("key").agg(F.min("verdict").alias("verdict"))
    lengths, longest = rules.agg(F.collect_set(F.length("path")), F.coalesce(F.max(F.length("host")), F.lit(0))).first()
    # domains longer than the host of any rule can't fit one: of a longer host, what follows the first dot of its end
    end = F.regexp_replace(F.right("host", F.lit(longest + 1)), r"(?s)^[^.]*\.?", "")
    labels = F.split(F.when(F.length("host") <= longest, F.col("host")).otherwise(end), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")),
                         lambda n: F.substring("path", F.lit(1), n))
    found = (
        parts.select("__url", "host", "path").distinct().where("host <> ''")
        .select("__url", F.explode(F.flatten(F.transform(
            F.filter(domains, lambda d: d != ""), lambda d: F.transform(starts, lambda s: F.concat(d, s))))).alias("candidate"))
        .withColumn("digest", F.xxhash64("candidate"))
        .join(keys.withColumn("digest", F.xxhash64("key")), "digest").where("candidate = key")
        .groupBy("__url").agg(F.max_by("key", F.length("key")).alias("rule"),
                              F.max_by("verdict", F.length("key")).alias("verdict")))
    return parts.join(found, "__url", "left").drop("__url").withColumn(
        "verdict", F.coalesce("verdict", F.lit(default)))

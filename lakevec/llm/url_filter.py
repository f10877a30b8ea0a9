"""URL filters: a trie over reversed host labels and path segments, broadcast; the longest entry decides.

An entry (host, path, verdict) fits its host and all subdomains where the url's
path starts with the entry's. The trie goes from the last label of a host to the
first, then from one whole path segment to the next; what stands behind an
entry's last slash may end inside a segment and hangs at the node as a tail. A
url is walked down once, whatever the number of entries.

The trie is broadcast only while the entries stay below a checked size; larger
lists meet the urls in joins on (host suffix, path prefix), with equal results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.llm.common import lower_ascii, stored, work_folder

#: Most entries, and most bytes of their hosts and paths, that travel to the workers as a trie, and its greatest depth.
TRIE_ENTRIES, TRIE_BYTES, TRIE_DEPTH = 1_000_000, 64 << 20, 200
#: Parts into which the urls of one host suffix are dealt in the joins.
SALTS = 64
#: Verdict on urls that no entry fits.
DEFAULT = "allow"

#: The entries of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


@dataclass(slots=True)
class PathNode:
    """Where the entries below some whole path segments hang: the next segments, and tails that may end inside one."""

    segments: dict[str, PathNode] = field(default_factory=dict)
    tails: dict[str, tuple[str, str]] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)  # of the tails, longest first


@dataclass(slots=True)
class HostNode:
    labels: dict[str, HostNode] = field(default_factory=dict)
    paths: PathNode | None = None


class Trie:
    """Entries by reversed host labels, then path segments."""

    def __init__(self, entries: Iterable[tuple[str, str, str]]):
        self.root = HostNode()
        for host, path, verdict in entries:
            at = self.root
            for label in reversed(host.split(".")):
                at = at.labels.setdefault(label, HostNode())
            at.paths = node = at.paths or PathNode()
            *segments, tail = path.split("/")
            for s in segments:
                node = node.segments.setdefault(s, PathNode())
            if node.tails.get(tail, ("", ""))[1] != "block":
                node.tails[tail] = (host + path, verdict)
            if len(tail) not in node.lengths:
                node.lengths = sorted([*node.lengths, len(tail)], reverse=True)

    @staticmethod
    def _in_path(node: PathNode, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while True:
            best = next((node.tails[t] for n in node.lengths if len(t := path[at : at + n]) == n and t in node.tails), best)
            end = path.find("/", at)
            below = node.segments.get(path[at:end]) if end >= 0 else None
            if below is None:
                return best
            node, at = below, end + 1

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(entry, verdict) of the longest host that has a fitting path, and of its paths the longest."""
        best, at = None, self.root
        if not host:
            return None
        for label in reversed(host.split(".")):
            at = at.labels.get(label)
            if at is None:
                break
            if at.paths is not None:
                best = self._in_path(at.paths, path) or best
        return best


def entries_of(rules: DataFrame) -> DataFrame:
    """(host, path, verdict), each host and path once: hosts lower-cased, missing paths empty; rows without a host or with another verdict than allow or block are no entries. Of equal entries block wins."""
    host, path = lower_ascii(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    sound = rules.where("length(host) > 0 AND verdict IN ('allow', 'block')").select(host.alias("host"), path.alias("path"), "verdict")
    return sound.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def _walked(urls: DataFrame, trie: Trie, default: str) -> DataFrame:
    """urls (_row, host, path) with rule and verdict, by the broadcast trie."""
    shared = urls.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = shared.value.longest
        for b in batches:
            found = [longest(h, p) or (None, default) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            cols = [*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "rule", "verdict"])

    return urls.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema) + ", rule string, verdict string")


def _joined(urls: DataFrame, entries: DataFrame, default: str) -> DataFrame:
    """The same by joins: each different (host, path) meets the suffixes of its host that entries have, then the path lengths of those, then the entries.

    Urls of one suffix are dealt into SALTS parts, so that a suffix of very
    many urls is not one task. Suffixes are made of hosts alone, before paths come.
    """
    folder = work_folder(urls.sparkSession, "urls")
    asked = stored(urls.select("host", "path").where("host <> ''").distinct(), f"{folder}/asked")
    lengths = entries.select("host", F.length("path").alias("n")).distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = asked.select("host").distinct().select("host", F.explode(suffix).alias("suffix"))
    hosts = hosts.join(lengths.select(F.col("host").alias("suffix")).distinct(), "suffix", "left_semi")
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS))
    pairs = asked.join(hosts, "host").withColumn("salt", salt)
    dealt = lengths.select(F.col("host").alias("suffix"), "n", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    keys = pairs.join(dealt, ["suffix", "salt"]).where("n <= length(path)").withColumn("start", F.expr("left(path, n)"))
    hits = keys.join(entries.select(F.col("host").alias("suffix"), F.col("path").alias("start"), F.col("verdict").alias("v")), ["suffix", "start"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("suffix").alias("h"), F.length("start").alias("p"), F.concat("suffix", "start").alias("rule"), "v")).alias("x"))
    best = stored(best.select("host", "path", "x.rule", F.col("x.v").alias("verdict")), f"{folder}/best")
    out = urls.join(best, ["host", "path"], "left")
    return out.select(*urls.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url_col: str = "url", trie_entries: int = TRIE_ENTRIES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(_row, host, path, rule, verdict): every row of pages, as the struct _row, with the longest entry that fits its url.

    rules has host, path and verdict (allow or block). Longest means the longest
    host and, of its fitting paths, the longest; of equal entries block wins.
    rule is host and path of the entry, null where none fits; then verdict is
    `default`. A null url, or one without `://`, has an empty host and path and
    fits nothing. Ports and user names count as part of the host. Repeated rows
    are judged alike; an empty table gives an empty result; own columns of pages
    may have any name. Rules that are null or incomplete are left out; without
    rules all urls get the default.

    Up to trie_entries entries of trie_bytes bytes, none deeper than TRIE_DEPTH, are broadcast as a trie;
    beyond that, urls and entries are joined. Both give the same rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row")
    host, path = host_and_path(F.col("_row").getField(url_col))
    urls = pages.select(row).select("_row", host.alias("host"), path.alias("path"))
    entries = stored(entries_of(rules), f"{work_folder(pages.sparkSession, 'rules')}/entries")
    depth = F.size(F.split("host", r"\.")) + F.size(F.split("path", "/"))
    n, size, deep = entries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)), F.coalesce(F.max(depth), F.lit(0))).first()
    if n > trie_entries or size > trie_bytes or deep > TRIE_DEPTH:
        return _joined(urls, entries, default)
    return _walked(urls, Trie((r["host"], r["path"], r["verdict"]) for r in entries.collect()), default)  # at most trie_entries rows, see above


def allowed(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url_col: str = "url") -> DataFrame:
    """pages in their own columns, without the rows whose url is blocked."""
    return judged(pages, rules, default, url_col).where("verdict = 'allow'").select(*[F.col("_row").getField(c).alias(c) for c in pages.columns])


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, entry and verdict under the contract's entries."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)
    return found.select(F.col("_row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

OP11_SQL = rf"""
WITH r(rhost, rpath, verdict) AS (VALUES {_VALUES}),
a AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT rid, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT rid, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
m AS (SELECT rid, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
  FROM c JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM c LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rid)
"""

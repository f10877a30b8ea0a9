"""Runs of repeated words, found in the Re-Pair grammar of the word ids.

A run is a stretch of words with a smallest period q, at least twice as long as
q and at least `least` words long, that no neighbour extends. The words of some
documents at a time become ids, and Re-Pair folds them into a grammar: pairs of
neighbouring symbols that come at least twice become nonterminals, the more
frequent of two overlapping pairs first, until no pair comes twice. What is left
of each document is put under a balanced tree. Each run lies inside a lowest
node of these derivations and crosses the seam of that node's two halves, so
the runs across a nonterminal's seam are sought once, in one occurrence, carried
to all positions where it was derived, and there merged into maximal intervals.

All steps work on arrays of all documents of a group together. Distances at
which two trigrams next to a seam recur are the only periods tried; how far they
hold is told by sums of word hashes and compared word by word afterwards.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words of a run at least, and words handled together; a longer document is a group of its own.
LEAST, GROUP = 12, 1 << 18
#: Positions next to seams compared at once.
SLICE = 1 << 21
#: Primes of the hash sums, below 2^31, and their bases: fixed values, any others would do.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1140671485)


@dataclass
class Nodes:
    """Nodes of derivations: words [start, end) of the group, halves meeting at seam."""

    start: np.ndarray
    seam: np.ndarray
    end: np.ndarray


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): all integers of every [lo, hi), and whose they are."""
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def repair(ids: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[Nodes, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (one occurrence of each nonterminal of at least `least` words, nonterminal of each derived position, the position, where the last symbols start).

    A round replaces the pairs that are more frequent, by powers of two, than
    the pairs that overlap them; of a symbol repeated alone every second pair
    counts. Symbols with no frequent pair on either side are left out of
    later rounds, as no pair becomes more frequent.
    """
    n = len(ids)
    first = np.ones(n, bool)  # where a symbol starts
    ends = np.zeros(n + 1, bool)
    ends[offsets[1:]] = True
    sym, pos, length = ids.astype(np.int64), np.arange(n), np.ones(n, np.int64)
    tied = ~ends[pos + length]  # may pair with the next one
    symbols = int(ids.max(initial=0)) + 1
    starts, seams, stops, kinds, places, made = [], [], [], [], [], 0
    while len(sym) > 1:
        at = np.flatnonzero(tied[:-1])
        code = sym[at] * symbols + sym[at + 1]
        alone = (sym[at] == sym[at + 1]) & np.concatenate([[False], (code[1:] == code[:-1]) & (at[1:] == at[:-1] + 1)])[: len(at)]
        back = np.arange(len(at)) - np.maximum.accumulate(np.where(alone, -1, np.arange(len(at))))
        even = back % 2 == 0
        kinds_of, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
        counts = np.bincount(inverse[even], minlength=len(kinds_of))
        often = counts[inverse] > 1
        order = (np.frexp(counts.astype(float))[1].astype(np.uint64) << np.uint64(56)) | ((np.arange(len(kinds_of), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8))
        rank = np.zeros(len(sym) + 2, np.uint64)
        rank[at + 1] = np.where(often & even, order[inverse], 0)
        take = at[(rank[at + 1] > rank[at]) & (rank[at + 1] > rank[at + 2])]
        if not len(take):
            break
        kind = inverse[np.searchsorted(at, take)]
        used, kind = np.unique(kind, return_inverse=True)
        total = length[take] + length[take + 1]
        long = total >= least
        one = np.zeros(len(used), np.int64)
        one[kind] = take
        one_long = np.flatnonzero(length[one] + length[one + 1] >= least)
        number = np.full(len(used), -1)
        number[one_long] = made + np.arange(len(one_long))
        made += len(one_long)
        starts.append(pos[one[one_long]])
        seams.append(pos[one[one_long] + 1])
        stops.append(pos[one[one_long]] + length[one[one_long]] + length[one[one_long] + 1])
        kinds.append(number[kind[long]])
        places.append(pos[take[long]])
        first[pos[take + 1]] = False
        sym[take], length[take] = symbols + kind, total
        symbols += len(used)
        link = np.zeros(len(sym), bool)  # pairs that may come again: a new symbol's comes no more often than the pair of words that it stands on
        link[at[often]] = True
        link[take] = link[take + 1]
        keep = np.ones(len(sym), bool)
        keep[take + 1] = False
        tied = link[keep]
        sym, pos, length = sym[keep], pos[keep], length[keep]
        near = tied.copy()
        near[1:] |= tied[:-1]
        sym, pos, length, tied = sym[near], pos[near], length[near], tied[near]

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)

    return Nodes(joined(starts), joined(seams), joined(stops)), joined(kinds), joined(places), np.flatnonzero(first)


def tree(symbols: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> Nodes:
    """Inner nodes of balanced trees over each document's symbols (their starts), at least `least` words long."""
    m = np.searchsorted(symbols, offsets)
    bounds = np.concatenate([symbols, offsets[-1:]])
    starts, seams, stops, step = [], [], [], 1
    while step < np.max(np.diff(m), initial=0):
        which, k = ranges(np.zeros(len(m) - 1, np.int64), -(-(np.diff(m) - step) // (2 * step)))
        left = m[which] + 2 * step * k
        a, b, c = bounds[left], bounds[left + step], bounds[np.minimum(left + 2 * step, m[which + 1])]
        c = np.where(left + 2 * step >= m[which + 1], offsets[which + 1], c)
        fit = c - a >= least
        starts.append(a[fit])
        seams.append(b[fit])
        stops.append(c[fit])
        step *= 2
    none = [np.zeros(0, np.int64)]
    return Nodes(*(np.concatenate(x + none).astype(np.int64) for x in (starts, seams, stops)))


class Reach:
    """How far two positions hold the same words: sums of word ids times powers modulo two primes. salt changes the powers."""

    def __init__(self, ids: np.ndarray, salt: int = 0):
        self.sums, self.powers = [], []
        for prime, base in zip(PRIMES, BASES, strict=True):
            p = np.uint64(prime)
            powers = np.ones(len(ids) + 1, np.uint64)
            done, factor = 1, np.uint64(base + salt)  # factor: base to the power of done
            while done < len(powers):
                more = min(done, len(powers) - done)
                powers[done : done + more] = powers[:more] * factor % p
                done, factor = done + more, factor * factor % p
            sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * powers[:-1] % p, out=sums[1:])
            self.sums.append(sums)
            self.powers.append(powers)

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from i and from j > i are the same."""
        out = np.ones(len(i), bool)
        for prime, sums, powers in zip(PRIMES, self.sums, self.powers, strict=True):
            p = np.uint64(prime)
            out &= (sums[i + n] - sums[i]) % p * powers[j - i] % p == (sums[j + n] - sums[j]) % p
        return out

    def _most(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
        lo, hi = np.zeros(len(i), np.int64), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            shift = mid if sign < 0 else np.zeros_like(mid)
            ok = self.same(i - shift, j - shift, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    def right(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        return self._most(i, j, most, 1)

    def left(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same, of the words before i and j."""
        return self._most(i, j, most, -1)


def seam_runs(nodes: Nodes, ids: np.ndarray, reach: Reach, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, start, end, period) of every run inside a node that crosses its seam, cut at the node's ends; of periods of one stretch the least.

    A run of period p holds p words before the seam or p words behind it. In
    the first case the words from the seam on equal those p before, or those in
    front of it do, for p or `least` - p words together, so three at least on
    one side; the second case mirrors it.
    """
    n = len(ids)
    padded = np.concatenate([ids.astype(np.uint64), np.full(3, 2**40, np.uint64)])
    three = padded[:-2] * np.uint64(0x9E3779B97F4A7C15) + padded[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[2:] * np.uint64(0x165667B19E3779F9)
    found: list[tuple[np.ndarray, ...]] = []
    sizes = np.cumsum(nodes.end - nodes.start)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE, "right")))
        a, s, e = nodes.start[lo:hi], nodes.seam[lo:hi], nodes.end[lo:hi]
        half = (e - a) // 2
        for sign in (-1, 1):
            which, p = ranges(np.ones(len(a), np.int64), np.minimum(s - a if sign < 0 else e - s, half) + 1)
            seam = s[which]
            near = three[seam] == three[np.minimum(seam + sign * p, n)]
            near |= three[np.maximum(seam - 3, 0)] == three[np.clip(seam + sign * p - 3, 0, n)]
            which, p = which[near], p[near]
            i, j = (s[which] - p, s[which]) if sign < 0 else (s[which], s[which] + p)
            forward = reach.right(i, j, e[which] - j)
            back = reach.left(i, j, i - a[which])
            fit = (forward + back >= p) & (forward + back + p >= least)
            found.append((which[fit] + lo, (i - back)[fit], (j + forward)[fit], p[fit]))
        lo = hi
    node, start, end, period = (np.concatenate([f[k] for f in found] + [np.zeros(0, np.int64)]).astype(np.int64) for k in range(4))
    order = np.lexsort((period, end, start, node))
    node, start, end, period = node[order], start[order], end[order], period[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[new], start[new], end[new], period[new]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals: those of one period that share at least a period's words are one run. Sorted by start, then period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        span = int(end.max()) + 1
        until = np.maximum.accumulate(end + period * span) - period * span  # no end of a smaller period reaches the next one's
        new = np.ones(len(start), bool)
        new[1:] = (period[1:] != period[:-1]) | (start[1:] > until[:-1] - period[1:])
        at = np.flatnonzero(new)
        start, end, period = start[at], np.maximum.reduceat(end, at), period[at]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(ids: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the documents ids[offsets[k] : offsets[k + 1]], in places of ids, by start, then period."""
    least = max(least, 7)  # what seam_runs rests on; shorter runs aren't sought
    rules, kind, place, symbols = repair(ids, offsets, least)
    by_kind = np.argsort(kind, kind="stable")
    tops, salt = tree(symbols, offsets, least), 0
    while True:
        reach = Reach(ids, salt)
        node, start, end, period = seam_runs(rules, ids, reach, least)
        which, k = ranges(np.searchsorted(kind[by_kind], node, "left"), np.searchsorted(kind[by_kind], node, "right"))
        shift = place[by_kind[k]] - rules.start[node[which]]
        _, own_start, own_end, own_period = seam_runs(tops, ids, reach, least)
        found = merged(np.concatenate([start[which] + shift, own_start]), np.concatenate([end[which] + shift, own_end]), np.concatenate([period[which], own_period]))
        if all(np.array_equal(ids[a : b - p], ids[a + p : b]) for a, b, p in zip(*(x.tolist() for x in found), strict=True)):
            return found
        salt += 1  # different words had the same sums: once more, with other powers


def altered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's texts: where crc32 of the id ends in 0, the words from some place on repeat themselves; rows without an id stay as they are."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


FIELDS = {
    "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "runs": pa.list_(pa.list_(pa.int64())), "collapsed": pa.string(),
}


def _described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """One document's fields; runs are (start, length, period)."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = b" ".join(w for w, x in zip(words, np.cumsum(gone).tolist(), strict=False) if not x)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), runs, kept.decode()


def _group(docs: list[list[bytes]], least: int) -> list[tuple]:
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    ids = np.fromiter((known[w] for d in docs for w in d), np.int64, int(offsets[-1]))
    start, end, period = runs_of(ids, offsets, least)
    at = np.searchsorted(start, offsets)
    out = []
    for k, words in enumerate(docs):
        own = slice(at[k], at[k + 1])
        out.append(_described(words, list(zip((start[own] - offsets[k]).tolist(), (end[own] - start[own]).tolist(), period[own].tolist(), strict=True))))
    return out


def periodic_runs(docs: DataFrame, least: int = LEAST, with_text: bool = True, alter: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row of docs (doc_id, text) and, with_text, runs and collapsed.

    Words are what stands between ASCII blanks, numbered from 0. start, length,
    period and exponent_milli are those of the longest run, of equal ones the
    first and then that of the least period; null without a run. runs lists
    [start, length, period] by start, then period. collapsed is the text without
    the words that any run holds after its first period, joined by one space.
    Runs of fewer than max(least, 7) words aren't sought. Null, empty and blank texts have no words and no
    runs. Every row is a document of its own, whether its id repeats or is null;
    an empty table gives an empty result; other columns are left out. A text
    is handled whole, with memory in proportion to its words; texts of any number
    make groups of about GROUP words. alter repeats words first, as the contract asks.
    """
    names = [x for x in FIELDS if with_text or x not in ("runs", "collapsed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column("doc_id"), b.column("text").cast(pa.large_binary())
            group, size, first = [], 0, 0
            for i in range(len(texts) + 1):
                words = (texts[i].as_py() or b"").split() if i < len(texts) else []
                if group and (i == len(texts) or size + len(words) > GROUP):
                    rows = _group(group, least)
                    cols = [pa.array([r[k] for r in rows], t) for k, (x, t) in enumerate(FIELDS.items()) if x in names]
                    yield pa.RecordBatch.from_arrays([keys.slice(first, len(rows)), *cols], names=["doc_id", *names])
                    group, size, first = [], 0, i
                if i < len(texts):
                    group.append(altered(words, keys[i].as_py()) if alter else words)
                    size += len(words)

    kinds = {"runs": "array<array<bigint>>"} | {x: "string" for x in ("runs_sha256", "collapsed_sha256", "collapsed")}
    schema = ", ".join(f"{x} {kinds.get(x, 'bigint')}" for x in names)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of the runs of all documents, altered as the contract says."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False, alter=True)

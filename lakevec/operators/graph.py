"""Proximity graph: build in overlapping shards with alpha pruning, and search in rounds of joins.

The graph is a DataFrame topology(id, nbrs), apart from vectors(id, vec), so a
traversal never reads vectors that it doesn't need. All queries of a call move
together: a round takes the nearest unexpanded entries of every query's pool,
joins their neighbours, measures them and keeps each pool's best. Pairs of a
query and a row move; topology, codes and vectors stay where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakevec.functions.keyed import FEW, Keyed, keyed, rows_of
from lakevec.functions.storage import stored, work_folder
from lakevec.operators import cluster, pq, sampling
from lakevec.operators.exact import knn, ranked
from lakevec.operators.metrics import SOUND, l2sq, matrix

#: Rows of a part, in which neighbours are compared with each other.
PART = 4096


@dataclass
class GraphParams:
    degree: int = 32
    candidates: int = 160
    alpha: float = 1.2
    overlap: int = 2
    saturate: bool = False
    part: int = PART


@dataclass
class Coder:
    """What a traversal measures candidates with: PQ codes packed by row, and their codebook."""

    codes: DataFrame | Keyed  # (id, codes: array<int>)
    book: DataFrame  # (chunk, code, sub)
    dim: int
    chunks: int
    _sent: Broadcast | None = None

    def sent(self) -> Broadcast:
        """The table of centres, sent to the tasks once."""
        if self._sent is None:
            self._sent = self.book.sparkSession.sparkContext.broadcast(pq.centres(self.book))
        return self._sent

    def over(self, codes: DataFrame | Keyed) -> Coder:
        """The same book with other codes."""
        return Coder(codes, self.book, self.dim, self.chunks, self.sent())


def _apart(vecs: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of rows; those that rounding could hide, as of equal rows, are measured one by one."""
    sq = (vecs * vecs).sum(1)
    both = sq[:, None] + sq[None, :]
    apart = both - 2 * (vecs @ vecs.T)
    i, j = np.nonzero(apart <= 1e-9 * both)
    i, j = i[i < j], j[i < j]
    apart[i, j] = apart[j, i] = ((vecs[i] - vecs[j]) ** 2).sum(1)
    return apart


def robust_prune(dist: np.ndarray, vecs: np.ndarray, degree: int, alpha: float, saturate: bool = False, entry: int = -1) -> list[int]:
    """Which of the candidates, sorted by distance to the node, become its neighbours.

    A candidate is passed over while an already chosen one is nearer to it than
    the node is, by more than the factor of the round; the factor grows from 1
    to alpha in steps of 1.2. Candidates equal to a chosen one never come in.
    `entry`, if it was chosen in the last quarter, goes again; with saturate the
    nearest others fill the list up to degree.
    """
    n, chosen = len(dist), []
    between = _apart(vecs)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(between > 0, dist[None, :] / between, np.inf)
    occlusion = np.zeros(n)
    factor = 1.0
    while factor <= alpha + 1e-6 and len(chosen) < degree:
        at = 0
        while at < n and len(chosen) < degree:
            i = at + int((occlusion[at:] <= factor).argmax())
            if occlusion[i] > factor:
                break
            chosen.append(i)
            occlusion[i] = np.inf
            np.maximum(occlusion[i + 1 :], ratio[i, i + 1 :], out=occlusion[i + 1 :])
            at = i + 1
        factor *= 1.2
    chosen = sorted(chosen)
    chosen = [c for i, c in enumerate(chosen) if c != entry or i <= len(chosen) * 3 // 4]
    if saturate:
        chosen += [i for i in range(n) if i not in set(chosen)][: degree - len(chosen)]
    return sorted(chosen)


def delta_prune(dist: np.ndarray, vecs: np.ndarray, new: int, alpha: float) -> int:
    """Which one of degree + 1 neighbours, sorted by distance, is evicted after `new` came in."""
    between = ((vecs - vecs[new]) ** 2).sum(1)
    factor = alpha
    while factor >= 1:
        for i in range(len(dist) - 1, -1, -1):
            if i == new:
                continue
            near = max(between[i], 1e-300)  # an equal row occludes the new one, however near both are
            if dist[i] > dist[new] and dist[i] / near > factor:
                return i
            if dist[i] <= dist[new] and max(dist[new], 1e-290) / near > factor:
                return new
        factor /= 1.2
    for p in range(len(dist)):  # each earlier neighbour and the first later one that it occludes
        later = dist[p + 1 :] > alpha * ((vecs[p + 1 :] - vecs[p]) ** 2).sum(1)
        if p != new and later.any():
            return p + 1 + int(later.argmax())
    return len(dist) - 1


def with_back_edges(dist: np.ndarray, vecs: np.ndarray, fresh: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Which of a node's neighbours stay when the fresh ones come in one after the other, nearest first: over degree each evicts one (delta_prune)."""
    held = [int(i) for i in np.flatnonzero(~fresh)]
    for new in np.flatnonzero(fresh):
        held = sorted([*held, int(new)])
        if len(held) > degree:
            held.pop(delta_prune(dist[held], vecs[held], held.index(int(new)), alpha))
    return held


def candidate_lists(candidates: DataFrame, vectors: DataFrame | Keyed | Coder, most: int) -> DataFrame:
    """(id, c): each node's nearest `most` candidates (id, nbr[, fresh]) with distance and vector or codes, nearest first.

    vectors (id, vec) give exact distances, a Coder those between the codes; of
    either only the rows that candidates name are read and moved.
    """
    fresh = F.max("fresh").alias("fresh") if "fresh" in candidates.columns else F.lit(False).alias("fresh")
    edges = stored(candidates.where("id <> nbr").groupBy("id", "nbr").agg(fresh), f"{work_folder(candidates.sparkSession, 'edges')}/edges")
    few = edges.count() <= FEW
    coded = isinstance(vectors, Coder)
    table = keyed(vectors.codes if coded else vectors)
    column = "codes" if coded else "vec"
    edges = table.join(edges.withColumnsRenamed({"id": "from", "nbr": "id"}), few).select(F.col("from").alias("id"), F.col("id").alias("nbr"), "fresh", F.col(column).alias("nvec"))
    # The node's own row comes last, where its candidates are ranked: it never moves with a pair.
    edges = table.join(edges, few).select("id", "nbr", "fresh", F.col(column).alias("own"), "nvec")
    edges = _between(edges, vectors) if coded else edges.withColumn("dist", l2sq(F.col("own"), F.col("nvec")))
    rank = F.row_number().over(W.partitionBy("id").orderBy("dist", "nbr"))
    edges = edges.drop("own").withColumn("r", rank).where(F.col("r") <= most)
    return edges.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dist", "nbr", "fresh", "nvec"))).alias("c"))


def _between(edges: DataFrame, coder: Coder) -> DataFrame:
    """edges (id, nbr, fresh, own, nvec) with dist, the squared distance of both ends' codes, by the table of centres that travels with the tasks."""
    sent = coder.sent()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                apart = pq.decode(matrix(b.column("own")), sent.value) - pq.decode(matrix(b.column("nvec")), sent.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((apart**2).sum(1))], names=[*b.schema.names, "dist"])

    return edges.mapInArrow(run, "id long, nbr long, fresh boolean, own array<int>, nvec array<int>, dist double")


def _kept(lists: DataFrame, keep, coder: Coder | None = None) -> DataFrame:
    """topology of the candidates that keep(dist, vecs, fresh, ids) picks."""
    sent = coder.sent() if coder else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.column("c"):
                c = row.values
                nbr, x = c.field("nbr").to_numpy(), matrix(c.field("nvec"))
                x = pq.decode(x, sent.value) if sent else x
                out.append(nbr[keep(c.field("dist").to_numpy(), x, c.field("fresh").to_numpy(zero_copy_only=False), nbr)])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.int64()))], names=["id", "nbrs"])

    return lists.mapInArrow(run, "id long, nbrs array<long>")


def prune(candidates: DataFrame, vectors: DataFrame | Keyed | Coder, degree: int, alpha: float, most: int, saturate: bool = False, medoid: int = -1) -> DataFrame:
    """topology from (id, nbr) candidates: each node's nearest `most`, alpha-pruned to degree, nearest first.

    With a Coder distances are those between codes, and no stored vector is
    read. A node that has `medoid` far down its list loses it.
    """
    coder = vectors if isinstance(vectors, Coder) else None
    return _kept(candidate_lists(candidates, vectors, most), lambda dist, vecs, _, ids: robust_prune(dist, vecs, degree, alpha, saturate, int(np.flatnonzero(ids == medoid)[0]) if medoid in ids else -1), coder)


def link_back(own: DataFrame, back: DataFrame, vectors: DataFrame | Keyed | Coder, degree: int, alpha: float, most: int = 2**31 - 1) -> DataFrame:
    """topology of the nodes that back (id, nbr) names: their lists of own (id, nbr) take in the new edges, each over the degree evicting one. Old and new edges of a node count up to the nearest `most`."""
    both = own.select("id", "nbr", F.lit(False).alias("fresh")).unionByName(back.join(own, ["id", "nbr"], "left_anti").select("id", "nbr", F.lit(True).alias("fresh")))
    coder = vectors if isinstance(vectors, Coder) else None
    return _kept(candidate_lists(both, vectors, most), lambda dist, vecs, fresh, _: with_back_edges(dist, vecs, fresh, degree, alpha), coder)


def near_in_parts(placed: DataFrame, p: GraphParams) -> DataFrame:
    """(id, nbr): inside each part of placed(part, id, vec) the pruned nearest rows of every row."""
    most = p.candidates

    def near(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), matrix(table.column("vec"))
        a, b = [], []
        for lo in range(0, len(ids), 512):
            d = (x[lo : lo + 512] ** 2).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x[lo : lo + 512] @ x.T
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            m = min(most, len(ids) - 1)
            if m:
                top = np.argpartition(d, m - 1, axis=1)[:, :m]
                for i, t in enumerate(top):
                    t = t[np.lexsort((ids[t], d[i, t]))]
                    keep = t[robust_prune(np.maximum(d[i, t], 0), x[t], p.degree, p.alpha, p.saturate)]
                    a.append(np.full(len(keep), ids[lo + i]))
                    b.append(ids[keep])
        none = [np.zeros(0, np.int64)]
        return pa.table({"id": np.concatenate(none + a), "nbr": np.concatenate(none + b)})

    return placed.select("part", "id", "vec").groupBy("part").applyInArrow(near, "id long, nbr long")


def build(base: DataFrame, params: GraphParams | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(topology, entries): the graph of base(id, vec) and its entry points, one for each part.

    Rows lie in overlapping parts of near rows (cluster.parts), as many as the
    table needs. Inside a part every row's nearest rows are its candidates; the
    parts' lists are merged by distance. Edges go both ways, each row keeping
    its nearest candidates before the pruning, so a row that is near to very
    many others gets no long list. The entry of a row's first part leads to it
    (linked_in_parts), so no row is out of reach of all entries.
    """
    p, spark = params or GraphParams(), base.sparkSession
    folder = folder or work_folder(spark, "graph")
    base = stored(base.where(SOUND.format("vec")).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")), f"{folder}/vectors")
    placed = stored(cluster.parts(base, folder, p.part, p.overlap), f"{folder}/placed")
    edges = stored(near_in_parts(placed, p), f"{folder}/edges")
    both = edges.unionByName(edges.select(F.col("nbr").alias("id"), F.col("id").alias("nbr")))
    home = stored(placed.groupBy("id").agg(F.min("part").alias("part")), f"{folder}/home")
    topology = stored(linked_in_parts(both, home, base, p), f"{folder}/topology")
    entries = stored(home.groupBy("part").agg(F.min("id").alias("id")).select("id").unionByName(cluster.medoid(base).select("id")).distinct(), f"{folder}/entries")
    return topology, entries


def rooted(own: np.ndarray, lists: list[np.ndarray], x: np.ndarray, degree: int) -> list[np.ndarray]:
    """lists of the rows own of x, nearest first, with a path from the first of own to all of them.

    Who isn't reached gets an edge from the nearest reached row with room: a
    list below the degree, or the farthest edge of a full one that no path
    found so far needs.
    """
    spot = np.full(len(x), -1)
    spot[own] = np.arange(len(own))
    lists, needed, reached = list(lists), [set() for _ in own], np.zeros(len(own), bool)

    def walk(front: list[int]) -> None:
        while front:
            later = []
            for k in front:
                for b in lists[k].tolist():
                    j = spot[b]
                    if j >= 0 and not reached[j]:
                        reached[j] = True
                        needed[k].add(b)
                        later.append(j)
            front = later

    def link(u: int) -> None:
        there = np.flatnonzero(reached)
        for v in there[np.argsort(((x[own[there]] - x[own[u]]) ** 2).sum(1), kind="stable")]:
            held = lists[v].tolist()
            loose = next((b for b in reversed(held) if b not in needed[v]), None) if len(held) >= degree else -1
            if loose is not None:
                held = np.array([b for b in held if b != loose] + [own[u]], np.int64)
                lists[v] = held[np.lexsort((held, ((x[held] - x[own[v]]) ** 2).sum(1)))]
                needed[v].add(int(own[u]))
                return

    if len(own):
        reached[0] = True
        walk([0])
    while not reached.all():
        left = np.flatnonzero(~reached)
        named = np.zeros(len(x), bool)
        named[np.concatenate([lists[u] for u in left])] = True
        first = left[~named[own[left]]]
        for u in first if len(first) else left[:1]:
            link(u)
            reached[u] = True
            walk([u])
    return lists


def linked_in_parts(candidates: DataFrame, home: DataFrame, base: DataFrame, p: GraphParams) -> DataFrame:
    """topology from (id, nbr) candidates, as prune() makes it, of all rows of home(id, part); a part's least id leads to all its rows by edges inside the part.

    Pairs meet vectors in the part of their row: a vector moves once to each part
    that names it, not once for each pair.
    """
    edges = candidates.where("id <> nbr").join(home, "id").select("part", "id", "nbr")
    named = edges.select("part", F.col("nbr").alias("id"), F.lit(0).alias("own")).unionByName(home.select("part", "id", F.lit(1).alias("own")))
    known = named.groupBy("part", "id").agg(F.max("own").alias("own")).join(base, "id").select("part", "id", "own", "vec")

    def link(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        ids, first = np.unique(rows.column("id").to_numpy(), return_index=True)
        own, x = np.flatnonzero(rows.column("own").to_numpy()[first]), matrix(rows.column("vec"))[first]
        n = max(len(ids), 1)
        a, b = np.divmod(np.unique(np.searchsorted(ids, pairs.column("id").to_numpy()) * n + np.searchsorted(ids, pairs.column("nbr").to_numpy())), n)
        step = 1 << 14
        dist = np.concatenate([np.zeros(0)] + [((x[a[i : i + step]] - x[b[i : i + step]]) ** 2).sum(1) for i in range(0, len(a), step)])
        order = np.lexsort((b, dist, a))
        a, b, dist = a[order], b[order], dist[order]
        lists = []
        for lo, hi in zip(np.searchsorted(a, own), np.searchsorted(a, own, "right"), strict=True):
            hi = min(hi, lo + p.candidates)
            lists.append(b[lo:hi][robust_prune(dist[lo:hi], x[b[lo:hi]], p.degree, p.alpha, p.saturate)])
        lists = rooted(own, lists, x, p.degree)
        return pa.table({"id": ids[own], "nbrs": pa.array([ids[c] for c in lists], pa.list_(pa.int64()))})

    return edges.withColumnRenamed("part", "of").groupBy("of").cogroup(known.groupBy("part")).applyInArrow(link, "id long, nbrs array<long>")


#: Fixed value: how far over the degree a list may grow during an incremental build before it is pruned.
SLACK = 1.3


def grow(base: DataFrame, params: GraphParams | None = None, length: int = 75, width: int = 16, slack: float = SLACK, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(topology, entries): the graph of base(id, vec), built in batches that double the rows in it.

    Rows come in the order of a hash. The first part is built as a whole; each
    row of a batch is searched for in the graph of the rows before, so edges lead
    to wherever its nearest rows are, and meets the near rows of its own batch.
    Its neighbours take the new edge at the end of their lists; a list is
    pruned only when it grows over slack times the degree, and all that are over
    the degree are in the end. Batches double, so the tables written add up to
    about twice the last one, and the rounds of searches grow with the logarithm of the table.
    """
    p, spark = params or GraphParams(), base.sparkSession
    folder = work_folder(spark, "grow")
    spot = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = base.where(SOUND.format("vec")).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    rows = stored(rows.withColumn("spot", spot), f"{folder}/rows")
    share = min(1.0, p.part / max(rows.count(), 1))
    topology, entries = build(rows.where(F.col("spot") < share).select("id", "vec"), p)
    step = 0
    while share < 1:
        step, upto = step + 1, min(1.0, 2 * share)
        batch = stored(rows.where((F.col("spot") >= share) & (F.col("spot") < upto)).select("id", "vec"), f"{folder}/batch-{step}")
        known = rows.where(F.col("spot") < share).select("id", "vec")
        topology = stored(_grown(batch, known, topology, entries, p, length, width, slack, f"{folder}/{step}"), f"{folder}/topology-{step}")
        share = upto
    every = rows.select("id", "vec")
    long = topology.where(F.size("nbrs") > p.degree)
    cut = stored(prune(long.select("id", F.explode("nbrs").alias("nbr")), every, p.degree, p.alpha, p.candidates, p.saturate), f"{folder}/cut")
    return stored(topology.join(cut.select("id"), "id", "left_anti").unionByName(cut), f"{folder}/topology"), entries


def _grown(batch: DataFrame, known: DataFrame, topology: DataFrame, entries: DataFrame, p: GraphParams, length: int, width: int, slack: float, folder: str) -> DataFrame:
    """topology with the lists of a batch and the edges back to it."""
    every, most = known.unionByName(batch), int(p.degree * slack)
    found = search(batch.selectExpr("id AS qid", "vec AS qvec"), known, topology, entries, k=length, length=length, width=width)
    among = stored(near_in_parts(cluster.parts(batch, folder, p.part), p), f"{folder}/among")
    candidates = found.selectExpr("qid AS id", "id AS nbr").unionByName(among).unionByName(among.selectExpr("nbr AS id", "id AS nbr"))
    linked = stored(prune(candidates, every, p.degree, p.alpha, p.candidates, p.saturate), f"{folder}/linked")
    linked = linked.unionByName(batch.select("id").join(linked.select("id"), "id", "left_anti").select("id", F.array().cast("array<long>").alias("nbrs")))
    back = stored(linked.select(F.explode("nbrs").alias("id"), F.col("id").alias("nbr")), f"{folder}/back")
    ends = back.select("id").distinct()
    both = topology.unionByName(linked)
    own = both.join(ends, "id", "left_semi").select("id", F.posexplode("nbrs").alias("pos", "nbr"))
    edges = own.unionByName(back.select("id", F.lit(2**30).alias("pos"), "nbr")).groupBy("id", "nbr").agg(F.min("pos").alias("pos"))
    edges = stored(edges, f"{folder}/edges")
    short = edges.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("id")
    appended = edges.join(short, "id", "left_semi").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nbr"))), lambda x: x["nbr"]).alias("nbrs"))
    pruned = prune(edges.join(short, "id", "left_anti").select("id", "nbr"), every, p.degree, p.alpha, p.candidates, p.saturate)
    changed = stored(appended.unionByName(pruned), f"{folder}/changed")
    return both.join(changed.select("id"), "id", "left_anti").unionByName(changed)


def navigation(base: DataFrame, share: float = 0.1, params: GraphParams | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, topology, entries) of a graph over a sample of base, which finds entry points of the large one (see entry_rows)."""
    some = sampling.at_least_one(base, share)
    return some.select("id", "vec"), *build(some.select("id", "vec"), params)


def entry_rows(queries: DataFrame, sample: tuple[DataFrame, DataFrame, DataFrame], n: int = 10) -> DataFrame:
    """(qid, id): each query's own entry points, what it finds in the sample's graph."""
    vectors, topology, entries = sample
    return search(queries, vectors, topology, entries, k=n, length=max(2 * n, 20)).select("qid", "id")


def _query_tables(queries: DataFrame, coder: Coder | None) -> DataFrame:
    """(qid, qvec, lut): queries, with a table of distances for each chunk where codes are used."""
    if coder is None:
        return queries.select("qid", "qvec", F.lit(None).cast("array<array<double>>").alias("lut"))
    t = pq.lookup(pq.split(queries.selectExpr("qid AS id", "qvec AS vec"), coder.dim, coder.chunks), coder.book)
    t = t.groupBy("qid", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "d"))), lambda x: x["d"]).alias("row"))
    t = t.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "row"))), lambda x: x["row"]).alias("lut"))
    return queries.select("qid", "qvec").join(t, "qid")


def truncation(length: int, keep: int) -> int:
    """How many of a pool of that length are rescored."""
    return min(length, max(keep, math.ceil(keep * (1 + math.log10(max(length, 1) / max(keep, 1))))))


#: Modes that traverse on codes.
CODED = ("beam", "pipe", "coro", "page", "rerank", "codes")
#: Fixed value: the width at which an adaptive traversal begins.
NARROW = 4
#: Neighbours of a row that a round reckons with; only for telling without a count that there are few pairs.
LONGEST = 128
#: Entries up to which every query is measured against all of them.
GUIDED = 4096
#: Rows of a pool for each entry point that a query starts at.
POOL_ROWS = 32
#: Bytes of query tables that are sent to all executors; larger ones meet the pairs in a shuffle by query.
TABLE_BYTES = 64 << 20


def search(queries: DataFrame, vectors: DataFrame | Keyed, topology: DataFrame | Keyed, entries: DataFrame, k: int = 10, length: int = 64, width: int = 8, mode: str = "memory", coder: Coder | None = None, layout: DataFrame | None = None, tombstones: DataFrame | None = None, keep: int | None = None, max_hops: int | None = None, n_entries: int = 8, max_compared: int | None = None, counts: bool = False) -> DataFrame:
    """(qid, rank, id, dist): approximate neighbours, ordered by (dist, id), without deleted ids.

    mode `memory` measures the pool exactly. The others traverse on codes:
    `codes` answers with the distances of the codes, `rerank` cuts the pool and
    rescores what is left, `beam` and `coro` answer with the exact distances of
    all expanded rows. `pipe` does so too, but each query has its own width:
    it starts at NARROW and grows by half, up to `width`, while at most a tenth of
    the rows that a round expanded are pushed out of the first half of the pool by
    what they found. `page` reads whole pages: the other rows on the pages of the
    expanded ones come into the pool, and those that are near enough to be in it are
    expanded in the same round.

    entries has id, and each query starts at its nearest n_entries of them, or at
    more if its pool is long, which a graph over the entries finds where they
    are more than GUIDED; with a qid they are each query's own. A pool that isn't
    full when all of it is expanded goes on from the entries it hasn't met, so
    it ends with every row that any entry leads to. Deleted rows are traversed like others, but
    length, width of the cut and k count live rows alone, so a pool widens until
    it holds `length` of these. Rounds go on until every pool is expanded. With
    max_hops they end there, and with max_compared a query's end once it has
    measured so many rows; then a column `complete` says for each query whether
    its pool was expanded. Fewer than k live rows within reach give fewer results.

    With counts every answer carries its query's work: hops, expanded,
    compared (rows measured, entries included), pages (of expanded rows, where
    there is a layout) and rescored.

    A round with few pairs filters topology and codes where they lie; one
    with more sends the pairs to their buckets, if the tables have any.
    """
    if mode != "memory" and mode not in CODED:
        raise ValueError(f"no such mode: {mode}")
    if mode != "memory" and coder is None:
        raise ValueError(f"mode {mode} needs codes")
    if mode == "page" and layout is None:
        raise ValueError("mode page needs a layout")
    vectors, topology = keyed(vectors), keyed(topology)
    spark = vectors.base.sparkSession
    folder = work_folder(spark, "search")
    tables = stored(_query_tables(queries, coder if mode != "memory" else None), f"{folder}/queries")
    shape = tables.agg(F.count("*"), F.sum(F.coalesce(F.size("lut") * F.size(F.element_at("lut", 1)), F.size("qvec")) * F.lit(8))).first()
    tables = F.broadcast(tables) if (shape[1] or 0) <= TABLE_BYTES else tables
    gone = None if tombstones is None else tombstones.select("id").distinct().withColumn("dead", F.lit(True))
    coded = keyed(coder.codes) if mode != "memory" else None

    def measure(pairs: DataFrame, few: bool) -> DataFrame:
        """pairs (qid, id, others) with dist and live."""
        rest = [c for c in pairs.columns if c not in ("qid", "id")]
        if mode == "memory":
            d = l2sq(F.col("qvec"), F.col("vec"))
        else:
            d = sum((F.get(F.get("lut", F.lit(c)), F.get("codes", F.lit(c))) for c in range(coder.chunks)), F.lit(0.0))
        pairs = (vectors if mode == "memory" else coded).join(pairs, few).join(tables, "qid").select("qid", "id", *rest, d.alias("dist"))
        if gone is None:
            return pairs.withColumn("live", F.lit(1))
        return pairs.join(gone, "id", "left").select("qid", "id", *rest, "dist", F.when(F.col("dead"), 0).otherwise(1).alias("live"))

    def exact(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select("qid", "id"), f"{folder}/rescored")
        return vectors.join(pairs, pairs.count() <= FEW).join(tables.select("qid", "qvec"), "qid").select("qid", "id", l2sq(F.col("qvec"), F.col("vec")).alias("dist"))

    by_query, by_pool = W.partitionBy("qid"), W.partitionBy("qid").orderBy("dist", "id")
    state = ["qid", "id", "dist", "live", "expanded", "open", "place", "width", "compared"]

    def pooled(rows: DataFrame) -> DataFrame:
        """The pool as far as its `length`-th live row; `open` numbers the unexpanded rows of it, `width` says how many of them the next round takes.

        New rows have no `width` and no `compared`; old ones carry their query's.
        `now` tells the rows that this round expanded. No round's number is in
        the plan, so that all rounds run the same compiled code.
        """
        rows = rows.withColumn("compared", F.coalesce(F.max("compared").over(by_query), F.lit(0)) + F.count_if(F.isnull("compared")).over(by_query))
        upto = F.sum("live").over(by_pool.rowsBetween(W.unboundedPreceding, 0))
        rows = rows.withColumns({"upto": upto, "place": F.row_number().over(by_pool)})
        if mode == "pipe":
            had = F.coalesce(F.max("width").over(by_query), F.lit(NARROW))
            front = F.count_if("now").over(by_query)
            out = F.count_if(F.col("now") & (F.col("upto") > F.lit(length / 2))).over(by_query)
            grown = F.least(F.lit(max(width, 1)), had + F.greatest(F.lit(1), F.floor(had / 2)).cast("int"))
            rows = rows.withColumn("width", F.when((front > 0) & (out * 10 <= front), grown).otherwise(F.least(had, F.lit(max(width, 1)))))
        else:
            rows = rows.withColumn("width", F.lit(width))
        rows = rows.where(F.col("upto") - F.col("live") < length)
        left = F.col("compared") < max_compared if max_compared is not None else F.lit(True)
        numbered = F.sum((~F.col("expanded")).cast("int")).over(by_pool.rowsBetween(W.unboundedPreceding, 0))
        return rows.withColumn("open", F.when(~F.col("expanded"), numbered)).withColumn("width", F.when(left, F.col("width")).otherwise(0)).select(*state)

    known, others = None, 0
    if "qid" in entries.columns:
        first = entries.select("qid", "id").distinct()
    else:
        known = stored(vectors.join(entries.select("id").distinct()).select("id", "vec"), f"{folder}/entries")
        n_known, n_entries = known.count(), max(n_entries, length // POOL_ROWS)
        others = n_known - n_entries
        if n_known > GUIDED:
            first = entry_rows(queries, (known, *build(known)), n_entries)
        else:
            first = knn(queries, known, n_entries).select("qid", "id")
    fresh = {"expanded": F.lit(False), "now": F.lit(False), "width": F.lit(None).cast("int"), "compared": F.lit(None).cast("long")}
    pool = stored(pooled(measure(first, False).withColumns(fresh)), f"{folder}/pool-0")
    in_front = F.coalesce(F.col("open") <= F.col("width"), F.lit(False))

    def unmet() -> DataFrame:
        """(qid, id): the entries that pools which aren't full haven't met."""
        short = pool.groupBy("qid").agg(F.sum("live").alias("n"), F.max("compared").alias("c")).where(F.col("n") < length)
        short = short if max_compared is None else short.where(F.col("c") < max_compared)
        met = pool.join(known.select("id"), "id").select("qid", "id")
        return short.select("qid").crossJoin(known.select("id")).join(met, ["qid", "id"], "left_anti")

    hop, page_hops = 0, []
    while max_hops is None or hop < max_hops:
        n_front = pool.where(in_front).count()
        if not n_front:
            more = stored(unmet(), f"{folder}/unmet-{hop}") if others > 0 else None
            others = 0
            if more is None or not more.limit(1).count():
                break
            hop += 1
            old = pool.select("qid", "id", "dist", "live", "expanded", F.lit(False).alias("now"), "width", "compared")
            pool = stored(pooled(old.unionByName(measure(more, more.count() <= FEW).withColumns(fresh))), f"{folder}/pool-{hop}")
            continue
        hop += 1
        front = pool.where(in_front).select("qid", "id")
        mates = None
        if mode == "page":
            front, mates = _with_pages(pool, front, layout, measure, length, f"{folder}/pages-{hop}")
            page_hops.append(hop)
            n_front = front.count()
        found = topology.join(front, n_front <= FEW).select("qid", F.explode("nbrs").alias("id")).distinct().join(pool.select("qid", "id"), ["qid", "id"], "left_anti")
        if mates is not None:
            found = found.join(mates.select("qid", "id"), ["qid", "id"], "left_anti")
        few = n_front * LONGEST <= FEW
        if not few:
            found = stored(found, f"{folder}/found-{hop}")
            few = found.count() <= FEW
        new = measure(found, few).withColumns(fresh)
        # Of rows that are in the pool already, those of the front are expanded now.
        taken = in_front if mates is None else F.col("front")
        old = pool if mates is None else pool.join(front.withColumn("front", F.lit(True)), ["qid", "id"], "left").withColumn("front", F.coalesce("front", F.lit(False)))
        old = old.select("qid", "id", "dist", "live", (F.col("expanded") | taken).alias("expanded"), taken.alias("now"), "width", "compared")
        rows = old.unionByName(new)
        if mates is not None:
            own = mates.join(front.withColumn("now", F.lit(True)), ["qid", "id"], "left").withColumn("now", F.isnotnull("now"))
            rows = rows.unionByName(own.select("qid", "id", "dist", "live", F.col("now").alias("expanded"), "now", *[fresh[c].alias(c) for c in ("width", "compared")]))
        pool = stored(pooled(rows), f"{folder}/pool-{hop}")

    def expanded_rows() -> DataFrame:
        """(qid, id) of all rows expanded at some time: the last pool's, and those of earlier pools and of their fronts, which later pools may have pushed out."""
        seen = pool.where("expanded").select("qid", "id")
        if hop:
            earlier = spark.read.schema(pool.schema).parquet(*[f"{folder}/pool-{h}" for h in range(hop)])
            seen = seen.unionByName(earlier.where(F.col("expanded") | in_front).select("qid", "id"))
        if page_hops:
            seen = seen.unionByName(spark.read.schema(PAGE_FRONT).parquet(*[f"{folder}/pages-{h}/front" for h in page_hops]))
        return seen.distinct()

    def answer(found: DataFrame, rescored: DataFrame | None = None) -> DataFrame:
        out = ranked(found, k)
        if max_hops is not None or max_compared is not None:
            out = out.join(pool.groupBy("qid").agg((F.count("open") == 0).alias("complete")), "qid")
        if counts:
            seen = stored(expanded_rows(), f"{folder}/expanded")
            every = spark.read.schema(pool.schema).parquet(*[f"{folder}/pool-{h}" for h in range(hop + 1)])
            work = every.groupBy("qid").agg(F.max("compared").alias("compared"))
            hops = spark.read.schema(pool.schema).parquet(*[f"{folder}/pool-{h}" for h in range(hop)]).withColumn("h", F.input_file_name()).where(in_front).groupBy("qid").agg(F.countDistinct(F.regexp_extract("h", r"pool-(\d+)/", 1)).alias("hops")) if hop else work.select("qid", F.lit(0).alias("hops"))
            tallies = [hops, seen.groupBy("qid").agg(F.count("*").alias("expanded"))]
            if layout is not None:
                tallies.append(seen.join(layout.select("id", "page"), "id").groupBy("qid").agg(F.countDistinct("page").alias("pages")))
            if rescored is not None:
                tallies.append(rescored.groupBy("qid").agg(F.count("*").alias("rescored")))
            for t in tallies:
                work = work.join(t, "qid", "left")
            for c in ("hops", "expanded", "pages", "rescored"):
                work = work.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long") if c in work.columns else F.lit(0).cast("long"))
            out = out.join(work.select("qid", "hops", "expanded", "compared", "pages", "rescored"), "qid")
        return out

    if mode in ("memory", "codes"):
        return answer(pool.where("live = 1"))
    if mode == "rerank":
        cut = truncation(length, keep or length)
        chosen = pool.where("live = 1").withColumn("r", F.row_number().over(by_pool)).where(F.col("r") <= cut)
    else:
        chosen = expanded_rows()
        if mode == "page":
            pages = chosen.join(layout.select("id", "page"), "id").select("qid", "page").distinct()
            chosen = pages.join(layout.select("id", "page"), "page").select("qid", "id").distinct()
        if gone is not None:
            chosen = chosen.join(gone, "id", "left_anti")
    measured = stored(exact(chosen), f"{folder}/exact")
    return answer(measured, measured)


PAGE_FRONT = "qid long, id long"


def _with_pages(pool: DataFrame, front: DataFrame, layout: DataFrame, measure, length: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(front, mates): the rows to expand of a round that reads whole pages, and the other rows (qid, id, dist, live) on the front's pages that the pool doesn't hold.

    The front takes in what lies on its pages and is as near as the pool's last
    row, or anything there while a pool isn't full.
    """
    pages = front.join(layout.select("id", "page"), "id").select("qid", "page").distinct()
    there = stored(pages.join(layout.select("id", "page"), "page").select("qid", "id"), f"{folder}/there")
    mates = stored(measure(there.join(pool.select("qid", "id"), ["qid", "id"], "left_anti"), there.count() <= FEW), f"{folder}/mates")
    last = pool.groupBy("qid").agg(F.when(F.sum("live") >= length, F.max("dist")).otherwise(F.lit(float("inf"))).alias("last"))
    near = mates.join(last, "qid").where("dist <= last").select("qid", "id")
    held = there.join(pool.where("NOT expanded").select("qid", "id"), ["qid", "id"], "left_semi")
    both = front.unionByName(held).unionByName(near).distinct()
    return stored(both.select("qid", "id"), f"{folder}/front"), mates


def with_tags(found: DataFrame, tags: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Answers with the tags of their rows (a row without one has its id) and, if asked for, their vectors."""
    out = found.join(tags.select("id", "tag"), "id", "left").withColumn("tag", F.coalesce("tag", "id"))
    return out if vectors is None else out.join(vectors.select("id", "vec"), "id")


#: The bits of a search strategy.
STRATEGY = ("rerank", "topology_order", "two_books", "vector_order", "topology_buffer", "neighbour_cache", "truncate", "three_books", "page_compute")


def strategy(bits: int) -> dict[str, bool]:
    """The options that the bits of a strategy name."""
    if bits < 0 or bits >> len(STRATEGY):
        raise ValueError(f"no such strategy: {bits}")
    return {name: bool(bits >> i & 1) for i, name in enumerate(STRATEGY)}


def search_options(bits: int, keep: int = 40) -> dict[str, object]:
    """What search() takes for a strategy: its mode and, where the pool is cut, `keep`.

    Order and two books are properties of the tables that are searched (see
    layout and pq.dual); buffers and caches are Spark's and change no result;
    a third book has no counterpart and raises.
    """
    on = strategy(bits)
    if on["three_books"]:
        raise ValueError("there is no third codebook")
    mode = "page" if on["page_compute"] else "rerank" if on["rerank"] else "beam"
    return {"mode": mode} | ({"keep": keep} if on["truncate"] and mode == "rerank" else {})

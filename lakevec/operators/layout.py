"""Which rows lie on a page together, so that a traversal finds near rows side by side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakevec.functions.keyed import FEW, Keyed, keyed
from lakevec.functions.storage import placed, stored, work_folder
from lakevec.operators import cluster

#: Neighbours of a row, nearest first, that it may share a page with.
NEAREST = 8


def joined(ids: np.ndarray, a: np.ndarray, b: np.ndarray, rank: np.ndarray, capacity: int) -> np.ndarray:
    """The group of each row, the place of its first row among ids (sorted): edges (a, b), nearest first, join groups while they fit a page."""
    place = {int(x): i for i, x in enumerate(ids)}
    root, size = list(range(len(ids))), [1] * len(ids)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for e in np.lexsort((b, a, rank)):
        x, y = place.get(int(a[e])), place.get(int(b[e]))
        if x is None or y is None:
            continue
        x, y = find(x), find(y)
        if x != y and size[x] + size[y] <= capacity:
            x, y = min(x, y), max(x, y)
            root[y] = x
            size[x] += size[y]
    return np.array([find(x) for x in root], np.int64)


def filled(group: np.ndarray, capacity: int) -> np.ndarray:
    """The page of each row, from 0: groups of at most capacity rows fill pages, largest first."""
    groups: dict[int, list[int]] = {}
    for i, g in enumerate(group):
        groups.setdefault(int(g), []).append(i)
    page, room, at = np.zeros(len(group), np.int64), [], {}  # at: the pages with so much room
    for _, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
        need = len(members)
        free = next((r for r in range(need, capacity + 1) if at.get(r)), None)
        if free is None:
            room.append(capacity)
            p = len(room) - 1
        else:
            p = at[free].pop()
        room[p] -= need
        at.setdefault(room[p], []).append(p)
        page[members] = p
    return page


def _numbered(key: str, of: int, ids: np.ndarray, page: np.ndarray) -> pa.Table:
    order = np.lexsort((ids, page))
    ids, page = ids[order], page[order]
    slot = np.arange(len(ids)) - np.searchsorted(page, page)
    return pa.table({key: pa.array(np.full(len(ids), of, np.int64)), "id": ids, "page": page, "slot": slot.astype(np.int32)})


def _packed(rows: DataFrame, edges: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, id, page, slot): the rows of each group in pages of their own, numbered from 0."""

    def run(members: pa.Table, near: pa.Table) -> pa.Table:
        ids = np.sort(members.column("id").to_numpy())
        group = joined(ids, near.column("a").to_numpy(), near.column("b").to_numpy(), near.column("rank").to_numpy(), capacity)
        return _numbered(key, members.column(key)[0].as_py() if len(ids) else 0, ids, filled(group, capacity))

    edges = edges.withColumn("group", F.col(key)).drop(key)
    return rows.groupBy(key).cogroup(edges.groupBy("group")).applyInArrow(run, f"{key} long, id long, page long, slot int")


def _nearest_edges(topology: DataFrame) -> DataFrame:
    return topology.select(F.col("id").alias("a"), F.posexplode(F.slice("nbrs", 1, NEAREST)).alias("rank", "b"))


def _groups(rows: DataFrame, edges: DataFrame, capacity: int) -> DataFrame:
    """(part, id, grp) of rows(part, id, alone): what the edges inside a part join there; grp is the least id. Rows that are to stay alone do."""

    def run(members: pa.Table, near: pa.Table) -> pa.Table:
        ids, alone = members.column("id").to_numpy(), members.column("alone").to_numpy(zero_copy_only=False).astype(bool)
        alone, order = ids[alone], np.argsort(ids)
        ids, a, b = ids[order], near.column("a").to_numpy(), near.column("b").to_numpy()
        free = ~(np.isin(a, alone) | np.isin(b, alone))
        group = joined(ids, a[free], b[free], near.column("rank").to_numpy()[free], capacity)
        return pa.table({"part": pa.array(np.full(len(ids), members.column("part")[0].as_py() if len(ids) else 0, np.int64)), "id": ids, "grp": ids[group]})

    return rows.groupBy("part").cogroup(edges.withColumnRenamed("part", "of").groupBy("of")).applyInArrow(run, "part long, id long, grp long")


def matched(sizes: DataFrame, edges: DataFrame, capacity: int = 16, rounds: int = 8, folder: str | None = None) -> DataFrame:
    """(grp, to): where each group of sizes(grp, size) goes when edges(x, y, rank, n), x < y and one row a pair, join groups that fit a page together.

    In each round every group names its best edge that would fit: least rank,
    then most edges n, then least x and y. Pairs that name each other become
    one group, called by the lesser, and their edges are added up. The order is
    the same from both ends, so the best edge of all is always taken. It ends when
    nothing more fits, or after `rounds` rounds: groups are then still whole, with less
    in them. Minimums and sums combine before each shuffle, so a group with
    very many edges is no hot group.
    """
    spark = sizes.sparkSession
    folder = folder or work_folder(spark, "matching")
    went = sizes.select("grp", F.col("grp").alias("to"))
    for r in range(rounds):
        end = sizes.select(F.col("grp").alias("y"), F.col("size").alias("more"))
        fit = edges.join(sizes.withColumnRenamed("grp", "x"), "x").join(end, "y").where(F.col("size") + F.col("more") <= capacity)
        fit = stored(fit.select("x", "y", "rank", "n"), f"{folder}/fit-{r}")  # what doesn't fit now never will
        edge = F.struct("rank", (-F.col("n")).alias("n"), "x", "y")
        named = fit.select(F.explode(F.array("x", "y")).alias("grp"), edge.alias("edge")).groupBy("grp").agg(F.min("edge").alias("edge"))
        merge = named.groupBy("edge.x", "edge.y").agg(F.count("*").alias("c")).where("c = 2")
        merge = stored(merge.select(F.col("y").alias("grp"), F.col("x").alias("into")), f"{folder}/merge-{r}")
        if not merge.limit(1).count():
            break
        sizes = sizes.join(merge, "grp", "left").groupBy(F.coalesce("into", "grp").alias("grp")).agg(F.sum("size").alias("size"))
        sizes = stored(sizes, f"{folder}/sizes-{r}")
        went = went.join(merge.withColumnRenamed("grp", "to"), "to", "left").select("grp", F.coalesce("into", "to").alias("to"))
        went = stored(went, f"{folder}/went-{r}")
        for c in ("x", "y"):
            fit = fit.join(merge.select(F.col("grp").alias(c), "into"), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")
        fit = fit.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        edges = fit.agg(F.min("rank").alias("rank"), F.sum("n").alias("n"))
    return went


def pages(topology: DataFrame, vectors: DataFrame, capacity: int = 16, part: int = 4096, rounds: int = 8) -> DataFrame:
    """(id, page, slot): near rows together, at most capacity on a page.

    Rows lie in parts of near rows of bounded size (cluster.parts). Inside a
    part rows and their nearest neighbours are joined group by group; a row
    whose nearest neighbour lies in another part waits. Then groups of all parts
    are matched over the edges that lead out of them (matched), and groups fill pages
    with others whose least row lies in the same part. A part thus packs at most `capacity`
    times its rows.
    """
    folder = work_folder(topology.sparkSession, "pages")
    rows = cluster.parts(vectors.select("id", "vec"), folder, part).select(F.col("part").alias("part"), "id")
    rows = stored(topology.select("id").join(rows, "id", "left").select(F.coalesce("part", F.lit(0)).cast("long").alias("part"), "id"), f"{folder}/rows")
    ends = _nearest_edges(topology).join(rows.select("part", F.col("id").alias("a")), "a").join(rows.select(F.col("part").alias("other"), F.col("id").alias("b")), "b")
    ends = stored(ends.where("a <> b").select("part", "other", "a", "b", "rank"), f"{folder}/ends")
    inside = ends.where("part = other").select("part", "a", "b", "rank")
    if not ends.where("part <> other").limit(1).count():
        local = stored(_packed(rows, inside, "part", capacity), f"{folder}/local")
    else:
        waiting = ends.where("part <> other AND rank = 0").select(F.col("a").alias("id"), F.lit(True).alias("alone"))
        rows = rows.join(waiting, "id", "left").select("part", "id", F.coalesce("alone", F.lit(False)).alias("alone"))
        groups = stored(_groups(rows, inside, capacity), f"{folder}/groups")
        edges = ends.join(groups.select(F.col("id").alias("a"), F.col("grp").alias("x")), "a").join(groups.select(F.col("id").alias("b"), F.col("grp").alias("y")), "b").where("x <> y")
        edges = edges.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
        to = matched(groups.groupBy("grp").agg(F.count("*").alias("size")), edges, capacity, rounds, folder)
        groups = groups.join(to, "grp").select("id", F.col("to").alias("grp"))
        groups = groups.join(rows.select(F.col("id").alias("grp"), "part"), "grp")  # a group is called by its least row

        def fill(t: pa.Table) -> pa.Table:
            return _numbered("part", t.column("part")[0].as_py(), t.column("id").to_numpy(), filled(t.column("grp").to_numpy(), capacity))

        local = stored(groups.select("part", "id", "grp").groupBy("part").applyInArrow(fill, "part long, id long, page long, slot int"), f"{folder}/local")
    sizes = local.groupBy("part").agg((F.max("page") + 1).alias("n"))
    first = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))  # a row for each part
    return local.join(first, "part").select("id", (F.col("first") + F.col("page")).alias("page"), "slot")


def with_new_rows(layout: DataFrame, topology: DataFrame, new: DataFrame, capacity: int = 16) -> DataFrame:
    """layout with the rows of new(id), placed by changed_by. Other pages are not touched."""
    changed = changed_by(layout, topology, topology.join(new.select("id").distinct(), "id", "left_semi"), new, capacity)
    return layout.select("id", "page", "slot").join(changed.select("id"), "id", "left_anti").unionByName(changed)


def changed_by(layout: DataFrame, topology: DataFrame | Keyed, lists: DataFrame, new: DataFrame, capacity: int = 16, choices: int = 2, rounds: int = 3) -> DataFrame:
    """(id, page, slot) of the rows that get a place, or another one, when new(id) come in; lists (id, nbrs) has those of new and is laid over topology.

    In each round a row without a place bids for the pages of its `choices`
    nearest placed neighbours, rows placed in earlier rounds included; it goes
    for the nearest one with room, and a page takes the nearest bidders it has
    room for, into its free slots. Who finds all its pages full goes to the first of
    them: that page is split by the edges of its rows, keeps its number for its
    first group, and the others get numbers behind the last page. Rows without a
    placed neighbour fill pages together. Only pages that get rows are read, and of
    topology only the lists of rows on split pages.
    """
    spark = lists.sparkSession
    folder = work_folder(spark, "splits")
    fresh = stored(new.select("id").distinct().join(layout.select("id"), "id", "left_anti"), f"{folder}/fresh")
    near = stored(lists.join(fresh, "id", "left_semi").select("id", F.posexplode("nbrs").alias("pos", "nbr")), f"{folder}/near")
    ends = stored(near.select(F.col("nbr").alias("id")).distinct(), f"{folder}/ends")
    at = stored(layout.select("id", "page").join(F.broadcast(ends) if ends.count() <= FEW else ends, "id"), f"{folder}/at")
    pages = at.select("page").distinct()
    used = stored(layout.join(F.broadcast(pages) if at.count() <= FEW else pages, "page", "left_semi").select("id", "page", "slot"), f"{folder}/used")
    placed_rows = spark.createDataFrame([], "id long, page long, slot int")
    for r in range(rounds):
        known = at.unionByName(placed_rows.select("id", "page"))
        bids = near.join(placed_rows.select("id"), "id", "left_anti").join(known.withColumnRenamed("id", "nbr"), "nbr")
        bids = bids.groupBy("id", "page").agg(F.min("pos").alias("pos"))
        bids = bids.withColumn("choice", F.row_number().over(W.partitionBy("id").orderBy("pos", "page"))).where(F.col("choice") <= choices)
        slots = used.select("page", "slot").unionByName(placed_rows.select("page", "slot")).groupBy("page").agg(F.collect_set("slot").alias("taken"))  # at most capacity of a page
        room = slots.select("page", F.array_except(F.sequence(F.lit(0), F.lit(capacity - 1)), "taken").alias("free")).where("size(free) > 0")
        bids = bids.join(room, "page")
        best = bids.groupBy("id").agg(F.min_by(F.struct("page", "pos", "free"), "choice").alias("x")).select("id", "x.*")
        best = best.withColumn("turn", F.row_number().over(W.partitionBy("page").orderBy("pos", "id"))).where(F.col("turn") <= F.size("free"))
        won = stored(best.select("id", "page", F.element_at("free", F.col("turn")).alias("slot")), f"{folder}/won-{r}")
        if not won.limit(1).count():
            break
        placed_rows = stored(placed_rows.unionByName(won), f"{folder}/placed-{r}")
    left = stored(fresh.join(placed_rows.select("id"), "id", "left_anti"), f"{folder}/left")
    if not left.limit(1).count():
        return placed_rows
    known = at.unionByName(placed_rows.select("id", "page"))
    first = near.join(left, "id", "left_semi").join(known.withColumnRenamed("id", "nbr"), "nbr").groupBy("id").agg(F.min(F.struct("pos", "page")).alias("x")).select("id", "x.page")
    wanted = left.join(first, "id", "left")
    wanted = stored(wanted.select("id", F.coalesce("page", F.lit(-1) - F.pmod(F.xxhash64("id"), F.lit(64))).alias("page")), f"{folder}/wanted")
    full = wanted.select("page").distinct()
    there = used.unionByName(placed_rows.select("id", "page", "slot")).join(full, "page", "left_semi").select("id", "page")
    rows = stored(there.unionByName(wanted).withColumnRenamed("page", "home"), f"{folder}/rows")
    old = rows.select("id", "home").join(lists.select("id"), "id", "left_anti")
    own = keyed(topology).join(old, old.count() <= FEW).select("home", "id", "nbrs").unionByName(lists.join(rows, "id").select("home", "id", "nbrs"))
    edges = own.select("home", F.col("id").alias("a"), F.posexplode(F.slice("nbrs", 1, NEAREST)).alias("rank", "b"))
    local = stored(_packed(rows, edges, "home", capacity), f"{folder}/local")
    more = local.where("page > 0 OR home < 0").select("home", "page").distinct()
    last = layout.agg(F.coalesce(F.max("page"), F.lit(-1)).alias("last"))
    more = placed(more, "home", "page").crossJoin(F.broadcast(last)).select("home", "page", (F.col("last") + 1 + F.col("place")).alias("to"))  # last is one row
    moved = local.join(more, ["home", "page"], "left").select("id", F.coalesce("to", "home").alias("page"), "slot")
    moved = stored(moved, f"{folder}/moved")
    before = used.select("id", F.col("page").alias("p"), F.col("slot").alias("s"))
    moved = moved.join(before, "id", "left").where("p IS NULL OR p <> page OR s <> slot").select("id", "page", "slot")
    return placed_rows.join(moved.select("id"), "id", "left_anti").unionByName(moved)


def locality(topology: DataFrame, layout: DataFrame, nearest: int = 2) -> DataFrame:
    """One row: share of the edges to the nearest rows that stay on a page, and how full pages are at `capacity` rows, the fullest page's."""
    at = layout.select("id", "page")
    edges = topology.select("id", F.explode(F.slice("nbrs", 1, nearest)).alias("nbr")).join(at, "id").join(at.select(F.col("id").alias("nbr"), F.col("page").alias("other")), "nbr")
    sizes = at.groupBy("page").agg(F.count("*").alias("n"))
    fill = sizes.agg((F.sum("n") / (F.count("*") * F.max("n"))).alias("fill"))
    return edges.agg(F.avg((F.col("page") == F.col("other")).cast("double")).alias("same_page")).crossJoin(fill)


def reordered(table: DataFrame, layout: DataFrame) -> DataFrame:
    """table in the order of the layout: range-partitioned by page and sorted inside, for narrow row groups."""
    return table.join(layout, "id").repartitionByRange("page").sortWithinPartitions("page", "slot")


def neighbourhood(topology: DataFrame, entries: DataFrame, hops: int) -> DataFrame:
    """(id, hop): rows at most hops edges from an entry point, for a cache."""
    seen = entries.select("id", F.lit(0).alias("hop"))
    front = seen
    for h in range(1, hops + 1):
        front = front.join(topology, "id").select(F.explode("nbrs").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").select("id", F.lit(h).alias("hop"))
        seen = seen.unionByName(front)
    return seen

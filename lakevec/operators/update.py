"""Inserts, lazy deletes, repair of the graph after deletes, renumbering, and update traces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakevec.functions.keyed import FEW, Keyed, keyed, rows_of
from lakevec.functions.storage import placed, stored, work_folder
from lakevec.operators import cluster
from lakevec.operators.graph import Coder, GraphParams, link_back, near_in_parts, prune, search
from lakevec.operators.metrics import SOUND


def lazy_delete(tombstones: DataFrame, tags: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tombstones, failed): tombstones with the known tags, each once, and the tags that aren't live."""
    known = tags.select("id").distinct().join(live.select("id"), "id", "left_semi")
    failed = tags.select("id").distinct().join(live.select("id"), "id", "left_anti")
    return tombstones.select("id").unionByName(known).distinct(), failed


def active(live: DataFrame, tombstones: DataFrame) -> DataFrame:
    return live.join(tombstones.select("id").distinct(), "id", "left_anti")


def lists_naming(topology: DataFrame, gone: DataFrame) -> DataFrame:
    """topology (id, nbrs) of the rows that aren't gone but have a neighbour that is.

    Few gone ids travel to where the lists lie, which are then read once and
    neither moved nor taken apart.
    """
    gone = gone.select("id").distinct()
    if gone.count() > FEW:
        hurt = topology.select("id", F.explode("nbrs").alias("nbr")).join(gone.select(F.col("id").alias("nbr")), "nbr", "left_semi").select("id").distinct()
        return topology.join(hurt, "id", "left_semi").join(gone, "id", "left_anti").select("id", "nbrs")
    sent = topology.sparkSession.sparkContext.broadcast(np.sort(np.array([r["id"] for r in gone.collect()], np.int64)))  # at most FEW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("nbrs")
            named = np.isin(lists.flatten().to_numpy(), sent.value)
            owner = lists.value_parent_indices().to_numpy()
            hurt = np.bincount(owner[named], minlength=b.num_rows) > 0
            yield b.filter(pa.array(hurt & ~np.isin(b.column("id").to_numpy(), sent.value)))

    return topology.select("id", "nbrs").mapInArrow(run, "id long, nbrs array<long>")


def repaired_neighbours(topology: DataFrame | Keyed, tombstones: DataFrame, sampled: int = 20, hurt: DataFrame | None = None) -> DataFrame:
    """(id, nbr) of the live nodes that point to deleted ones: those are replaced by their own first live neighbours. hurt: the lists of these nodes, if they are known."""
    gone = tombstones.select("id").distinct()
    hurt = lists_naming(rows_of(topology), gone) if hurt is None else hurt
    dead = gone.select(F.col("id").alias("nbr"))
    edges = keyed(topology).join(gone).select("id", F.posexplode("nbrs").alias("pos", "nbr")).join(dead, "nbr", "left_anti")
    heirs = edges.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("pos"))).where(F.col("r") <= sampled).select(F.col("id").alias("dead"), F.col("nbr").alias("heir"))
    own = hurt.select("id", F.explode("nbrs").alias("nbr"))
    come = own.join(heirs, own["nbr"] == heirs["dead"]).select("id", F.col("heir").alias("nbr"))
    return own.join(dead, "nbr", "left_anti").select("id", "nbr").unionByName(come).where("id <> nbr").distinct()


def replaced_entries(topology: DataFrame, entries: DataFrame, tombstones: DataFrame, live: DataFrame, rounds: int = 3) -> DataFrame:
    """entries without deleted ones: each gives way to its first live neighbour or, without one, to its first neighbour's, some rounds long; if none is left at all, to the least live id."""
    gone = tombstones.select("id").distinct()
    kept, lost = entries.select("id").join(gone, "id", "left_anti"), entries.select("id").join(gone, "id", "left_semi")
    for _ in range(rounds):
        near = lost.select(F.col("id").alias("entry")).join(topology.select(F.col("id").alias("entry"), F.posexplode("nbrs").alias("pos", "id")), "entry")
        near = near.join(gone.withColumn("dead", F.lit(1)), "id", "left").groupBy("entry").agg(F.min(F.struct(F.coalesce("dead", F.lit(0)).alias("dead"), "pos", "id")).alias("x")).select("x.dead", "x.id")
        kept, lost = kept.unionByName(near.where("dead = 0").select("id")), near.where("dead = 1").select("id").distinct()
    found = kept.distinct()
    none = found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("one"))
    least = live.agg(F.min("id").alias("id")).where("id IS NOT NULL").join(none, F.col("one") == 1).select("id")
    return found.unionByName(least)


@dataclass
class Delta:
    """What an update changes: new or changed lists, ids that go, new vectors. Small against the tables it goes on."""

    topology: DataFrame  # (id, nbrs)
    gone: DataFrame  # (id)
    vectors: DataFrame  # (id, vec)

    def on_topology(self, topology: DataFrame) -> DataFrame:
        return topology.join(self.topology.select("id").unionByName(self.gone), "id", "left_anti").unionByName(self.topology)

    def on_vectors(self, vectors: DataFrame) -> DataFrame:
        return vectors.join(self.vectors.select("id").unionByName(self.gone), "id", "left_anti").unionByName(self.vectors)


def deletion(topology: DataFrame | Keyed, vectors: DataFrame | Keyed, tombstones: DataFrame, params: GraphParams | None = None, coder: Coder | None = None) -> Delta:
    """The changed lists after deletes: nodes that pointed to deleted rows get new ones, pruned on exact distances or, with a coder, on those between codes."""
    p, spark = params or GraphParams(), tombstones.sparkSession
    folder = work_folder(spark, "deletion")
    gone = tombstones.select("id").distinct()
    hurt = stored(lists_naming(rows_of(topology), gone), f"{folder}/hurt")
    candidates = stored(repaired_neighbours(topology, gone, hurt=hurt), f"{folder}/candidates")
    changed = stored(prune(candidates, coder or vectors, p.degree, p.alpha, p.candidates, p.saturate), f"{folder}/changed")
    bare = hurt.select("id").join(changed.select("id"), "id", "left_anti").select("id", F.array().cast("array<long>").alias("nbrs"))
    return Delta(stored(changed.unionByName(bare), f"{folder}/topology"), gone, rows_of(vectors).limit(0).select("id", "vec"))


def consolidate(topology: DataFrame, vectors: DataFrame, entries: DataFrame, tombstones: DataFrame, params: GraphParams | None = None, coder: Coder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topology, vectors, entries) without the deleted rows; only the lists of nodes that pointed to one are written, the rest is read as it lies."""
    delta = deletion(topology, vectors, tombstones, params, coder)
    live = delta.on_vectors(vectors)
    starts = replaced_entries(topology, entries, tombstones, live)
    return delta.on_topology(topology), live, stored(starts, f"{work_folder(topology.sparkSession, 'consolidate')}/entries")


def next_epoch(tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frozen, tombstones): of tombstones (id, epoch) the set to merge away, and all of them with the next epoch open.

    Searches go on to leave out both (all ids of tombstones); deletes that come
    in during the merge get the new epoch and stay when the frozen set goes.
    """
    last = tombstones.agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("e"))
    return tombstones.join(F.broadcast(last), F.col("epoch") <= F.col("e")).select("id").distinct(), tombstones


def deleted_in(tombstones: DataFrame, ids: DataFrame, epoch: int) -> DataFrame:
    """tombstones (id, epoch) with more ids; an id keeps the epoch in which it was deleted first."""
    return tombstones.select("id", "epoch").unionByName(ids.select("id", F.lit(epoch).alias("epoch"))).groupBy("id").agg(F.min("epoch").alias("epoch"))


def merge_deletes(topology: DataFrame, vectors: DataFrame, entries: DataFrame, tags: DataFrame, frozen: DataFrame, params: GraphParams | None = None, coder: Coder | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The first four tables of merged()."""
    return merged(topology, vectors, entries, tags, frozen, params, coder)[:4]


def merged(topology: DataFrame, vectors: DataFrame, entries: DataFrame, tags: DataFrame, frozen: DataFrame, params: GraphParams | None = None, coder: Coder | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(topology, vectors, entries, tags, ids (id, new_id)) without the frozen rows and with dense new ids; tags keep naming the same vectors.

    A row without a tag has its id as one, which is written out before the ids change.
    """
    new, live, starts = consolidate(topology, vectors, entries, frozen, params, coder)
    ids = stored(renumber(live), f"{work_folder(topology.sparkSession, 'merge')}/ids")

    def moved(df: DataFrame) -> DataFrame:
        return df.join(ids, "id").drop("id").withColumnRenamed("new_id", "id")

    edges = new.select("id", F.posexplode_outer("nbrs").alias("pos", "nbr")).join(ids.select(F.col("id").alias("nbr"), F.col("new_id").alias("to")), "nbr", "left")
    lists = moved(edges.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("to").isNotNull(), F.struct("pos", "to")))), lambda x: x["to"]).alias("nbrs")))
    named = live.select("id").join(tags, "id", "left").select("id", F.coalesce("tag", "id").alias("tag"))
    return lists.select("id", "nbrs"), moved(live).select("id", "vec"), moved(starts).select("id"), moved(named).select("id", "tag"), ids


def renumber(live: DataFrame) -> DataFrame:
    """(id, new_id): dense numbers from 0 in the order of ids."""
    return placed(live.select("id"), "id").select("id", F.col("place").alias("new_id"))


def insertion(new: DataFrame, vectors: DataFrame | Keyed, topology: DataFrame | Keyed, entries: DataFrame, params: GraphParams | None = None, length: int = 64, tombstones: DataFrame | None = None, coder: Coder | None = None, codes: DataFrame | None = None) -> Delta:
    """The lists of new rows and those that change by them: a batch costs what it touches.

    Each new row is searched for; what it finds and its nearest rows of the batch
    are its candidates, pruned on exact distances. Its neighbours take the new
    edge in, one after the other, and evict one each over the degree. With a
    coder, and the codes (id, codes) of the new rows, all of this is on code
    distances, and no stored vector is read. A live id that comes again replaces
    its row. A row that finds nothing gets an empty list. Rows of new without a
    sound vector are left out.
    """
    p, spark = params or GraphParams(), new.sparkSession
    folder = work_folder(spark, "insertion")
    new = stored(new.where(SOUND.format("vec")).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).dropDuplicates(["id"]), f"{folder}/new")
    old, old_vectors = keyed(topology), keyed(vectors)
    again = stored(old.join(new.select("id")).select("id"), f"{folder}/again")
    if again.limit(1).count():
        old, old_vectors = old.without(again), old_vectors.without(again)
        tombstones = tombstones.join(again, "id", "left_anti") if tombstones is not None else None
        entries = entries.join(again, "id", "left_anti")
        coder = coder and coder.over(keyed(coder.codes).without(again))
    asked = new.selectExpr("id AS qid", "vec AS qvec")
    found = search(asked, old_vectors, old, entries, k=length, length=length, width=max(8, length), tombstones=tombstones, **({"mode": "codes", "coder": coder} if coder else {}))
    among = near_in_parts(cluster.parts(new, folder, p.part), p)
    candidates = found.selectExpr("qid AS id", "id AS nbr").unionByName(among).unionByName(among.selectExpr("nbr AS id", "id AS nbr"))
    if coder:
        every = coder.over(keyed(coder.codes).over(codes))
    else:
        every = Keyed(old_vectors.base.select("id", F.col("vec").cast("array<double>").alias("vec")), old_vectors.changed).over(new)
    linked = stored(prune(candidates, every, p.degree, p.alpha, p.candidates, p.saturate), f"{folder}/linked")
    linked = linked.unionByName(new.select("id").join(linked.select("id"), "id", "left_anti").select("id", F.array().cast("array<long>").alias("nbrs")))
    back = stored(linked.select(F.explode("nbrs").alias("id"), F.col("id").alias("nbr")), f"{folder}/back")
    ends = stored(back.select("id").distinct(), f"{folder}/ends")
    hit = old.join(ends).select("id", "nbrs").unionByName(linked.join(ends, "id", "left_semi")).select("id", F.explode("nbrs").alias("nbr"))
    changed = stored(link_back(stored(hit, f"{folder}/hit"), back, every, p.degree, p.alpha, p.candidates + p.degree), f"{folder}/changed")
    return Delta(linked.join(changed.select("id"), "id", "left_anti").unionByName(changed), new.select("id").limit(0), new)


def insert(new: DataFrame, vectors: DataFrame, topology: DataFrame, entries: DataFrame, params: GraphParams | None = None, length: int = 64, tombstones: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(topology, vectors) with the rows of new: see insertion(). Lists and vectors that don't change are read as they lie."""
    delta = insertion(new, vectors, topology, entries, params, length, tombstones)
    return delta.on_topology(topology), delta.on_vectors(vectors.select("id", F.col("vec").cast("array<double>").alias("vec")))


def trace(base: DataFrame, n: int, batch: int, steps: int) -> DataFrame:
    """(step, op, id): step i deletes the ids of [i b, (i + 1) b) and inserts those of [n + i b, n + (i + 1) b)."""
    ids = base.select("id")
    gone = ids.where((F.col("id") >= 0) & (F.col("id") < steps * batch)).select((F.col("id") / batch).cast("int").alias("step"), F.lit("delete").alias("op"), "id")
    come = ids.where((F.col("id") >= n) & (F.col("id") < n + steps * batch)).select(((F.col("id") - n) / batch).cast("int").alias("step"), F.lit("insert").alias("op"), "id")
    return gone.unionByName(come)

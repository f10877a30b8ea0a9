"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A document's MinHash signature is cut into trees; in each tree it is a path of
DEPTH hashed minimums, and the paths, sorted, are a prefix trie whose nodes are
the documents that share a prefix. Nodes are looked into from the deepest on:
their documents are compared exactly, then the matched prefix is shortened by
one and the nodes are looked into where shorter prefixes bring documents
together that longer ones kept apart. The verified links tell how many links
the forest must still miss: a pair of similarity s shares a prefix of d in one
of the trees with the probability 1 - (1 - s^d)^trees. When the recall that
follows reaches the target, the shortening ends.

Documents with the same shingles are one vertex from the start. A node's
documents go to tasks in blocks, where pairs are compared; a pair that meets in
several nodes counts in the first alone. Only counts of links and as many
links as tie the node's documents together leave a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.llm.common import connected_components, discard, stored, work_folder
from lakevec.llm.language_id import flat_bytes

#: Trees, longest and, at a threshold of 0.8, shortest matched prefix, and the recall of links at which the prefix is shortened no further.
TREES, DEPTH, LEAST_DEPTH, TARGET = 24, 8, 5, 0.9999
#: Shingles and documents of one block of a node, about: all pairs of a block's documents are a matrix in one task.
BLOCK_SHINGLES, BLOCK_DOCS = 400_000, 2048
#: Bytes handled at once in the signature step.
PIECE = 1 << 21

_WORD = np.ones(256, bool)  # bytes of words: the ASCII letters and digits and all others from 0x80
_WORD[np.r_[0:0x30, 0x3A:0x41, 0x5B:0x61, 0x7B:0x80]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def meeting(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """The probability that a pair shares a prefix of that depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float, depth: int, trees: int, target: float = TARGET) -> int:
    """The longest prefix at which pairs of the threshold's similarity still meet with a probability of target; raises where even one step is too long."""
    for d in range(depth, 0, -1):
        if meeting(threshold, d, trees) >= min(target, TARGET):
            return d
    raise ValueError(f"{trees} trees can't find pairs of similarity {threshold} with a recall of {min(target, TARGET)}")


def forest_recall(links: dict[int, int], depth: int, trees: int) -> float:
    """The recall at a depth from the links found there, counted by similarity in thousandths: each stands for 1 / meeting() links."""
    found = sum(links.values())
    return found / sum(n / meeting(s / 1000, depth, trees) for s, n in links.items()) if found else 1.0


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's word n-grams in order, as 64-bit hashes.

    Words are runs of ASCII letters, digits and bytes from 0x80, A-Z
    lower-cased. A text with fewer words than n, but some, has one shingle.
    """
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    inside = _WORD[data]
    first = inside.copy()
    cut = np.zeros(size + 1, bool)
    cut[offsets] = True
    first[1:] &= ~inside[:-1] | cut[1:size]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:size]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    # Horner's scheme modulo 2^64: a byte weighs a power of an odd number by its place in the word.
    place = np.arange(size) - np.repeat(begin, np.diff(np.append(begin, size))) if len(begin) and begin[0] == 0 else None
    if place is None:
        owner = np.searchsorted(begin, np.arange(size), "right") - 1
        place = np.where(owner >= 0, np.arange(size) - (begin[np.maximum(owner, 0)] if len(begin) else 0), 0)
    powers = np.ones(int(place.max(initial=0)) + 1, np.uint64)
    powers[1:] = _ODD
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(inside, (low.astype(np.uint64) + np.uint64(1)) * powers[place], np.uint64(0)), dtype=np.uint64)])
    word = mix(sums[end] - sums[begin] + (end - begin).astype(np.uint64))
    count = np.searchsorted(begin, offsets[1:], "left") - np.searchsorted(begin, offsets[:-1], "left")
    at = np.concatenate([[0], np.cumsum(count)])
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(grams)])
    owner = np.repeat(np.arange(len(count)), grams)
    start = at[:-1][owner] + np.arange(out_at[-1]) - out_at[:-1][owner]
    width = np.minimum(count, n)[owner]
    out = np.zeros(len(start), np.uint64)
    padded = np.concatenate([word, np.zeros(n, np.uint64)])
    for i in range(n):
        out = np.where(i < width, mix(out * _ODD + padded[start + i] + np.uint64(i + 1)), out)
    return out, out_at


def sorted_sets(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted and without repeats."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(at) - 1))]).astype(np.int64)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about PIECE bytes."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        yield lo, hi
        lo = hi


def text_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, hashes, offsets): the shingle sets of rows lo to hi."""
    data, offsets = flat_bytes(column)
    for lo, hi in _pieces(data, offsets):
        yield lo, hi, *sorted_sets(*shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n))


def _bits(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _signed(n: int, trees: int, depth: int):
    """Rows with their text to the same rows with two hashes of their shingle set, its size and the paths of the trees, 4 bytes a step."""
    factors = np.random.default_rng(20240229).integers(1, 2**63, size=trees * depth, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [x for x in b.schema.names if x != "text"]
            for lo, hi, hashes, at in text_sets(b.column("text"), n):
                full = np.flatnonzero(np.diff(at) > 0)
                sums = [np.zeros(hi - lo, np.uint64) for _ in range(2)]
                paths = np.zeros((hi - lo, trees * depth), "<u4")
                if len(full):
                    starts = at[:-1][full]
                    for i, s in enumerate(sums):
                        s[full] = mix(np.add.reduceat(mix(hashes + np.uint64(i * 77 + 1)), starts) + np.diff(at)[full].astype(np.uint64))
                    for k, factor in enumerate(factors):
                        f = hashes * factor
                        paths[full, k] = mix(np.minimum.reduceat(f ^ (f >> np.uint64(29)), starts)) >> np.uint64(32)
                part = b.slice(lo, hi - lo)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * trees * depth), hi - lo, [None, pa.py_buffer(paths.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(x) for x in names] + [_bits(s) for s in sums] + [pa.array(np.diff(at)), raw], names=[*names, "s1", "s2", "n_shingles", "paths"])

    return run


def _in_common(sets: list[np.ndarray], na: int | None) -> np.ndarray:
    """How many values each two sets share: all of them or, with na, the first na against the rest. Values of one set alone are left out of the product."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(column, minlength=len(values)) > 1
    keep = common[column]
    row, column, width = row[keep], (np.cumsum(common) - 1)[column[keep]], int(common.sum())
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)) if na is None else (na, len(sets) - na), np.float32)
    step = max(256, 16_000_000 // max(1, len(sets)))
    for lo in range(0, width, step):
        i, j = np.searchsorted(column, [lo, lo + step])
        m = np.zeros((len(sets), min(step, width - lo)), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        shared += m @ m.T if na is None else m[:na] @ m[na:].T
    return shared


def compare_blocks(sets: list[np.ndarray], na: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(near, similarity): which pairs of sets have a Jaccard similarity of the threshold or more; of all or, with na, of the first na with the rest."""
    sizes = np.array([len(x) for x in sets], np.float32)
    shared = _in_common(sets, na)
    whole = sizes[:na, None] + sizes[None, na or 0 :] - shared
    return shared >= threshold * whole - 1e-4, shared / whole


def _tied(near: np.ndarray, na: int | None) -> np.ndarray:
    """The least member that chains of near pairs tie each member to; near is square or, with na, the first na against the rest."""
    n = len(near) if na is None else sum(near.shape)
    label = np.arange(n, dtype=np.int32)

    def least(of: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, of[None, :], n).min(1).astype(np.int32)

    while True:
        near_label = least(label, near) if na is None else np.concatenate([least(label[na:], near), least(label[:na], near.T)])
        new = np.minimum(label, near_label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(threshold: float):
    """A block of a node to rows (v, other, n): n links of v (other -1), n links of similarity v in thousandths (-2), and tied members v, other (0)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "v"])
        node, m = key[0], int((pdf["side"] == 0).sum())
        na = None if key[1] == key[2] else m
        none = pd.DataFrame({"v": [], "other": [], "n": []})
        if na is None and m < 2 or na is not None and (not m or m == len(pdf)):
            return none
        near, similarity = compare_blocks([np.frombuffer(x, np.uint64) for x in pdf["shingles"]], na, threshold)
        if na is None:
            np.fill_diagonal(near, False)
        if not near.any():
            return none
        ids, root = pdf["v"].to_numpy(), _tied(near, na)
        u = np.flatnonzero(root != np.arange(len(root)))
        # Pairs that share a node that was looked into before, or one before this, have been counted there.
        before = [np.array([*old, *(x for x in now if x < node)], np.int64) for old, now in zip(pdf["old"], pdf["now"], strict=True)]
        near &= _in_common(before, na) == 0
        counts = near.sum(1) if na is None else np.concatenate([near.sum(1), near.sum(0)])
        hit = np.flatnonzero(counts)
        at, n = np.unique(np.floor((similarity[np.triu(near) if na is None else near] * 1000).clip(1, 1000)).astype(int), return_counts=True)
        out = [(ids[hit], -1, counts[hit]), (at, -2, n), (ids[u], ids[root[u]], 0)]
        return pd.concat([pd.DataFrame({"v": v, "other": other, "n": c}) for v, other, c in out])

    return run


def _with_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, hashes, at in text_sets(b.column("text"), n):
                raw = [hashes[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column("v").slice(lo, hi - lo), pa.array(raw, pa.binary()), pa.array(np.diff(at))], names=["v", "shingles", "n"])

    return run


def node_blocks(members: DataFrame) -> DataFrame:
    """(node, blocks): into how many blocks the documents (node, n shingles) of a node are cut."""
    wanted = F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count("*") / F.lit(BLOCK_DOCS)))
    return members.groupBy("node").agg(wanted.cast("int").alias("blocks"))


def shared_paths(vertices: DataFrame, trees: int, depth: int, least: int, folder: str) -> DataFrame:
    """The tries: (root, path, v) of the vertices (v, paths) that share a prefix of the least length in a tree, root naming tree and prefix, sorted."""
    step, tree = 4 * depth, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    at = vertices.select("v", "paths", tree).select("v", "tree", F.expr(f"substring(paths, tree * {step} + 1, {4 * least})").alias("prefix"))
    roots = stored(at.select("v", "tree", F.xxhash64("tree", "prefix").alias("root")), f"{folder}/roots")
    several = roots.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    roots = roots.join(several, "root", "left_semi")
    tries = roots.join(vertices.select("v", "paths"), "v").select("root", F.expr(f"substring(paths, tree * {step} + 1, {step})").alias("path"), "v")
    return stored(tries.sortWithinPartitions("root", "path"), f"{folder}/tries")


def nodes_at(tries: DataFrame, d: int, depth: int) -> DataFrame:
    """(node, v): members of the nodes of prefix length d that have more than one child; of nodes of the same members, one."""
    prefix = F.substring("path", 1, 4 * d)
    named = tries.select("v", F.xxhash64("root", prefix).alias("node"), F.xxhash64(F.substring("path", 1, 4 * (d + 1))).alias("child"))
    alike = named.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(3))).alias("y"), F.min("child").alias("c1"), F.max("child").alias("c2"))
    alike = alike.where((F.col("n") > 1) & ((F.lit(d) == depth) | (F.col("c1") != F.col("c2"))))
    kept = alike.groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node")
    return named.select("node", "v").join(kept, "node", "left_semi")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = TREES, depth: int = DEPTH, least: int | None = None, target: float = TARGET) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links): one row for each row of docs.

    copy_of is the least doc_id of the rows with the same set of word n-grams.
    n_links counts the other such sets whose Jaccard similarity is at least the
    threshold, and class_id is the least doc_id among all rows that chains of
    links tie together. A row's vertex is its set, so different texts of one id
    are apart and repeated rows are copies. Rows without an id take part like
    others; a class of such rows alone has a null class_id. Texts without words
    (null, empty) have no shingles and are each a class of their own. Ids are
    integers. Other columns are left out; an empty table gives an empty result.
    The prefix is shortened to `least` steps at most, which by default follow
    from the threshold (least_depth), so links at the threshold are found too.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "jaccard")
    least = least_depth(threshold, depth, trees, target) if least is None else least
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    kind = "row long, doc_id long, h long, s1 long, s2 long, n_shingles long, paths binary"
    keys = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h", "text").mapInArrow(_signed(n, trees, depth), kind), f"{folder}/keys")
    full = keys.where("n_shingles > 0")
    vertices = stored(full.groupBy("s1", "s2").agg(F.min("row").alias("v"), F.min("doc_id").alias("copy_of")), f"{folder}/vertices")
    heads = full.join(vertices.select(F.col("v").alias("row")), "row", "left_semi").select(F.col("row").alias("v"), "doc_id", "h", "paths")
    tries = shared_paths(heads, trees, depth, least, folder)
    wanted = heads.drop("paths").join(tries.select("v").distinct(), "v", "left_semi").withColumnsRenamed({"doc_id": "id", "h": "g"})
    texts = docs.where("text IS NOT NULL").join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g"))).select("v", "text").dropDuplicates(["v"])
    sets = stored(texts.mapInArrow(_with_sets(n), "v long, shingles binary, n long"), f"{folder}/sets")

    met = spark.createDataFrame([], "v long, old array<long>")
    found, links = None, Counter()
    for d in range(depth, least - 1, -1):
        members = stored(nodes_at(tries, d, depth), f"{folder}/nodes-{d}")
        blocks = node_blocks(members.join(sets.select("v", "n"), "v"))
        now = members.groupBy("v").agg(F.collect_list("node").alias("now"))
        placed = members.join(blocks, "node").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
        placed = placed.join(now, "v").join(met, "v", "left").join(sets.drop("n"), "v")
        spread = placed.select("node", "v", "now", F.coalesce("old", F.array().cast("array<long>")).alias("old"), "shingles", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        spread = spread.select("node", "v", "now", "old", "shingles", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).cast("int").alias("side"))
        # Dealt by node and block, or all blocks of a large node would stay with the node in one task.
        spread = spread.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node", "i", "j")
        new = stored(spread.groupBy("node", "i", "j").applyInPandas(_verify(threshold), "v long, other long, n long"), f"{folder}/links-{d}")
        found = new if found is None else found.unionByName(new)
        links.update({r["v"]: r["n"] for r in new.where("other = -2").groupBy("v").agg(F.sum("n").alias("n")).collect()})
        if forest_recall(links, d, trees) >= target:
            break
        met = stored(met.unionByName(now.withColumnRenamed("now", "old")).select("v", F.explode("old").alias("o")).groupBy("v").agg(F.collect_list("o").alias("old")), f"{folder}/met-{d}")
    counts = found.where("other = -1").groupBy("v").agg(F.sum("n").alias("n_links"))
    tied = connected_components(found.where("other >= 0").select(F.col("v").alias("a"), F.col("other").alias("b")), f"{folder}/classes")
    grouped = vertices.select("s1", "s2", "v", "copy_of").join(tied, "v", "left").join(counts, "v", "left").withColumn("label", F.coalesce("label", "v"))
    least_ids = grouped.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    grouped = stored(grouped.join(least_ids, "label").select("s1", "s2", "copy_of", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), f"{folder}/grouped")
    out = keys.select("doc_id", "s1", "s2", "n_shingles").join(grouped, ["s1", "s2"], "left")
    alone = F.col("n_shingles") == 0
    out = out.select("doc_id", *[F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "copy_of")], F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = stored(out, f"{folder}/out")
    for name in ("keys", "grouped", "vertices", "roots", "tries", "sets", "classes", *(f"{x}-{d}" for x in ("nodes", "links", "met") for d in range(least, depth + 1))):
        discard(spark, f"{folder}/{name}")  # four numbers a row are left
    return out


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

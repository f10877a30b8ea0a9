"""Removal of repeated byte strings by column-wise construction over aligned text pieces.

Every window of `length` bytes is anchored at the least hash among its k-byte
grams, so equal windows have equal anchors at the same place. Neighbouring
windows share an anchor; together they are a piece of text around it. Spark
deals the anchors by hash. Pieces that recur as a whole are settled by their
hashes. The pieces that differ around the same anchor are documents of a
collection, aligned at the anchor, for which the suffix order and the common
prefixes are built column by column, one symbol of every piece each round from
the right: a stable sort by the new symbol updates the order (the permutation
of the transform), and range minimums update the common prefixes. Where a
common prefix reaches `length`, neighbours in the order share that window, and
all but the earliest go.

Anchors, pieces and spans move as packed columns, one row for each batch and
bucket; buckets follow from the size of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.llm.common import stored, work_folder
from lakevec.llm.language_id import flat_bytes
from lakevec.llm.ngram_join import _pieces, mix

#: Bytes of text for each bucket, and pieces that one round of the construction handles together.
BUCKET_BYTES, CHUNK = 24 << 20, 100_000
PAD = 0xFF  # no byte of UTF-8
_M = 0x9E3779B97F4A7C15
_M_INVERSE = pow(_M, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: u and v say which document: its id and, where ids repeat, a hash of its text.
ANCHOR = [("fp", "u8"), ("eh", "u8"), ("u", "i8"), ("v", "i8"), ("start", "u4"), ("lo", "u1"), ("span", "u1")]
SPAN = [("u", "i8"), ("v", "i8"), ("start", "u4"), ("end", "u4")]
#: Bits of an anchor's hash that give way to its place. Constant, so that equal windows have equal anchors wherever they stand.
PLACE_BITS = np.uint64(32)


def pack(columns: dict[str, np.ndarray], kinds: list[tuple[str, str]]) -> bytes:
    """Columns as one compressed string, bytes of equal weight together."""
    raw = [np.ascontiguousarray(columns[k], dtype=t) for k, t in kinds]
    raw = [x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in raw]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpack(packed: list[bytes], kinds: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {k: [np.zeros(0, t)] for k, t in kinds}
    width = sum(np.dtype(t).itemsize for _, t in kinds)
    for p in packed:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint8)
        n, at = len(raw) // width, 0
        for k, t in kinds:
            size = np.dtype(t).itemsize
            parts[k].append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(t).ravel())
            at += n * size
    return {k: np.concatenate(v) for k, v in parts.items()}


def _by_bucket(columns: dict[str, np.ndarray], kinds: list[tuple[str, str]], bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), pack({k: v[part] for k, v in columns.items()}, kinds)


def spark_hash(*columns: np.ndarray) -> np.ndarray:
    """Spark's hash() of columns of longs: Murmur3 of 32 bits with the seed 42."""
    h = np.full(len(columns[0]), 42, np.uint32)
    for column in columns:
        halves = np.ascontiguousarray(column, "<i8").view(np.uint32).reshape(-1, 2)
        for k in (halves[:, 0], halves[:, 1]):
            k = k * np.uint32(0xCC9E2D51)
            k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
            h = h ^ k
            h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h = h ^ np.uint32(8)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h = h ^ (h >> np.uint32(16))
    return h.view(np.int32)


def _doc_bucket(a: dict[str, np.ndarray], n: int) -> np.ndarray:
    return spark_hash(a["u"], a["v"]).astype(np.int64) % n


def _doc_places(known_u: np.ndarray, known_v: np.ndarray, a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each known document and of the document of each row of a, in one order."""
    both = np.empty(len(known_u) + len(a["u"]), [("u", "i8"), ("v", "i8")])
    both["u"], both["v"] = np.concatenate([known_u, a["u"]]), np.concatenate([known_v, a["v"]])
    rank = np.unique(both, return_inverse=True)[1].ravel()
    return rank[: len(known_u)], rank[len(known_u) :]


def _power(base: int, n: int, name: str) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
    return _powers[name][:n]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """The pieces of texts: row, first window start, place of the anchor after it (lo), further windows (span), hashes of gram and piece."""
    n, w = len(data), length - k + 1
    empty = {"row": np.zeros(0, np.int64), "start": np.zeros(0, np.uint32), "lo": np.zeros(0, np.uint8), "span": np.zeros(0, np.uint8), "fp": np.zeros(0, np.uint64), "eh": np.zeros(0, np.uint64)}
    if n < length:
        return empty
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_M, n, "up"), dtype=np.uint64)])
    inverse = _power(_M_INVERSE, n, "down")
    gram = mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    least = ((gram >> PLACE_BITS) << PLACE_BITS) | np.arange(n - k + 1, dtype=np.uint64)
    step = 1
    while step * 2 <= w:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if w > step:
        least = np.minimum(least[: len(least) - (w - step)], least[w - step :])
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    total = int(count.sum())
    if not total:
        return empty
    row = np.repeat(np.arange(len(count)), count)
    p = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][row]
    at = (least[p] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    first = np.ones(total, bool)
    first[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    i = np.flatnonzero(first)
    j = np.append(i[1:], total) - 1
    begin, end, anchor = p[i], p[j] + length, at[i]
    lo, span = anchor - begin, p[j] - p[i]
    piece = (sums[end] - sums[begin]) * inverse[begin]
    eh = mix(piece + mix((lo * 4096 + span).astype(np.uint64)))
    return {"row": row[i], "start": (begin - offsets[:-1][row[i]]).astype(np.uint32), "lo": lo.astype(np.uint8), "span": span.astype(np.uint8), "fp": gram[anchor], "eh": eh}


def _settle(a: dict[str, np.ndarray], length: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(earliest of each kind of piece, spans of all the others)."""
    order = np.lexsort((a["start"], a["v"], a["u"], a["eh"], a["fp"]))
    a = {k: v[order] for k, v in a.items()}
    head = np.ones(len(order), bool)
    head[1:] = (a["fp"][1:] != a["fp"][:-1]) | (a["eh"][1:] != a["eh"][:-1])
    gone = {"u": a["u"][~head], "v": a["v"][~head], "start": a["start"][~head], "end": a["start"][~head] + a["span"][~head].astype(np.uint32) + np.uint32(length)}
    return {k: v[head] for k, v in a.items()}, gone


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, bucket, packed = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()), pa.array(packed, pa.binary())], names=["kind", "bucket", "packed"])


PACKED = "kind int, bucket long, packed binary"


def find_anchors(length: int, k: int, n_buckets: int) -> Callable:
    """Texts to packed anchors by bucket of their hash (kind 0) and, settled within the batch, spans by bucket of their document (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat_bytes(b.column("text"))
            u, v = b.column("u").to_numpy(), b.column("v").to_numpy()
            parts = []
            for lo, hi in _pieces(data, offsets):
                a = anchors(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length, k)
                row = lo + a.pop("row")
                a |= {"u": u[row], "v": v[row]}
                parts.append(a)
            if not parts:
                continue
            a, gone = _settle({x: np.concatenate([p[x] for p in parts]) for x, _ in ANCHOR}, length)
            rows = [(0, x, y) for x, y in _by_bucket(a, ANCHOR, (a["fp"] % np.uint64(n_buckets)).astype(np.int64))]
            rows += [(1, x, y) for x, y in _by_bucket(gone, SPAN, _doc_bucket(gone, n_buckets))]
            yield _rows(rows)

    return run


def meet(length: int, n_buckets: int) -> Callable:
    """Anchors of a bucket to spans of pieces that an earlier one equals (kind 1) and pieces to compare (kind 2), by document."""

    def run(table: pa.Table) -> pa.Table:
        kind, packed = table.column("kind").to_numpy(), table.column("packed").to_pylist()
        rows = [(1, b, p) for t, b, p in zip(kind, table.column("bucket").to_pylist(), packed, strict=True) if t == 1]
        a, gone = _settle(unpack([p for t, p in zip(kind, packed, strict=True) if t == 0], ANCHOR), length)
        same = a["fp"][1:] == a["fp"][:-1]
        many = np.zeros(len(a["fp"]), bool)
        many[1:] |= same
        many[:-1] |= same
        a = {k: v[many] for k, v in a.items()}
        rows += [(1, x, y) for x, y in _by_bucket(gone, SPAN, _doc_bucket(gone, n_buckets))]
        rows += [(2, x, y) for x, y in _by_bucket(a, ANCHOR, _doc_bucket(a, n_buckets))]
        return pa.Table.from_batches([_rows(rows)])

    return run


def cut_pieces(length: int, k: int, n_buckets: int) -> Callable:
    """Documents and their pieces to compare: to the pieces' bytes, aligned at the anchor, by bucket of the hash."""
    width = 3 * length - 2 * k

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        a = unpack(found.column("packed").to_pylist(), ANCHOR)
        if len(a["u"]) and docs.num_rows:
            docs = docs.combine_chunks()
            data, offsets = flat_bytes(docs.column("text").combine_chunks())
            own, of = _doc_places(docs.column("u").to_numpy(), docs.column("v").to_numpy(), a)
            order = np.argsort(own, kind="stable")
            doc = order[np.searchsorted(own[order], of)]
            for lo in range(0, len(doc), CHUNK):
                part = {x: v[lo : lo + CHUNK] for x, v in a.items()}
                begin = offsets[doc[lo : lo + CHUNK]] + part["start"]
                column = np.arange(width) - (length - k)
                at = (begin + part["lo"])[:, None] + column
                inside = (column >= -part["lo"].astype(int)[:, None]) & (column < (part["span"].astype(int) - part["lo"] + length)[:, None])
                text = np.where(inside, data[np.where(inside, at, 0)], PAD).astype(np.uint8)
                part["text"] = text.view(f"V{width}").ravel()
                rows += [(3, x, y) for x, y in _by_bucket(part, [*ANCHOR, ("text", f"V{width}")], (part["fp"] % np.uint64(n_buckets)).astype(np.int64))]
        return pa.Table.from_batches([_rows(rows)])

    return run


def common_windows(text: np.ndarray, lo: np.ndarray, span: np.ndarray, rank: np.ndarray, length: int, k: int) -> np.ndarray:
    """gone[piece, c]: the window at column c is also in a piece of less rank.

    text has a row for each piece, aligned at the anchor, which is at column
    length - k. Column by column from the right, every piece gives one symbol:
    `order` is the order of the pieces by their text from the column on, and
    `prefix` what each has in common with the one before it.
    """
    m, width = text.shape
    order, prefix = np.arange(m), np.zeros(m, np.int32)
    gone = np.zeros((m, length - k + 1), bool)
    left, right = length - k - lo.astype(int), length - k - lo.astype(int) + span
    for c in range(width - 1, -1, -1):
        symbol = text[order, c]
        new = np.argsort(symbol, kind="stable")
        got = symbol[new]
        again = np.zeros(m, bool)
        again[1:] = got[1:] == got[:-1]
        pairs = np.empty(2 * int(again.sum()), np.int64)
        pairs[0::2], pairs[1::2] = new[:-1][again[1:]] + 1, new[again] + 1
        fresh = np.zeros(m, np.int32)
        if len(pairs):
            fresh[again] = np.minimum.reduceat(np.append(prefix, 0), pairs)[::2] + 1
        order, prefix = order[new], fresh
        if c <= length - k:
            valid = (left[order] <= c) & (c <= right[order])
            heads = np.flatnonzero(prefix < length)
            ranks = np.where(valid, rank[order], m)
            least = np.repeat(np.minimum.reduceat(ranks, heads), np.diff(np.append(heads, m)))
            gone[order, c] = valid & (ranks > least)
    return gone


def compare(length: int, k: int, n_buckets: int) -> Callable:
    """Aligned pieces of a bucket to the spans of their windows that stand in an earlier piece, by document."""
    width = 3 * length - 2 * k

    def run(table: pa.Table) -> pa.Table:
        a = unpack(table.column("packed").to_pylist(), [*ANCHOR, ("text", f"V{width}")])
        order = np.lexsort((a["start"], a["v"], a["u"], a["fp"]))
        a = {x: v[order] for x, v in a.items()}
        ends = np.append(np.flatnonzero(a["fp"][1:] != a["fp"][:-1]) + 1, len(order))
        rows, at = [], 0
        while at < len(order):
            to = int(ends[min(np.searchsorted(ends, at + CHUNK), len(ends) - 1)])
            part = {x: v[at:to] for x, v in a.items()}
            text = np.ascontiguousarray(part.pop("text")).view(np.uint8).reshape(to - at, width)
            gone = common_windows(text, part["lo"], part["span"], np.arange(to - at), length, k)
            edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            piece, first = np.nonzero(edge == 1)
            last = np.nonzero(edge == -1)[1] - 1
            base = part["start"].astype(np.int64) + part["lo"] - (length - k)
            spans = {"u": part["u"][piece], "v": part["v"][piece], "start": base[piece] + first, "end": base[piece] + last + length}
            rows += [(1, x, y) for x, y in _by_bucket(spans, SPAN, _doc_bucket(spans, n_buckets))]
            at = to
        return pa.Table.from_batches([_rows(rows)])

    return run


def keep_rest(with_text: bool) -> Callable:
    """Documents and their spans to what is left of them."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        s = unpack(found.column("packed").to_pylist(), SPAN)
        own, of = _doc_places(docs.column("u").to_numpy(), docs.column("v").to_numpy(), s)
        order = np.lexsort((s["start"], of))
        s, of = {k: v[order] for k, v in s.items()}, of[order]
        sizes, removed, spans, shas, kept = [], [], [], [], []
        lo, hi = np.searchsorted(of, own, "left"), np.searchsorted(of, own, "right")
        for i, text in enumerate(docs.column("text").to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            parts, at, runs, n = [], 0, 0, 0
            if hi[i] > lo[i]:
                start, end = s["start"][lo[i] : hi[i]].astype(np.int64), np.maximum.accumulate(s["end"][lo[i] : hi[i]].astype(np.int64))
                heads = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                for x, y in zip(start[heads], end[np.append(heads[1:], len(start)) - 1], strict=True):
                    parts.append(raw[at:x])
                    at, runs, n = int(y), runs + 1, n + int(y - x)
            parts.append(raw[at:])
            left = b"".join(parts)
            sizes.append(len(raw))
            removed.append(n)
            spans.append(runs)
            shas.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(left)
        cols = {"doc_id": docs.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
        return pa.table(cols | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    return run


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text and u, v, which order documents as their ids do; and the same with each (u, v) once.

    Rows without an id come last. Where ids repeat, v is a hash of the text, so
    rows of one id are ordered by it and rows that are wholly alike are one document.
    """
    last = F.lit((1 << 63) - 1)
    base = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), last).alias("u"))
    repeats = base.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if not repeats:
        base = base.withColumn("v", F.lit(0).cast("long"))
        return base, base
    base = base.withColumn("v", F.xxhash64(F.coalesce("text", F.lit(""))))
    return base, base.dropDuplicates(["u", "v"])


def remove_repeats(docs: DataFrame, length: int = 100, k: int = 32, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): one row for each row of docs.

    Each byte goes that is covered by a string of `length` bytes which also
    starts earlier (in a document of less id, or earlier in the same one),
    judged on the input. Null texts are empty; other columns are left out; an
    empty table gives an empty result. Ids are integers; rows without one come
    last, rows of one id in the order of a hash of their text, and rows alike in
    both are one document. length is at most 200 bytes more than k, k at least
    8. kept is what is left, as bytes, since a cut can divide a character.
    Pieces that recur whole are told by 128 bits of hash, without their bytes.
    """
    if not 8 <= k < length <= k + 200:
        raise ValueError("length and k don't fit")
    spark = docs.sparkSession
    folder = work_folder(spark, "repeats")
    docs, once = numbered(docs)
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(4, -(-total // BUCKET_BYTES))
    packed = once.select("u", "v", "text").mapInArrow(find_anchors(length, k, n), PACKED)
    met = stored(packed.groupBy("bucket").applyInArrow(meet(length, n), PACKED), f"{folder}/met")
    by_doc = docs.withColumn("bucket", F.pmod(F.hash("u", "v"), F.lit(n)).cast("long")).groupBy("bucket")
    pieces = by_doc.cogroup(met.where("kind = 2").groupBy("bucket")).applyInArrow(cut_pieces(length, k, n), PACKED)
    spans = pieces.groupBy("bucket").applyInArrow(compare(length, k, n), PACKED).unionByName(met.where("kind = 1"))
    spans = stored(spans, f"{folder}/spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return by_doc.cogroup(spans.groupBy("bucket")).applyInArrow(keep_rest(with_text), schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)

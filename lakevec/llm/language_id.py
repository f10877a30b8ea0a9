"""Language ID by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ORDER bytes with counts; a
context stands in it if training saw it often enough, so the tree's depth
varies. A byte that its longest context has seen costs
-log2(count / (total + distinct)); one that it hasn't costs the escape
-log2(distinct / (total + distinct)) and is coded in the next shorter context,
at last evenly over 256 bytes. The statistics are frozen after training, so a
text's code length under a language is an exact sum, and the language of the
shortest code wins. Contexts are sorted keys, each with the languages that saw
it alone, so memory follows the contexts that training saw and not their number times the
languages.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from lakevec.llm.common import crc_remainder

#: Training rows for each language, about; rows are picked by a hash of their content.
MAX_TRAIN_DOCS = 3000
#: Bytes of the longest context, and how often a context of two bytes or more must be seen to be in the tree.
ORDER, MIN_SEEN = 3, 4
#: Code lengths are divided by this before they are turned into a probability.
TEMPERATURE = 8.0
#: Bytes handled at once, and half as many costs.
PIECE = 1 << 20
#: Rows coded and handed on at once.
SLICE_ROWS = 512

_TABLES: dict[str, CodeTable] = {}


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, n + 1 offsets) of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def grams_of(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The bytes from lo to hi, each with the ORDER bytes before it, the last byte lowest; 0 before a text's start."""
    begin = max(0, lo - ORDER)
    part = data[begin:hi].astype(np.int64)
    starts = offsets[np.searchsorted(offsets, begin, "left") : np.searchsorted(offsets, hi, "left")] - begin
    out = part.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros(len(part), np.int64)
        before[k:] = part[:-k]
        none = (starts[:, None] + np.arange(k)).ravel()
        before[none[none < len(part)]] = 0
        out |= before << (8 * k)
    return out[lo - begin :]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = b.column("lang").to_pandas()
        for lang in langs.unique():
            data, offsets = flat_bytes(b.column("text").filter(pa.array(langs == lang)))
            for lo in range(0, len(data), PIECE):
                grams, n = np.unique(grams_of(data, offsets, lo, min(lo + PIECE, len(data))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> pd.DataFrame:
    """(lang, k, gram, n): how often each byte (the lowest of gram) follows each context of k bytes of the language's tree.

    A bounded sample: each language gives about max_docs rows, picked by a hash
    of their content, whole texts; rows without language or text teach nothing,
    repeated rows count as often as they come. Contexts are counted and
    those seen too seldom dropped on the cluster; what is left is the model and
    comes to the driver.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    share = {r["lang"]: min(1.0, max_docs / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return pd.DataFrame({"lang": [], "k": [], "gram": [], "n": []})
    table = docs.sparkSession.createDataFrame(list(share.items()), "lang string, share double")
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.join(F.broadcast(table), "lang").where(spot < F.col("share")).select("lang", "text")
    longest = rows.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    every = longest.select("lang", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k"), "gram", "n")
    every = every.withColumn("gram", F.col("gram").bitwiseAND(F.expr("shiftleft(1L, 8 * (k + 1)) - 1"))).groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    context = F.expr("shiftright(gram, 8)")
    seen = every.groupBy("lang", "k", context.alias("context")).agg(F.sum("n").alias("total")).where(f"k < 2 OR total >= {MIN_SEEN}")
    return every.withColumn("context", context).join(seen, ["lang", "k", "context"], "left_semi").select("lang", "k", "gram", "n").toPandas()


@dataclass
class Entries:
    """Bits for pairs of a key and a language, by sorted key: those of key i are starts[i] to starts[i + 1]."""

    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    bits: np.ndarray

    def add_to(self, total: np.ndarray, key: np.ndarray) -> None:
        """Add the bits of each row's key to the row's languages."""
        at, hit = _find(self.keys, key)
        row, at = np.flatnonzero(hit), at[hit]
        size = self.starts[at + 1] - self.starts[at]
        entry = np.repeat(self.starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        total[np.repeat(row, size), self.langs[entry]] += self.bits[entry]  # a pair comes once


@dataclass
class CodeTable:
    """For each order: what a context adds to the next shorter order's cost, its escape, and what a gram adds to that."""

    n_langs: int
    grams: list[Entries]
    contexts: list[Entries]

    def order_costs(self, gram: np.ndarray, orders: tuple[int, ...]) -> list[np.ndarray]:
        """For each of the orders k: bits of each gram's last byte in its context of k bytes under each language, with escapes to shorter ones."""
        total, found = np.full((len(gram), self.n_langs), 8.0), {}
        for k in range(max(orders) + 1):
            own = gram & ((1 << 8 * (k + 1)) - 1)
            self.contexts[k].add_to(total, own >> 8)
            self.grams[k].add_to(total, own)
            if k in orders:
                found[k] = total.copy()
        return [found[k] for k in orders]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _entries(pair: np.ndarray, bits: np.ndarray, n_langs: int) -> Entries:
    """Entries of sorted pairs key * n_langs + language."""
    keys, starts = np.unique(pair // n_langs, return_index=True)
    return Entries(keys, np.append(starts, len(pair)), (pair % n_langs).astype(np.int32), bits)


def code_table(model: pd.DataFrame, langs: list[str]) -> CodeTable:
    n_langs, table = len(langs), CodeTable(len(langs), [], [])
    code = model["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    known: list[tuple[np.ndarray, ...]] = []  # of each order: pairs of grams and their costs, pairs of contexts and their escapes

    def cost(gram: np.ndarray, lang: np.ndarray, k: int) -> np.ndarray:
        """Bits of each gram under its language, from order k down."""
        out, left = np.zeros(len(gram)), np.arange(len(gram))
        for grams, costs, contexts, escapes in known[k::-1] if k >= 0 else []:
            own = gram[left] & ((1 << 8 * (k + 1)) - 1)
            at, hit = _find(grams, own * n_langs + lang[left])
            out[left[hit]] += costs[at[hit]]
            left, own, k = left[~hit], own[~hit], k - 1
            at, hit = _find(contexts, (own >> 8) * n_langs + lang[left])
            out[left[hit]] += escapes[at[hit]]
        out[left] += 8
        return out

    for k in range(ORDER + 1):
        there = (model["k"] == k).to_numpy()
        gram, lang, n = model["gram"].to_numpy(dtype=np.int64)[there], code[there], model["n"].to_numpy(dtype=float)[there]
        order = np.lexsort((lang, gram))
        gram, lang, n = gram[order], lang[order], n[order]
        contexts, of, distinct = np.unique((gram >> 8) * n_langs + lang, return_inverse=True, return_counts=True)
        base = np.bincount(of, weights=n, minlength=len(contexts)) + distinct
        escapes, own = -np.log2(distinct / base), -np.log2(n / base[of])
        pair = gram * n_langs + lang
        table.contexts.append(_entries(contexts, escapes, n_langs))
        table.grams.append(_entries(pair, own - escapes[of] - cost(gram, lang, k - 1), n_langs))
        known.append((pair, own, contexts, escapes))
    return table


def code_lengths(data: np.ndarray, offsets: np.ndarray, table: CodeTable, orders: tuple[int, ...] = (ORDER,)) -> list[np.ndarray]:
    """For each of the orders: bits of each text under each language. A piece's different grams are looked up once; only they have a row for all languages."""
    out = [np.zeros((len(offsets) - 1, table.n_langs)) for _ in orders]
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = offsets[:-1][full]
    step = max(1, PIECE // (2 * table.n_langs))
    for lo in range(0, len(data), step):
        hi = min(lo + step, len(data))
        gram, of = np.unique(grams_of(data, offsets, lo, hi), return_inverse=True)
        first, last = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")
        cuts = np.maximum(starts[first:last], lo) - lo
        for bits, costs in zip(out, table.order_costs(gram, orders), strict=True):
            bits[full[first:last]] += np.add.reduceat(costs[of], cuts, axis=0)
    return out


def predict(docs: DataFrame, model: pd.DataFrame, names: tuple[str, str, str] = ("lang_pred", "score", "fits")) -> DataFrame:
    """docs with lang_pred, score and fits.

    lang_pred is `und`, with score 0, where the text is null or has no letter,
    or where nothing was learned. score is the probability of the language of
    the shortest code, from code lengths divided by TEMPERATURE. Equal lengths
    go to the first language by name. fits says that the contexts of that
    language shorten the text against its single bytes, which they don't where
    a text is in no learned language; it is false where lang_pred is `und`.
    Whole texts are coded, of any length; repeated rows each get their row. Own
    columns of these names are replaced; `names` can give others.
    """
    langs = sorted(model["lang"].unique())
    own = [c for c in docs.columns if c not in names]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    packed = docs.select(row, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kept = [F.col("row").getField(c).alias(c) for c in own]
    if not langs:
        return packed.select(*kept, F.lit("und").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(False).alias(names[2]))
    coded = model["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, langs, coded, *(model[c].to_numpy() for c in ("k", "gram", "n"))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, *columns = sent.value
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = code_table(pd.DataFrame(dict(zip(("lang", "k", "gram", "n"), columns, strict=True))), list(range(len(known))))
        for b in (whole.slice(lo, SLICE_ROWS) for whole in batches for lo in range(0, whole.num_rows, SLICE_ROWS)):
            data, offsets = flat_bytes(b.column("row").field("text"))
            bits, single = code_lengths(data, offsets, _TABLES[key], (ORDER, 0))
            letters = b.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best = bits.argmin(1)
            at = np.arange(len(best))
            share = 1 / np.exp2((bits.min(1, keepdims=True) - bits) / TEMPERATURE).sum(1)
            found = pa.array(np.where(letters, np.array(known, object)[best], "und"), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row"), found, pa.array(np.where(letters, share, 0.0)), pa.array(letters & (bits[at, best] < single[at, best]))], names=["row", "p", "s", "f"])

    schema = StructType([packed.schema["row"], StructField("p", StringType()), StructField("s", DoubleType()), StructField("f", BooleanType())])
    out = packed.mapInArrow(score, schema)
    return out.select(*kept, *[F.col(x).alias(y) for x, y in zip("psf", names, strict=True)])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_remainder(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")

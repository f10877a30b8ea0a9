"""Toxicity by compression distance with zstandard dictionaries of toxic and of ordinary text.

The same trainer makes, from windows of labelled texts, a dictionary of toxic
and one of ordinary text, of one size; both go on top of a larger shared
dictionary, which covers what all text has in common. A window is scored by
how many bytes less it takes with the toxic dictionary than with the ordinary
one. A toxic document holds mostly ordinary text, so the toxic dictionary is
trained on the places of toxic windows that tell: runs of bytes which both
halves of the toxic rows hold far more often than ordinary rows do. So the signs
of a language with few rows aren't crowded out by those of one with many.
How many windows of a text pass which threshold turns into a probability that
is calibrated on labelled rows that no dictionary was trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec.llm.common import crc_remainder

#: Bounds of the sample: labelled rows of each class, and windows of each class and half for the dictionaries. Both are picked by a hash over all.
MAX_TOXIC, MAX_ORDINARY, MAX_WINDOWS = 1500, 3000, 30_000
#: One in so many sampled rows calibrates; the others train the dictionaries.
CALIBRATE = 3
#: Bytes of a window and from one window to the next.
WINDOW, STEP = 48, 16
#: Bytes of the shared and of either class's dictionary, trainer's segment and match lengths.
SHARED_BYTES, CLASS_BYTES, SEGMENT, MATCH = 65_536, 2048, 20, 8
#: Bytes that tell stand in so many windows of each half, and so many times as often in toxic windows as in ordinary ones; bytes taken along on either side.
GRAM, MIN_WINDOWS, ABOVE, AROUND = 6, 2, 16, 4
#: Bytes gained that windows are counted by.
GAINS = (2, 3, 4, 5, 7)
LEVEL, FEATURES = 3, len(GAINS) + 3


@dataclass
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def windows(text: str) -> list[bytes]:
    """The overlapping windows of the whole text, lower-cased; an empty text has one empty window."""
    b = text.lower().encode("utf-8", "replace")
    return [b[i : i + WINDOW] for i in range(0, max(1, len(b) - (WINDOW - STEP)), STEP)]


def _compressor(dictionary: bytes):
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    kind = zstandard.DICT_TYPE_AUTO if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary.rjust(64), dict_type=kind), compression_params=p).compress


def features(texts: list[str], ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Of each text: the largest gain, the mean of the three largest, how many windows gain how much over the root of their number, and that number."""
    a, b = _compressor(ordinary), _compressor(toxic)
    out = np.zeros((len(texts), FEATURES))
    for i, text in enumerate(texts):
        g = np.array([len(a(x)) - len(b(x)) for x in windows(text)], dtype=float)
        n = len(g)
        out[i] = [g.max(), np.sort(g)[-3:].mean(), *((g >= t).sum() / n**0.5 for t in GAINS), np.log(n)]
    return out


def probability(f: np.ndarray, model: ToxicModel) -> np.ndarray:
    x = np.c_[(f - model.mean) / model.scale, np.ones(len(f))]
    return 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))


def trained(samples: list[bytes], size: int) -> bytes:
    """The zstandard trainer's dictionary of the samples; too few of them serve as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MATCH, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(samples)[-size:]


def grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, text): the windows in a row, a zero after each, and the GRAM bytes from each place as a number, -1 where a zero is among them."""
    text = np.frombuffer(b"".join(w + b"\0" for w in found) + b"\0" * GRAM, np.uint8)
    flat, n = text.astype(np.int64), len(text) - GRAM
    number = sum(flat[i : n + i] << 8 * i for i in range(GRAM))
    cut = np.convolve(text == 0, np.ones(GRAM, int))[GRAM - 1 : GRAM - 1 + n] > 0
    return np.where(cut, -1, number), text


def telling(toxic: list[list[bytes]], ordinary: list[bytes]) -> np.ndarray:
    """The grams that both halves' toxic windows hold, and toxic windows far more often than ordinary ones."""
    usual, b = np.unique(np.r_[-1, grams(ordinary)[0]], return_counts=True)
    (one, n), (two, m) = (np.unique(grams(half)[0], return_counts=True) for half in toxic)
    both, i, j = np.intersect1d(one, two, return_indices=True)
    at = np.minimum(np.searchsorted(usual, both), len(usual) - 1)
    known = np.where(usual[at] == both, b[at], 0)
    often = (n[i] + m[j]) * max(1, len(ordinary)) >= ABOVE * (known + 1) * sum(map(len, toxic))
    return both[(both >= 0) & (np.minimum(n[i], m[j]) >= MIN_WINDOWS) & often]


def pieces(found: list[bytes], told: np.ndarray) -> list[bytes]:
    """The runs of telling grams in the windows, with AROUND bytes on either side."""
    numbers, text = grams(found)
    raw, at = text.tobytes(), np.flatnonzero(np.isin(numbers, told))
    out = []
    for run in np.split(at, np.flatnonzero(np.diff(at) > GRAM) + 1) if len(at) else []:
        lo, hi = int(run[0]), int(run[-1]) + GRAM
        out.append(raw[max(raw.rfind(b"\0", 0, lo) + 1, lo - AROUND) : min(raw.find(b"\0", hi), hi + AROUND)])
    return out


def dictionaries(found: dict[tuple[int, int], list[bytes]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) from the windows of each (label, half)."""
    toxic, ordinary = [found.get((1, h), []) for h in (0, 1)], found.get((0, 0), []) + found.get((0, 1), [])
    shared, every = trained(ordinary, SHARED_BYTES), toxic[0] + toxic[1]
    picked = pieces(every, telling(toxic, ordinary))
    return shared + trained(ordinary, CLASS_BYTES), shared + trained(picked if len(picked) > 20 else every, CLASS_BYTES)


def calibrated(ordinary: bytes, toxic: bytes, f: np.ndarray, y: np.ndarray) -> ToxicModel:
    """The model whose probabilities fit the rows of features f and labels y."""
    model = ToxicModel(ordinary, toxic, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1))
    if not len(y):
        model.weights[-1] = -5
        return model
    model.mean, model.scale = f.mean(0), f.std(0) + 1e-9
    x, w = np.c_[(f - model.mean) / model.scale, np.ones(len(f))], model.weights
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + np.eye(FEATURES + 1) * 0.5, x.T @ (y - p) - 0.5 * w)
    return model


def _spot(*cols: Column | str) -> Column:
    """A number from 0 to 1 by a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, half, calibrates): about MAX_TOXIC and MAX_ORDINARY labelled rows, whole texts; repeated texts share half and use."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, MAX_TOXIC / max(1, counts.get(1, 0))).otherwise(MAX_ORDINARY / max(1, counts.get(0, 0)))
    picked = known.where(_spot("doc_id", F.lit(5)) < share)  # about MAX_TOXIC + MAX_ORDINARY rows at any size, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text IS NOT NULL")
    place = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(2 * CALIBRATE))
    return rows.select("text", "toxic", (place % 2).cast("int").alias("half"), (F.floor(place / 2) == 0).alias("calibrates"))


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, toxic, half in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("half").to_pylist(), strict=True):
            found = windows(text)
            yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(found), pa.int32()), pa.array([half] * len(found), pa.int32()), pa.array(found, pa.binary())], names=["toxic", "half", "w"])


def fit(rows: DataFrame) -> ToxicModel:
    """Dictionaries and calibration from rows (text, toxic, half, calibrates).

    At most about MAX_WINDOWS windows of each class and half, picked by a hash
    among those of all rows, and one row of numbers for each calibrating text
    come to the driver.
    """
    found = rows.where("NOT calibrates").select("text", "toxic", "half").mapInArrow(_windows_of, "toxic int, half int, w binary").distinct()
    sizes = {(r["toxic"], r["half"]): r["n"] for r in found.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when((F.col("toxic") == t) & (F.col("half") == h), F.lit(MAX_WINDOWS / max(n, 1))) for (t, h), n in sizes.items()], F.lit(1.0))
    samples: dict[tuple[int, int], list[bytes]] = {}
    for r in found.where(_spot("w", F.lit(9)) < share).orderBy(F.xxhash64("w"), "w", "toxic").toLocalIterator():
        samples.setdefault((r["toxic"], r["half"]), []).append(bytes(r["w"]))
    ordinary, toxic = dictionaries(samples)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = features(b.column("text").to_pylist(), ordinary, toxic)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(list(f), pa.list_(pa.float64()))], names=["toxic", "f"])

    got = rows.where("calibrates").select("text", "toxic").distinct().mapInArrow(measured, "toxic int, f array<double>").orderBy("f", "toxic").collect()
    return calibrated(ordinary, toxic, np.array([r["f"] for r in got]).reshape(len(got), FEATURES), np.array([r["toxic"] for r in got], dtype=float))


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """docs with score (0 to 1) and predicted in place of text.

    Null texts score as empty ones, long texts by all their windows, repeated
    rows each get their row. Own columns named score or predicted are replaced.
    An empty table gives an empty result.
    """
    docs = docs.drop("score", "predicted")
    kept = [x for x in docs.columns if x != "text"]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = probability(features([t or "" for t in b.column("text").to_pylist()], model.ordinary, model.toxic), model)
            yield pa.RecordBatch.from_arrays([b.column(x) for x in kept] + [pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    model = fit(sample(docs.where(~held_out), labels.where(~held_out)))
    return score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")

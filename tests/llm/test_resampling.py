import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from lakevec.llm import resampling as r
from lakevec.llm.common import UPPER, WORD

LOWER = str.maketrans(UPPER, UPPER.lower())


def plain_features(text):
    words = re.findall(WORD, (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=5, min_words=20, buckets=10_000):
    """Rows (id, n_features, weight, score, rank) by the definition, n-grams spelled out."""

    def counts(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for x in texts for g in plain_features(x)[1])

    s, t = counts(x for _, x in docs), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        n, grams = plain_features(x)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in grams)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words))
    able = sorted((x for x in rows if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    rank = {id(x): k for k, x in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*x[:4], rank.get(id(x))) for x in rows]


def test_hashes_equal_those_of_spelled_out_ngrams():
    for text in ("Zwei Wörter, ÉTÉ été_3 x", "", "a", "A b", "one-two three.four five", "\u0080x  y\x7fz 漢字 a"):
        assert sorted(r.ngram_hashes(r.words_of(text.encode()))) == sorted(zlib.crc32(g.encode()) for g in plain_features(text)[1])
    assert len(r.TABLE) == 256


def test_contract_query_equals_plain_version(spark):
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = r.op13(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain([(d["doc_id"], d["text"]) for d in docs], [b["text"] for b in target])
    assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda x: x[0]) and sum(x[4] is not None for x in want) > 20


def test_odd_rows_ties_and_clashing_columns(spark, odd_docs, odd_rows):
    target = spark.createDataFrame([("abc de",), (None,), ("",)], "text string")
    found = r.ranked(odd_docs, target, percent=50).collect()
    want = plain([x[:2] for x in odd_rows], ["abc de"], percent=50)
    key = repr
    assert sorted((tuple(x)[1:5] for x in found), key=key) == sorted((x[:4] for x in want), key=key)
    assert sorted(x["rank"] for x in found if x["rank"]) == sorted(x[4] for x in want if x[4])
    by_rank = {x["rank"]: x["score"] for x in found if x["rank"]}
    assert by_rank == {x[4]: x[3] for x in want if x[4]}
    kept = r.resampled(odd_docs, target, percent=50)
    assert kept.columns == odd_docs.columns and kept.count() == len(by_rank)


@pytest.mark.parametrize("percent, drawn", [(0, 0), (34, 2), (100, 6)])
def test_equal_rows_and_shares(spark, percent, drawn):
    docs = spark.createDataFrame([(7, "a " * 30)] * 6 + [(8, "a " * 19)], "doc_id long, text string")
    got = r.ranked(docs, docs.select("text"), percent=percent).collect()
    assert sorted(x["rank"] for x in got if x["rank"]) == list(range(1, drawn + 1))


def test_empty_tables(spark, no_docs, odd_docs):
    target = spark.createDataFrame([], "text string")
    assert r.ranked(no_docs, target).count() == 0
    none = {(x["n_features"] == 0, x["weight"] == 0) for x in r.ranked(odd_docs, target).collect() if not x["n_features"]}
    assert none == {(True, True)}


def test_draw_leans_towards_the_target(spark):
    rows = [(i, " ".join(["alpha", "beta", "gamma"][k % 3] if i % 10 == 0 else ["red", "green", "blue"][k % 3] for k in range(30))) for i in range(400)]
    got = r.ranked(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("alpha beta gamma alpha",)], "text string"), percent=10)
    assert {x["doc_id"] % 10 for x in got.collect() if x["rank"]} == {0}

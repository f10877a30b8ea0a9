import hashlib
import random

import numpy as np
import pytest

from lakevec.llm import substring_dedup as s


def brute(docs, n):
    seen, out = set(), []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(w)
        runs = sum(gone[q] and (q == 0 or not gone[q - 1]) for q in range(len(b)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(s, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(s, "CHUNK", 50)
    passages = ["".join(rng.choice("abé \x00") for _ in range(rng.randint(30, 200))) for _ in range(6)]
    docs = [(i, "".join(rng.choice([rng.choice(passages), "".join(rng.choice("abcd\n") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    docs += [(100, "ab" * 200), (101, None), (102, ""), (103, docs[5][1])]
    got = s.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), with_text=False).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(docs, 100)


def test_odd_documents(odd_docs, odd_rows, no_docs):
    got = s.remove_repeats(odd_docs)
    rows = got.collect()
    assert len(rows) == len(odd_rows) and all(r["n_bytes"] - r["n_removed"] == len(r["kept"]) for r in rows)
    first = [r for r in rows if r["doc_id"] == 1]
    assert [r["n_removed"] for r in first] == [0, 0]  # rows that are wholly alike are one document
    assert next(r for r in rows if r["doc_id"] == 2)["n_removed"] == next(r for r in rows if r["doc_id"] == 2)["n_bytes"]
    assert s.remove_repeats(no_docs).count() == 0


def test_arguments():
    with pytest.raises(ValueError):
        s.remove_repeats(None, length=20, k=32)


def test_hash_equals_sparks(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-(2**63), 2**63), rng.randrange(-(2**63), 2**63)) for _ in range(200)] + [(0, 0), (2**63 - 1, -1)]
    want = [r["h"] for r in spark.createDataFrame(rows, "u long, v long").coalesce(1).selectExpr("hash(u, v) AS h").collect()]
    assert s.spark_hash(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])).tolist() == want


def test_many_rows_without_id_and_large_ids(spark):
    rng = random.Random(3)
    common = "".join(rng.choice("abcdef") for _ in range(150))
    rows = [(None, f"{i} {common} {i}") for i in range(1500)] + [(2**63 - 2, common), (5, common)]
    got = s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1502
    assert all(r["n_removed"] >= 150 for r in got if r["doc_id"] != 5) and next(r for r in got if r["doc_id"] == 5)["n_removed"] == 0


def test_buckets_are_even_where_ids_repeat_or_share_a_factor(spark):
    rows = [(i * 64, "x") for i in range(4000)] + [(64, y) for y in "abc"]
    base, once = s.numbered(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = [r["count"] for r in base.selectExpr("pmod(hash(u, v), 4) AS b").groupBy("b").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.2 * min(sizes) and once.count() == 4003

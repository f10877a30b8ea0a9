import random

import numpy as np
import zstandard

from lakevec.llm import toxicity as t


def corpus(n, seed=2):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "un", "sha", "pre", "don"]
    rows = []
    for i in range(n):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(3, len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(["nastyword", "vileterm", "uglyslur"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def labelled(spark, rows):
    """Rows as sample() gives them."""
    return spark.createDataFrame([(x, y, i // 4 % 2, i // 8 % 3 == 0) for i, x, y in rows], "text string, toxic int, half int, calibrates boolean")


def test_held_out_accuracy(spark):
    rows = corpus(900)
    model = t.fit(labelled(spark, [r for r in rows if r[0] % 5]))
    test = [r for r in rows if r[0] % 5 == 0]
    df = spark.createDataFrame([r[:2] for r in test], "doc_id long, text string")
    got = {r["doc_id"]: r for r in t.score(df, model).collect()}
    assert sum(got[i]["predicted"] == y for i, _, y in test) / len(test) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    # Without the toxic dictionary nothing is told apart.
    model.toxic = model.ordinary
    assert t.score(df, model).select("predicted").distinct().count() == 1


def test_scores_equal_plain_compression(spark):
    rows = corpus(120)
    model = t.fit(labelled(spark, rows))
    assert model.toxic != model.ordinary and len(model.toxic) > 0

    def length(window, dictionary):
        p = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(window))

    got = {r["doc_id"]: r["score"] for r in t.score(spark.createDataFrame([r[:2] for r in rows[:20]], "doc_id long, text string"), model).collect()}
    for i, text, _ in rows[:20]:
        raw = text.lower().encode()
        cut = [raw[a : a + 48] for a in range(0, max(1, len(raw) - 32), 16)]
        gain = sorted(length(w, model.ordinary) - length(w, model.toxic) for w in cut)
        f = [gain[-1], sum(gain[-3:]) / len(gain[-3:]), *(sum(g >= b for g in gain) / len(gain) ** 0.5 for b in (2, 3, 4, 5, 7)), np.log(len(gain))]
        z = sum((a - m) / s * w for a, m, s, w in zip(f, model.mean, model.scale, model.weights, strict=False)) + model.weights[-1]
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_odd_and_empty(spark, odd_docs, odd_rows, no_docs):
    model = t.fit(labelled(spark, corpus(80)))
    got = t.score(odd_docs, model)
    assert got.count() == len(odd_rows) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert got.columns.count("score") == 1
    assert t.score(no_docs, model).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (11, 0)], "doc_id long, toxic int")
    assert {r["toxic"] for r in t.sample(odd_docs, labels).collect()} == {0, 1}
    assert t.sample(no_docs, labels.limit(0)).count() == 0
    none = t.fit(t.sample(no_docs, labels.limit(0)))
    assert t.score(odd_docs, none).where("predicted = 1").count() == 0
    alone = t.fit(t.sample(odd_docs, labels))
    assert t.score(odd_docs, alone).count() == len(odd_rows)


def test_late_windows_count(spark):
    """A term at the end of a very long text is seen."""
    rows = corpus(900)
    model = t.fit(labelled(spark, rows))
    calm = " ".join(x for _, x, y in rows if not y)
    texts = [(1, calm), (2, calm + " nastyword vileterm uglyslur" * 30)]
    got = {r["doc_id"]: r["score"] for r in t.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert got[2] > got[1]


def test_query_on_held_out_rows(spark):
    got = t.op5(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert got.count() == 1000
    m = got.where("held_out").join(labels, "doc_id").selectExpr("avg(cast(predicted = toxic as int)) AS right").first()["right"]
    assert m > 0.85

import random
from collections import Counter

import numpy as np
import pandas as pd

from lakevec.llm import language_id as g


def counted(lang, *texts):
    """The rows of train() for some texts, counted plainly."""
    rows = Counter()
    for text in texts:
        padded = b"\0" * g.ORDER + text
        for i in range(g.ORDER, len(padded)):
            for k in range(g.ORDER + 1):
                rows[k, padded[i - k : i], padded[i]] += 1
    total = Counter()
    for (k, context, _), n in rows.items():
        total[k, context] += n
    kept = {x: n for x, n in rows.items() if x[0] < 2 or total[x[:2]] >= g.MIN_SEEN}
    return kept, [(lang, k, int.from_bytes(context + bytes([byte]), "big"), n) for (k, context, byte), n in kept.items()]


def plain_cost(kept, context, byte):
    """Bits of a byte by the definition: the longest context of the tree, then escapes."""
    k = len(context)
    n = {b: c for (j, x, b), c in kept.items() if j == k and x == context}
    shorter = lambda: plain_cost(kept, context[1:], byte) if k else 8.0
    if not n:
        return shorter()
    base = sum(n.values()) + len(n)
    return -np.log2(n[byte] / base) if byte in n else -np.log2(len(n) / base) + shorter()


def test_code_lengths_equal_a_plain_model(spark, monkeypatch):
    """Contexts of up to three bytes, two languages, escapes and even bytes at last, byte by byte."""
    texts = {"x": [b"abracadabra abracadabra abra", b"cabra"], "y": [b"banana bandana bab"]}
    models = {lang: counted(lang, *t) for lang, t in texts.items()}
    model = pd.DataFrame([r for _, rows in models.values() for r in rows], columns=["lang", "k", "gram", "n"])
    docs = spark.createDataFrame([(i, t.decode(), lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, g.train(docs).itertuples(index=False))) == sorted(map(tuple, model.itertuples(index=False)))
    text = b"abrab!acanda band"
    data = np.frombuffer(text + text, np.uint8)
    table = g.code_table(model, ["x", "y"])
    monkeypatch.setattr(g, "PIECE", 5)
    for order in (g.ORDER, 0):
        (got,) = g.code_lengths(data, np.array([0, len(text), len(text), 2 * len(text)]), table, (order,))
        for i, lang in enumerate("xy"):
            padded = b"\0" * g.ORDER + text
            want = sum(plain_cost(models[lang][0], padded[j - order : j], padded[j]) for j in range(g.ORDER, len(padded)))
            assert abs(got[0, i] - want) < 1e-3 and got[1, i] == 0 and abs(got[2, i] - want) < 1e-3


def test_memory_follows_contexts_seen_and_not_languages():
    """A hundred languages of grams of their own: as many entries as the model has rows."""
    rng = np.random.default_rng(1)
    langs = [f"l{i:03}" for i in range(100)]
    kept = {lang: counted(lang, bytes(rng.integers(i, i + 9, 300).astype(np.uint8)) * 4) for i, lang in enumerate(langs)}
    model = pd.DataFrame([r for _, rows in kept.values() for r in rows], columns=["lang", "k", "gram", "n"])
    table = g.code_table(model, langs)
    assert sum(len(e.bits) for e in table.grams) == len(model) and sum(len(e.bits) for e in table.contexts) <= len(model)
    data = rng.integers(0, 110, 50).astype(np.uint8)
    (got,) = g.code_lengths(data, np.array([0, 50]), table)
    padded = b"\0" * g.ORDER + bytes(data)
    for i in (0, 42, 99):
        assert abs(got[0, i] - sum(plain_cost(kept[langs[i]][0], padded[j - g.ORDER : j], padded[j]) for j in range(g.ORDER, len(padded)))) < 1e-6


def test_texts_of_no_learned_language_do_not_fit(spark):
    rng = random.Random(1)
    real = [(i, " ".join(rng.choice(["water", "under", "the", "bridge", "runs", "slowly"]) for _ in range(40)), "en") for i in range(60)]
    noise = [(100 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)), "en") for i in range(5)]
    model = g.train(spark.createDataFrame(real, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r["fits"] for r in g.predict(spark.createDataFrame([*real, *noise], "doc_id long, text string, lang string"), model).collect()}
    assert all(got[i] for i, _, _ in real) and not any(got[i] for i, _, _ in noise)


def test_odd_and_empty(spark, odd_docs, odd_rows, no_docs):
    model = g.train(odd_docs)
    got = g.predict(odd_docs, model)
    rows = got.select("doc_id", "text", "lang_pred", "score").collect()
    assert len(rows) == len(odd_rows)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1 for r in rows)
    assert g.predict(no_docs, model).count() == 0
    nothing = g.train(no_docs)
    assert {r["lang_pred"] for r in g.predict(odd_docs, nothing).select("lang_pred").collect()} == {"und"}


def test_held_out_accuracy(spark):
    got = g.op10(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").selectExpr("avg(cast(lang = lang_pred AS int)) AS right").first()["right"] > 0.97


def test_grams_do_not_depend_on_where_they_are_cut():
    data = np.frombuffer(b"abcdefgxyzq", np.uint8)
    offsets = np.array([0, 7, 7, 9, 11])
    whole = g.grams_of(data, offsets, 0, 11)
    assert [int(x) for x in whole[6:9]] == [int.from_bytes(b"defg", "big"), ord("x"), int.from_bytes(b"xy", "big")] and whole[9] == ord("z")
    for lo in range(11):
        for hi in range(lo + 1, 12):
            assert (g.grams_of(data, offsets, lo, hi) == whole[lo:hi]).all()

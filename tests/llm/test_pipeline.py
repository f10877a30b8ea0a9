import random

import corpus_pipeline as p
from lakevec.llm.common import stored, work_folder


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder, columns, counts = work_folder(spark, "stages"), docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(p.STAGES):
        before, docs = docs, stored(stage(spark, docs, "/root/testdata/sf0.001"), f"{folder}/{i}")
        counts.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert counts[1] == counts[0] and counts[3] < counts[2] and counts[4] < counts[3]
    assert docs.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    for table in (odd_docs, no_docs):
        docs, folder = table, work_folder(spark, "odd")
        for i, (_, stage) in enumerate(p.STAGES):
            docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), f"{folder}/{i}")
        assert (docs.count() > 0) == (table is odd_docs)


def test_one_row_of_equal_rows_and_of_copies_without_ids_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, a), (7, a), (None, a), (None, b), (None, b), (9, c), (3, a + " more"), (9, b), (4, c)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, row string")
    got = sorted((r["doc_id"], r["text"]) for r in p.near_copies(spark, docs, "").collect())
    assert got == [(3, a + " more"), (4, c), (9, b)]
    assert [r["text"] for r in p.near_copies(spark, docs.where("doc_id IS NULL AND text LIKE 'b%'"), "").collect()] == [b]


def test_language_stage_rejects_what_no_language_codes(spark):
    rng = random.Random(2)
    real = [(i, " ".join(rng.choice(["water", "under", "the", "bridge", "runs", "slowly"]) for _ in range(30)), "en", "x", "y") for i in range(50)]
    noise = [(100, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(150)), None, "x", "y"), (101, "12 34", None, "x", "y"), (102, None, None, "x", "y")]
    docs = spark.createDataFrame([*real, *noise], "doc_id long, text string, lang string, score string, fits string")
    got = p.languages(spark, docs, "").collect()
    assert {r["doc_id"] for r in got} == set(range(50)) and {(r["score"], r["fits"]) for r in got} == {("x", "y")}
    # Without the model's answer the random letters would stay.
    model = p.language_id.train(docs.select("doc_id", "text", "lang"))
    assert p.language_id.predict(docs, model).where("doc_id = 100 AND lang_pred = 'en' AND NOT fits").count() == 1


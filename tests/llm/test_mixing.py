from collections import Counter

from pyspark.sql import functions as F

from lakevec.llm import mixing as m
from lakevec.llm.queries import ORACLES, QUERIES


def test_odd_documents(odd_docs, odd_rows, no_docs):
    got = m.mix_table(odd_docs).collect()
    assert len(got) == len(odd_rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] and len(r["shards"]) * r["size"] == r["taken"] for r in got)
    assert m.mix_table(no_docs).count() == 0
    mix = m.mixed(odd_docs)
    assert mix.columns == [*odd_docs.columns, "shard", "place"]
    assert mix.count() == sum(len(r["shards"]) for r in got) and {r["r1"] for r in mix.select("r1").collect()} == {"r"}


def test_targets_are_met_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_DOCS", 16)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 40).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    one = m.mix_table(docs, n_shards=5)
    by = one.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"))
    rows = by.collect()
    assert all(abs(r["taken"] - r["target"]) <= 20 and r["target"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["target"] for r in rows) - sum(r["size"] for r in rows)) < 1e-3
    key = lambda df: sorted((r["doc_id"], tuple(r["shards"])) for r in df.collect())
    assert key(one) == key(m.mix_table(docs.repartition(7), n_shards=5))
    per = Counter(s for r in one.collect() for s in r["shards"])
    assert set(per) == set(range(5)) and max(per.values()) < 1.5 * min(per.values())


def test_tree_deals_exact_quotas(spark):
    quotas = [7, 0, 100, 33]
    draws = m.shard_draws(spark, quotas, 6, 1).collect()
    for s, q in enumerate(quotas):
        assert sorted(r["draw"] for r in draws if r["source_no"] == s) == list(range(q))
    per = Counter(r["shard"] for r in draws)
    assert set(per) == set(range(6)) and max(per.values()) - min(per.values()) <= 2
    assert sorted(map(tuple, draws)) == sorted(map(tuple, m.shard_draws(spark, quotas, 6, 1).repartition(3).collect()))


def test_words_come_from_the_shards_draws(spark, monkeypatch):
    """Without the tree nothing is taken."""
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(50)], "doc_id long, text string, source string")
    assert m.mix_table(docs).agg(F.sum("taken")).first()[0] == 150
    monkeypatch.setattr(m, "shard_draws", lambda spark, *_: spark.createDataFrame([], "source_no int, draw long, shard int"))
    assert m.mix_table(docs).agg(F.sum("taken")).first()[0] == 0


def test_like_rows_of_two_sources_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a b", "A"), (1, "a b", "B"), (1, "a b", "A")], "doc_id long, text string, source string")
    want = Counter({r["source"]: r["n"] for r in m.mix_table(docs).join(spark.createDataFrame([("A", 4), ("B", 2)], "source string, source_size long"), "source_size").groupBy("source").agg(F.sum(F.size("shards")).alias("n")).collect()})
    got = Counter(r["source"] for r in m.mixed(docs).collect())
    assert got == want and set(got) == {"A", "B"}


def test_like_rows_lie_in_many_blocks(spark):
    """30,000 rows of one id and text among as many others: no block has 2,048 rows, all rows come out, the mix holds what the table says."""
    docs = spark.range(60_000).select(F.when(F.col("id") < 30_000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 30_000, "a b").otherwise(F.concat_ws(" ", F.lit("c d"), "id")).alias("text"), F.when(F.col("id") % 5 < 3, "A").otherwise("B").alias("source"))
    mix = m.Mix(m._sized(docs), None, 3, 17)
    blocks = mix.pieces.groupBy("source_no", "block", "part").agg(F.sum("m").alias("n"))
    assert blocks.agg(F.max("n"), F.sum("n")).first() == (blocks.agg(F.max("n")).first()[0], 60_000) and blocks.agg(F.max("n")).first()[0] < 2048
    table = m.mix_table(docs).groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum(F.size("shards")).alias("copies"), F.sum("taken").alias("taken"))
    assert table.agg(F.sum("rows")).first()[0] == 60_000 and table.where("doc_id = 7").first()["rows"] == 30_000
    got = m.mixed(docs).groupBy("doc_id").agg(F.count("*").alias("n"))
    assert table.where("copies > 0").join(got, "doc_id", "full").where("n IS NULL OR copies IS NULL OR n <> copies").count() == 0


def test_each_of_some_like_rows_has_its_number(spark):
    docs = spark.createDataFrame([(i % 3 or None, f"t{i % 3}", "s", i) for i in range(90)], "doc_id long, text string, source string, own long")
    got = m.mixed(docs, max_repeats=1).collect()
    assert sorted(r["own"] for r in got) == list(range(90))


def test_equals_sql(against_sql):
    against_sql(QUERIES["op8_mixing"], ORACLES["op8_mixing"], "/root/testdata/sf0.001")

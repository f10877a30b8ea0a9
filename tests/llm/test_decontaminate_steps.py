from pyspark.sql import functions as F

from lakevec.llm import common
from lakevec.llm import decontaminate as d
from lakevec.llm.common import stored, with_row_key, work_folder


def test_each_step_reads_the_index_once(spark):
    """Windows of one, two and three probes are found, repeated rows once, and three steps read the index three times."""
    docs = with_row_key(spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "c d a b"), (3, "d d")], "doc_id long, text string"))
    folder = work_folder(spark, "steps")
    index = stored(d.postings(d.numbered_words(docs), d.numbered_words(docs).selectExpr("explode(terms) AS t").distinct()), f"{folder}/index")
    items = spark.createDataFrame([(1, "b c d e"), (2, "a b"), (3, "d")], "item_id long, text string")
    windows = stored(d.benchmark_windows(items), f"{folder}/windows")
    probes = stored(d.probes_of(windows, d.term_counts(d.numbered_words(docs), windows.selectExpr("explode(terms.t) AS t").distinct()), 3), f"{folder}/probes")
    found = d.intersect(index, probes, 3)
    ids, phrases = docs.select("doc_id", "r1", "r2").distinct(), windows.select("w", "phrase")
    got = sorted((r["phrase"], r["doc_id"], r["s"]) for r in found.join(ids, ["r1", "r2"]).join(phrases, "w").collect())
    assert got == [("a b", 1, 1), ("a b", 2, 3), ("b c d e", 1, 2), ("d", 1, 4), ("d", 2, 2), ("d", 3, 1), ("d", 3, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "pos" in line for line in plan.splitlines()) == 3


def test_words_are_those_of_the_contract(spark):
    """Every character is part of a word, or isn't, as the contract's pattern has it."""
    points = [*range(0x3000), *range(0xD7F0, 0xD800), *range(0xE000, 0xE010), *range(0xFFF0, 0x10010), 0x1F600, 0x10FFFF]
    one = spark.createDataFrame([(chr(i),) for i in points], "c string")
    for mine, theirs in ((d.WORD, common.WORD), (d.ANY_WORD, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        assert one.where(F.regexp_count("c", F.lit(mine)) != F.regexp_count("c", F.lit(theirs))).count() == 0
    assert mine != theirs

import hashlib
import re

from pyspark.sql import functions as F

from lakevec.llm import decontaminate as d
from lakevec.llm.common import with_row_key
from lakevec.llm.queries import ORACLES, QUERIES


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items, n=10):
    out = []
    for i, t in docs:
        w, hit, found = tokens(t), set(), set()
        for item, text in items:
            v = tokens(text)
            for s in range(max(1, len(v) - n + 1)) if v else ():
                x = v[s : s + n]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit.update(range(p, p + len(x)))
                        found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_odd_documents(spark, odd_docs, odd_rows):
    short = [r for r in odd_rows if len(r[1] or "") < 10_000]
    a = short[0][1].split()
    items = [(1, " ".join(a[5:25])), (2, "Same, line"), (3, None), (4, "..."), (10, " ".join(a[30:45]) + " other words that are not there at all"), (10, "x"), (11, "ÉLAN vital"), (12, "Élan VITAL"), (13, "not there")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = d.contamination(odd_docs.where("length(text) < 10000 OR text IS NULL"), table)
    assert set(COLUMNS) <= set(got.columns) and {r["r1"] for r in got.select("r1").collect()} == {"r"}
    assert sorted(repr(tuple(r)) for r in got.select(*COLUMNS).collect()) == brute([r[:2] for r in short], items)


def test_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert d.contamination(no_docs, items).count() == 0
    assert d.contamination(odd_docs, items.limit(0)).where("contaminated OR n_items > 0").count() == 0


def test_proximity(spark):
    docs = with_row_key(spark.createDataFrame([(1, "alpha x x beta x x x x x x beta"), (2, "beta alpha")], "doc_id long, text string"))
    terms = spark.createDataFrame([("alpha",), ("beta",)], "w string").select(d.term(F.col("w")).alias("t"))
    index = d.postings(d.numbered_words(docs), terms)
    pair = spark.createDataFrame([(1, "alpha", "beta")], "pair int, x string, y string").select("pair", d.term(F.col("x")).alias("a"), d.term(F.col("y")).alias("b"))
    assert sorted((r["pos"], r["other"]) for r in d.proximity_matches(index, pair, 3).collect()) == [(1, 4), (2, 1)]


def test_equals_sql(against_sql):
    against_sql(QUERIES["op2_decontamination"], ORACLES["op2_decontamination"], "/root/testdata/sf0.001")


def test_plan_has_no_python(spark):
    df = QUERIES["op2_decontamination"](spark, "/root/testdata/sf0.001")
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())

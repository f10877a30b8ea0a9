import hashlib
import re
from collections import Counter

from lakevec.llm import line_dedup
from lakevec.llm.common import work_folder
from lakevec.llm.queries import ORACLES, QUERIES


def brute(rows, min_docs):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        left = "\n".join(x for x in parts if not key(x) or n[key(x)] < min_docs)
        out.append((i, len(parts), sum(bool(key(x)) and n[key(x)] >= min_docs for x in parts), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_odd_documents(odd_docs, odd_rows):
    for least in (1, 2, 3, 4):
        got = line_dedup.dedup_lines(odd_docs, min_docs=least, fanout=2).drop("kept_text").collect()
        assert sorted(repr(tuple(r)) for r in got) == brute([r[:2] for r in odd_rows], least)


def test_own_columns_stay(odd_docs, odd_rows):
    got = line_dedup.kept_documents(odd_docs, min_docs=3)
    assert got.columns == odd_docs.columns and got.count() == len(odd_rows)
    assert {r["r1"] for r in got.collect()} == {"r"}
    assert got.where("text IS NULL").count() == 2


def test_empty_table(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0
    assert line_dedup.kept_documents(no_docs).columns == no_docs.columns


def test_runs_meet_without_a_shuffle_and_compact_before_the_end(spark):
    folder = work_folder(spark, "runs")
    runs = line_dedup.LineRuns(spark, folder, min_docs=5, fanout=2, buckets=4)
    want, sizes = Counter(), []
    for i in range(5):
        keys = [(k % 11, k % 3) for k in range(i, 40 + i)]
        known = {k for k, n in want.items() if n >= 5}
        want.update(k for k in keys if k not in known)  # what is known as frequent isn't counted on
        runs.add(spark.createDataFrame(keys, "h1 long, h2 long"))
        sizes.append([len(level) for level in runs.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    assert {(r["h1"], r["h2"]): r["n"] for r in runs._merged(runs.names()).collect()} == want
    assert {tuple(r) for r in runs.frequent().collect()} == {k for k, n in want.items() if n >= 5}
    for met in (runs._merged(runs.names()), runs._known(spark.table(runs.names()[0]), runs.names()[1:])):
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_equals_sql(against_sql):
    against_sql(QUERIES["op1_line_dedup"], ORACLES["op1_line_dedup"], "/root/testdata/sf0.001")

import random
import re

from lakevec.llm import license_scan as s
from lakevec.llm.common import WORD


def test_finds_whole_and_changed_notices(spark):
    mit = s.TEMPLATES["MIT-text"]
    w = mit.split()
    changed = " ".join(w[:20] + ["new"] + w[20:40] + w[42:])
    docs = [(1, "words before. Released under the MIT License. after"), (2, "x " * 50 + changed + " y" * 9), (3, "the MIT of things"), (4, None), (5, ""), (6, "Released under the MIT License. Released under the MIT License."), (None, s.TEMPLATES["GPL-3.0"]), (7, "licensed under the apache license version 2 0")]
    got = s.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"] or 0, r["license"]) for r in got)
    assert found == [(0, "GPL-3.0"), (1, "MIT"), (2, "MIT-text"), (6, "MIT"), (6, "MIT"), (7, "Apache-2.0")]
    one = next(r for r in got if r["doc_id"] == 1)
    assert docs[0][1][one["start"] : one["end"]] == "Released under the MIT License" and one["coverage"] == 1.0
    two = next(r for r in got if r["doc_id"] == 2)
    assert 0.9 < two["coverage"] < 1 and two["start"] == 100


def test_odd_and_empty_tables(odd_docs, no_docs):
    assert s.scan(odd_docs).count() == 0 and s.scan(no_docs).count() == 0


def test_every_planted_notice_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in s.scan(docs).collect()}
    for name in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"):
        want = {(r["doc_id"], name) for r in docs.where(docs.text.contains(s.TEMPLATES[name])).select("doc_id").collect()}
        assert want and want <= got


def test_siblings_are_told_apart(spark):
    names = sorted(s.TEMPLATES)
    unknown = s.TEMPLATES["GPL-3.0-header"].replace("version 3", "version 7")
    docs = [(i, f"some words {s.TEMPLATES[n]} and others") for i, n in enumerate(names)] + [(100, unknown), (101, "Released under the Foo License.")]
    got = sorted((r["doc_id"], r["license"], r["coverage"]) for r in s.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(i, n, 1.0) for i, n in enumerate(names)]


def full_alignment(template, words):
    """(matched, first, end) of the best local alignment of all of a text, without band or index: match 1, anything else -1."""
    best, above = (0, 0, 0, 0), [(0, 0, j) for j in range(len(words) + 1)]
    for w in template:
        row = [(0, 0, 0)]
        for j, x in enumerate(words, 1):
            score, m, f = above[j - 1] if above[j - 1][0] > 0 else (0, 0, j - 1)
            cell = (score + 1, m + 1, f) if x == w else (score - 1, m, f)
            for o in (above[j], row[j - 1]):
                if o[0] - 1 > cell[0]:
                    cell = (o[0] - 1, o[1], o[2])
            row.append(cell if cell[0] > 0 else (0, 0, j))
            if cell[0] > best[0]:
                best = (*cell, j)
        above = row
    return best[1], best[2], best[3]


def test_equals_full_alignment_of_changed_templates(spark):
    rng = random.Random(6)
    names = ["MIT-grant", "BSD-2-Clause", "Apache-2.0-header", "MPL-2.0", "ISC-text"]
    docs, spots = [], {}
    for i in range(25):
        name = names[i % len(names)]
        w = s.TEMPLATES[name].split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(5, len(w) - 5)
            w[at : at + 1] = rng.choice([[], ["changed"], [w[at], "added"]])
        around = [["filler%d" % rng.randrange(1000) for _ in range(rng.randint(0, 60))] for _ in range(2)]
        docs.append((i, " ".join(around[0] + w + around[1])))
        spots[i] = name
    got = {(r["doc_id"], r["license"]): r for r in s.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == 25
    for i, text in docs:
        template = re.findall(WORD, s.TEMPLATES[spots[i]].lower())
        found = [m for m in re.finditer(WORD, text.lower())]
        matched, first, end = full_alignment(template, [m.group() for m in found])
        r = got[i, spots[i]]
        assert (r["n_matched"], r["start"], r["end"], r["n_template"]) == (matched, found[first].start(), found[end - 1].end(), len(template))

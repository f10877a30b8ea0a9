import random
import re

import numpy as np
import pytest

from lakevec.llm import ngram_join as j


def shingles(t, n=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(docs, threshold=0.8):
    """Every pair of different shingle sets, whatever ids their rows have."""
    rows = [(i, shingles(t)) for i, t in docs]
    sets = list({s for _, s in rows if s})
    links, parent = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            if len(a & sets[y]) >= threshold * len(a | sets[y]):
                links[x] += 1
                links[y] += 1
                parent[find(x)] = find(y)
    place = {s: k for k, s in enumerate(sets)}
    ids, classes = {}, {}
    for i, s in rows:
        if s and i is not None:
            k = place[s]
            ids[k] = min(i, ids.get(k, i))
            classes[find(k)] = min(i, classes.get(find(k), i))
    return sorted(map(repr, [(i, classes.get(find(place[s])), ids.get(place[s]), links[place[s]]) if s else (i, i, i, 0) for i, s in rows]))


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "class_id", "copy_of", "n_links").collect())


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))]
        out.append((i, " ".join(w)))
    rng.shuffle(out)
    return out


def test_equals_brute_force(spark, monkeypatch):
    docs = corpus(1, 300)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(j.near_duplicates(df)) == brute(docs)
    monkeypatch.setattr(j, "BLOCK_SHINGLES", 2_000)  # small blocks split the nodes
    assert found(j.near_duplicates(df, target=2.0)) == brute(docs)  # the prefix is shortened to the end


def test_prefix_is_shortened_until_the_recall_is_met(spark, monkeypatch):
    """With one tree of long prefixes links are missing; shorter prefixes find more of them."""
    docs = corpus(3, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    total = [j.near_duplicates(df, trees=2, depth=d, least=d).agg({"n_links": "sum"}).first()[0] for d in (8, 3)]
    assert total[0] < total[1]
    depths = []
    monkeypatch.setattr(j, "forest_recall", lambda links, d, trees: depths.append(d) or (1.0 if d <= 7 else 0.0))
    j.near_duplicates(df)
    assert depths == [8, 7]


def test_odd_documents(odd_docs, odd_rows):
    assert found(j.near_duplicates(odd_docs)) == brute([r[:2] for r in odd_rows])


def test_two_texts_of_one_id_are_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (12, a), (12, b), (20, b), (None, b)]
    got = j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in got.collect()) == [(0, 12, 0), (1, 1, 0), (12, 1, 0), (12, 12, 0), (20, 12, 0)]


def test_empty_table(no_docs):
    assert j.near_duplicates(no_docs).count() == 0


def test_recall_follows_from_the_links_found():
    rng = np.random.default_rng(1)
    s = rng.integers(800, 1000, 200_000)
    met = s[rng.random(len(s)) < j.meeting(s / 1000, 8, 6)]
    at, n = np.unique(met, return_counts=True)
    assert abs(j.forest_recall(dict(zip(at, n, strict=True)), 8, 6) - len(met) / len(s)) < 0.01
    assert j.forest_recall({}, 8, 6) == 1.0 and j.meeting(0.8, j.LEAST_DEPTH, j.TREES) > 0.9999


def test_shingle_hashes_follow_words():
    texts = ["A b c d e f", "x a,b;c-d!e f", "", "one two", "É b c d e é"]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    hashes, offsets = j.shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), at, 5)
    sets = [list(hashes[offsets[i] : offsets[i + 1]]) for i in range(5)]
    assert [len(s) for s in sets] == [2, 3, 0, 1, 2] and sets[0] == sets[1][1:] and len({*sets[4], *sets[0]}) == 4


def test_blocks_bound_documents_of_few_shingles(spark):
    members = spark.range(100_000).selectExpr("1L AS node", "3L AS n")
    assert j.node_blocks(members).first()["blocks"] >= 100_000 / j.BLOCK_DOCS


def test_low_thresholds_shorten_the_prefix_further(spark):
    """Pairs of Jaccard 0.4925 at a threshold of 0.45: all of them are found."""
    rng = random.Random(45)
    rows = []
    for i in range(300):
        shared, a, b = ([f"{x}{i}w{rng.randrange(10**9)}" for _ in range(n)] for x, n in (("s", 70), ("a", 34), ("b", 34)))
        rows += [(2 * i, " ".join(shared + a)), (2 * i + 1, " ".join(shared + b))]
    got = j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.45)
    assert got.where("n_links = 1").count() == 600
    assert j.least_depth(0.8, j.DEPTH, j.TREES) == j.LEAST_DEPTH and j.least_depth(0.45, j.DEPTH, j.TREES) == 1
    with pytest.raises(ValueError):
        j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.1)

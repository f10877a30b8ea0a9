import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lakevec.llm import periodic_runs as r


def plain_runs(words, least=12):
    """(start, length, period) by trying every period; a stretch keeps its least one."""
    n, seen, out = len(words), set(), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(least, 2 * p) and (i, length) not in seen:
                seen.add((i, length))
                out.append((i, length, p))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_altered(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text, alter=True):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    words = plain_altered(words, doc_id) if alter else words
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, n, p in runs), kept)]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)


def words_with_runs(rng):
    """Random words of few kinds with planted, nested and copied stretches."""
    out = []
    for _ in range(rng.randint(1, 6)):
        kind = rng.random()
        if kind < 0.4:
            out += [rng.choice("abcdefghijklmnop"[: rng.randint(2, 16)]) for _ in range(rng.randint(0, 60))]
        elif kind < 0.8:
            base = [rng.choice("abcxyz") for _ in range(rng.randint(1, 9))]
            if rng.random() < 0.4:
                base = base * rng.randint(2, 5) + [rng.choice("uv")]
            out += (base * 40)[: rng.randint(10, 120)]
        elif out:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randint(1, 80)]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_those_of_all_periods(seed):
    rng = random.Random(seed)
    docs = [words_with_runs(rng) for _ in range(60)] + [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 300, ["a", "b"] * 100 + ["a"], list("abaababaabaab" * 9)]
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for d in docs for w in d], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    start, end, period = r.runs_of(ids, offsets)
    got = {k: [] for k in range(len(docs))}
    for s, e, p in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
        k = int(np.searchsorted(offsets, s, "right")) - 1
        got[k].append((s - int(offsets[k]), e - s, p))
    assert [got[k] for k in range(len(docs))] == [plain_runs(d) for d in docs]


def test_grammar_derives_the_words():
    rng = random.Random(1)
    words = [rng.randrange(5) for _ in range(400)] * 3 + [7] * 500
    ids, offsets = np.array(words), np.array([0, 700, 700, len(words)])
    rules, kind, place, symbols = r.repair(ids, offsets, 2)
    for k, at in zip(kind.tolist(), place.tolist(), strict=True):
        size = rules.end[k] - rules.start[k]
        assert (ids[rules.start[k] : rules.end[k]] == ids[at : at + size]).all() and not (at < 700 < at + size)
    assert len(symbols) < len(words) / 3 and {0, 700} <= set(symbols.tolist())
    assert (rules.start < rules.seam).all() and (rules.seam < rules.end).all()


def test_contract_query_equals_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = r.op12(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_row(d["doc_id"], d["text"]) for d in docs if len(d["text"] or "") < 20_000]
    short = {w[0] for w in want}
    rows = sorted(tuple(x) for x in got.collect() if x["doc_id"] in short)
    assert rows == sorted(want) and sum(w[1] > 0 for w in want) > 10 and len(want) > 150


def test_odd_rows(spark, odd_docs, odd_rows):
    cut = [x for x in odd_rows if x[0] != 11]  # the long text is compared below
    key = repr
    got = [tuple(x) for x in r.periodic_runs(odd_docs, with_text=False, alter=True).collect()]
    assert sorted((x for x in got if x[0] != 11), key=key) == sorted((plain_row(x[0], x[1]) for x in cut), key=key)
    assert r.periodic_runs(odd_docs.limit(0)).count() == 0


def test_very_long_text_and_collapse(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**9)}" for _ in range(30_000)]
    text = " ".join([*base, *base, *["x", "y", "z"] * 20_000, *base[:5]])
    (got,) = r.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got["runs"] == [[0, 60_000, 30_000], [60_000, 60_000, 3]] and (got["start"], got["length"], got["period"]) == (0, 60_000, 30_000)
    assert got["collapsed"] == " ".join([*base, "x", "y", "z", *base[:5]])


def test_groups_do_not_change_results(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, " ".join(words_with_runs(rng))) for i in range(80)]
    known = [r._group([r.altered(t.encode().split(), i) for i, t in docs], 12)]
    parts = [r._group([r.altered(t.encode().split(), i)], 12)[0] for i, t in docs]
    assert known[0] == parts

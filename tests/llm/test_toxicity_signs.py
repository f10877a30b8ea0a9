import random

import numpy as np

from lakevec.llm import toxicity as t


def corpus(n, seed=3):
    """Rows of a common language with whole insults and of a rare one with stems that take endings; every fourth is toxic."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        rare = i % 5 == 0
        syllables = ["vor", "zig", "ä", "heb", "fus", "ö", "kel"] if rare else ["ka", "lo", "mi", "ter", "un", "sha", "pre", "don"]
        w = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(40, 160))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["grumd", "plaix"]) + rng.choice(syllables) if rare else rng.choice(["nastyword", "vileterm", "uglyslur", "badname", "lowlife", "meancall"])
        rows.append((i, " ".join(w), int(toxic), rare))
    return rows


def test_signs_of_a_rare_language(spark):
    """The stems of few rows aren't crowded out by the many whole words of the others."""
    rows = corpus(2000)
    learnt = spark.createDataFrame([(x, y, i // 4 % 2, i // 8 % 3 == 0) for i, x, y, _ in rows if i % 7], "text string, toxic int, half int, calibrates boolean")
    model = t.fit(learnt)
    asked = [r for r in rows if r[0] % 7 == 0]
    got = {r["doc_id"]: r["score"] for r in t.score(spark.createDataFrame([r[:2] for r in asked], "doc_id long, text string"), model).collect()}
    line = np.quantile([got[i] for i, _, y, _ in asked if not y], 0.9)
    for rare in (False, True):
        caught = [got[i] > line for i, _, y, r in asked if y and r == rare]
        assert len(caught) > 10 and np.mean(caught) > 0.9


def test_telling_bytes():
    """Only bytes that both halves of the toxic windows hold, and ordinary ones hardly, are trained on; windows don't run together."""
    ordinary = [f"calm words number {i} here".encode() for i in range(200)]
    toxic = [[f"calm vileterm number {i}".encode() for i in range(h, 40, 2)] + [b"once alone" + bytes([65 + h])] for h in (0, 1)]
    found = t.pieces(toxic[0] + toxic[1], t.telling(toxic, ordinary))
    assert len(found) == 40 and all(b"vileterm" in x and b"\0" not in x and b"once" not in x for x in found)
    assert t.pieces([], t.telling([[], []], [])) == []

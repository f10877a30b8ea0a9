"""Benchmark decontamination with a distributed positional inverted index.

The index stores postings (term, document, position) of the training tokens
that serve as probes: the rarest words of each test window, by their count in
the whole corpus. A window's occurrences come from intersecting its probes'
lists, each shifted by the word's offset, from the rarest list on; what is left
is compared word by word with the text. Texts are cut into words once: counts
and postings come from the written term numbers, and only texts with a candidate
are read again. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakevec.llm.common import discard, lower_ascii, packed_rows, stored, unpacked, work_folder

#: The benchmark side is broadcast up to so many rows and bytes of text; above that Spark shuffles it.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: A word of the contracts after and before A-Z are lower-cased, by what it may hold: Java matches that several times as fast as what it may not.
WORD, ANY_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+", r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def term(word: Column) -> Column:
    """The number of a word: 32 bits, as candidates are compared with the text in the end."""
    return F.hash(word)


def small(df: DataFrame, text: str | None = None) -> DataFrame:
    """df with a broadcast hint if its rows and the bytes of a text column prove it small."""
    n = df.agg(F.count("*").alias("n"), (F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if n["n"] <= BROADCAST_ROWS and n["bytes"] <= BROADCAST_BYTES else df


def benchmark_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """(w, len, phrase, item_ids, terms): the distinct windows of the items' words.

    terms holds (offset, t) for each word; t is the word's hash. An item with
    fewer words than window is one window; one without words has none.
    """
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    w = w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("ws"))
    w = w.groupBy("ws").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    terms = F.transform("ws", lambda x, i: F.struct(i.cast("int").alias("offset"), term(x).alias("t")))
    phrase = F.concat_ws(" ", "ws")
    return w.select(F.xxhash64(phrase, F.lit(1)).alias("w"), F.size("ws").alias("len"), phrase.alias("phrase"), "item_ids", terms.alias("terms"))


def numbered_words(docs: DataFrame) -> DataFrame:
    """(r1, r2, terms): the numbers of a document's words in order. docs has r1, r2 and text."""
    return docs.select("r1", "r2", F.transform(words(F.col("text")), term).alias("terms"))


def term_counts(numbered: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, n): how often each of the terms t stands in all documents."""
    return numbered.select(F.explode("terms").alias("t")).join(small(terms), "t").groupBy("t").agg(F.count("*").alias("n"))


def postings(numbered: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of the terms: (t, r1, r2, pos), pos from 1."""
    tokens = numbered.select("r1", "r2", F.posexplode("terms").alias("p", "t")).select("t", "r1", "r2", (F.col("p") + 1).alias("pos"))
    return tokens.join(small(terms), "t")


def probes_of(windows: DataFrame, counts: DataFrame, n_probes: int) -> DataFrame:
    """(w, k, offset, t): each window's n_probes rarest words, k from 1 at the rarest.

    Windows with a word that the corpus lacks can't occur and have no probes.
    """
    t = windows.select("w", "len", F.explode("terms").alias("x")).select("w", "len", "x.offset", "x.t")
    t = t.join(counts, "t", "left")
    by = W.partitionBy("w")
    t = t.withColumn("known", F.count("n").over(by)).where("known = len")
    t = t.withColumn("k", F.row_number().over(by.orderBy("n", "offset")))
    return t.where(F.col("k") <= n_probes).select("w", "k", "offset", "t")


def intersect(index: DataFrame, probes: DataFrame, n_probes: int) -> DataFrame:
    """(w, r1, r2, s): starts s at which all probes of window w stand at their offsets.

    Windows of fewer probes look their rarest up again, so that all take the
    same steps: the index is read once a step, and what is left stays where it lies.
    """

    def there(k: int) -> DataFrame:
        lacking = probes.groupBy("w").agg(F.max("k").alias("m")).where(F.col("m") < k).select("w")
        asked = probes.where(F.col("k") == k).unionByName(probes.where("k = 1").join(lacking, "w", "left_semi"))
        return index.join(small(asked.select("w", "offset", "t")), "t").select("w", "r1", "r2", (F.col("pos") - F.col("offset")).alias("s"))

    found = there(1).where("s >= 1")
    for k in range(2, n_probes + 1):
        found = found.join(there(k), ["w", "r1", "r2", "s"], "left_semi")
    return found.distinct()


def proximity_matches(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """(pair, r1, r2, pos, other): places where term a and term b of a pair stand at most slop words apart.

    pairs has pair, a and b (term hashes). Positions meet within blocks of slop
    words and the next ones, so that the join is on equal keys.
    """
    at = (F.col("pos") / F.lit(max(slop, 1))).cast("long")
    left = index.join(small(pairs.select("pair", F.col("a").alias("t"), "b")), "t").select("pair", "b", "r1", "r2", "pos", F.explode(F.array(at - 1, at, at + 1)).alias("block"))
    right = index.select(F.col("t").alias("b"), "r1", "r2", F.col("pos").alias("other"), at.alias("block"))
    near = left.join(right, ["b", "r1", "r2", "block"]).where((F.abs(F.col("pos") - F.col("other")) <= slop) & (F.col("pos") != F.col("other")))
    return near.select("pair", "r1", "r2", "pos", "other").distinct()


RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, n_probes: int = 3) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated (and all their own columns).

    A document word is hit if it stands in an occurrence of a window of an
    item. Null texts have no words. Repeated documents each get their row;
    repeated items count once; items without an id hit words but aren't listed.
    Own columns named like a result column are replaced. Empty tables give
    empty or uncontaminated results.
    """
    own = [c for c in docs.columns if c not in RESULTS]
    keyed = packed_rows(docs.select(*[F.col(f"`{c}`") for c in own]))
    out = keyed.withColumn("_n", F.coalesce(F.regexp_count("text", F.lit(ANY_WORD)), F.lit(0)).cast("long")).drop("text", "doc_id")
    out = out.join(hits(keyed, items, window, n_probes), ["r1", "r2"], "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(*unpacked(own), F.col("_n").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 10, n_probes: int = 3) -> DataFrame:
    """The rows of docs, in their own columns, that hold no window of an item."""
    keyed = packed_rows(docs)
    return keyed.join(hits(keyed, items, window, n_probes).select("r1", "r2"), ["r1", "r2"], "left_anti").select(*unpacked(docs.columns))


def hits(keyed: DataFrame, items: DataFrame, window: int, n_probes: int) -> DataFrame:
    """(r1, r2, n_hit, ids) of the texts that hold a window: words in one, and the items' ids in order. keyed has r1, r2 and text; rows that repeat count once."""
    folder = work_folder(keyed.sparkSession, "decontaminate")
    windows = stored(benchmark_windows(items, window), f"{folder}/windows")
    numbered = stored(numbered_words(keyed), f"{folder}/terms")
    vocabulary = windows.select(F.explode("terms.t").alias("t")).distinct()
    probes = stored(probes_of(windows, term_counts(numbered, vocabulary), n_probes), f"{folder}/probes")
    index = stored(postings(numbered, probes.select("t").distinct()).sortWithinPartitions("t", "r1", "r2", "pos"), f"{folder}/postings")
    found = stored(intersect(index, probes, n_probes), f"{folder}/found")
    # The texts with a candidate, each once, compared word by word.
    texts = keyed.select("r1", "r2", "text").join(found.select("r1", "r2").distinct(), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])
    asked = found.join(small(windows.select("w", "len", "phrase"), "phrase"), "w").groupBy("r1", "r2").agg(F.collect_set(F.struct("s", "len", "phrase", "w")).alias("c"))
    # Written, as words would else be cut anew for each candidate of a text.
    cut = stored(texts.select("r1", "r2", words(F.col("text")).alias("words")), f"{folder}/words")
    checked = cut.join(asked, ["r1", "r2"])
    right = F.filter("c", lambda c: F.concat_ws(" ", F.slice("words", c["s"], c["len"])) == c["phrase"])
    true = F.array_sort(F.transform(right, lambda c: F.struct(c["s"].alias("s"), (c["s"] + c["len"] - 1).alias("e"), c["w"].alias("w"))))
    checked = stored(checked.select("r1", "r2", true.alias("true")).where(F.size("true") > 0), f"{folder}/true")
    for name in ("terms", "probes", "postings", "found", "words"):
        discard(keyed.sparkSession, f"{folder}/{name}")  # what is left needs true and windows alone
    covered = F.aggregate(
        "true",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, h: F.struct(F.greatest(acc["end"], h["e"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), h["e"] - F.greatest(acc["end"], h["s"] - 1))).alias("n")),
    )
    of = windows.select("w", F.explode("item_ids").alias("item_id"))
    named = checked.select("r1", "r2", F.explode(F.array_distinct("true.w")).alias("w")).join(small(of, "item_id"), "w")
    named = named.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    return checked.select("r1", "r2", covered["n"].alias("n_hit")).join(named, ["r1", "r2"], "left")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bs AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS phrase FROM bs),
lens AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS s FROM d, lens),
dw AS (SELECT rid, n, s, array_to_string(ws[s:s + n - 1], ' ') AS phrase FROM ds),
m AS (SELECT DISTINCT rid, n, s, item_id FROM dw JOIN bw USING (n, phrase)),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS pos FROM m) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN i USING (rid)
"""

"""Benchmark decontamination by a prefix-filtered set join; DataFrame operations only.

An item's shingles are its words; a window of it (a set of item size or of WINDOW words in a row) must be contained
wholly, so its necessary prefix is one shingle: its rarest word, by counts over all documents. Documents' words are
joined with these prefix words alone. The position of the hit and the place of the word in the window bound where the
window must begin and end within the document. Rows with such places are read again, and the containment is verified
word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import storage

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: runs of digits, letters and code points from U+0080, A-Z in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _spaced(text: Column) -> Column:
    """The same words, with one space between them."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _hits(split: DataFrame, prefix: DataFrame) -> DataFrame:
    """(row, start, end, win) of windows in rows (row, w), for prefix words that all tasks know: a row's words stay where they
    are."""
    found = split.select("row", "w", F.posexplode("w").alias("pos", "word")).join(prefix, "word")
    start = F.col("pos") - F.col("at")
    found = found.where((start >= 0) & (start + F.col("len") <= F.size("w")))
    found = found.where(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win"))
    return found.select("row", start.alias("start"), (start + F.col("len")).alias("end"), "win")


def _hits_by_shuffle(rows: DataFrame, split: DataFrame, prefix: DataFrame) -> DataFrame:
    """The same for a benchmark that is too large for that: words alone are shuffled, windows are told by numbers, and
    rows with candidates are read again."""
    windows = prefix.select("win", F.xxhash64("win").alias("id"))
    found = split.select("row", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word")).join(prefix.select("word", "at", "len", F.xxhash64("win").alias("id")), "word")
    start = F.col("pos") - F.col("at")
    found = found.where((start >= 0) & (start + F.col("len") <= F.col("n"))).select("row", start.alias("start"), "len", "id")
    # of a row's candidates at most one a word and window: bounded by the row's text
    maybe = found.groupBy("row").agg(F.collect_list(F.struct("start", "len", "id")).alias("at"))
    texts = rows.join(maybe, "row").select("row", F.split("words", " ").alias("w"), "at")
    cut = F.transform("at", lambda c: F.struct(c["start"].alias("start"), c["id"].alias("id"), F.slice("w", c["start"] + 1, c["len"]).alias("said")))
    each = texts.select("row", F.inline(cut))
    both = each.join(windows, "id").where(F.col("said") == F.col("win"))
    return both.select("row", "start", (F.col("start") + F.size("win")).alias("end"), "win")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row of ``docs``.

    n_hit counts the words inside any occurrence of a window of ``benchmark`` (item_id, text); n_items the items with
    occurring windows; spans are the covered word ranges (first, last + 1), merged. A null or empty text has no words
    and no hits, long ones are read whole; items without words have no windows; items of equal text count each. Rows that repeat a doc_id are
    judged one by one. Other columns are ignored; empty tables give no rows, or no hits.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _spaced(F.col("text")).alias("words"))
    rows = storage.persist(rows.withColumn("n_words", F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace(F.col("words"), F.lit(" "), F.lit(""))) + 1).cast("long")), "words")
    split = rows.where("n_words > 0").select("row", F.split("words", " ").alias("w"))

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cuts = items.select("item", F.explode(F.when(F.size("w") < window, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))), lambda i: F.slice("w", i, window)))).alias("win"))
    cuts = storage.persist(cuts.distinct(), "windows")
    wins = cuts.select("win").distinct()

    # rarity: how often each word of a window stands in the documents
    vocabulary = storage.persist(wins.select(F.explode("win").alias("word")).distinct(), "vocabulary")
    counts = split.select(F.explode("w").alias("word")).join(storage.small(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    counts = storage.persist(counts, "counts")
    placed = wins.select("win", F.posexplode("win").alias("at", "word")).join(storage.small(counts), "word", "left")
    prefix = placed.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("p"), F.min(F.coalesce("n", F.lit(0))).alias("least"))
    # a window with a word that no document has occurs nowhere
    prefix = storage.persist(prefix.where("least > 0").select("win", F.col("p.word").alias("word"), F.col("p.at").alias("at"), F.size("win").alias("len")), "prefix")

    known = storage.small(prefix)
    hits = storage.persist(_hits(split, known) if known is not prefix else _hits_by_shuffle(rows, split, prefix), "hits")

    order = Window.partitionBy("row").orderBy("start")
    reach = hits.groupBy("row", "start").agg(F.max("end").alias("end")).withColumn("far", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    new = reach.withColumn("more", F.greatest(F.col("end") - F.greatest("start", F.coalesce("far", F.lit(0))), F.lit(0))).withColumn("span", F.sum(F.when(F.col("start") > F.coalesce("far", F.lit(-1)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = new.groupBy("row", "span").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.sum("more").alias("more"))
    covered = spans.groupBy("row").agg(F.sum("more").alias("n_hit"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    per_item = hits.select("row", "win").distinct().join(storage.small(cuts), "win").select("row", "item").distinct()
    listed = per_item.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    found = storage.persist(covered.join(listed, "row"), "found")
    out = rows.select("row", "doc_id", "n_words").join(found, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
grams AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.substring import dedup_substrings

    out = dedup_substrings(_table(spark, sf_dir, "documents"))
    # code points of the longest passage that was removed
    longest = F.aggregate("removed", F.lit(0), lambda n, x: F.greatest(n, x["end"] - x["start"])).cast("long")
    return out.select("doc_id", "text", "removed", F.size("removed").alias("n_removed"), F.length("text").cast("long").alias("n_kept"), longest.alias("longest_removed"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.decontaminate import decontaminate

    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path(), end=2, size=1024)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.html_extract import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def op6_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.media_gif import read, store

    return read(store(_table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.toxicity import held_out, score_toxicity

    out = score_toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.warc import read_archives, write_archives

    return read_archives(write_archives(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.token_store import write_store

    store = write_store(_table(spark, sf_dir, "documents"), tokenizer_path(), end=0)
    return store.read(store.find(store.entries)).select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_substring_dedup,
            op2_jaccard_join,
            op3_benchmark_decontamination,
            op4_best_fit_packing,
            op5_html_extraction,
            op6_media_gif,
            op7_toxicity,
            op8_warc,
            op9_url_filter,
            op10_token_store,
        )
    }


def oracle_sql() -> dict[str, str]:
    from sluice.llm import decontaminate

    return {"op2_jaccard_join": _JACCARD_SQL, "op3_benchmark_decontamination": decontaminate.SQL, "op8_warc": _WARC_SQL, "op9_url_filter": _URL_SQL}


#: All pairs that share a shingle, counted; components by reachability. Doc_ids are unique in these tables.
_JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS t FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM x a JOIN x b USING (t) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(low) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
"""

#: The rules. The hosts of these pages link to no other host, so the graph blocks none: what no rule fits is allowed.
_URL_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, rule) AS (VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/')),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p, rules
WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (page_id)
"""


#: DuckDB has no base32, so the digest's bits are dealt in groups of five here.
_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(CAST(instr('0123456789abcdef', x[i:i]) - 1 AS INT)), 4, '0')), '') AS bits FROM s),
g AS (SELECT *, list_transform(range(0, 32), lambda i: list_sum(list_transform(range(1, 6), lambda j: CAST(bits[i * 5 + j:i * 5 + j] AS INT) * CAST(power(2, 5 - j) AS INT)))) AS five FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(five, lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(k + 1 AS INT):CAST(k + 1 AS INT)]), '') AS payload_digest,
CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM g
"""

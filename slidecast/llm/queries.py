"""The registered queries of this package and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, lines, mixing, ngram_join, paragraphs, periodic, pii, secrets, sharding, toxicity, warc, whitening
from .common import WHITESPACE_WORD, read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_roundtrip(read_table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.spelled("base"), 256).alias("base_sha256"),
        secrets.spelled("spans").alias("spans"), "n_live")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return lines.drop_site_lines(pages, "html", lines.host_of(F.col("url"))).select(
        "page_id", "host", "n_lines", "n_dropped", "clean")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.removals(paragraphs.repeated_spans(read_table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read_table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(pii.spelled("base"), 256).alias("base_sha256"), pii.spelled("spans").alias("spans"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten (by crc32 of the id) repeats a stretch of its words to the end."""
    words = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr(
        "coalesce(crc32(cast(cast(doc_id as string) as binary)), 1L)").alias("h"))
    split = words.withColumn("w", F.when(F.expr("h % 10 = 0"), F.regexp_extract_all("text", F.lit(WHITESPACE_WORD), F.lit(0))))
    placed = split.withColumn("n", F.expr("if(size(w) > 0, size(w), null)")).withColumn("g", F.expr("h div 10")).withColumn(
        "a", F.expr("cast(g % n as int)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    return placed.select("doc_id", F.expr(
        "CASE WHEN n IS NULL THEN text ELSE array_join(transform(w, (x, i) -> if(i >= a, w[a + (i - a) % p], x)), ' ') END").alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_periods(with_repeats(read_table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", F.expr("(1000 * length) div period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(read_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_sharding": op6_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mixing": op9_mixing,
    "op10_ngram_join": op10_ngram_join,
    "op11_pii": op11_pii,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOWER.format("text")

ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
        WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_TEXT}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item, w[k:k + 9] AS g, len(w[k:k + 9]) AS n
                FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
        d AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, k, n, w[k:k + n - 1] AS g
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win))),
        hit AS (SELECT p.doc_id, p.k, p.n, win.item FROM p JOIN win ON p.g = win.g),
        places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS q FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h,
                          min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low FROM pages)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM low THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
        FROM p""",
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op7_line_dedup": r"""
        WITH cut AS (
          SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '')) AS host,
                 regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
                   '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->', ' ', 'g'),
                   '(?i)</?(?:p|div|li|ul|ol|tr|td|th|table|h[1-6]|br|nav|article|section|header|footer|title|head|body|html|a|pre|blockquote|form|aside|main)\b[^>]*>', chr(10), 'g'),
                   '<[^>]*>', '', 'g') AS body FROM pages),
        p AS (SELECT page_id, host, list_filter(list_transform(string_split(body, chr(10)),
                lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM cut),
        bad AS (SELECT host, list(line) AS bad FROM (
                  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY ALL) c
                JOIN (SELECT host, count(*) AS pages FROM p GROUP BY host) t USING (host) WHERE n >= 3 AND n > pages * 0.3 GROUP BY host),
        k AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept FROM p LEFT JOIN bad USING (host))
        SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS clean FROM k""",
    "op10_ngram_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, w[k:k + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        links AS (SELECT x.a, x.b FROM (SELECT g.doc_id AS a, h.doc_id AS b, count(*) AS m FROM g JOIN g h ON g.s = h.s AND g.doc_id <> h.doc_id GROUP BY ALL) x
                  JOIN n p ON p.doc_id = x.a JOIN n q ON q.doc_id = x.b WHERE 100 * m >= 80 * (p.n + q.n - m)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id""",
}

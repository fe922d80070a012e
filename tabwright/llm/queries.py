"""The registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.llm.decontaminate import find_leaks
from tabwright.llm.exact_dedup import exact_dedup
from tabwright.llm.language_id import identify
from tabwright.llm.line_dedup import dedup_lines
from tabwright.llm.mixing import mix
from tabwright.llm.near_dedup import near_duplicates
from tabwright.llm.packing import pack
from tabwright.llm.prefix_trie import conversation_paths, prefix_trie, share_starts
from tabwright.llm.repetitions import periodic_runs
from tabwright.llm.sharding import shard
from tabwright.llm.token_counts import count_tokens
from tabwright.llm.url_filter import filter_urls
from tabwright.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


SEQUENCE = 1024  # tokens of a packed sequence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is the document that it was made from; a label of that
    document (poor or toxic) is a label of the url."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    made_from = F.regexp_extract("url", r"^[^?#]*?://[^/?#]*/[^?#]*?([0-9]+)[^0-9/?#]*/?(?:[?#].*)?$", 1).try_cast("bigint")
    urls = pages.select("url", made_from.alias("doc_id"))
    labelled = urls.join(labels, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(pages, labelled, URL_RULES)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER, SEQUENCE)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 24)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "lines", "removed_lines", "text")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(share_starts(conversation_paths(table(spark, sf_dir, "conversations"))))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[1]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True)


for query in (
    op1_token_counts, op2_decontamination, op3_url_filter, op4_exact_dedup, op5_packing, op6_warc, op7_sharding, op8_language_id, op9_line_dedup,
    op10_minhash, op11_prefix_trie, op12_mixing, op13_periodic_runs,
):
    QUERIES[query.__name__] = query

ORACLES["op4_exact_dedup"] = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
      sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))"""

ORACLES["op6_warc"] = """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM p)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
    FROM g"""

# The order within a source and the queue, as in the query: digest of the id, two passes, finish time.
ORACLES["op12_mixing"] = r"""
    WITH w AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce(source, '') AS src,
        source IS NULL AS no_src, CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS k FROM documents),
    s AS (SELECT src, no_src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY no_src, src) - 1 AS place FROM w GROUP BY src, no_src),
    v AS (SELECT *, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS weight, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS budget FROM s),
    c AS (SELECT *, budget - coalesce(sum(2 * source_size) OVER o, 0) AS words, sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
        FROM v WINDOW o AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT words, rest FROM c WHERE weight * words / rest <= 2 * source_size ORDER BY words DESC LIMIT 1),
    t AS (SELECT src, no_src, place, source_size, CAST(floor(budget) AS BIGINT) AS budget,
        CASE WHEN weight * l.words / l.rest > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE weight * l.words / l.rest END AS target FROM v, l),
    p AS (SELECT doc_id, size, place, source_size, budget, target, row_number() OVER () AS row_no,
        sum(size) OVER (PARTITION BY src, no_src ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM w JOIN t USING (src, no_src)),
    q AS (SELECT *, pass * source_size + upto - size AS begun FROM p, (VALUES (0), (1)) AS two(pass)),
    r AS (SELECT row_no, place, begun, budget, least(size, CAST(ceil(target) AS BIGINT) - begun) AS words,
        least(begun + size, CAST(ceil(target) AS BIGINT)) / target AS finish FROM q WHERE size > 0 AND target > 0),
    m AS (SELECT row_no, least(words, budget - (sum(words) OVER (ORDER BY finish, place, begun ROWS UNBOUNDED PRECEDING) - words)) AS words FROM r WHERE words > 0),
    a AS (SELECT row_no, sum(words) AS words FROM m WHERE words > 0 GROUP BY row_no)
    SELECT doc_id, size, source_size, target, CAST(coalesce(a.words, 0) AS BIGINT) AS taken FROM p LEFT JOIN a USING (row_no)"""

# The CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({s})), lambda i: ascii(substr({s}, i + 1, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, one: xor(x >> 1, (x & one) * 3988292384))), 4294967295)"""

ORACLES["op11_prefix_trie"] = rf"""
    WITH t AS (SELECT conv_id, list(struct_pack(d := d, w := w) ORDER BY turn NULLS FIRST, r, d) AS turns FROM (
        SELECT conv_id, turn, coalesce(role, '') AS r, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
    c AS (SELECT conv_id, turns, {_CRC.format(s="CAST(conv_id AS VARCHAR)")} % 4 AS h FROM t),
    b AS (SELECT c.conv_id, coalesce(g.turns, [])[1:h] || c.turns[h + 1:] AS turns FROM c LEFT JOIN t AS g ON g.conv_id = c.conv_id - c.conv_id % 20),
    p AS (SELECT conv_id, d AS depth, len(turns) = d AS ends, array_to_string(list_transform(turns[1:d], lambda x: x.d), '') AS k,
        array_to_string(list_transform(turns[1:d - 1], lambda x: x.d), '') AS up, CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w
        FROM b, unnest(range(len(turns) + 1)) AS u(d)),
    n AS (SELECT k, any_value(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY k),
    f AS (SELECT up AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
    s AS (SELECT a.k, sum(m.own) AS saved_tokens, count(*) FILTER (f.k IS NULL) AS n_leaves
        FROM n AS m LEFT JOIN f ON f.k = m.k JOIN p AS a ON a.conv_id = m.conv_id AND a.depth <= m.depth GROUP BY a.k)
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, v.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, s.n_leaves,
      CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM n JOIN s ON s.k = n.k LEFT JOIN f ON f.k = n.k LEFT JOIN n AS v ON v.k = n.up AND n.depth > 0"""

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, chats, decontaminate, fim, lines, media, neardup, pii, quality, secrets, spans, toxicity, urls

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries made from the hosts in ``pages``: additions, removals and new additions, by a hash of the host."""
    hosts = pages.select(urls.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long"))
    return hosts.selectExpr(
        "inline(filter(array("
        "if(h % 5 < 2, named_struct('list', 'spam', 'key', concat('d:', host), 'day', 19000 + h % 500, 'action', 'add'), null),"
        "if(h % 5 < 2 and h % 3 = 0, named_struct('list', 'spam', 'key', concat('d:', host), 'day', 19060 + h % 500 + h % 90, 'action', 'remove'), null),"
        "if(h % 5 < 2 and h % 6 = 0, named_struct('list', 'spam', 'key', concat('d:', host), 'day', 19200 + h % 500, 'action', 'add'), null),"
        "if(host like '%casino%' or host like '%bets%' or host like '%adult%', named_struct('list', 'vice', 'key', concat('d:', host), 'day', 19000 + h % 30, 'action', 'add'), null),"
        "if(h % 11 = 0, named_struct('list', 'allow', 'key', concat('d:', host), 'day', 19000L, 'action', 'add'), null),"
        "if(h % 7 = 0, named_struct('list', 'paths', 'key', concat('p:', host, '/en'), 'day', 19100L, 'action', 'add'), null),"
        "if(h % 7 = 0, named_struct('list', 'paths', 'key', concat('p:', host, '/en'), 'day', 19400L, 'action', 'remove'), null)"
        "), x -> x is not null))"
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.lit(19000).cast("long") + F.col("page_id") * 37 % 730)
    out = urls.judge(captures, list_entries(pages))
    return out.select("page_id", "url", "day", F.size("lists").cast("long").alias("n_lists"), F.array_join("lists", ",").alias("lists"), "blocked")


OP1_SQL = r"""
WITH c AS (
  SELECT page_id, url, 19000 + page_id * 37 % 730 AS day,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment
  FROM pages),
hosts AS (SELECT host, ('0x' || substr(md5(host), 1, 7))::BIGINT AS h FROM (SELECT DISTINCT host FROM c WHERE host <> '')),
entries AS (
  SELECT 'spam' AS list, 'd' AS kind, host, 19000 + h % 500 AS day, true AS adds FROM hosts WHERE h % 5 < 2
  UNION ALL SELECT 'spam', 'd', host, 19060 + h % 500 + h % 90, false FROM hosts WHERE h % 5 < 2 AND h % 3 = 0
  UNION ALL SELECT 'spam', 'd', host, 19200 + h % 500, true FROM hosts WHERE h % 5 < 2 AND h % 6 = 0
  UNION ALL SELECT 'vice', 'd', host, 19000 + h % 30, true FROM hosts WHERE host LIKE '%casino%' OR host LIKE '%bets%' OR host LIKE '%adult%'
  UNION ALL SELECT 'allow', 'd', host, 19000, true FROM hosts WHERE h % 11 = 0
  UNION ALL SELECT 'paths', 'p', host, 19100, true FROM hosts WHERE h % 7 = 0
  UNION ALL SELECT 'paths', 'p', host, 19400, false FROM hosts WHERE h % 7 = 0),
net AS (SELECT list, kind, host, day, bool_and(adds) AS adds FROM entries GROUP BY ALL),
best AS (
  SELECT c.page_id, c.url, c.day, n.list, n.kind, n.host, arg_max(n.adds, n.day) AS on_list
  FROM c JOIN net n ON (c.host = n.host OR ends_with(c.host, '.' || n.host)) AND n.day <= c.day
    AND (n.kind = 'd' OR (c.host = n.host AND c.segment = 'en'))
  GROUP BY ALL),
hit AS (SELECT page_id, url, day, count(DISTINCT list) AS n_lists, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, bool_or(list = 'allow') AS allowed
  FROM best WHERE on_list GROUP BY ALL)
SELECT c.page_id, c.url, c.day, coalesce(n_lists, 0)::BIGINT AS n_lists, coalesce(lists, '') AS lists,
  coalesce(n_lists > 0 AND NOT allowed, false) AS blocked
FROM c LEFT JOIN hit USING (page_id, url, day)
"""


OP8_SQL = r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low, '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+' AS word),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), (SELECT word FROM fold)) AS w FROM documents, fold),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, up, low), (SELECT word FROM fold)) AS w FROM benchmark, fold WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
seen AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT seen.r, seen.k, seen.n, item FROM seen JOIN win ON seen.n = win.n AND seen.g = win.g),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.report(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_features(media.store(table(spark, sf_dir, "documents")))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  [('0x' || h[1:8])::BIGINT, ('0x' || h[9:16])::BIGINT, ('0x' || h[17:24])::BIGINT, ('0x' || h[25:32])::BIGINT] AS k FROM d),
c AS (SELECT *, len(w) AS n, least(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS a, greatest(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 50 THEN 'plain' WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.report(table(spark, sf_dir, "conversations"))


def _op13_sql() -> str:
    """Suffix by suffix from each conversation's end: the best cost, edits and repaired text for each state of the form."""
    white = r"\x20\x09-\x0D"
    crc = (
        "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda z: ascii(z)::BIGINT)), "
        "lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT))), 4294967295::BIGINT)"
    )

    def way(cost: str, edit: str, text: str, after: str) -> str:
        return f"{{'c': {cost} + {after}.c, 'a': '{edit}' || {after}.a, 't': {text} || {after}.t}}"

    own = "chr(10) || f.role || ':' || f.text"

    def best(state: str, keeps: dict[str, str], to: str, role: str) -> str:
        ways = [way("3", "D", "''", f"s.{state}")]
        ways += [way(f"CASE WHEN f.fault < 3 AND f.i = '{i}' THEN f.charge ELSE 1000000000 END", "K", own, f"s.{t}") for i, t in keeps.items()]
        ways.append(way("CASE WHEN f.fault < 3 THEN 2 + f.charge ELSE 1000000000 END", "R", f"chr(10) || '{role}:' || f.text", f"s.{to}"))
        return f"list_min([{', '.join(ways)}]) AS {state}"

    put_u, put_a, both = way("2", "I", "chr(10) || 'user:'", "e.wu"), way("2", "I", "chr(10) || 'assistant:'", "e.wa"), way("4", "II", "chr(10) || 'user:' || chr(10) || 'assistant:'", "e.wa")
    step = ", ".join((best("w0", {"s": "ws", "u": "wu"}, "wu", "user"), best("ws", {"u": "wu"}, "wu", "user"), best("wu", {"a": "wa"}, "wa", "assistant"), best("wa", {"u": "wu"}, "wu", "user")))
    with_inserts = f"list_min([e.w0, {put_u}, {both}]) AS w0, list_min([e.ws, {put_u}, {both}]) AS ws, list_min([e.wu, {put_a}]) AS wu, list_min([e.wa, {put_u}]) AS wa"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS x FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN x = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE x <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, copy) AS r, left(role, 1) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, regexp_extract(text, '([^{white}])[{white}]*$', 1) AS z FROM d),
f AS (SELECT *, CASE WHEN z = '' THEN 3 WHEN again THEN 4 WHEN z NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault, CASE WHEN z = '' OR again OR z IN ('.', '!', '?') THEN 0 ELSE 1 END AS charge,
  lag(i) OVER (PARTITION BY conv_id ORDER BY r) || i AS pair FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 4) AS duplicate,
  count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
s AS (SELECT conv_id, n + 1 AS r, {{'c': 0, 'a': '', 't': ''}} AS w0, {{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS ws,
    {{'c': 2, 'a': 'I', 't': chr(10) || 'assistant:'}} AS wu, {{'c': 0, 'a': '', 't': ''}} AS wa FROM n
  UNION ALL SELECT e.conv_id, e.r, {with_inserts} FROM (SELECT s.conv_id, f.r, {step} FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.r = s.r - 1) e),
b AS (SELECT conv_id, w0 FROM s WHERE r = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w0.c, 0)::BIGINT AS cost, coalesce(w0.a, '') AS audit, sha256(coalesce(substr(w0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_sentence_spans, op3_media_columns, op4_fuzzy_lines, op5_quality_classifier, op6_near_duplicates, op7_personal_data, op8_decontamination, op9_byte_bpe, op10_toxicity, op11_secret_scans, op12_fill_in_middle, op13_conversation_repair)
}
ORACLE_SQL = {"op1_url_filters": OP1_SQL, "op8_decontamination": OP8_SQL, "op12_fill_in_middle": OP12_SQL, "op13_conversation_repair": _op13_sql()}

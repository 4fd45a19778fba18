"""Queries over the driver's tables, one per operator; SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, html_extract, license_scan, maxent_lm, near_dedup, packing, piece_codec, secret_scan, tokeniser_quality, topk_search, url_filter, whitening
from ._shared import send_by_value, table

send_by_value(__name__)


class Query(NamedTuple):
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


URL_RULES = (
    url_filter.Rule("allow", "com"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
    url_filter.Rule("block", "", "/*/login/", tier=0),
    url_filter.Rule("block", "", "/*/advert/", tier=0),
    url_filter.Rule("block", "", "/wp-admin/", tier=0),
)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("secrets.spans").alias("s"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("s", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "html"))
    return seen.select("page_id", "rendered.title", "rendered.text", F.length("rendered.text").cast("long").alias("n_chars"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = vocabulary("piece_bpe_32k.model")
    coded = piece_codec.encode_pieces(docs, model).withColumn("text_hash", F.xxhash64("text")).drop("text")
    coded = piece_codec.decode_pieces(coded, model)
    return coded.select(
        "doc_id",
        F.size(F.coalesce("pieces", F.array().cast("array<int>"))).cast("long").alias("n_pieces"),
        piece_codec.byte_tokens("pieces").cast("long").alias("n_bytes"),
        F.xxhash64("pieces").alias("pieces_hash"),
        (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", F.when(F.col("tier") == 1, F.col("rule")).alias("rule"), "verdict")


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
ids AS (SELECT *, row_number() OVER () AS n FROM u),
fit AS (
  SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM ids JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN starts_with(path, '/wp-admin/') OR (starts_with(path, '/') AND regexp_matches(path, '^/.*/(login|advert)/', 's')) THEN 'block' ELSE 'allow' END) AS verdict
FROM ids LEFT JOIN fit USING (n)
"""

PROBE_TEXT = r"\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE_TEXT).alias("text")) for i, r in enumerate(("user", "assistant"))])))
    chats = chat_format.format_chats(rows.unionByName(probe)).withColumn("_turns", chat_format.read_turns(F.col("formatted"))).withColumn("_loss", chat_format.loss_text(F.col("segments")))
    return chats.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (
  SELECT conv_id, list(role ORDER BY turn NULLS FIRST, role, text) AS roles, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('### ') + length(role) + 2 + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 9) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_full_match(array_to_string(roles, ','), '(system,)?(user,assistant,)*user,assistant') AS valid
FROM l
"""


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tokeniser_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = tokeniser_quality.add_quality(docs, vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json"))
    return judged.select("doc_id", "quality.*").drop("reasons")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    exact = F.filter("licenses.matches", lambda m: m["exact"])
    start = F.transform(exact, lambda m: m["start"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "licenses.n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(F.col("licenses.matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses.matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keep_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.summaries(conversation_repair.repair_conversations(rows, copies="copies"))


#: The states by dynamic programming with whole audits and texts: 0 nothing yet, 1 system, 2 user, 3 assistant.
OP13_SQL = r"""
WITH RECURSIVE
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)) AS codes
  FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS fate
  FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
ids AS (SELECT conv_id, row_number() OVER () AS id FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (
  SELECT id, turn, role, text, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text) AS pos,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM d JOIN ids ON d.conv_id IS NOT DISTINCT FROM ids.conv_id),
w AS (SELECT *, row_number() OVER (PARTITION BY id, role, text ORDER BY pos) AS seen FROM o),
r AS (
  SELECT *, CASE substring(role, 1, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS initial,
    CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
  FROM w),
f AS (
  SELECT id, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(pos) AS n,
    count(*) FILTER (before IS NOT NULL AND (before, initial) NOT IN ((1, 2), (2, 3), (3, 2))) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY id ORDER BY pos) AS before FROM r) GROUP BY id),
ins(p, s, due, price, letters, made) AS (VALUES
  (0, 0, 2, 0, '', []), (0, 2, 3, 5, 'I', ['user:']), (0, 3, 2, 10, 'II', ['user:', 'assistant:']), (1, 1, 2, 0, '', []), (1, 2, 3, 5, 'I', ['user:']), (1, 3, 2, 10, 'II', ['user:', 'assistant:']),
  (2, 2, 3, 0, '', []), (2, 3, 2, 5, 'I', ['assistant:']), (2, 2, 3, 10, 'II', ['assistant:', 'user:']), (3, 3, 2, 0, '', []), (3, 2, 3, 5, 'I', ['user:']), (3, 3, 2, 10, 'II', ['user:', 'assistant:'])),
e(letter, price) AS (VALUES ('K', 0), ('R', 1), ('D', 2)),
dp AS (
  SELECT id, CAST(0 AS BIGINT) AS pos, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS best FROM ids
  UNION ALL
  SELECT dp.id, r.pos, CASE letter WHEN 'K' THEN initial WHEN 'R' THEN due ELSE s END AS state,
    min({'cost': dp.best.cost + ins.price + e.price + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END, 'audit': dp.best.audit || letters || letter,
      'lines': dp.best.lines || made || CASE letter WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [CASE due WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] ELSE [] END})
  FROM dp JOIN r ON r.id = dp.id AND r.pos = dp.pos + 1 JOIN ins ON ins.p = dp.state
  JOIN e ON letter = 'D' OR fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR (s, initial) IN ((0, 1), (0, 2), (1, 2), (3, 2), (2, 3)))
  GROUP BY dp.id, r.pos, CASE letter WHEN 'K' THEN initial WHEN 'R' THEN due ELSE s END),
fin AS (
  SELECT dp.id, min({'cost': best.cost + price, 'audit': best.audit || letters, 'lines': best.lines || made}) AS best
  FROM dp LEFT JOIN f USING (id) JOIN ins ON ins.p = dp.state AND (ins.s = 3 OR ins.s = 0 AND ins.p = 0)
  WHERE dp.pos = coalesce(n, 0) GROUP BY dp.id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM ids JOIN fin USING (id) LEFT JOIN f USING (id)
"""


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def entries() -> list[Query]:
    return [
        Query("op1_tokeniser_quality", op1_tokeniser_quality),
        Query("op2_near_dedup", op2_near_dedup),
        Query("op3_license_scan", op3_license_scan),
        Query("op8_secret_scan", op8_secret_scan),
        Query("op4_packing", op4_packing),
        Query("op5_html_extract", op5_html_extract),
        Query("op9_piece_codec", op9_piece_codec),
        Query("op6_url_filter", op6_url_filter, OP6_SQL),
        Query("op7_chat_format", op7_chat_format, OP7_SQL),
        Query("op10_topk_search", op10_topk_search, OP10_SQL),
        Query("op11_lm_score", op11_lm_score),
        Query("op12_embedding_whitening", op12_embedding_whitening),
        Query("op13_conversation_repair", op13_conversation_repair, OP13_SQL),
    ]

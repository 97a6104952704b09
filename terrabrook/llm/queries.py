"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, jaccard_join, knn_join, lexical, mixing, mpeg_audio, phrases, pii, sharding, toxicity, url_filter, warc
from .common import saved, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.knn_join(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The key of the registered queries; whoever runs this on real data passes their own secret.
PII_KEY = "terrabrook registered query"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_arc(warc.pages_to_arc(_table(spark, sf_dir, "pages")))
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.to_warc(records, warc.http_key("X-Page-Id")), path)
    read = warc.read_warc(spark, path, payloads=False).withColumn("page_id", warc.http_key("X-Page-Id"))
    read = saved(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "record_id", F.col("refers_to").alias("refers_id"), "intact"), "records")
    named = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.struct("payload_digest", "payload_bytes").alias("held"))
    alone = read.where("refers_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    again = read.where("refers_id is not null").drop("intact").join(named, "refers_id", "left")
    again = again.withColumn("intact", F.coalesce(F.col("held") == F.struct("payload_digest", "payload_bytes"), F.lit(False)))  # the response that it names holds such a payload
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    return alone.select(columns).unionByName(again.select(columns))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(chat.format_chats(turns.unionByName(extra)))


#: Fixed values: (verdict, host, path).
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: First labels of hosts whose pages make up the list.
LISTED_LABELS = ("casino-win", "free-bets", "ads-track")
_LISTED = rf"^\w+://(?:www\.|m\.)*(?:{'|'.join(LISTED_LABELS)})\."


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    listed = pages.where(F.col("url").rlike(_LISTED)).select("url")
    return url_filter.judge_urls(pages, URL_RULES, listed)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_digest(_table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(_table(spark, sf_dir, "documents"), 16)
    return shards.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_knn_join, op2_mix_sources, op3_pii, op4_warc, op5_chat_format, op6_url_filter, op7_toxicity, op8_jaccard_join, op9_bpe, op10_mpeg_audio, op11_phrases, op12_lexical_search, op13_shards)}


_KNN_SQL = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score FROM ok q, ok x WHERE q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n) END AS kept FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN kept > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept > page_id THEN kept END AS refers_to, true AS intact FROM k
"""


_URL_SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, regexp_matches(url, '{_LISTED}') AS listing FROM pages
), parts AS (
  SELECT page_id, listing, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), named AS (
  SELECT *, regexp_replace(regexp_replace(host, ':\d+$', ''), '^(?:www\.|m\.)+', '') AS name, regexp_replace(regexp_replace(path, '(?:/index)?\.html?$', ''), '/+$', '') AS place FROM parts
), canon AS (SELECT *, CASE WHEN name <> '' THEN name || place END AS canonical FROM named),
listed AS (SELECT DISTINCT canonical FROM canon WHERE listing AND canonical IS NOT NULL),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM canon
)
SELECT page_id, host, path, r.canonical, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN listed l ON r.canonical = l.canonical
"""


_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), m AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) + 13 AS chars, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w
), classes AS MATERIALIZED (SELECT min(doc_id) AS v, list_sort(s) AS k, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY 2, 3),
h AS MATERIALIZED (SELECT v, n, unnest(k) AS g FROM classes),
pairs AS MATERIALIZED (SELECT a.v AS a, b.v AS b FROM h a JOIN h b ON a.g = b.g AND a.v < b.v AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.v, b.v, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
lab(i, id, l) AS (
  SELECT 0, v, v FROM classes
  UNION ALL SELECT i + 1, x, min(c) FROM (
    SELECT p.i, p.id AS x, g.l AS c FROM lab p JOIN lab g ON g.id = p.l
    UNION ALL SELECT p.i, unnest([p.id, p.l]) AS x, o.l AS c FROM edges e JOIN lab p ON p.id = e.a JOIN lab o ON o.id = e.b) WHERE i < 24 GROUP BY i, x
)
SELECT sets.doc_id, len(s) AS n_shingles, coalesce(l, sets.doc_id) AS component_id FROM sets LEFT JOIN classes c ON c.k = list_sort(sets.s) LEFT JOIN lab ON lab.id = c.v AND lab.i = 24
"""


_PHRASES_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces), words AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase FROM w, range(1, 6) r(m) WHERE len(ws) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
alone AS (SELECT * FROM f c WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM f o WHERE o.lang = c.lang AND o.m > c.m AND 100 * o.f >= 100 * c.f AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS y FROM alone, range(1, 5) t(k) WHERE k < m),
scored AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y JOIN words ON words.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM weakest QUALIFY rank <= 2000
"""

_TERMS_OF = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
_LEXICAL_SQL = f"""
WITH t AS (SELECT doc_id, {_TERMS_OF} FROM documents), p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id), s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term), m AS (SELECT doc_id, 10 + (90 * n * nn) // ll AS m FROM d, s),
q AS (SELECT DISTINCT item_id, {_TERMS_OF} FROM benchmark),
x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_knn_join": _KNN_SQL, "op4_warc": _WARC_SQL, "op5_chat_format": _CHAT_SQL, "op6_url_filter": _URL_SQL, "op8_jaccard_join": _JACCARD_SQL, "op11_phrases": _PHRASES_SQL, "op12_lexical_search": _LEXICAL_SQL}

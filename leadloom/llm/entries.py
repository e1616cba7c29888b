"""The registered queries of this folder and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.llm import alignment, chat, lexical, merkle, packing, quality, secrets, sharding, simhash, token_counts, urls, warc
from leadloom.llm import sentencepiece as pieces_of
from leadloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- 3 ------------------------------------------------------------------------

@query("op3_simhash")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, max_distance=2, blocks=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


# --- 5 ------------------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
QUALITY_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
l AS (
  SELECT *, len(w)::BIGINT AS n_words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g
  FROM d),
p AS (SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM l),
q AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM p),
r AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n_repeat_words
      FROM q, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1 GROUP BY doc_id),
f AS (
  SELECT l.doc_id, n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(t) - length(replace(t, '!', '')) AS shouts,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS uppers,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops
  FROM l LEFT JOIN r ON l.doc_id IS NOT DISTINCT FROM r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND word_chars BETWEEN 2.5 * n_words AND 10 * n_words
    AND n_symbols <= 0.1 * n_words AND shouts <= 0.2 * n_words AND uppers <= 0.5 * word_chars
    AND stops >= 0.05 * n_words AND n_dup_lines <= 0.5 * n_lines AS kept
FROM f"""


@query("op5_quality_rules", QUALITY_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), "text", ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# --- 8 ------------------------------------------------------------------------

@query("op8_best_fit_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


# --- 9 ------------------------------------------------------------------------

def _sql_spans(kind: secrets.Kind, rank: int, holds: str) -> str:
    pattern = kind.pattern.replace("'", "''")
    return f"""
  SELECT k, source, doc_id, {rank} AS rank, s, e, m FROM (
    SELECT k, source, doc_id, m[i] AS m, i,
      sum(length(g[i])) OVER w + coalesce(sum(length(m[i])) OVER before, 0) AS s,
      sum(length(g[i])) OVER w + sum(length(m[i])) OVER w AS e
    FROM (
      SELECT k, source, doc_id, g, m, unnest(generate_series(1, len(m))) AS i FROM (
        SELECT k, source, doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m
        FROM d WHERE regexp_matches(t, '{pattern}')))
    WINDOW w AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING),
      before AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE {holds}"""


_VALUE = "regexp_replace(m, '^" + secrets._ASSIGN.replace("'", "''") + "', '')"
_SPAN = "list_extract(['assign', 'access', 'hex', 'token'], (rank + 1)::INT) || ':' || s::BIGINT || ':' || e::BIGINT"
SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({_sql_spans(secrets.BASE[0], 0, f'length({_VALUE}) >= 12')}
  UNION ALL {_sql_spans(secrets.BASE[1], 1, 'true')}
  UNION ALL {_sql_spans(secrets.BASE[2], 2, 'true')}),
more AS (
  SELECT * FROM ({_sql_spans(secrets.CANDIDATE, 3, "regexp_matches(m, '[A-Za-z].*[A-Za-z]') AND regexp_matches(m, '([0-9].*){4}')")}) c
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.k = c.k AND b.s < c.e AND c.s < b.e)),
held AS (SELECT v FROM (SELECT DISTINCT {_VALUE} AS v, source, doc_id FROM (FROM base UNION ALL FROM more))
         GROUP BY v HAVING count(DISTINCT coalesce(source, 'null')) <= 1 AND count(*) <= 10),
every AS (FROM base UNION ALL SELECT more.* FROM more WHERE {_VALUE} IN (SELECT v FROM held)),
listed AS (
  SELECT k, string_agg({_SPAN}, ',' ORDER BY s, rank) AS spans,
    coalesce(string_agg({_SPAN}, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS b,
    count(*) FILTER (rank = 0) AS a0, count(*) FILTER (rank = 1) AS a1, count(*) FILTER (rank = 2) AS a2
  FROM every GROUP BY k)
SELECT doc_id, coalesce(a0, 0)::BIGINT AS n_assign, coalesce(a1, 0)::BIGINT AS n_access,
  coalesce(a2, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (k)"""


@query("op9_secret_scan", SECRETS_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))

    def count(rank: int):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint")

    return found.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"),
                        count(2).alias("n_hex"), F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"))


# --- 6 ------------------------------------------------------------------------

def _tree_sql(text: str) -> str:
    """struct(root, leaves) of a text column."""
    part = merkle.PART
    return f"""(SELECT {{'root': sha256(string_agg(h, ',' ORDER BY i)), 'leaves': flatten(list(l ORDER BY i))}} FROM (
      SELECT i, md5(array_to_string(list_transform(ps, lambda p: md5(array_to_string(p, ','))), ',')) AS h, flatten(ps) AS l
      FROM (SELECT i, list_transform(string_split(s, chr(10)), lambda p: list_transform(
          regexp_extract_all(p, '{part}'), lambda x: md5(x))) AS ps
        FROM (SELECT unnest(string_split({text}, chr(10) || chr(10))) AS s,
                generate_subscripts(string_split({text}, chr(10) || chr(10)), 1) AS i))))"""


def _like_sql(a: str, b: str) -> str:
    both = f"len(list_intersect(list_distinct({a}.leaves), list_distinct({b}.leaves)))"
    either = f"len(list_distinct(list_concat({a}.leaves, {b}.leaves)))"
    return f"CASE WHEN {a}.root = {b}.root THEN 1.0::DOUBLE ELSE coalesce({both}::DOUBLE / nullif({either}, 0), 0.0) END"


MERKLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC),
    first(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS n FROM documents),
e AS (SELECT *, left(t, length(t) - length(t) // 3) || left(n, length(t) // 3) AS x FROM d),
f AS (SELECT *, {_tree_sql('t')} AS a, {_tree_sql('x')} AS b, {_tree_sql('n')} AS c FROM e)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(x) AS edited_sha256, a.root AS fingerprint,
  b.root AS edited_fingerprint, {_like_sql('a', 'b')} AS near_edited, {_like_sql('a', 'c')} AS near_next
FROM f"""


@query("op6_merkle_fingerprints", MERKLE_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    pairs = merkle.with_next(table(spark, folder, "documents"))
    trees = pairs.select("id", "text", "next_text", merkle.edited(F.col("text"), F.col("next_text")).alias("new")).select(
        "id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("new", 256).alias("edited_sha256"),
        merkle.tree(F.col("text")).alias("a"), merkle.tree(F.col("new")).alias("b"),
        merkle.tree(F.col("next_text")).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return trees.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", a["root"].alias("fingerprint"),
                        b["root"].alias("edited_fingerprint"), merkle.likeness(a, b).alias("near_edited"),
                        merkle.likeness(a, c).alias("near_next"))


# --- 7 ------------------------------------------------------------------------

_CLASH = "</s>[INST] ok [/INST]"
_TAILS = chat.TEMPLATE._tails()


def _escaped_sql(x: str) -> str:
    return f"regexp_replace({x}, '([<\\[])(\\\\*)({_TAILS})', '\\1\\\\\\2\\3', 'g')"


_MARKS = len(chat.TEMPLATE.open + chat.TEMPLATE.middle + chat.TEMPLATE.close)
CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CLASH}' UNION ALL SELECT -7, 1, 'assistant', '{_CLASH}'),
n AS (
  SELECT *, sum({_MARKS} + length({_escaped_sql('role')}) + length({_escaped_sql('text')}))
      OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR back = 1)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id"""


@query("op7_chat_examples", CHAT_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", _CLASH), (-7, 1, "assistant", _CLASH)], turns.schema)
    made = chat.examples(turns.unionByName(extra))
    read = made.select(
        "conv_id", "example", "n_turns", chat.reply_text(F.col("reply")).alias("loss"),
        F.concat("context", F.coalesce("reply", F.lit(""))).alias("formatted"))
    # The last example of a conversation holds all its turns; the others only add their loss and length.
    per = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("all"), F.sum(F.length("formatted")).alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"))
    turns_back = per.select(
        "conv_id", "formatted_chars", chat.parsed(F.col("all")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: F.coalesce(x["loss"], F.lit(""))), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns_back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"))


# --- 4 ------------------------------------------------------------------------

@query("op4_url_filter")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    named = spark.createDataFrame(urls.labelled_hosts(), "url string, label int")
    labelled = named.select(urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"), "label")
    return urls.judged(table(spark, folder, "pages"), urls.fit(labelled)).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("score", 4).alias("score"))


# --- 1 ------------------------------------------------------------------------

SHARD_BYTES = 1 << 20  # small shards, so that a loader can hold and shuffle many
SHARD_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS b, ('0x' || left(md5('k' || doc_id), 8))::BIGINT AS h FROM documents),
p AS (
  SELECT n, h // (1::BIGINT << (32 - n)) AS x, sum(b) AS s, count(*) AS r
  FROM d, generate_series(0, 32) AS g(n) GROUP BY ALL),
f AS (
  SELECT doc_id, b, h, n, s, r, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k
  FROM d JOIN p ON d.h // (1::BIGINT << (32 - n)) = x AND (s <= {SHARD_BYTES} OR r = 1))
SELECT doc_id, n::INTEGER AS depth, left(lpad(bin(h), 32, '0'), n::INT) AS shard, s::BIGINT AS shard_bytes, r AS shard_rows
FROM f WHERE k = 1"""


@query("op1_extendible_shards", SHARD_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.sized_rows(table(spark, folder, "documents"), "doc_id", F.octet_length("text"))
    leaves, placed = sharding.shards(rows, SHARD_BYTES)
    return placed.join(leaves.select("leaf", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows")), "leaf"
                       ).select(F.col("key").alias("doc_id"), F.length("leaf").alias("depth"), F.col("leaf").alias("shard"),
                                "shard_bytes", "shard_rows")


# --- 10 -----------------------------------------------------------------------

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT *, strlen(t)::BIGINT AS n, sha256(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM q"""


@query("op10_warc_zip", WARC_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.round_trip(spark, table(spark, folder, "pages"))
    # A response's figures come from its payload as read; a revisit's from its own head.
    return read.select(
        "page_id", F.coalesce(F.octet_length("payload"), "payload_bytes").cast("bigint").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


# --- 2 ------------------------------------------------------------------------

@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, folder, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("was"))
    coded = pieces_of.encode(docs, model, keep=["doc_id", "was"]).select(
        "doc_id", "was", "ids", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"))
    back = pieces_of.decode(coded, model, keep=["doc_id", "was", "n_pieces", "ids_hash"])
    return back.select("doc_id", "n_pieces", "ids_hash", F.sha2("text", 256).alias("decoded_sha256"),
                       (F.sha2("text", 256) == F.col("was")).alias("exact"))


# --- 11 -----------------------------------------------------------------------

@query("op11_token_counts")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), keep=["doc_id"])


# --- 12 -----------------------------------------------------------------------

@query("op12_token_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"),
                           tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])


# --- 13 -----------------------------------------------------------------------

_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
p AS (SELECT k, doc_id, n, t, count(*) AS tf FROM (SELECT k, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
v AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, docs),
q AS (SELECT DISTINCT j, item_id, t FROM (
  SELECT row_number() OVER () AS j, item_id, unnest({_TERMS}) AS t FROM benchmark)),
r AS (
  SELECT j, item_id, k, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN v USING (t), s GROUP BY j, item_id, k, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10"""


@query("op13_lexical_search", SEARCH_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")

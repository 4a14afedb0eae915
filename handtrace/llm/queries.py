"""Registered queries of the operators, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handtrace.plans.registry import Query

from . import (
    ann, byte_bpe, chat, collocations, decontaminate, html_density, language, near_dup, prefix_trie, quality,
    sentencepiece_bpe, substring_dup, token_files,
)
from .common import table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, rowid AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM bw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM dw, lens, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT g.r, g.n, g.i, item_id FROM grams g JOIN win USING (n, g)),
cover AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, n, i FROM hit), unnest(range(i, i + n)) AS t(p) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""


@query("op3_decontamination", OP3_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_names", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicate documents of every document."""
    return near_dup.duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_kept")


@query("op6_repeated_passages")
def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that it shares with an earlier one, and its class."""
    found = substring_dup.remove_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_words_removed", "passages", "text")


@query("op2_main_text")
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_density.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(quality.fold("doc_id", 4) == 2, F.lit(False))
    found = language.predict(docs, language.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(quality.fold("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"),
                        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_tokens(
        docs, token_files.scratch_uri(docs), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return token_files.read_tokens(manifest)


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and their round trip."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sentencepiece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), id_lists=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op8_nearest")
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


# Tool traffic of the conversations: a user turn is a call, an assistant turn the result of the turn before.
ARGUMENTS = """CASE length(text) % 3
    WHEN 0 THEN concat('{{"query" : ', {text}, ', "limit": ', length(text) % 120, '}}')
    WHEN 1 THEN concat('{{"pinned":', CASE WHEN length(text) % 7 = 0 THEN '"yes"' ELSE 'true' END,
        CASE WHEN length(text) % 5 = 0 THEN '' ELSE concat(', "body":', {text}) END,
        CASE WHEN length(text) % 11 = 0 THEN ', "colour": "red"' ELSE '' END, '}}')
    ELSE concat('{{"key":"', md5(text), '","depth":', length(text) % 10, CASE WHEN length(text) % 13 = 0 THEN '' ELSE '}}' END) END"""
TOOLS = [("search", "query", "string", True, 1, 800), ("search", "limit", "integer", True, 1, 100),
         ("note", "body", "string", True, None, None), ("note", "pinned", "boolean", False, None, None),
         ("lookup", "key", "string", True, 32, 32), ("lookup", "depth", "integer", False, 0, 6)]

OP1_SQL = """
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (
  SELECT conv_id, turn, text, 'c' || turn AS call_id, CASE WHEN turn >= 2 THEN 'c' || (turn - 2) END AS after,
         length(text) AS n, to_json(text)::VARCHAR AS j FROM m WHERE role = 'user'),
tree AS (
  SELECT conv_id, call_id, 0 AS depth FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.call_id = c.after)
  UNION ALL SELECT c.conv_id, c.call_id, depth + 1 FROM tree t JOIN c ON c.conv_id = t.conv_id AND c.after = t.call_id),
r AS (SELECT conv_id, turn, text, 'c' || (turn - 1) AS call_id, to_json(text)::VARCHAR AS j FROM m WHERE role = 'assistant'),
named AS (
  SELECT c.*, depth, CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'note' ELSE 'lookup' END AS name,
         EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id) AS answered
  FROM c JOIN tree USING (conv_id, call_id)),
checked AS (
  SELECT *, CASE n % 3
    WHEN 0 THEN '{"limit":' || n % 120 || ',"query":' || j || '}'
    WHEN 1 THEN '{' || CASE WHEN n % 5 = 0 THEN '' ELSE '"body":' || j || ',' END
        || CASE WHEN n % 11 = 0 THEN '"colour":"red",' ELSE '' END
        || '"pinned":' || CASE WHEN n % 7 = 0 THEN '"yes"' ELSE 'true' END || '}'
    ELSE CASE WHEN n % 13 = 0 THEN '{}' ELSE '{"depth":' || n % 10 || ',"key":"' || md5(text) || '"}' END END AS args,
    concat_ws(',',
      CASE WHEN n % 3 = 2 AND n % 13 = 0 THEN 'json,missing:key' END,
      CASE WHEN n % 3 = 1 AND n % 5 = 0 THEN 'missing:body' END,
      CASE WHEN n % 3 = 2 AND n % 13 <> 0 AND n % 10 > 6 THEN 'range:depth' END,
      CASE WHEN n % 3 = 0 AND (n % 120 < 1 OR n % 120 > 100) THEN 'range:limit' END,
      CASE WHEN n % 3 = 0 AND (n < 1 OR n > 800) THEN 'range:query' END,
      CASE WHEN n % 3 = 1 AND n % 7 = 0 THEN 'type:pinned' END,
      CASE WHEN n % 3 = 1 AND n % 11 = 0 THEN 'unknown:colour' END) AS problems
  FROM named)
SELECT conv_id, turn, 'call' AS role, call_id, 2 * depth AS rank, CASE WHEN answered THEN 'linked' ELSE 'unanswered' END AS status,
       problems, '{"arguments":' || args || ',"call_id":"' || call_id || '","name":"' || name || '","role":"assistant"}' AS json
FROM checked
UNION ALL
SELECT r.conv_id, r.turn, 'tool', r.call_id, 2 * depth + 1, CASE WHEN name IS NULL THEN 'orphan' ELSE 'linked' END, '',
       '{"call_id":"' || r.call_id || '","content":' || r.j || CASE WHEN name IS NULL THEN '' ELSE ',"name":"' || name || '"' END
       || ',"role":"tool"}'
FROM r LEFT JOIN named USING (conv_id, call_id)
UNION ALL
SELECT conv_id, turn, role, NULL, -1, 'message', '', '{"content":' || to_json(text)::VARCHAR || ',"role":"' || role || '"}'
FROM m WHERE role NOT IN ('user', 'assistant')
"""


def tool_traffic(turns: DataFrame) -> DataFrame:
    """Messages of the chat operator: calls and results derived from the turns of conversations."""
    quoted = "substr(to_json(array(text)), 2, length(to_json(array(text))) - 2)"
    return turns.selectExpr(
        "conv_id", "turn", "CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'tool' ELSE role END AS role",
        "CASE WHEN role = 'user' THEN NULL ELSE text END AS content",
        "CASE role WHEN 'user' THEN concat('c', turn) WHEN 'assistant' THEN concat('c', turn - 1) END AS call_id",
        "CASE WHEN role = 'user' AND turn >= 2 THEN concat('c', turn - 2) END AS after",
        "CASE WHEN role = 'user' THEN CASE length(text) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'note' ELSE 'lookup' END END AS name",
        f"CASE WHEN role = 'user' THEN {ARGUMENTS.format(text=quoted)} END AS arguments")


@query("op1_chat", OP1_SQL)
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, ordered and checked tool traffic of all conversations as canonical JSON."""
    tools = spark.createDataFrame(TOOLS, "name string, field string, kind string, required boolean, least int, most int")
    return chat.format_messages(tool_traffic(table(spark, sf_dir, "conversations")), tools)


# crc32 of the decimal digits, bit by bit.
OP11_SQL = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
taken AS (
  SELECT conv_id, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, b)),
    4294967295), 4294967295) % 6 AS h
  FROM ids),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
built AS (
  SELECT conv_id, t.place, t.role, t.text FROM taken JOIN turns t USING (conv_id) WHERE t.place >= h
  UNION ALL
  SELECT c.conv_id, t.place, t.role, t.text FROM taken c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.place < h),
dense AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS d FROM built),
chain AS (
  SELECT conv_id, 0::BIGINT AS d, md5('') AS node, NULL::VARCHAR AS up, 0::BIGINT AS len FROM ids
  UNION ALL
  SELECT c.conv_id, b.d, md5(c.node || length(b.role) || ':' || b.role || b.text), c.node, length(b.text)
  FROM chain c JOIN dense b ON b.conv_id = c.conv_id AND b.d = c.d + 1),
deepest AS (SELECT conv_id, max(d) AS d FROM chain GROUP BY conv_id),
ended AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM chain JOIN deepest USING (conv_id, d) GROUP BY node),
nodes AS (SELECT node, any_value(up) AS up, any_value(d) AS d, any_value(len) AS len, min(conv_id) AS conv, count(*) AS n
          FROM chain GROUP BY node),
kids AS (SELECT up AS node, count(*) AS k FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT node AS top, node FROM nodes
  UNION ALL SELECT b.top, n.node FROM below b JOIN nodes n ON n.up = b.node),
sums AS (SELECT top AS node, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END)::BIGINT AS leaves, sum((n - 1) * len)::BIGINT AS saved
         FROM below JOIN nodes USING (node) LEFT JOIN kids USING (node) GROUP BY top)
SELECT n.conv AS conv_id, n.d AS depth, p.conv AS parent_conv_id, n.n AS n_convs, coalesce(k, 0)::BIGINT AS n_children,
       leaves AS n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN nodes p ON p.node = n.up LEFT JOIN kids ON kids.node = n.node LEFT JOIN ended ON ended.node = n.node
"""


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversation ids, keyed turns): the first h turns of conversation c - c % 100, then c's own after its first h."""
    turns = prefix_trie.numbered(prefix_trie.keyed_turns(conversations), "at")
    ids = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    taken = F.crc32(F.col("conv_id").cast("string")) % 6
    givers = turns.where((F.col("conv_id") % 100 == 0) & (F.col("at") < 6)).withColumnRenamed("conv_id", "giver")
    copied = ids.withColumn("giver", F.col("conv_id") - F.col("conv_id") % 100).join(givers, "giver").where(F.col("at") < taken)
    shape = ["conv_id", F.col("at").alias("turn"), "role", "code", "length"]
    return ids, turns.where(F.col("at") >= taken).select(*shape).unionByName(copied.select(*shape))


@query("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    return prefix_trie.prefix_nodes(*rebuilt(table(spark, sf_dir, "conversations")))


@query("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every document and their round trip."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = byte_bpe.encode_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, id_lists=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


OP12_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM docs),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM pieces, range(1, 5) AS lengths(k), unnest(range(1, len(w) - k + 2)) AS t(i)
  WHERE len(w) >= k GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT lang, k, phrase, a, i, array_to_string(w[1:i], ' ') AS head, array_to_string(w[i + 1:], ' ') AS tail
  FROM c, unnest(range(1, k)) AS t(i)),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, min({'score': ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT, 'i': i, 'l': l.f, 'r': r.f}) AS cut
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = tail
  GROUP BY ALL),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS x
  FROM c, range(2, 4) AS inner_lengths(m), unnest(range(1, k - m + 2)) AS t(i) WHERE m < k GROUP BY ALL)
SELECT lang, rank, phrase, a, cut.l AS l, cut.r AS r, n, cut.score AS score FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.cut.score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE x IS NULL OR 100 * x < 80 * a) JOIN sizes USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))

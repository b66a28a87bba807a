"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, html, mtree, packing, quality, rpforest, secrets, sharding, simhash, toolcalls, trie, warc
from .common import table

RANKS_FILE = "byte_bpe_50k.json"
SHARDS = [f"shard-{k:03d}" for k in range(96)]
#: The tool that a user's turn calls, for the query on conversations.
SCHEMAS = {"ask": {"text": {"type": "string", "required": True, "min_length": 1, "max_length": 1000}, "turn": {"type": "integer", "required": True, "minimum": 0}, "words": {"type": "integer", "minimum": 1, "maximum": 150}}}


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens. A null text is empty: one piece, the end token alone."""
    import public_tokenizers

    parts = packing.pieces(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(RANKS_FILE))
    return packing.pack(parts)


def op2_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations framed as tool calls: each user turn calls `ask`, the turn after it is the result, and a call
    needs the result of the user turn two before it."""
    chat = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda back: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - back)
    words = F.size(F.filter(F.split(F.col("text"), "[ \\t\\n\\f\\r]+"), lambda w: w != ""))
    calls = chat.where("role = 'user'").select(
        "conv_id", "turn", name(0).alias("id"), name(2).alias("after_id"), F.lit("ask").alias("name"), F.to_json(F.struct("text", "turn", words.alias("words"))).alias("arguments")
    )
    results = chat.where("role = 'assistant'").select("turn", name(1).alias("id"), F.col("text").alias("content"))
    return toolcalls.link(calls, results, SCHEMAS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page; blocks as text. Derived records have no headers beyond the named ones."""
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")), ("page_id",))
    return made.drop("headers").withColumn("block", F.col("block").cast("string"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in benchmark windows. Texts without words are clean; repeated rows each get a row; an item without an
    id goes by the name None; an empty benchmark leaves all clean."""
    return decontaminate.report(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every hundredth vector, among the vectors of its length. Null, empty and non-finite vectors and null
    ids take no part; scores beyond 64 bits raise."""
    vectors = mtree.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return mtree.top_k(vectors.where("vec_id % 100 = 0"), vectors)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score. Null texts score as empty ones; a null id counts as the text '' for the held-out rule; with fewer than two
    positives or unlabelled rows all scores are 0.5."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id that it reaches. Wordless texts have fingerprint zero and are one
    component; a component without an id has a null one; repeated rows each get a row."""
    found = simhash.components(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard. Null ids share one slot; equal ids share theirs."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text. Null, empty and wordless pages have the empty text; repeated rows each get a row."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets. Null and empty texts have none; repeated rows each get a row."""
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's divergence from the others of its language, and its most telling terms. Null texts, languages and sources are
    empty ones; repeated rows count each; where a language keeps no term its pairs have the value 0."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that those of a run of five ids share first turns. Turns of one number go by role
    and MD5 of the text; rows without a conversation go; an empty table gives no node."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component. Null, zero and non-finite vectors and those without a label are alone; vectors without an id
    link and name no component; repeated rows each get a row."""
    return rpforest.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pack, op2_toolcalls, op3_warc, op4_decontaminate, op5_topk, op6_quality, op7_simhash, op8_shard, op9_main_text, op10_secrets, op11_divergence, op12_prefix_trie, op13_near_vectors)}


OP2 = r"""
WITH RECURSIVE u AS (
  SELECT id, min(conv_id) AS conv_id, min(turn) AS turn, min(arguments) AS arguments, count(*) AS n_calls FROM (
    SELECT 'c' || conv_id || '-' || turn AS id, conv_id, turn,
      CAST(to_json({'text': text, 'turn': turn, 'words': len(list_filter(string_split_regex(text, '[ \t\n\f\r]+'), lambda w: w <> ''))}) AS VARCHAR) AS arguments,
    FROM conversations WHERE role = 'user') GROUP BY id),
r AS (SELECT 'c' || conv_id || '-' || (turn - 1) AS id, min(text) AS content, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY 1),
d(id, depth) AS (
  SELECT id, 0 FROM u WHERE 'c' || conv_id || '-' || (turn - 2) NOT IN (SELECT id FROM u)
  UNION ALL SELECT u.id, depth + 1 FROM u JOIN d ON d.id = 'c' || u.conv_id || '-' || (u.turn - 2)),
e AS (
  SELECT u.*, depth, coalesce(n_results, 0) AS n_results, content, concat_ws(',',
    CASE WHEN length(json_extract_string(arguments, '$.text')) < 1 THEN 'text:min_length' END,
    CASE WHEN length(json_extract_string(arguments, '$.text')) > 1000 THEN 'text:max_length' END,
    CASE WHEN CAST(json_extract(arguments, '$.words') AS INT) < 1 THEN 'words:minimum' END,
    CASE WHEN CAST(json_extract(arguments, '$.words') AS INT) > 150 THEN 'words:maximum' END) AS errors
  FROM u JOIN d USING (id) LEFT JOIN r USING (id))
SELECT conv_id, turn, id AS call_id, 'ask' AS name, CAST(depth AS BIGINT) AS depth, n_calls, CAST(n_results AS BIGINT) AS n_results, errors,
  CASE WHEN errors <> '' THEN 'invalid' WHEN n_results = 0 THEN 'unanswered' ELSE 'ok' END AS status,
  '{"arguments":' || arguments || ',"id":' || CAST(to_json(id) AS VARCHAR) || ',"name":"ask","result":' || CASE WHEN n_results > 0 THEN CAST(to_json(content) AS VARCHAR) ELSE 'null' END || '}' AS line
FROM e
"""

OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, s, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM m)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score FROM k WHERE r <= 10
"""


_KEY = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
#: By kind in order: the pattern, the group that must have a least length, and that length.
OP10_KINDS = [
    ("assign", rf"(?:{_KEY})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=:,. \t\r\n\\]|-[A-Za-z0-9])*-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1), ("github", "gh[pousr]_([A-Za-z0-9]+)", 1, 36),
    ("slack", "xox[abprs]-[0-9]{6,}-([A-Za-z0-9-]+)", 1, 10), ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
]


def _op10() -> str:
    """A match starts after all parts between matches and all matches before it."""
    parts = [
        f"""SELECT r, {k} AS k, '{kind}' AS kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n
FROM (SELECT r, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{rx}', 0) AS m, string_split_regex(t, '{rx}') AS p FROM d)) WHERE length(regexp_extract(m[i], '{rx}', {group})) >= {least}"""
        for k, (kind, rx, group, least) in enumerate(OP10_KINDS)
    ]
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)}),
l AS (SELECT r, k, a, kind || ':' || a || ':' || (a + n) AS x FROM (SELECT r, k, kind, CAST(a AS BIGINT) AS a, n FROM s)),
g AS (SELECT r, {', '.join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, (kind, *_) in enumerate(OP10_KINDS[:3]))}, string_agg(x, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY a, k) AS spans FROM l GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{kind}, 0) AS n_{kind}' for kind, *_ in OP10_KINDS[:3])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (v.total + 2 * v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
s AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM s)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INT) AS rank FROM o WHERE part = 'pair' OR r <= 10
"""

#: CRC-32 of a text's bytes: a byte goes in by XOR, then eight shifts (marked -1).
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(conv_id AS VARCHAR), '')])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""

OP12 = f"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT conv_id, max(pos) AS n FROM t GROUP BY conv_id)),
x AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, pos - c.h + least(c.h, coalesce(b.n, 0)), role, text FROM c JOIN t USING (conv_id) LEFT JOIN c b ON b.conv_id = c.base WHERE pos > c.h),
m AS (SELECT conv_id, pos AS depth, strlen(text) AS bytes, list((role, text)) OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM x UNION ALL SELECT conv_id, 0, 0, [] FROM c),
n AS (SELECT depth, k, min(conv_id) AS node, count(*) AS n_convs, min(bytes) AS bytes FROM m GROUP BY depth, k),
w AS (SELECT m.conv_id, depth, node, n_convs, n.bytes FROM m JOIN n USING (depth, k)),
l AS (SELECT conv_id, max(depth) AS depth FROM w GROUP BY conv_id),
e AS (SELECT node, depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM w JOIN l USING (conv_id, depth) GROUP BY node, depth),
p AS (SELECT n.node, n.depth, n.n_convs, n.bytes, w.node AS parent FROM n LEFT JOIN w ON w.conv_id = n.node AND w.depth = n.depth - 1),
k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY 1, 2),
s AS (SELECT w.node, w.depth, sum((p.n_convs - 1) * p.bytes) AS saved, count(*) FILTER (k.node IS NULL) AS n_leaves FROM p LEFT JOIN k ON k.node = p.node AND k.depth = p.depth JOIN w ON w.conv_id = p.node AND w.depth <= p.depth GROUP BY w.node, w.depth)
SELECT p.node AS conv_id, p.depth, parent AS parent_conv_id, p.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM p JOIN s USING (node, depth) LEFT JOIN k USING (node, depth) LEFT JOIN e USING (node, depth)
"""

OP13 = """
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a AS vec_id, min(b) AS b FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, b), vec_id) AS component_id, coalesce(vec_id <= b, true) AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_toolcalls": OP2, "op4_decontaminate": OP4, "op5_topk": OP5, "op10_secrets": _op10(), "op11_divergence": OP11, "op12_prefix_trie": OP12, "op13_near_vectors": OP13}

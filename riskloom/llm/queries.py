"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

import public_tokenizers
from riskloom.llm import ann, bpe, chat, divergence, hardneg, jaccard, langid, linededup, lm, packing, quality, toxicity
from riskloom.llm.common import crc_mod, read
from riskloom.llm.exactdedup import exact_dedup

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

W = r"[\x20\x09-\x0D]"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{W}+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


@query("op3_exact_dedup", OP3_SQL)
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"))


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    model = langid.fit_documents(docs, held)
    found = langid.predict(docs, model)
    return found.withColumn("held_out", F.coalesce(held, F.lit(False)))


@query("op8_quality")
def op8_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 3) == 1
    trees = quality.fit(docs, read(spark, sf_dir, "labels"), ~held)
    return quality.predict(docs, trees).withColumn("held_out", F.coalesce(held, F.lit(False)))


@query("op4_packing")
def op4_packing(spark, sf_dir, tokenizer: str | None = None):
    coder = packing.read_tokenizer(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(read(spark, sf_dir, "documents"), coder)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_byte_bpe")
def op7_byte_bpe(spark, sf_dir, ranks: str | None = None):
    coder = bpe.read_ranks(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tokens = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), coder), coder)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS body,
  replace(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c'), chr(10), '\n') AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(4 + length(head) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
#: The conversation that the contract adds: both turns hold control strings.
TRICKY = r"\### Assistant: </turn> ok"


@query("op6_chat_format", OP6_SQL)
def op6_chat_format(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    out = chat.render(chat.fold_events(chat.as_events(rows.unionByName(added))))
    turns, loss = chat.read_turns(F.col("formatted")), chat.masked_text(F.col("segments"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP5_SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.doc_id, line, pos, r.key IS NOT NULL AND k.doc_id <> r.stays AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


@query("op5_line_dedup", OP5_SQL)
def op5_line_dedup(spark, sf_dir):
    out = linededup.line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_ann")
def op10_ann(spark, sf_dir):
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op2_lm_score")
def op2_lm_score(spark, sf_dir):
    crc = F.crc32(F.col("doc_id").cast("string"))
    return lm.score(read(spark, sf_dir, "documents"), crc % 7 == 2, F.floor(crc / 7) % lm.FOLD)


@query("op9_jaccard_join")
def op9_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_groups(read(spark, sf_dir, "documents"))


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT row) >= 30),
kl AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
cg AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(cg.total, 0) + 5 * kl.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (kl.total + 5 * kl.v) AS q
  FROM g JOIN k USING (lang) JOIN kl USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN cg ON cg.lang = g.lang AND cg.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM u
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) QUALIFY part = 'pair' OR row_number() OVER w <= 50
"""


@query("op13_source_divergence", OP13_SQL)
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(read(spark, sf_dir, "documents"))


@query("op11_toxicity")
def op11_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    net = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held)
    return toxicity.predict(docs, net).withColumn("held_out", F.coalesce(held, F.lit(False)))

"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import ann, chat, crosstok, langid, lines, mixing, neardup, pii, quality_rules, site_quality, spm, toxicity, whitening
from tickloom.llm.common import fold, table

CONFLICT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT)], "conv_id long, turn int, role string, text string")
    done = chat.format_conversations(turns.unionByName(extra))
    return done.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", F.length("formatted").cast("long").alias("formatted_chars"))


OP1_SQL = f"""
WITH t AS (
  SELECT conv_id::BIGINT conv_id, turn::BIGINT turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONFLICT}' UNION ALL SELECT -7, 1, 'assistant', '{CONFLICT}'),
e AS (
  SELECT *, length(regexp_replace(role, '{chat.CONTROL.pattern}', '\\1\\2\\\\\\3', 'g')) + length(regexp_replace(text, '{chat.CONTROL.pattern}', '\\1\\2\\\\\\3', 'g')) AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({chat.CONVERSATION_CHARS} + sum(chars + {chat.TURN_CHARS}))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def surrogate_key(spark: SparkSession) -> bytes:
    """The key of the surrogates: the session's spark.tickloom.surrogateKey, or one for demonstrations, which is no secret."""
    return spark.conf.get("spark.tickloom.surrogateKey", "demonstration").encode()


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))
    return done.select("doc_id", "text", F.col("_pii").alias("n_entities"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.weak_supervision(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    model = toxicity.learn(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    done = toxicity.score(docs, model)
    return done.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    models = langid.learn(docs.filter(~held_out))
    done = langid.identify(docs.select("doc_id", "text"), models)
    return done.select("doc_id", held_out.alias("held_out"), F.col("_lang.pred").alias("lang_pred"), F.col("_lang.score").alias("score"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"))


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, ((place - 1) % 3 + 1)::BIGINT AS weight FROM s),
c AS (SELECT *, (3 * source_size)::DOUBLE / weight AS cap FROM w),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER (ORDER BY cap, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
    / (sum(weight) OVER (ORDER BY cap, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM c),
t AS (
  SELECT source, source_size, least((SELECT arg_min(level, (cap, place)) FROM l WHERE level <= cap) * weight, (3 * source_size)::DOUBLE) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0::DOUBLE END AS rate FROM t),
j AS (
  SELECT doc_id, size, source_size, target, rate,
    ('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(d.source, '') || '|' || size::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS coin
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (coin < rate - floor(rate))::BIGINT) AS taken FROM j
"""


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"), labels.select("doc_id", F.col("quality").alias("label")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spm.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.coalesce(F.size("_spm.ids"), F.lit(0)).cast("long").alias("n_tokens"), "_spm.tokens_sha256", "_spm.round_trip", "_spm.parity")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white, parts = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = white.select("vec_id", F.col("_white.deviation").try_cast("long").alias("deviation"), F.posexplode("_white.whitened").alias("_k", "whitened"))
    told = F.broadcast(parts.select((F.col("component") - 1).alias("_k"), "component", "n", "explained", "identity_error"))  # eight rows
    return rows.join(told, "_k").select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = crosstok.align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "_align.*")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.kept_text(lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, row, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS first FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
v AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id <> g.first AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM v GROUP BY row, doc_id
"""


_QUERIES = (op1_chat_format, op2_surrogates, op3_quality_rules, op4_toxicity, op5_language_id, op6_source_mix, op7_nearest_vectors, op8_near_duplicates, op9_site_quality, op10_sentencepiece, op11_embedding_whitening, op12_tokenizer_alignment, op13_line_dedup)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op6_source_mix": OP6_SQL, "op8_near_duplicates": OP8_SQL, "op13_line_dedup": OP13_SQL}

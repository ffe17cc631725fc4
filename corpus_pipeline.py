"""From raw documents to tokens: language, near-duplicates, privacy, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import langid, mixing, neardup, pii, spm
from tickloom.llm.common import broadcast_if_small, fold, fresh, materialize, table
from tickloom.llm.queries import surrogate_key

#: Pairs of this similarity (in percent) are near-duplicates here.
SIMILAR = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (null text, no letter) go; lang becomes the language found.

    Where no document says its language, none can be learned and all go. Whole texts are parsed, however long; equal bits
    go to the smaller name, repeated rows stay, an empty table gives an empty table, and other columns pass through."""
    models = langid.learn(docs.filter(fold(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs, models).filter(F.col("_lang.pred") != langid.UNKNOWN)
    return found.select(*[F.col("_lang.pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays, and one row of it.

    Rows without id have one that their text gives, after all others; so of equal ones, and of those like a row with an
    id, one stays. Rows with one id and different texts are near-duplicates or not by either text, and all stay where the
    id does. Null and wordless texts stay; long texts are compared whole. An empty table gives an empty table, and other
    columns, whatever their names, pass through."""
    key = fresh(docs, "_key")
    unnamed = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), unnamed))
    found = neardup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), percent=SIMILAR)
    dropped = materialize(found.filter(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct(), "dup-dropped")
    kept = keyed.join(broadcast_if_small(dropped), key, "left_anti")
    repeated = broadcast_if_small(materialize(kept.groupBy(key).count().filter("count > 1").select(key), "dup-repeated"))
    once = kept.join(repeated, key, "left_semi").withColumn(text_key := fresh(kept, "_text_key"), F.sha2(F.col("text").cast("binary"), 256))
    once = once.dropDuplicates([key, text_key]).drop(text_key)
    return kept.join(repeated, key, "left_anti").unionByName(once).drop(key)


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text becomes surrogates; n_chars, where there is one, follows.

    Null and empty texts stay as they are; long texts are searched whole; repeated rows get equal texts; an empty table
    gives an empty table; other columns, whatever their names, pass through."""
    done = pii.replace_entities(docs, surrogate_key(spark))
    count = lambda c: F.when(F.col(c).isNotNull(), F.length("text")).cast(docs.schema[c].dataType).alias(c)
    return done.select(*[count(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for.

    Null and wordless texts follow their source's rate; equal rows take one draw; long texts are counted whole; an empty
    table gives an empty table; other columns, whatever their names, pass through."""
    return mixing.mix_sources(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row and whole text: doc_id, lang, source, n_tokens, tokens, their digest and the two checks.

    Null texts have null tokens, empty ones none; repeated rows have equal tokens; an empty table gives an empty table;
    further columns are left out, whatever their names."""
    done = spm.encode_documents(docs.select("doc_id", "lang", "source", "text"))
    n_tokens = F.coalesce(F.size("_spm.ids"), F.lit(0)).cast("long").alias("n_tokens")
    return done.select("doc_id", "lang", "source", n_tokens, F.col("_spm.ids").alias("tokens"), "_spm.tokens_sha256", "_spm.round_trip", "_spm.parity")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("surrogates", replace_private_data),
    ("source_mix", mix),
    ("sentencepiece", tokenize),
]

#: MinHash, sampled training text and a tokenizer can't be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, capped targets give each source a repetition rate, and every document is emitted
floor(rate) times plus one more copy with the probability of the fraction, drawn from a hash of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import broadcast_if_small, fresh, materialize, n_words

MAX_REPEAT = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, cycle: int = 3, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sizes (source, source_size): one row per source. Adds weight, target and rate.

    Sources by code point, null last, weigh 1, 2, .. cycle, repeating. The sum of all sizes is shared by weight;
    a target stops at max_repeat times its source's size and the excess is shared among the others by weight.
    That fixed point is a water level: with sources by rising cap per weight, the first one whose level stays below
    its cap gives the level of all. The windows here run over one row per source, never over documents.
    """
    by_name, by_cap = W.orderBy(F.asc_nulls_last("source")), W.orderBy("cap_per_weight", "place")
    before, after = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    ranked = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", ((F.col("place") - 1) % cycle + 1).cast("long"))
    ranked = ranked.withColumn("cap_per_weight", (max_repeat * F.col("source_size")).cast("double") / F.col("weight"))
    total = F.sum("source_size").over(W.partitionBy())
    ranked = ranked.withColumn("level", (total - max_repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
    level = F.min_by(F.when(F.col("level") <= F.col("cap_per_weight"), F.col("level")), F.when(F.col("level") <= F.col("cap_per_weight"), F.struct("cap_per_weight", "place"))).over(W.partitionBy())
    ranked = ranked.withColumn("target", F.least(level * F.col("weight"), (max_repeat * F.col("source_size")).cast("double")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeat)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return ranked.select("source", "source_size", "weight", "target", rate.alias("rate"))


def coin(doc_id: Column, source: Column, size: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on these values and the seed alone."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(source, F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix_plan(docs: DataFrame, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """All columns of docs and a struct _mix (size, source_size, target, rate, copies).

    docs needs doc_id, text, source; other columns pass through whatever their names (only _mix is replaced).
    Null or wordless texts have size 0 and follow their source's rate; a source without words has rate 0. Rows that
    are equal in every column take the same draw. Whole texts are counted, however long. An empty table gives an empty
    table.
    """
    docs = docs.drop("_mix")
    size = n_words(F.col("text"))
    sizes = docs.groupBy("source").agg(F.sum(size).alias("source_size"))
    targets = materialize(source_targets(sizes, max_repeat=max_repeat), "mix-targets")
    t = fresh(docs, "_t")
    found = broadcast_if_small(targets.select(F.struct("source", "source_size", "target", "rate").alias(t)))
    plan, rate = F.col(t), F.col(t)["rate"]
    whole = F.floor(rate).cast("long")
    own = fresh(docs, "_own_size")
    extra = (coin(F.col("doc_id"), F.col("source"), F.col(own), seed) < rate - whole).cast("long")
    out = docs.withColumn(own, size).join(found, F.col("source").eqNullSafe(plan["source"]), "left")
    mix = F.struct(F.col(own).alias("size"), plan["source_size"].alias("source_size"), plan["target"].alias("target"), rate.alias("rate"), (whole + extra).alias("copies"))
    return out.withColumn("_mix", mix).drop(own, t)


def mix_sources(docs: DataFrame, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of docs, each document as many times as its plan says.

    What mix_plan says of nulls, long and repeated texts, empty tables and other columns holds here too."""
    planned = mix_plan(docs, max_repeat, seed)
    copy = fresh(docs, "_copy")
    copies = F.explode(F.array_repeat(F.lit(1), F.col("_mix.copies").cast("int")))
    return planned.filter("_mix.copies > 0").withColumn(copy, copies).drop(copy, "_mix")

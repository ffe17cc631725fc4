"""No drawn set breaks the ratios that its draws depend on."""

from pyspark.sql import functions as F

from tickloom.operators import genomes, samplers


def nested(t):
    blocks = {b: [p for p in ps if f"{b}_{p}" in t.columns] for b, ps in genomes.COMBINED_BOUNDS.items()}
    return t.select("*", *[F.struct(*[F.col(f"{b}_{p}").alias(p) for p in ps]).alias(b) for b, ps in blocks.items()])


def test_correlated_sets_keep_all_ratios(spark):
    t = nested(samplers.correlated(spark, 3000)).withColumn("broken", genomes.ratio_violations(("_long", "_short")))
    broken = t.select(F.explode("broken").alias("b")).groupBy("b").count().collect()
    free = {"tp_dual_long", "tp_rsi_long", "tp_dual_short", "tp_rsi_short", "sides"}  # targets' periods and sides are drawn freely
    whole = {"sl_period_fast_long", "sl_period_fast_short"}  # the least period is cut to a whole number
    assert {r["b"] for r in broken} <= free | whole
    assert t.filter("sl_long_st_atrPeriod < floor(entry_st_atrPeriod * 0.1) or sl_short_st_atrPeriod < floor(entry_st_atrPeriod * 0.1)").count() == 0
    for b, ps in genomes.COMBINED_BOUNDS.items():
        for p, (lo, hi) in ps.items():
            if f"{b}_{p}" in t.columns and b != "entry":
                assert t.filter((F.col(f"{b}_{p}") < lo) | (F.col(f"{b}_{p}") > hi)).count() == 0, (b, p)
    assert t.groupBy("sensitivity", "risk").count().count() == 9
    assert samplers.correlated(spark, 0).count() == 0


def test_styles_are_pure_or_mixed(spark):
    t = samplers.by_archetype(spark, 2000)
    pure = t.filter("entry_style = sl_style and sl_style = tp_style").count()
    assert 1000 * 0.9 < pure < 2000 * 0.6 and t.filter("entry_rsi_ma_length >= entry_rsi_length").count() == 0
    for name, parts in samplers.ARCHETYPES.items():
        lo, hi = parts["sl"]["st_mult"]
        assert t.filter(f"sl_style = '{name}' and (sl_long_st_mult < {lo} or sl_long_st_mult > {hi})").count() == 0

"""Parameter sets drawn with dependence, as many as there are stored parameter sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.operators import samplers as sp
from tickloom.operators.genomes import COMBINED_BOUNDS, WHOLE
from tickloom.plans.registry import query
from tickloom.sources import derived as d


def _u(seed: str, block: str, param: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || sample_id || '|{block}|{param}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def _named(column: str, table: dict, end: int) -> str:
    return f"(CASE {column} " + " ".join(f"WHEN '{k}' THEN {float(v[end])}::DOUBLE" for k, v in table.items()) + " END)"


def _choice(names: list[str], u: str) -> str:
    return f"({list(names)})[floor({u} * {len(names)})::INT + 1]"


def _value(param: str, lo: str, hi: str, outer: tuple, other: tuple[str, str], u: str) -> str:
    """A draw from lo .. hi inside outer, or from other where nothing is left."""
    a, b = f"greatest({lo}, {float(outer[0])}::DOUBLE)", f"least({hi}, {float(outer[1])}::DOUBLE)"
    lo, hi = (f"(CASE WHEN {a} > {b} THEN {o} ELSE {x} END)" for o, x in ((other[0], a), (other[1], b)))
    if param in WHOLE:
        return f"(floor({lo}) + least(floor({u} * (floor({hi}) - floor({lo}) + 1)), floor({hi}) - floor({lo})))::INT"
    return f"round({lo} + {u} * ({hi} - {lo}), 2)"


def _span(span: tuple) -> tuple[str, str]:
    return f"{float(span[0])}::DOUBLE", f"{float(span[1])}::DOUBLE"


BASE = "WITH s0 AS (SELECT row_number() OVER () AS sample_id FROM part)"


def _correlated_sql() -> str:
    seed, bounds, entry = "correlated-1", COMBINED_BOUNDS, COMBINED_BOUNDS["entry"]
    meta = f"{_choice(list(sp.SENSITIVITY), _u(seed, 'meta', 'sensitivity'))} AS sensitivity, {_choice(list(sp.RISK), _u(seed, 'meta', 'risk'))} AS risk"
    first = []
    for p in ("st_atrPeriod", "st_mult", "rf_period", "rf_mult"):
        own = tuple(_named("sensitivity", {k: v[p] for k, v in sp.SENSITIVITY.items()}, e) for e in (0, 1))
        first.append(f"{_value(p, *own, entry[p], own, _u(seed, 'entry', p))} AS entry_{p}")
    rsi = _value("rsi_length", *_span(sp.RSI_LENGTH), entry["rsi_length"], _span(sp.RSI_LENGTH), _u(seed, "entry", "rsi_length"))
    least, top = max(2, entry["rsi_ma_length"][0]), entry["rsi_ma_length"][1]
    most = f"greatest({least}, least(entry_rsi_length - 2, {top}))"
    mean = f"({least} + least(floor({_u(seed, 'entry', 'rsi_ma_length')} * ({most} - {least} + 1)), {most} - {least}))::INT AS entry_rsi_ma_length"
    stops, goals = [], []
    for s in sp.SIDES:
        b, own = f"sl_{s}", bounds[f"sl_{s}"]
        risk = [_named("risk", {k: v["sl"] for k, v in sp.RISK.items()}, e) for e in (0, 1)]
        stops += [
            f"{_value('st_atrPeriod', 'floor(entry_st_atrPeriod * 0.1::DOUBLE)', 'floor(entry_st_atrPeriod * 10::DOUBLE)', own['st_atrPeriod'], _span(own['st_atrPeriod']), _u(seed, b, 'st_atrPeriod'))} AS {b}_st_atrPeriod",
            f"{_value('st_mult', f'greatest({risk[0]}, entry_st_mult * 0.2::DOUBLE)', f'least({risk[1]}, entry_st_mult * 15::DOUBLE)', own['st_mult'], _span(own['st_mult']), _u(seed, b, 'st_mult'))} AS {b}_st_mult",
            *[f"{_value(p, *_span(own[p]), own[p], _span(own[p]), _u(seed, b, p))} AS {b}_{p}" for p in ("rf_period", "rf_mult")],
        ]
        for g in sp.GOALS:
            b, own = f"{g}_{s}", bounds[f"{g}_{s}"]
            risk = [_named("risk", {k: v["rr"] for k, v in sp.RISK.items()}, e) for e in (0, 1)]
            goals += [f"{_value(p, *_span(own[p]), own[p], _span(own[p]), _u(seed, b, p))} AS {b}_{p}" for p in ("st_atrPeriod", "st_mult")]
            goals.append(f"{_value('rr_mult', f'greatest({risk[0]}, sl_{s}_st_mult * 0.02::DOUBLE)', f'least({risk[1]}, sl_{s}_st_mult * 5::DOUBLE)', own['rr_mult'], _span(own['rr_mult']), _u(seed, b, 'rr_mult'))} AS {b}_rr_mult")
    return (
        f"{BASE}, s1 AS (SELECT *, {meta} FROM s0), s2 AS (SELECT *, {', '.join(first)}, {rsi} AS entry_rsi_length FROM s1), "
        f"s3 AS (SELECT *, {mean}, {', '.join(stops)} FROM s2) SELECT *, {', '.join(goals)} FROM s3"
    )


def _archetype_sql() -> str:
    seed, names = "archetype-1", list(sp.ARCHETYPES)
    style = lambda part: _choice(names, f"(CASE WHEN {_u(seed, 'meta', 'mixed')} < 0.5 THEN {_u(seed, 'meta', part)} ELSE {_u(seed, 'meta', 'all')} END)")
    styles = ", ".join(f"{style(p)} AS {p}_style" for p in ("entry", "sl", "tp"))
    made = []
    for block, own in COMBINED_BOUNDS.items():
        part = block.split("_")[0]
        for p in sp.ARCHETYPES["scalper"][part]:
            span = tuple(_named(f"{part}_style", {k: v[part][p] for k, v in sp.ARCHETYPES.items()}, e) for e in (0, 1))
            made.append(f"{_value(p, *span, own[p], span, _u(seed, block, p))} AS {block}_{p}")
    shorter = "(CASE WHEN entry_rsi_ma_length >= entry_rsi_length THEN greatest(2, entry_rsi_length - 2) ELSE entry_rsi_ma_length END)::INT AS entry_rsi_ma_length"
    return f"{BASE}, s1 AS (SELECT *, {styles} FROM s0), s2 AS (SELECT *, {', '.join(made)} FROM s1) SELECT * REPLACE ({shorter}) FROM s2"


@query("correlated_samples", _correlated_sql())
def correlated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.correlated(spark, d.table(spark, sf_dir, "part").count())


@query("archetype_samples", _archetype_sql())
def archetype_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.by_archetype(spark, d.table(spark, sf_dir, "part").count())

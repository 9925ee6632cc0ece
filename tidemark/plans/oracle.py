"""Reference SQL of the registered queries over the raw test tables.

Written from the definitions, not from the Spark plans: plain windows over whole
groups, self-joins, recursion for the exponential means, built-in medians.
"""

from __future__ import annotations

import numpy as np

from tidemark.functions.catalog import (
    CURVE_SERIES,
    CURVE_STEPS,
    EMPLOYMENT_SERIES,
    ESTABLISHMENT_SERIES,
    HORIZONS,
    LATE_RELEASE,
    LOGISTIC_MODELS,
    MATURITIES,
    NS_FACTORS,
    PAYROLL_FEATURES,
    RESEARCH_TECHNICAL_FEATURES,
    RIDGE_MODELS,
    TREASURY_FEATURES,
    YIELDS,
    series_registry,
)

TARGETS = [f"forward_return_{h}" for h in HORIZONS]
# Written out here, not taken from the operators under test.
SLOPE_LEGS = (("10y", "2y"), ("30y", "2y"), ("30y", "5y"), ("30y", "10y"))


def fl(*names: str, digits: int = 6) -> str:
    """Rounded float columns."""
    return ", ".join(f"round({n}, {digits}) + 0.0 as {n}" for n in names)


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for m in CTES[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = ",\n".join(f"{n} as materialized ({CTES[n][1]})" if n != "smooth" else f"{n} as ({CTES[n][1]})" for n in order)
    return f"with recursive {parts}\n{body}" if order else body


# ------------------------------------------------------------------ bars

cte(
    "bars",
    """select o_orderpriority as symbol, cast(o_orderdate as date) as market_date,
    arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low,
    arg_max(o_totalprice, o_orderkey) as close, cast(count(*) as double) as volume
    from orders group by 1, 2""",
)
cte(
    "moves",
    """select *, row_number() over w as rn, greatest(close - lag(close) over w, 0) as gain,
    greatest(lag(close) over w - close, 0) as loss, close - lag(close) over w as step
    from bars window w as (partition by symbol order by market_date)""",
    "bars",
)
cte(
    "smooth",
    """select symbol, rn, close as e9, close as e21, cast(null as double) as ag, cast(null as double) as al
    from moves where rn = 1
    union all
    select m.symbol, m.rn, 0.8 * s.e9 + 0.2 * m.close, (10.0 / 11.0) * s.e21 + (1.0 / 11.0) * m.close,
    case when m.rn = 2 then m.gain else (13.0 / 14.0) * s.ag + (1.0 / 14.0) * m.gain end,
    case when m.rn = 2 then m.loss else (13.0 / 14.0) * s.al + (1.0 / 14.0) * m.loss end
    from smooth s join moves m on m.symbol = s.symbol and m.rn = s.rn + 1""",
    "moves",
)


def _roll(expr: str, column: str, n: int) -> str:
    frame = f"(partition by symbol order by market_date rows between {n - 1} preceding and current row)"
    return f"case when count({column}) over {frame} = {n} then {expr} over {frame} end"


cte(
    "tech0",
    f"""select m.*, s.e9 as ema_9, s.e21 as ema_21,
    case when m.rn >= 15 then case when s.al = 0 then case when s.ag > 0 then 100.0 end
      else 100 - 100 / (1 + s.ag / s.al) end end as rsi_14,
    {", ".join(f"{div('close', f'lag(close, {k}) over w')} - 1 as return_{k}d" for k in (1, 3, 5, 10))},
    {_roll("avg(volume)", "volume", 20)} as volume_avg_20,
    {_roll("max(close)", "close", 20)} as rolling_high_20,
    {_roll("min(close)", "close", 20)} as rolling_low_20,
    close - lag(close, 5) over w as momentum
    from moves m join smooth s on m.symbol = s.symbol and m.rn = s.rn
    window w as (partition by m.symbol order by market_date)""".replace("partition by symbol", "partition by m.symbol"),
    "moves",
    "smooth",
)
cte(
    "tech",
    f"""select *, {_roll("stddev_samp(return_1d)", "return_1d", 5)} as volatility_5d,
    {_roll("stddev_samp(return_1d)", "return_1d", 20)} as volatility_20d,
    {div("ema_9", "ema_21")} - 1 as ema_spread_pct, {div("close", "ema_9")} - 1 as close_vs_ema9,
    {div("close", "ema_21")} - 1 as close_vs_ema21, (rsi_14 - 50) / 50 as rsi_centered,
    return_5d as momentum_5d_pct, return_10d as momentum_10d_pct,
    {div("high - low", "close")} as range_pct, {div("volume", "volume_avg_20")} as relative_volume,
    ln(1 + volume) as log_volume, {div("close", "rolling_high_20")} - 1 as distance_from_20d_high,
    {div("close", "rolling_low_20")} - 1 as distance_from_20d_low
    from tech0""",
    "tech0",
)
cte(
    "fwd",
    f"""select symbol, market_date, {", ".join(f"{div(f'lead(close, {h}) over w', 'close')} - 1 as forward_return_{h}" for h in HORIZONS)}
    from bars window w as (partition by symbol order by market_date)""",
    "bars",
)
cte(
    "scored",
    """select *, trend_score + vwap_score + rsi_score + momentum_score + volume_score as directional_score from (
    select symbol, market_date, open, rn,
    case when ema_9 > ema_21 then 1 when ema_9 < ema_21 then -1 else 0 end as trend_score, 0 as vwap_score,
    case when rsi_14 > 55 then 1 when rsi_14 < 45 then -1 else 0 end as rsi_score,
    case when momentum > 0 then 1 when momentum < 0 then -1 else 0 end as momentum_score,
    case when volume > volume_avg_20 and step > 0 then 1 when volume > volume_avg_20 and step < 0 then -1 else 0 end as volume_score
    from tech0)""",
    "tech0",
)
cte(
    "edges",
    """select *, lead(open) over w as fill_price, lead(market_date) over w as fill_date,
    case when directional_score >= 4 and not coalesce(lag(directional_score) over w >= 4, false) then 1 else 0 end as bullish_entry,
    case when directional_score <= -4 and not coalesce(lag(directional_score) over w <= -4, false) then 1 else 0 end as bearish_exit
    from scored window w as (partition by symbol order by market_date)""",
    "scored",
)

# ----------------------------------------------------------------- curve

cte(
    "curve_long",
    """select cast(date_trunc('week', l_shipdate) as date) as curve_date, cast(l_suppkey % 10 as int) as slot,
    cast(sum(cast(round(l_discount * 100) as bigint)) as double) / count(*) as value from lineitem group by 1, 2""",
)
cte(
    "curve",
    f"""select curve_date, {", ".join(f"max(value) filter (slot = {i}) as {y}" for i, y in enumerate(YIELDS))}
    from curve_long group by 1 having {" and ".join(f"max(value) filter (slot = {i}) is not null" for i in range(10))}""",
    "curve_long",
)
_base = [f"(yield_{a} - yield_{b}) * 100 as curve_{a}_{b}_bp" for a, b in SLOPE_LEGS] + [
    f"({' + '.join(YIELDS)}) / 10 as curve_level",
    "(yield_30y - yield_3m) * 100 as curve_slope_30y_3m_bp",
    "(2 * yield_5y - yield_3m - yield_30y) * 100 as curve_curvature_5y_bp",
]
cte("curve_base", f"select *, {', '.join(_base)} from curve", "curve")
_steps = (
    [(f"yield_{m}", f"change_{m}_{k}d_bp", k, 100) for m in MATURITIES for k in CURVE_STEPS]
    + [(f"curve_{a}_{b}_bp", f"curve_{a}_{b}_bp_change_{k}d", k, 1) for a, b in SLOPE_LEGS for k in CURVE_STEPS]
    + [("curve_level", f"curve_level_change_{k}d_bp", k, 100) for k in CURVE_STEPS]
    + [("curve_slope_30y_3m_bp", f"curve_slope_change_{k}d_bp", k, 1) for k in CURVE_STEPS]
    + [("curve_curvature_5y_bp", f"curve_curvature_change_{k}d_bp", k, 1) for k in CURVE_STEPS]
)
cte(
    "curve_moves",
    f"""select *, {", ".join(f"({c} - lag({c}, {k}) over w) * {s} as {out}" for c, out, k, s in _steps)}
    from curve_base window w as (order by curve_date)""",
    "curve_base",
)


def _croll(column: str) -> str:
    frame = "(order by curve_date rows between 19 preceding and current row)"
    return f"case when count({column}) over {frame} = 20 then stddev_samp({column}) over {frame} end"


_vols = {
    "yield_10y_volatility_20d": "change_10y_1d_bp",
    "yield_30y_volatility_20d": "change_30y_1d_bp",
    "curve_level_volatility_20d": "curve_level_change_1d_bp",
    "curve_slope_volatility_20d": "curve_slope_change_1d_bp",
    "curve_curvature_volatility_20d": "curve_curvature_change_1d_bp",
}
cte("curve_feat", f"select *, {', '.join(f'{_croll(c)} as {o}' for o, c in _vols.items())} from curve_moves", "curve_moves")
# decay 0.0609 a month, maturities in years
_Z = np.array([0.25, 0.5, 1, 2, 3, 5, 7, 10, 20, 30]) * 12 * 0.0609
_HUMP = (1 - np.exp(-_Z)) / _Z
_L = np.column_stack([np.ones(10), _HUMP, _HUMP - np.exp(-_Z)])
_P = np.linalg.solve(_L.T @ _L, _L.T)
_beta = [
    " + ".join(f"({float(_P[i, j])!r}::double) * {y}" for j, y in enumerate(YIELDS)) + f" as {NS_FACTORS[i]}" for i in range(3)
]
_res = [
    f"power({y} - (" + " + ".join(f"({float(_L[j, i])!r}::double) * {NS_FACTORS[i]}" for i in range(3)) + "), 2)"
    for j, y in enumerate(YIELDS)
]
cte("ns", f"select *, sqrt(({' + '.join(_res)}) / 10) as ns_fit_rmse from (select *, {', '.join(_beta)} from curve)", "curve")
cte(
    "ns_moves",
    f"""select *, {", ".join(f"({f} - lag({f}, {k}) over w) * 100 as {f}_change_{k}d_bp" for f in NS_FACTORS for k in CURVE_STEPS)}
    from ns window w as (order by curve_date)""",
    "ns",
)
cte(
    "ns_feat",
    f"select *, {', '.join(f'{_croll(f"{f}_change_1d_bp")} as {f}_volatility_20d' for f in NS_FACTORS)} from ns_moves",
    "ns_moves",
)
cte(
    "regimes",
    """select f.*, c.curve_date as treasury_observation_date, f.market_date - c.curve_date as treasury_data_age_days,
    case when change_2y_5d_bp is null or change_30y_5d_bp is null then 'unclassified'
    when change_2y_5d_bp < 0 and change_30y_5d_bp < 0 and change_2y_5d_bp < change_30y_5d_bp then 'bull_steepening'
    when change_2y_5d_bp < 0 and change_30y_5d_bp < 0 then 'bull_flattening'
    when change_2y_5d_bp > 0 and change_30y_5d_bp > change_2y_5d_bp then 'bear_steepening'
    when change_2y_5d_bp > 0 and change_30y_5d_bp > 0 then 'bear_flattening'
    when change_2y_5d_bp < 0 and change_30y_5d_bp > 0 then 'twist_steepening'
    when change_2y_5d_bp > 0 and change_30y_5d_bp < 0 then 'twist_flattening'
    else 'mixed_or_flat' end as treasury_regime
    from fwd f asof left join curve_feat c on f.market_date >= c.curve_date""",
    "fwd",
    "curve_feat",
)
cte("dev", "select * from regimes where market_date <= date '2000-12-31'", "regimes")
cte(
    "panel_feat",
    f"""select t.*, {", ".join(f"f.{x}" for x in TARGETS)}, c.* exclude (curve_date), c.curve_date as treasury_observation_date
    from tech t join fwd f using (symbol, market_date) asof left join curve_feat c on t.market_date >= c.curve_date""",
    "tech",
    "fwd",
    "curve_feat",
)
cte(
    "episodes",
    """select *, sum(opens) over (partition by symbol order by market_date rows unbounded preceding) as regime_episode_id from (
    select *, case when lag(treasury_regime) over (partition by symbol order by market_date) is not distinct from treasury_regime
    then 0 else 1 end as opens from dev)""",
    "dev",
)
cte(
    "tagged",
    """select fold, role, p.*, case when forward_return_5 > 0 then 1 when forward_return_5 is not null then 0 end as target_up_5d,
    case when change_2y_5d_bp > 0 and change_30y_5d_bp > 0 and change_2y_5d_bp > change_30y_5d_bp then 1 else 0 end as bear_flattening
    from (select *, lead(market_date, 5) over (partition by symbol order by market_date) as target_end_date from panel_feat) p
    join (values ('fold_1', 'train', date '1995-01-01', date '1997-12-31'), ('fold_1', 'validation', date '1998-01-01', date '1998-12-31'),
    ('fold_2', 'train', date '1995-01-01', date '1998-12-31'), ('fold_2', 'validation', date '1999-01-01', date '1999-12-31'),
    ('fold_3', 'train', date '1995-01-01', date '1999-12-31'), ('fold_3', 'validation', date '2000-01-01', date '2000-12-31'))
    d(fold, role, a, b) on market_date between a and b and target_end_date <= b""",
    "panel_feat",
)
cte(
    "preds",
    """select symbol, market_date, fold, target_up_5d as actual_up, forward_return_5, model, probability from (
    select *, 'technical_probability' as model, round(least(greatest(0.5::double + 0.1::double * return_5d, 0), 1), 3) as probability from tagged
    union all
    select *, 'treasury_probability', round(least(greatest(0.5::double + 0.02::double * coalesce(change_2y_5d_bp, 0), 0), 1), 3) from tagged
    union all select *, 'flat_probability', 0.5::double from tagged)
    where role = 'validation' and return_5d is not null and forward_return_5 is not null""",
    "tagged",
)

# -------------------------------------------------------------- vintages

cte(
    "vint_all",
    """select o_orderpriority as series_name, 'S' || substr(o_orderpriority, 1, 1) as series_id,
    cast(date_trunc('month', o_orderdate) as date) as reference_date, cast(date_trunc('month', l_shipdate) as date) as vintage_date,
    sum(l_extendedprice) as flow, sum(l_extendedprice) filter (l_shipdate >= o_orderdate) as clean_flow,
    count(*) filter (l_shipdate >= o_orderdate) as clean_rows
    from orders join lineitem on o_orderkey = l_orderkey group by all""",
)
cte(
    "vint",
    """select series_name, series_id, reference_date, vintage_date, round(sum(clean_flow) over
    (partition by series_name, reference_date order by vintage_date rows unbounded preceding), 2) as value_as_known
    from vint_all where clean_rows > 0""",
    "vint_all",
)
cte(
    "hist",
    """select *, lag(value_as_known) over w as previous_value, lead(vintage_date) over w as known_until,
    min(vintage_date) over (partition by series_name, reference_date) as first_vintage_date from vint
    window w as (partition by series_name, reference_date order by vintage_date)""",
    "vint",
)
cte(
    "cal",
    """select series_name, reference_date, min(vintage_date) as release_date, '08:30' as release_time,
    'America/New_York' as release_timezone from vint group by 1, 2""",
    "vint",
)
cte(
    "events_cal",
    """select series_name, 'monthly_report' as event_name, max(reference_date) as reference_date, vintage_date as release_date,
    '08:30' as release_time, 'America/New_York' as release_timezone from vint group by series_name, vintage_date""",
    "vint",
)
cte(
    "obs",
    """select series_name, reference_date, case when month(reference_date) <> 11 then value_as_known end as value
    from hist where vintage_date = first_vintage_date""",
    "hist",
)
cte("part_cal", "select * from cal where month(reference_date) <> 7", "cal")
cte(
    "states",
    """select e.release_date as as_of_date, h.series_name, h.reference_date, h.value_as_known from events_cal e
    join hist h on h.series_name = e.series_name and h.vintage_date <= e.release_date
    and (h.known_until is null or e.release_date < h.known_until)""",
    "events_cal",
    "hist",
)
cte(
    "state_changes",
    """select *, value_as_known - lag(value_as_known) over w as change, row_number() over
    (partition by series_name, as_of_date order by reference_date desc) as newest from states
    window w as (partition by series_name, as_of_date order by reference_date)""",
    "states",
)
cte(
    "revs",
    """select *, value_as_known - previous_value as revision, row_number() over
    (partition by series_name, vintage_date order by reference_date desc) as k from hist where vintage_date > first_vintage_date""",
    "hist",
)
cte(
    "event_revs",
    """select series_name, vintage_date as event_date, coalesce(sum(revision) filter (k = 1), 0) as payroll_revision_1m,
    coalesce(sum(revision) filter (k = 2), 0) as payroll_revision_2m,
    coalesce(sum(revision) filter (k = 1), 0) + coalesce(sum(revision) filter (k = 2), 0) as payroll_revision_total
    from revs group by 1, 2""",
    "revs",
)
cte(
    "breadth",
    """select series_name, vintage_date as event_date, cast(count(*) filter (vintage_date = first_vintage_date) as int) as payroll_initial_periods,
    cast(count(*) filter (vintage_date > first_vintage_date) as int) as payroll_revised_periods,
    case when count(*) filter (vintage_date > first_vintage_date) > 2 then 1 else 0 end as payroll_broad_revision_event from hist group by 1, 2""",
    "hist",
)
cte(
    "event_feat",
    """select s.series_name, s.as_of_date as event_date, s.reference_date, s.value_as_known as payroll_level, s.change as payroll_change_1m,
    coalesce(r.payroll_revision_1m, 0) as payroll_revision_1m, coalesce(r.payroll_revision_2m, 0) as payroll_revision_2m,
    coalesce(r.payroll_revision_total, 0) as payroll_revision_total, coalesce(b.payroll_initial_periods, 0) as payroll_initial_periods,
    coalesce(b.payroll_revised_periods, 0) as payroll_revised_periods, coalesce(b.payroll_broad_revision_event, 0) as payroll_broad_revision_event
    from state_changes s left join event_revs r on r.series_name = s.series_name and r.event_date = s.as_of_date
    left join breadth b on b.series_name = s.series_name and b.event_date = s.as_of_date where newest = 1""",
    "state_changes",
    "event_revs",
    "breadth",
)


def _prior(value: str, history: str) -> str:
    frame = "(partition by series_name order by event_date rows between unbounded preceding and 1 preceding)"
    return (
        f"case when count({history}) over {frame} >= 12 then ({value} - avg({history}) over {frame}) / "
        f"nullif(stddev_samp({history}) over {frame}, 0) end"
    )


cte(
    "event_hist",
    f"""select e.event_name, e.reference_date as event_reference_date, f.*,
    {_prior("payroll_change_1m", "payroll_change_1m")} as payroll_change_z,
    case when payroll_broad_revision_event = 0 then
    {_prior("payroll_revision_total", "case when payroll_broad_revision_event = 0 then payroll_revision_total end")} end as payroll_revision_z
    from events_cal e join event_feat f on f.series_name = e.series_name and f.event_date = e.release_date""".replace(
        "partition by series_name", "partition by f.series_name"
    ),
    "events_cal",
    "event_feat",
)
cte(
    "event_market",
    """select b.*, e.* exclude (series_name, event_date), e.event_date as event_release_date,
    b.market_date - e.event_date as days_since_payroll_release, case when b.market_date = e.event_date then 1 else 0 end as payroll_release_day
    from (select symbol, market_date, close, (lead(close, 5) over w) / nullif(close, 0) - 1 as forward_return_5, lead(market_date, 5) over w as target_end_date
      from bars window w as (partition by symbol order by market_date)) b
    asof left join (select * from event_hist where series_name = '1-URGENT') e on b.market_date >= e.event_date""",
    "bars",
    "event_hist",
)
cte(
    "event_dev",
    "select * from event_market where market_date <= date '2000-12-31' and target_end_date <= date '2000-12-31'",
    "event_market",
)
cte("release_days", "select * from event_dev where payroll_release_day = 1", "event_dev")

ORACLE: dict[str, str] = {}


def ask(name: str, body: str, *names: str) -> None:
    ORACLE[name] = sql(body, *names)


# ---------------------------------------------------------- bar queries

ask(
    "s01_bars_first_arrival",
    "select o_orderpriority as symbol, cast(o_orderdate as date) as market_date, o_totalprice as open, o_totalprice as high, "
    "o_totalprice as low, o_totalprice as close, cast(o_custkey as double) as volume from orders "
    "qualify row_number() over (partition by o_orderpriority, o_orderdate order by o_orderkey) = 1",
)
ask(
    "s07_curve_pivot",
    f"select curve_date::timestamp as timestamp, {', '.join(f'round(max(value) filter (slot = {i}), 6) + 0.0 as {y}' for i, y in enumerate(YIELDS))} "
    "from curve_long group by 1".replace("curve_date::timestamp as timestamp", "curve_date as timestamp"),
    "curve_long",
)
ask(
    "s09_observation_normaliser",
    "select cast(o_orderdate as date) as reference_date, count(*) as observations, count(*) filter (o_orderstatus <> 'P') as readable, "
    "round(sum(o_totalprice) filter (o_orderstatus <> 'P'), 6) + 0.0 as total from orders group by 1",
)
ask("w00_bars_daily", "select * from bars", "bars")
ask("w01_trailing_returns", f"select symbol, market_date, {fl('return_1d', 'return_3d', 'return_5d', 'return_10d')} from tech", "tech")
ask("w02_momentum", f"select symbol, market_date, {fl('momentum')} from tech0", "tech0")
ask("w03_ema", f"select symbol, market_date, {fl('ema_9', 'ema_21', digits=3)} from tech", "tech")
ask("w04_rsi", f"select symbol, market_date, {fl('rsi_14')} from tech", "tech")
ask(
    "w05_ema_distances",
    f"select symbol, market_date, {fl('ema_spread_pct', 'close_vs_ema9', 'close_vs_ema21', 'rsi_centered')} from tech",
    "tech",
)
ask("w06_volatility", f"select symbol, market_date, {fl('volatility_5d', 'volatility_20d')} from tech", "tech")
ask("w07_volume", f"select symbol, market_date, {fl('volume_avg_20', 'relative_volume', 'log_volume')} from tech", "tech")
ask(
    "w08_price_extremes",
    "select symbol, market_date, "
    + fl("rolling_high_20", "rolling_low_20", "distance_from_20d_high", "distance_from_20d_low", "range_pct")
    + " from tech",
    "tech",
)
ask("w10_forward_returns", f"select symbol, market_date, {fl(*TARGETS)} from fwd", "fwd")
ask(
    "w11_directional_score",
    "select symbol, market_date, trend_score, vwap_score, rsi_score, momentum_score, volume_score, directional_score from scored",
    "scored",
)
ask(
    "w12_strength_label",
    """select symbol, case when directional_score >= 4 then 'strong_bullish' when directional_score >= 2 then 'bullish'
    when directional_score <= -4 then 'strong_bearish' when directional_score <= -2 then 'bearish' else 'neutral' end as strength,
    count(*) as bars from scored group by 1, 2""",
    "scored",
)
ask(
    "w13_edge_signals",
    "select symbol, market_date, bullish_entry, bearish_exit from edges where bullish_entry = 1 or bearish_exit = 1",
    "edges",
)
ask(
    "w14_signal_ledger",
    f"""select symbol, entry_signal_date, entry_date, {fl("entry_price")}, exit_signal_date, exit_date, {fl("exit_price")}, 100.0::double as amount,
    round((exit_price - entry_price) * 100, 6) + 0.0 as trade_pnl,
    round(sum((exit_price - entry_price) * 100) over (partition by symbol order by entry_signal_date rows unbounded preceding), 6) + 0.0 as total_pnl
    from (select symbol, side, market_date as entry_signal_date, fill_date as entry_date, fill_price as entry_price, lead(market_date) over w as exit_signal_date,
      lead(fill_date) over w as exit_date, lead(fill_price) over w as exit_price
      from (select *, lag(side) over (partition by symbol order by market_date) as last_side from
        (select symbol, market_date, fill_date, fill_price, case when bullish_entry = 1 then 'buy' else 'sell' end as side from edges
         where (bullish_entry = 1 or bearish_exit = 1) and fill_price is not null))
      where (last_side is null and side = 'buy') or side <> last_side window w as (partition by symbol order by market_date))
    where side = 'buy'""",
    "edges",
)
ask(
    "technical_features_all",
    f"select symbol, market_date, {fl(*RESEARCH_TECHNICAL_FEATURES, 'volume_avg_20', 'rolling_high_20', 'rolling_low_20')} from tech",
    "tech",
)

# -------------------------------------------------- summaries and pairs


def _outcomes(pattern: str, wide: bool, by_horizon: dict[str, str]) -> str:
    cells = []
    for h in HORIZONS:
        x = f"forward_return_{h}"
        for name, expr in by_horizon.items():
            cells.append(f"{expr.replace('$x', x)} as {name.replace('$h', str(h))}")
    return ", ".join(cells)


_mean, _se = "avg($x)", "stddev_samp($x) / sqrt(count($x))"
_positive = "round(avg(case when $x > 0 then 1.0::double when $x is not null then 0.0 end), 6) + 0.0"
ask(
    "a01_score_summary",
    "select directional_score, count(*) as observations, "
    + _outcomes(
        "",
        True,
        {
            "n_$h": "count($x)",
            "mean_return_$h": f"round({_mean}, 6) + 0.0",
            "median_return_$h": "round(median($x), 6) + 0.0",
            "std_return_$h": "round(stddev_samp($x), 6) + 0.0",
            "se_return_$h": f"round({_se}, 6) + 0.0",
            "ci95_low_$h": f"round({_mean} - 1.96 * ({_se}), 6) + 0.0",
            "ci95_high_$h": f"round({_mean} + 1.96 * ({_se}), 6) + 0.0",
            "positive_rate_$h": _positive,
        },
    )
    + " from scored join fwd using (symbol, market_date) group by 1",
    "scored",
    "fwd",
)
_REGIME = {
    "n_$hd": "count($x)",
    "mean_return_$hd": f"round({_mean}, 6) + 0.0",
    "median_return_$hd": "round(median($x), 6) + 0.0",
    "positive_rate_$hd": _positive,
}
ask("a02_regime_summary", f"select treasury_regime, count(*) as observations, {_outcomes('', True, _REGIME)} from dev group by 1", "dev")
ask(
    "a03_baseline",
    "select "
    + _outcomes("", True, {"baseline_mean_$hd": f"round({_mean}, 6) + 0.0", "baseline_positive_rate_$hd": _positive})
    + " from dev",
    "dev",
)
_rate = "avg(case when $x > 0 then 1.0::double when $x is not null then 0.0 end)"
ask(
    "a04_regime_excess",
    "select treasury_regime, count(*) as observations, "
    + _outcomes(
        "",
        True,
        {
            "excess_return_$hd": "round(avg($x) - (select avg($x) from dev), 6) + 0.0",
            "excess_positive_rate_$hd": f"round({_rate} - (select {_rate} from dev), 6) + 0.0",
        },
    )
    + " from dev group by 1",
    "dev",
)
ask(
    "w29_episodes",
    "select symbol, market_date, treasury_regime, cast(regime_episode_id as bigint) as regime_episode_id, opens as regime_episode_start from episodes",
    "episodes",
)
ask(
    "a05_episode_summary",
    f"select treasury_regime, count(*) as episodes, {_outcomes('', True, _REGIME)} from episodes "
    "where opens = 1 and treasury_regime <> 'unclassified' group by 1",
    "episodes",
)


def _pairs(source: str, features, targets) -> str:
    # every pair keeps the rows complete in both; ranks are taken per pair
    blocks = " union all ".join(
        f"select '{f}' as feature, '{t}' as target, {f}::double as x, {t}::double as y from {source}" for f in features for t in targets
    )
    return f"select * from ({blocks}) where x is not null and y is not null"


_PEARSON = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"
_RANKED = """select *, rank() over (partition by feature, target order by x) + (count(*) over (partition by feature, target, x) - 1) / 2.0::double as rx,
    rank() over (partition by feature, target order by y) + (count(*) over (partition by feature, target, y) - 1) / 2.0::double as ry"""
_SPEARMAN = "covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0)"


def _relationships(source: str, features, targets, least: int = 3) -> str:
    return f"""select feature, target, observations, round(p, 6) + 0.0 as pearson, round(s, 6) + 0.0 as spearman,
    round(abs(p), 6) as abs_pearson, round(abs(s), 6) as abs_spearman from (
    select feature, target, count(*) as observations, {_PEARSON} as p, {_SPEARMAN} as s
    from ({_RANKED} from ({_pairs(source, features, targets)})) group by 1, 2 having count(*) >= {least})"""


ask(
    "a06_pearson",
    f"select feature, target, count(*) as observations, round({_PEARSON}, 6) + 0.0 as pearson "
    f"from ({_pairs('panel_feat', RESEARCH_TECHNICAL_FEATURES, TARGETS)}) group by 1, 2",
    "panel_feat",
)
ask("a08_technical_relationships", _relationships("panel_feat", RESEARCH_TECHNICAL_FEATURES, TARGETS), "panel_feat")
ask("a08_treasury_relationships", _relationships("panel_feat", TREASURY_FEATURES, TARGETS), "panel_feat")
ask(
    "t03_top_features",
    "select feature, observations, abs_spearman from ("
    + _relationships("panel_feat", TREASURY_FEATURES, ["forward_return_5"])
    + ") order by abs_spearman desc nulls last, feature limit 10",
    "panel_feat",
)

# ---------------------------------------------------------------- curve

_changes = [o for _, o, _, _ in _steps if o.startswith("change_")]
_slopes = [f"curve_{a}_{b}_bp" for a, b in SLOPE_LEGS]
_slope_changes = [o for _, o, _, _ in _steps if o.startswith(("curve_10y", "curve_30y"))]
ask("w17_curve_changes", f"select curve_date, {fl(*_changes, *_slopes, *_slope_changes)} from curve_feat", "curve_feat")
_factors = ["curve_level", "curve_slope_30y_3m_bp", "curve_curvature_5y_bp"]
_factor_changes = [o for _, o, _, _ in _steps if o.startswith(("curve_level", "curve_slope", "curve_curv"))]
ask("w18_curve_factors", f"select curve_date, {fl(*_factors, *_factor_changes, *_vols)} from curve_feat", "curve_feat")
ask("m01_nelson_siegel", f"select curve_date, {fl(*NS_FACTORS, 'ns_fit_rmse')} from ns", "ns")
_dyn = [f"{f}_change_{k}d_bp" for f in NS_FACTORS for k in CURVE_STEPS] + [f"{f}_volatility_20d" for f in NS_FACTORS]
ask("m01b_nelson_siegel_dynamics", f"select curve_date, {fl(*_dyn)} from ns_feat", "ns_feat")
ask("p02_complete_curves", f"select curve_date, {fl(*YIELDS)} from curve", "curve")
ask(
    "j01_curve_asof_bars",
    f"""select symbol, market_date, close, c.curve_date as treasury_observation_date, {fl("yield_10y", *_factors)},
    cast(b.market_date - c.curve_date as double) as treasury_data_age_days from bars b asof left join curve_feat c on b.market_date >= c.curve_date""",
    "bars",
    "curve_feat",
)
ask(
    "j01_curve_asof_bars_keyed",
    f"select symbol, market_date, close, c.curve_date, {fl('yield_10y')} from bars b asof left join curve c on b.market_date >= c.curve_date".replace(
        "c.curve_date,", "c.curve_date as curve_date,"
    ),
    "bars",
    "curve",
)
ask(
    "v12_point_in_time_invariant",
    "select count(*) as rows, count(*) filter (treasury_observation_date > market_date) as future_rows, "
    "count(*) filter (treasury_observation_date is null) as unmatched_rows from regimes",
    "regimes",
)
ask("a18_data_age", "select cast(treasury_data_age_days as double) as treasury_data_age_days, count(*) as observations from regimes group by 1", "regimes")
ask(
    "a18_null_counts",
    "select " + ", ".join(f"count(*) filter ({c} is null) as {c}" for c in ("yield_2y", "yield_10y", "return_10d", "rsi_14", "volatility_20d")) + " from panel_feat",
    "panel_feat",
)
ask("m03_curve_regimes", "select symbol, treasury_regime, count(*) as rows from regimes group by 1, 2", "regimes")

# direct sandwich: u_t is the residual times its row of (X'X)^-1 X'
ask(
    "m02_hac_inference",
    """select treasury_regime, horizon_days, observations, regime_observations, round(coefficient, 6) + 0.0 as coefficient,
    round(se, 6) + 0.0 as hac_standard_error, round(coefficient / nullif(se, 0), 6) + 0.0 as t_stat,
    round(greatest(0, case when abs(coefficient / nullif(se, 0)) >= 8 then 0 else 1 - exp(-z * z) * list_sum(list_transform(range(0, 200), lambda n: exp((2 * n + 1) * ln(greatest(z, 1e-300)) - lgamma(n + 1.5)))) end), 6) + 0.0 as p_value,
    round(coefficient - 1.96 * se, 6) + 0.0 as ci_95_low, round(coefficient + 1.96 * se, 6) + 0.0 as ci_95_high
    from (select *, abs(coefficient / nullif(se, 0)) / sqrt(2.0::double) as z from (
      select treasury_regime, horizon_days, any_value(n) as observations, any_value(n1) as regime_observations, any_value(m1 - m0) as coefficient,
      sqrt(greatest(sum(u * u) + 2 * sum(cross_sum), 0)) as se from (
        select a.treasury_regime, a.horizon_days, a.n, a.n1, a.m1, a.m0, a.u,
        coalesce((1 - 1.0::double / (a.horizon_days + 1)) * a.u * a.u1, 0) + """
    + " + ".join(
        f"case when a.horizon_days >= {l} then coalesce((1 - {l}.0::double / (a.horizon_days + 1)) * a.u * a.u{l}, 0) else 0 end"
        for l in range(2, max(HORIZONS) + 1)
    )
    + """ as cross_sum from (select *, """
    + ", ".join(f"lag(u, {l}) over w as u{l}" for l in range(1, max(HORIZONS) + 1))
    + """ from (select *, (y - case when d then m1 else m0 end) * case when d then 1.0::double / n1 else -1.0::double / (n - n1) end as u from (
          select *, avg(y) filter (d) over g as m1, avg(y) filter (not d) over g as m0, count(*) over g as n, count(*) filter (d) over g as n1 from (
            select r.treasury_regime, l.symbol, l.market_date, l.horizon_days, l.y, l.treasury_regime = r.treasury_regime as d
            from (select distinct treasury_regime from dev where treasury_regime <> 'unclassified') r cross join (
              """
    + " union all ".join(
        f"select symbol, market_date, treasury_regime, {h} as horizon_days, forward_return_{h} as y from dev where forward_return_{h} is not null" for h in HORIZONS
    )
    + """) l) window g as (partition by treasury_regime, horizon_days)))
        window w as (partition by treasury_regime, horizon_days, symbol order by market_date)) a)
      group by 1, 2))""",
    "dev",
)

# ---------------------------------------------------------------- folds

ask(
    "w28_target_end",
    "select symbol, market_date, lead(market_date, 5) over (partition by symbol order by market_date) as target_end_date from bars",
    "bars",
)
ask(
    "f01_purged_range",
    "select * from (select symbol, market_date, lead(market_date, 5) over (partition by symbol order by market_date) as target_end_date from bars) "
    "where market_date between date '1996-01-01' and date '1997-12-31' and target_end_date <= date '1997-12-31'",
    "bars",
)
ask(
    "f03_walk_forward_folds",
    "select fold, role, count(*) as rows, min(market_date) as first_date, max(market_date) as last_date, max(target_end_date) as last_target from tagged group by 1, 2",
    "tagged",
)
ask(
    "p04_chronological_split",
    "select symbol, case when market_date < date '2000-01-01' then 'development' else 'test' end as role, count(*) as rows, max(market_date) as last_date from bars group by 1, 2",
    "bars",
)
ask("p07_model_flags", "select fold, role, symbol, market_date, bear_flattening, target_up_5d from tagged", "tagged")
ask("a19_class_balance", "select target_up_5d, count(*) as observations from tagged where role = 'train' group by 1", "tagged")
ask(
    "v20_holdout_lock",
    "select count(*) as rows, count(*) filter (year(market_date) = 2001 or year(target_end_date) = 2001) as locked_rows from tagged",
    "tagged",
)
ask(
    "m06_baseline_forecasts",
    "select fold, round(avg(forward_return_5) filter (role = 'train'), 6) + 0.0 as naive_mean, "
    "round(avg(target_up_5d) filter (role = 'train'), 6) + 0.0 as base_rate, count(*) filter (role = 'train') as train_rows, "
    "count(*) filter (role = 'validation') as validation_rows from tagged where forward_return_5 is not null group by 1",
    "tagged",
)

# -------------------------------------------------- probability reports

_LABEL = "['Q1_lowest', 'Q2', 'Q3', 'Q4', 'Q5_highest'][cast(ceil(row_number() over w * 5.0::double / count(*) over g) as int)]"


def _quintiles(keys: str) -> str:
    return f"""select *, {_LABEL} as probability_bucket from preds
    window w as (partition by {keys} order by probability, market_date, symbol), g as (partition by {keys})"""


_BUCKET = """count(*) as observations, round(avg(probability), 6) + 0.0 as mean_predicted_probability,
    round(avg(actual_up), 6) + 0.0 as actual_positive_rate, round(avg(forward_return_5), 6) + 0.0 as mean_forward_return_5"""
ask(
    "w16_quintiles",
    f"select model, fold, symbol, market_date, {fl('probability')}, probability_bucket from ({_quintiles('model')})",
    "preds",
)
ask(
    "a12_quintile_summary",
    f"select model, probability_bucket, {_BUCKET}, round(median(forward_return_5), 6) + 0.0 as median_forward_return_5 from ({_quintiles('model')}) group by 1, 2",
    "preds",
)
ask(
    "a13_fold_quintiles",
    f"select fold, model, probability_bucket, {_BUCKET}, round(median(forward_return_5), 6) + 0.0 as median_forward_return_5 "
    f"from ({_quintiles('fold, model')}) group by 1, 2, 3",
    "preds",
)
_bins = " ".join(
    f"when probability <= {(k * 0.1)!r}::double then '{'(-0.001, 0.1]' if k == 1 else f'({(k - 1) / 10}, {k / 10}]'}'" for k in range(1, 11)
)
ask("a14_calibration", f"select model, case {_bins} end as calibration_bucket, {_BUCKET} from preds group by 1, 2", "preds")
_EPS = "2.220446049250313e-16::double"
_CLASS = f"""select fold, model, count(*) as validation_rows, avg(actual_up) as validation_up_rate, avg(power(probability - actual_up, 2)) as brier_score,
    avg(-case when actual_up = 1 then ln(greatest({_EPS}, least(1 - {_EPS}, probability))) else ln(1 - greatest({_EPS}, least(1 - {_EPS}, probability))) end) as log_loss,
    avg(case when (probability >= 0.5) = (actual_up = 1) then 1.0::double else 0 end) as accuracy,
    (avg(case when probability >= 0.5 then 1.0::double else 0 end) filter (actual_up = 1) + avg(case when probability < 0.5 then 1.0::double else 0 end) filter (actual_up = 0)) / 2 as balanced_accuracy,
    (sum(r) filter (actual_up = 1) - sum(actual_up) * (sum(actual_up) + 1) / 2.0::double) / nullif(sum(actual_up) * sum(1 - actual_up), 0) as roc_auc
    from (select *, rank() over (partition by fold, model order by probability) + (count(*) over (partition by fold, model, probability) - 1) / 2.0::double as r from preds) group by 1, 2"""
ask(
    "a22_classification_metrics",
    f"select fold, model, validation_rows, {fl('validation_up_rate', 'brier_score', 'log_loss', 'accuracy', 'balanced_accuracy', 'roc_auc')} from ({_CLASS})",
    "preds",
)
ask(
    "a20_average_metrics",
    "select model, "
    + ", ".join(f"round(avg({c}), 6) + 0.0 as {c}" for c in ("roc_auc", "brier_score", "log_loss", "accuracy", "balanced_accuracy"))
    + f" from ({_CLASS}) group by 1",
    "preds",
)
ask(
    "a21_regression_metrics",
    """select fold, model, count(*) as validation_rows, round(avg(abs(y - p)), 6) + 0.0 as mae, round(sqrt(avg(power(y - p, 2))), 6) + 0.0 as rmse,
    round(1 - avg(power(y - p, 2)) / nullif(var_pop(y), 0), 6) + 0.0 as r2,
    round(case when max(abs(p)) > 0 then avg(case when sign(y) = sign(p) then 1.0::double else 0 end) end, 6) + 0.0 as directional_accuracy
    from (select *, forward_return_5 as y, probability - 0.5 as p from preds) group by 1, 2""",
    "preds",
)

# -------------------------------------------------------- macro queries

_V = "series_name, reference_date, vintage_date"
ask("s06_vintage_payload", f"select series_name, series_id, reference_date, vintage_date, {fl('value_as_known')} from vint", "vint")
_reg = {r["series_name"]: r for r in series_registry()}
_values = ", ".join(
    f"('{i}', '{s}', '{_reg[s]['series_id']}', '{_reg[s]['category']}', '{_reg[s]['source']}', '{_reg[s]['frequency']}', '{_reg[s]['units']}')"
    for i, s in enumerate(EMPLOYMENT_SERIES[:5], 1)
)
ask(
    "s10_registry_stamp",
    f"""select o.reference_date, {fl("value")}, r.series_name, series_id, category, source, frequency, units from obs o
    join (values {_values}) r(slot, series_name, series_id, category, source, frequency, units) on substr(o.series_name, 1, 1) = r.slot""",
    "obs",
)
ask("s14_fingerprint", "select doc_id, sha256(text) as sha256 from documents")
ask("p17_vintages_prepared", f"select series_name, series_id, reference_date, vintage_date, {fl('value_as_known')} from vint", "vint")
ask(
    "v01_vintage_rule_counts",
    """select series_name, count(*) as checked_rows, count(*) filter (reference_date is null) as missing_reference_date,
    count(*) filter (vintage_date is null) as missing_vintage_date, count(*) filter (vintage_date < reference_date) as vintage_before_reference
    from vint_all group by 1""",
    "vint_all",
)
ask("v04_vintage_order_violations", f"select 'vintage_before_reference' as check, {_V} from vint_all where vintage_date < reference_date", "vint_all")
ask(
    "v05_duplicate_keys",
    "select o_orderpriority as symbol, cast(o_orderdate as date) as market_date, count(*) as copies from orders group by 1, 2 having count(*) > 1",
)
ask(
    "v07_release_clock_checks",
    """select 'invalid_time' as check, series_name, reference_date from cal where month(reference_date) = 3
    union all select 'invalid_timezone', series_name, reference_date from cal where month(reference_date) = 5""",
    "cal",
)
ask(
    "v10_initial_calendar_check",
    f"select 'initial_without_calendar' as check, {_V} from hist where vintage_date = first_vintage_date and month(reference_date) = 7",
    "hist",
)
ask(
    "v13_availability_audit",
    """select series_name, count(*) filter (value is not null) as observations,
    count(*) filter (value is not null and release_date >= reference_date) as valid_availability,
    count(*) filter (value is not null and not coalesce(release_date >= reference_date, false)) as invalid_availability
    from obs left join part_cal using (series_name, reference_date) group by 1""",
    "obs",
    "part_cal",
)
ask(
    "v14_reference_window",
    f"""select series_name, reference_date, {fl("value")}, release_date, release_time, release_timezone, release_date as market_date_available
    from obs left join cal using (series_name, reference_date) where reference_date between date '1997-09-01' and date '1997-11-01'""",
    "obs",
    "cal",
)
ask(
    "v15_release_coverage",
    """select series_name, count(value) as non_null_observations, count(*) filter (value is not null and release_date is not null) as matched_release_events,
    count(*) filter (value is not null and release_date is null) as unmatched_observations,
    round(count(*) filter (value is not null and release_date is not null) / nullif(count(value), 0)::double, 6) + 0.0 as coverage_rate
    from obs left join part_cal using (series_name, reference_date) group by 1""",
    "obs",
    "part_cal",
)
ask("v11_coverage_problems", f"select series_name, reference_date, {fl('value')} from obs where value is not null and month(reference_date) = 7", "obs")
ask(
    "w19_initial_release",
    f"select {_V}, {fl('value_as_known', 'previous_value')}, known_until, case when vintage_date = first_vintage_date then 1 else 0 end as is_initial_release from hist",
    "hist",
)
_ASOF = "date '1998-06-15'"
_STATE = f"select *, {_ASOF} as as_of_date from vint where vintage_date <= {_ASOF} qualify row_number() over (partition by series_name, series_id, reference_date order by vintage_date desc) = 1"
ask("w20_reconstruct_as_of", f"select series_name, series_id, reference_date, vintage_date, {fl('value_as_known')}, as_of_date from ({_STATE})", "vint")
ask(
    "w21_latest_period",
    f"select series_name, reference_date, series_id, vintage_date, {fl('value_as_known')}, as_of_date from ({_STATE}) "
    "qualify row_number() over (partition by series_name order by reference_date desc) = 1",
    "vint",
)
ask(
    "j13_states_as_of_events",
    "select series_name, as_of_date, count(*) as periods, max(reference_date) as newest, round(sum(value_as_known), 2) + 0.0 as total from states group by 1, 2",
    "states",
)
ask(
    "w22_state_changes",
    "select series_name, as_of_date, reference_date, round(value_as_known, 2) + 0.0 as payroll_level, round(change, 2) + 0.0 as payroll_change_1m "
    "from state_changes",
    "state_changes",
)
ask(
    "j06_release_calendar_attach",
    f"""select h.series_name, series_id, h.reference_date, c.release_date as original_release_date,
    case when vintage_date = c.release_date then release_time end as release_time, case when vintage_date = c.release_date then release_timezone end as release_timezone,
    vintage_date, {fl("value_as_known")}, vintage_date as market_date_available, case when vintage_date = first_vintage_date then 1 else 0 end as is_initial_release
    from hist h left join cal c on c.series_name = h.series_name and c.reference_date = h.reference_date""",
    "hist",
    "cal",
)
ask(
    "j07_event_timing",
    f"""select h.series_name, h.reference_date, h.vintage_date, {fl("value_as_known")}, e.event_name, e.reference_date as event_reference_date,
    e.release_date as event_release_date, e.release_time as event_release_time
    from hist h left join (select * from events_cal where month(release_date) <> 12) e on e.series_name = h.series_name and e.release_date = h.vintage_date""",
    "hist",
    "events_cal",
)
_REV = ["payroll_revision_1m", "payroll_revision_2m", "payroll_revision_total"]
ask("w23_event_revisions", f"select series_name, event_date, {fl(*_REV, digits=2)} from event_revs", "event_revs")
ask("a16_revision_breadth", "select * from breadth", "breadth")
ask("a15_first_vintage", "select series_name, reference_date, min(vintage_date) as first_vintage_date from vint group by 1, 2", "vint")
ask(
    "a17_vintage_profile",
    """select series_name, cast(sum(n) as bigint) as vintage_rows, count(*) as reference_periods, count(*) filter (n > 1) as revised_periods,
    min(a) as first_vintage, max(b) as last_vintage
    from (select series_name, reference_date, count(*) as n, min(vintage_date) as a, max(vintage_date) as b from vint group by 1, 2) group by 1""",
    "vint",
)
_BREADTH = "payroll_initial_periods, payroll_revised_periods, payroll_broad_revision_event"
_LEVELS = ["payroll_level", "payroll_change_1m", *_REV]
ask("w24_event_features", f"select series_name, event_date, reference_date, {fl(*_LEVELS, digits=2)}, {_BREADTH} from event_feat", "event_feat")
ask(
    "w25_event_history",
    f"select series_name, event_date as event_release_date, event_name, event_reference_date, reference_date, "
    f"{fl(*_LEVELS, 'payroll_change_z', 'payroll_revision_z', digits=4)}, {_BREADTH} from event_hist",
    "event_hist",
)
ask(
    "w26_prior_zscore",
    f"select series_name, event_date as event_release_date, {fl('payroll_change_1m', 'payroll_change_z', digits=4)} from event_hist",
    "event_hist",
)
ask(
    "w27_regular_revision_zscore",
    f"""select series_name, event_date as event_release_date, broad as payroll_broad_revision_event, {fl("payroll_revision_total", digits=4)},
    round(case when broad = 0 then {_prior("payroll_revision_total", "case when broad = 0 then payroll_revision_total end")} end, 4) + 0.0 as payroll_revision_z
    from (select *, case when payroll_revised_periods % 3 = 0 then 1 else 0 end as broad from event_feat)""",
    "event_feat",
)
ask(
    "j04_events_to_market",
    f"select symbol, market_date, event_release_date, reference_date, {fl('payroll_level', 'payroll_revision_total', digits=2)}, "
    "cast(days_since_payroll_release as double) as days_since_payroll_release, payroll_release_day from event_market",
    "event_market",
)


def _macro_asof(series: str, prefix: str) -> str:
    return f"""asof left join (select reference_date, value, release_date from obs join cal using (series_name, reference_date)
    where series_name = '{series}' and value is not null qualify row_number() over (partition by release_date order by reference_date desc) = 1)
    {prefix} on b.market_date >= {prefix}.release_date"""


ask(
    "j02_macro_series_asof",
    f"""select symbol, market_date, close, u.release_date as urgent_market_date_available, round(u.value, 6) + 0.0 as urgent,
    u.reference_date as urgent_reference_date, u.release_date as urgent_release_date,
    case when u.release_date is not null then '08:30' end as urgent_release_time, case when u.release_date is not null then 'America/New_York' end as urgent_release_timezone,
    cast(market_date - u.release_date as double) as urgent_data_age_days from bars b {_macro_asof("1-URGENT", "u")}""",
    "bars",
    "obs",
    "cal",
)
ask(
    "j03_macro_family_asof",
    "select symbol, market_date, "
    + ", ".join(
        f"round({p}.value, 6) + 0.0 as {n}, {p}.reference_date as {n}_reference_date, cast(market_date - {p}.release_date as double) as {n}_data_age_days"
        for n, p in (("urgent", "u"), ("high", "h"), ("medium", "m"), ("unspecified", "n"), ("low", "l"))
    )
    + " from bars b "
    + " ".join(_macro_asof(s, p) for s, p in (("1-URGENT", "u"), ("2-HIGH", "h"), ("3-MEDIUM", "m"), ("4-NOT SPECIFIED", "n"), ("5-LOW", "l"))),
    "bars",
    "obs",
    "cal",
)
ask(
    "j05_observation_releases",
    f"select series_name, reference_date, {fl('value')}, release_date, release_time, release_timezone from obs left join part_cal using (series_name, reference_date)",
    "obs",
    "part_cal",
)
ask("p12_market_observed", f"select series_name, reference_date, {fl('value')}, reference_date as market_date_available from obs", "obs")
ask("p15_informative_observations", "select round(value, 6) + 0.0 as macro, reference_date as macro_reference_date from obs where value is not null", "obs")
_EXPANDED = f"""select report, s.series_name, reference_date, release_date, release_time, release_timezone
    from (select * rename (series_name as report) from events_cal) cross join (values {", ".join(f"('{s}')" for s in EMPLOYMENT_SERIES)}) s(series_name)"""
ask("j11_calendar_expansion", _EXPANDED, "events_cal")
ask(
    "u02_late_release",
    f"{_EXPANDED} union all select distinct e.series_name, t.series_name, date '{LATE_RELEASE[0]}', date '{LATE_RELEASE[1]}', '{LATE_RELEASE[2]}', '{LATE_RELEASE[3]}' "
    f"from events_cal e cross join (values {', '.join(f"('{s}')" for s in ESTABLISHMENT_SERIES)}) t(series_name)",
    "events_cal",
)


def _us_summer(d: str) -> str:
    """Daylight saving of 1987-2006: first Sunday of April to last Sunday of October."""
    april = f"make_date(year({d}), 4, 1)"
    october = f"make_date(year({d}), 10, 31)"
    start = f"({april} + cast((7 - dayofweek({april})) % 7 as int))"
    end = f"({october} - cast(dayofweek({october}) as int))"
    return f"({d} >= {start} and {d} < {end})"


ask(
    "release_instants",
    f"""select series_name, reference_date, strftime(release_date, '%Y-%m-%d') || case when {_us_summer("release_date")} then ' 12:30' else ' 13:30' end as released_utc from cal""",
    "cal",
)
_PF = list(PAYROLL_FEATURES)


def _event_corr(source: str, features) -> str:
    return f"""select feature, count(*) as observations, count(distinct x) as unique_feature_values, round({_PEARSON}, 6) + 0.0 as pearson,
    round({_SPEARMAN}, 6) + 0.0 as spearman from ({_RANKED} from ({_pairs(source, features, ["forward_return_5"])})) group by 1"""


ask("a09_daily_event_correlations", _event_corr("event_dev", _PF), "event_dev")
ask("p06_release_day_correlations", _event_corr("release_days", _PF[:-1]), "release_days")
_three = ["payroll_change_1m", "payroll_revision_total", "forward_return_5"]
ask(
    "a10_release_correlation_matrix",
    f"""select feature as row, target as column, round({_PEARSON}, 6) + 0.0 as pearson, round({_SPEARMAN}, 6) + 0.0 as spearman
    from ({_RANKED} from ({_pairs(f"(select * from release_days where {' and '.join(f'{c} is not null' for c in _three)})", _three, _three)})) group by 1, 2""".replace(
        "as column,", 'as "column",'
    ),
    "release_days",
)
ask(
    "a11_event_distribution",
    "select feature, count(x) as count, round(avg(x), 4) + 0.0 as mean, round(stddev_samp(x), 4) + 0.0 as std, round(min(x), 4) + 0.0 as min, "
    "round(max(x), 4) + 0.0 as max, round(quantile_cont(x, 0.25), 4) + 0.0 as p25, round(quantile_cont(x, 0.5), 4) + 0.0 as p50, "
    "round(quantile_cont(x, 0.75), 4) + 0.0 as p75 from ("
    + " union all ".join(f"select '{f}' as feature, {f}::double as x from event_dev" for f in _PF)
    + ") where x is not null group by 1",
    "event_dev",
)
ask(
    "a23_revision_sign_means",
    """select count(*) filter (x > 0) as positive_events, count(*) filter (x < 0) as negative_events,
    round(avg(forward_return_5) filter (x > 0), 6) + 0.0 as mean_after_positive, round(avg(forward_return_5) filter (x < 0), 6) + 0.0 as mean_after_negative
    from (select *, payroll_revision_total - 1000000 as x from release_days)""",
    "release_days",
)
ask(
    "f04_event_development",
    "select symbol, count(*) as rows, max(market_date) as last_date, max(target_end_date) as last_target from event_dev group by 1",
    "event_dev",
)
ask(
    "t04_largest_revisions",
    f"""select market_date, symbol, {fl(*_REV, digits=2)} from release_days
    order by abs(payroll_revision_total) desc nulls last, market_date, symbol, payroll_revision_1m, payroll_revision_2m, payroll_revision_total limit 10""",
    "release_days",
)
cte(
    "forecasts",
    """select * from (select symbol, market_date as forecast_origin, lead(market_date, 5) over (partition by symbol order by market_date) as target,
    (close % 125) / 100 as p from bars) where target is not null""",
    "bars",
)
ask(
    "s11_forecast_contract",
    "select 'probability' as check, symbol, forecast_origin, 'final_model' as model from forecasts where p > 1",
    "forecasts",
)


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _status(ahead: int) -> str:
    whose = " ".join(f"when '{_PRIORITIES[(i + ahead) % 5]}' then '{s}'" for i, s in enumerate(_PRIORITIES))
    return f"""select f.symbol, f.forecast_origin, r.state, case when r.day < f.forecast_origin then r.day end as latest,
    case when r.day = f.forecast_origin and r.n > 1 then 'ambiguous_duplicate_date' when r.day = f.forecast_origin then 'matched' else 'date_mismatch' end as status
    from forecasts f asof left join (select case o_orderpriority {whose} end as symbol, cast(o_orderdate as date) as day, count(*) as n,
    min(o_orderstatus) as state from orders group by 1, 2) r on f.symbol = r.symbol and f.forecast_origin >= r.day"""


ask(
    "v18_report_status",
    f"select symbol, forecast_origin as as_of, status, latest as latest_available_as_of, case when status = 'matched' then state end as state from ({_status(1)})",
    "forecasts",
)
ask(
    "j12_assessments",
    f"""select a.symbol, a.forecast_origin, a.status as opportunity_status, b.status as risk_status,
    case when a.status = 'matched' and b.status = 'matched' then 1 else 0 end as aligned, 'NOT_AUTHORIZED_READ_ONLY' as trading_status
    from ({_status(1)}) a join ({_status(2)}) b using (symbol, forecast_origin)""",
    "forecasts",
)

# ------------------------------------------------------ intraday queries

cte(
    "ibars",
    """select event_type as symbol, time_bucket(interval '5 minutes', ts) as bar_start, arg_min(value, (ts, event_id)) as open, max(value) as high,
    min(value) as low, arg_max(value, (ts, event_id)) as close, cast(sum(cast(json_extract(props, '$.k') as bigint)) as double) as volume
    from events group by 1, 2""",
)
# the ticks lie in January: New York is five hours behind throughout
cte(
    "sess",
    """select *, cast(bar_start - interval 5 hours as date) as session_date,
    cast(hour(bar_start - interval 5 hours) * 60 + minute(bar_start - interval 5 hours) as int) as minute_of_day,
    cast(dayofweek(bar_start - interval 5 hours) as int) as day_of_week from ibars""",
    "ibars",
)
ask("e01_five_minute_bars", "select * from ibars", "ibars")
ask(
    "e01_streaming_bars",
    "select * from ibars where bar_start + interval 5 minutes <= (select max(ts) - interval 10 minutes from events)",
    "ibars",
)
ask(
    "e02_session_columns",
    """select symbol, bar_start, session_date, minute_of_day, minute_of_day - 570 as minutes_from_open, 960 - minute_of_day as minutes_to_close, day_of_week,
    case when minute_of_day between 570 and 959 and day_of_week between 1 and 5 then 1 else 0 end as is_regular_session,
    case when minute_of_day between 570 and 599 then 1 else 0 end as opening_30m, case when minute_of_day between 900 and 959 then 1 else 0 end as power_hour from sess""",
    "sess",
)


def _other(minutes: int) -> str:
    return f"left join sess b{'p' if minutes > 0 else 'm'}{abs(minutes)} on b{'p' if minutes > 0 else 'm'}{abs(minutes)}.symbol = s.symbol and b{'p' if minutes > 0 else 'm'}{abs(minutes)}.session_date = s.session_date and b{'p' if minutes > 0 else 'm'}{abs(minutes)}.bar_start = s.bar_start + interval ({minutes}) minutes"


_back, _ahead = (5, 15, 30, 60, 120), (15, 30, 60, 120)
ask(
    "e03_bar_returns",
    "select s.symbol, s.bar_start, "
    + ", ".join(f"round(ln(s.close / nullif(bm{m}.close, 0)), 6) + 0.0 as ret_{m}m" for m in _back)
    + ", "
    + ", ".join(f"round(bp{m}.close / nullif(s.close, 0) - 1, 6) + 0.0 as fwd_{m}m" for m in _ahead)
    + ", "
    + ", ".join(f"case when bp{m}.close is not null and s.close <> 0 then case when bp{m}.close / s.close - 1 > 0 then 1.0::double else 0.0 end end as dir_{m}m" for m in _ahead)
    + " from sess s "
    + " ".join(_other(-m) for m in _back)
    + " "
    + " ".join(_other(m) for m in _ahead),
    "sess",
)
_S = "(partition by symbol, session_date order by bar_start rows unbounded preceding)"
ask(
    "e04_session_vwap",
    f"""select symbol, bar_start, round(v, 6) + 0.0 as vwap, round(close / nullif(v, 0) - 1, 6) + 0.0 as vwap_distance from (
    select *, sum(close * volume) over {_S} / nullif(sum(volume) over {_S}, 0) as v from sess)""",
    "sess",
)


def _past_minutes(m: int) -> str:
    return f"(partition by symbol, session_date order by bar_start range between interval {m - 5} minutes preceding and current row)"


ask(
    "e05_session_volume",
    "select symbol, bar_start, "
    + ", ".join(f"sum(volume) over {_past_minutes(m)} as volume_{m}m" for m in (15, 30, 60))
    + ", round(volume / nullif(avg(volume) over (partition by symbol, minute_of_day order by session_date rows between unbounded preceding and 1 preceding), 0), 6) + 0.0 as relative_volume from sess",
    "sess",
)
ask(
    "e06_realized_volatility",
    "select symbol, bar_start, "
    + ", ".join(f"round(sqrt(sum(sq) over {_past_minutes(m)}), 6) + 0.0 as vol_{m}m" for m in (15, 30, 60))
    + ", round((high - low) / nullif(close, 0), 6) + 0.0 as range_pct from (select s.*, power(ln(s.close / nullif(bm5.close, 0)), 2) as sq from sess s "
    + _other(-5)
    + ")",
    "sess",
)
_YIELDS = {"ust10y": "view", "ust30y": "signup"}
_MOVES = (5, 15, 30, 60)
ask(
    "e06_yield_changes",
    "select * from (with slots as (select session_date, unnest(generate_series(min(bar_start), max(bar_start), interval 5 minutes)) as bar_start from sess where symbol in ('view', 'signup') group by 1), "
    "filled as (select g.session_date, g.bar_start, "
    + ", ".join(f"case when epoch(g.bar_start - {leg}.bar_start) <= 600 then {leg}.close end as {leg}" for leg in _YIELDS)
    + " from slots g "
    + " ".join(
        f"asof left join (select * from sess where symbol = '{s}' and close is not null) {leg} on {leg}.session_date = g.session_date and g.bar_start >= {leg}.bar_start"
        for leg, s in _YIELDS.items()
    )
    + "), spread as (select *, (ust30y - ust10y) * 100 as curve_10s30s_bp from filled) "
    "select n.session_date, n.bar_start, round(n.ust10y, 6) + 0.0 as ust10y, round(n.ust30y, 6) + 0.0 as ust30y, round(n.curve_10s30s_bp, 6) + 0.0 as curve_10s30s_bp, "
    + ", ".join(f"round((n.{leg} - b{m}.{leg}) * 100, 6) + 0.0 as {leg}_chg_{m}m" for leg in _YIELDS for m in _MOVES)
    + ", "
    + ", ".join(f"round(n.curve_10s30s_bp - b{m}.curve_10s30s_bp, 6) + 0.0 as curve_10s30s_chg_{m}m" for m in _MOVES)
    + " from spread n "
    + " ".join(f"left join spread b{m} on b{m}.session_date = n.session_date and b{m}.bar_start = n.bar_start - interval {m} minutes" for m in _MOVES)
    + ")",
    "sess",
)
_PAST = "(partition by series_name order by event_date rows between unbounded preceding and 1 preceding)"
ask(
    "e07_macro_surprise",
    f"""select series_name, event_date as event_release_date, round(x, 4) + 0.0 as macro_surprise_raw,
    round(case when count(x) over {_PAST} >= 12 then x / nullif(stddev_samp(x) over {_PAST}, 0) end, 4) + 0.0 as macro_surprise_z,
    case when x > 0 then 1 else 0 end as macro_positive_surprise, case when x < 0 then 1 else 0 end as macro_negative_surprise
    from (select *, payroll_change_1m as x from event_feat)""",
    "event_feat",
)
cte("sched", "select distinct event_type as symbol, date_trunc('minute', ts) as event_ts from events where value > 150")
ask(
    "e08_event_distance",
    """select symbol, bar_start, close, round(since, 6) + 0.0 as minutes_since_event, round(until, 6) + 0.0 as minutes_until_event,
    case when since <= 15 then 1 else 0 end as post_event_15m, case when since <= 30 then 1 else 0 end as post_event_30m,
    case when since <= 60 then 1 else 0 end as post_event_60m, case when until <= 15 then 1 else 0 end as pre_event_15m,
    case when since <= 60 or until <= 15 then 1 else 0 end as is_event_window from (
    select b.symbol, b.bar_start, b.close, epoch(b.bar_start - a.event_ts) / 60.0::double as since, epoch(n.event_ts - b.bar_start) / 60.0::double as until
    from ibars b asof left join sched a on a.symbol = b.symbol and b.bar_start >= a.event_ts
    asof left join sched n on n.symbol = b.symbol and b.bar_start <= n.event_ts)""",
    "ibars",
    "sched",
)
_W4 = "(partition by symbol order by market_date rows between 3 preceding and current row)"
ask(
    "e09_quality_flags",
    f"""select symbol, market_date, 0 as duplicate_timestamp, case when close > 0 then 0 else 1 end as invalid_price,
    case when market_date - lag(market_date) over w > 3 then 1 else 0 end as missing_interval,
    case when count(close) over {_W4} = 4 and max(close) over {_W4} = min(close) over {_W4} then 1 else 0 end as stale_value,
    case when abs(close / nullif(lag(close) over w, 0) - 1) > 10 then 1 else 0 end as outlier_flag from bars
    window w as (partition by symbol order by market_date)""",
    "bars",
)
_SCALED = ["return_5d", "rsi_14", "volatility_20d", "relative_volume", "distance_from_20d_high", "yield_10y", "yield_30y",
           "change_2y_5d_bp", "change_30y_5d_bp", "curve_10y_2y_bp", "curve_30y_2y_bp", "yield_30y_volatility_20d", "bear_flattening"]
cte("train", "select * from tagged where role = 'train' and forward_return_5 is not null", "tagged")
cte(
    "scaling",
    "select fold, feature, med as median, avg(coalesce(x, med)) as mean, stddev_pop(coalesce(x, med)) as deviation from "
    "(select *, median(x) over (partition by fold, feature) as med from ("
    + " union all ".join(f"select fold, '{f}' as feature, {f}::double as x from train" for f in _SCALED)
    + ")) group by 1, 2, 3",
    "train",
)
# one scaled feature z with mean 0 over the train rows: weight = sum(z y) / (sum(z z) + 1), intercept = mean of y
_SINGLE = {"oscillator_ridge": "rsi_14", "slope_ridge": "curve_10y_2y_bp"}
cte(
    "single_ridge",
    "with cells as ("
    + " union all ".join(
        f"select t.fold, t.role, t.symbol, t.market_date, t.forward_return_5 as y, '{m}' as model, (coalesce({f}::double, s.median) - s.mean) / s.deviation as z "
        f"from tagged t join scaling s on s.fold = t.fold and s.feature = '{f}' where t.forward_return_5 is not null"
        for m, f in _SINGLE.items()
    )
    + """), fit as (select fold, model, avg(y) as level, sum(z * y) / (sum(z * z) + 1) as weight from cells where role = 'train' group by 1, 2)
    select c.fold, c.model, c.y, f.level + f.weight * c.z as p from cells c join fit f using (fold, model) where c.role = 'validation'
    union all select c.fold, 'naive_mean', c.y, f.level from cells c join fit f using (fold, model) where c.role = 'validation' and c.model = 'slope_ridge'
    union all select fold, 'zero_return', y, 0.0 from cells where role = 'validation' and model = 'slope_ridge'""",
    "tagged",
    "scaling",
)
ask(
    "m04_single_ridge_walk_forward",
    """select fold, model, validation_rows, train_rows, round(train_up_rate, 6) + 0.0 as train_up_rate, round(mae, 6) + 0.0 as mae, round(rmse, 6) + 0.0 as rmse,
    round(r2, 6) + 0.0 as r2, round(directional_accuracy, 6) + 0.0 as directional_accuracy from (
    select fold, model, count(*) as validation_rows, avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse, 1 - avg((y - p) * (y - p)) / var_pop(y) as r2,
    case when max(abs(p)) > 0 then avg(case when sign(y) = sign(p) then 1.0 else 0.0 end) end as directional_accuracy from single_ridge group by 1, 2)
    join (select fold, count(*) as train_rows, avg(case when forward_return_5 > 0 then 1.0 else 0.0 end) as train_up_rate from train group by 1) using (fold)""",
    "single_ridge",
    "train",
)
# ------------------------------------------------ linear and logistic models
_ALL = list(dict.fromkeys(f for fs in (*RIDGE_MODELS.values(), *LOGISTIC_MODELS.values()) for f in fs))


def _eliminated(system: str, size: str) -> str:
    """Gauss-Jordan elimination of the first ``size`` columns of a list of rows."""
    row = "list_transform(a.m[b.k], lambda x: x / a.m[b.k][b.k])"
    other = "list_transform(r, lambda x, j: x - r[b.k] * a.m[b.k][j] / a.m[b.k][b.k])"
    return (
        f"list_reduce(list_transform(range(1, {size} + 1), lambda i: {{'k': i, 'm': []::double[][]}}), "
        f"lambda a, b: {{'k': b.k, 'm': list_transform(a.m, lambda r, i: case when i = b.k then {row} else {other} end)}}, {{'k': 0::bigint, 'm': {system}}}).m"
    )


def _models(models) -> str:
    rows = ", ".join(f"('{m}', {[_ALL.index(f) + 1 for f in fs]})" for m, fs in models.items())
    return f"(values {rows}) as models(model, places)"


# every row of a fold as one list of scaled features; a feature without train values adds nothing
cte(
    "vectors",
    f"with wide as materialized (select t.*, {', '.join('n.' + f for f in _ALL if f.startswith('ns_'))} from tagged t left join ns_feat n on n.curve_date = t.treasury_observation_date where forward_return_5 is not null), long as ("
    + " union all ".join(f"select fold, role, symbol, market_date, {i} as i, {f}::double as x from wide" for i, f in enumerate(_ALL))
    + """), middle as (select fold, i, median(x) as med from long where role = 'train' group by 1, 2),
    spread as (select fold, i, med, avg(coalesce(x, med)) as mean, stddev_pop(coalesce(x, med)) as deviation from long join middle using (fold, i) where role = 'train' group by 1, 2, 3)
    select fold, role, symbol, market_date, forward_return_5 as y, target_up_5d as up, v from (
    select fold, role, symbol, market_date, list(coalesce((coalesce(x, med) - mean) / case when deviation = 0 then 1 else deviation end, 0) order by i) as v
    from long join spread using (fold, i) group by 1, 2, 3, 4) join tagged using (fold, role, symbol, market_date)""",
    "tagged",
    "ns_feat",
)
cte(
    "ridge_fits",
    f"""with level as (select fold, avg(y) as mean from vectors where role = 'train' group by 1),
    grams as (select fold, i, j, sum(v[i] * v[j]) as s from vectors, range(1, {len(_ALL) + 1}) a(i), range(1, {len(_ALL) + 1}) b(j) where role = 'train' group by 1, 2, 3),
    pulls as (select fold, i, sum(v[i] * (y - mean)) as s from vectors join level using (fold), range(1, {len(_ALL) + 1}) a(i) where role = 'train' group by 1, 2),
    cells as (
      select fold, model, a.k as i, b.k as j, s + case when a.k = b.k then 1.0 else 0.0 end as s from (select *, unnest(range(1, len(places) + 1)) as k from {_models(RIDGE_MODELS)}) a
      join (select model as other, places as p, unnest(range(1, len(places) + 1)) as k from {_models(RIDGE_MODELS)}) b on b.other = a.model
      join grams g on g.i = a.places[a.k] and g.j = b.p[b.k]
      union all
      select fold, model, k, len(places) + 1, s from (select *, unnest(range(1, len(places) + 1)) as k from {_models(RIDGE_MODELS)}) a join pulls p on p.i = a.places[a.k]),
    systems as (select fold, model, list(r order by i) as m from (select fold, model, i, list(s order by j) as r from cells group by 1, 2, 3) group by 1, 2)
    select fold, model, places, mean, list_transform({_eliminated("m", "len(m)")}, lambda r: r[-1]) as w from systems join level using (fold) join {_models(RIDGE_MODELS)} using (model)""",
    "vectors",
)
cte(
    "ridge_preds",
    """select fold, model, y, mean + list_inner_product(w, list_select(v, places)) as p from vectors join ridge_fits using (fold) where role = 'validation'
    union all select fold, 'naive_mean', y, mean from vectors join (select distinct fold, mean from ridge_fits) using (fold) where role = 'validation'
    union all select fold, 'zero_return', y, 0.0 from vectors where role = 'validation'""",
    "vectors",
    "ridge_fits",
)
_TRAINED = "(select fold, count(*) as train_rows, round(avg(up), 6) + 0.0 as train_up_rate from vectors where role = 'train' group by 1)"
ask(
    "m04_ridge_walk_forward",
    f"""select * from {_TRAINED} join (select fold, model, count(*) as validation_rows, round(avg(abs(y - p)), 6) + 0.0 as mae, round(sqrt(avg((y - p) * (y - p))), 6) + 0.0 as rmse,
    round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) + 0.0 as r2,
    round(case when max(abs(p)) > 0 then avg(case when sign(y) = sign(p) then 1.0 else 0.0 end) end, 6) + 0.0 as directional_accuracy from ridge_preds group by 1, 2) using (fold)""",
    "ridge_preds",
    "vectors",
)
# Newton's method: cells of the Hessian and, in one more column, of the slope; the intercept is not penalised
_STEPS = 8
cte(
    "newton",
    f"""select 0 as step, fold, model, places, list_transform(range(0, len(places) + 1), lambda i: 0.0::double) as w
    from (select distinct fold from vectors), {_models(LOGISTIC_MODELS)}
    union all
    select step + 1, fold, model, places, list_transform(w, lambda x, i: x + moves[i]) from (
      select step, fold, model, places, w, list_transform({_eliminated("m", "len(places) + 1")}, lambda r: r[-1]) as moves from (
        select step, fold, model, places, w, list_transform(sums, lambda r, i: list_transform(r, lambda x, j:
          x + case when i = 1 then 0 when i = j then 1 when j = len(places) + 2 then -w[i] else 0 end)) as m
        from newton join (
          select fold, model, list(r order by i) as sums from (
            select fold, model, i, list(s order by j) as r from (
              select fold, model, i, j, sum(case when j <= n then s * x_i * x[j] else d * x_i end) as s from (
                select fold, model, i, n, s, d, x, x[i] as x_i, unnest(range(1, n + 2)) as j from (
                  select fold, model, len(x) as n, p * (1 - p) as s, up - p as d, x, unnest(range(1, len(x) + 1)) as i from (
                    select *, 1 / (1 + exp(-list_inner_product(w, x))) as p from (
                      select n.fold, model, w, up, list_concat([1.0::double], list_select(v, places)) as x
                      from newton n join vectors t on t.fold = n.fold where role = 'train' and step < {_STEPS}))))
              group by fold, model, i, j)
            group by fold, model, i)
          group by fold, model) using (fold, model)))""",
    "vectors",
)
cte(
    "logistic_preds",
    f"""select symbol, market_date, fold, up as actual_up, y as forward_return_5, model, 1 / (1 + exp(-list_inner_product(w, list_concat([1.0::double], list_select(v, places))))) as probability
    from vectors join (select * from newton where step = {_STEPS}) using (fold) where role = 'validation'
    union all select symbol, market_date, fold, up, y, 'base_rate', rate from vectors
    join (select fold, avg(up) as rate from vectors where role = 'train' group by 1) using (fold) where role = 'validation'""",
    "vectors",
    "newton",
)
_SHOWN = {"base_rate": "base_probability", **{m: m.replace("_logistic", "_probability") for m in LOGISTIC_MODELS}}
ask(
    "m05_logistic_predictions",
    f"""select symbol, market_date, fold, any_value(actual_up) as actual_up, round(any_value(forward_return_5), 4) + 0.0 as forward_return_5,
    {", ".join(f"round(any_value(probability) filter (model = '{m}'), 4) + 0.0 as {c}" for m, c in _SHOWN.items())} from logistic_preds group by 1, 2, 3""",
    "logistic_preds",
)
_METRICS = ("validation_up_rate", "brier_score", "log_loss", "accuracy", "balanced_accuracy", "roc_auc")
ask(
    "m07_logistic_walk_forward",
    f"""select fold, model, validation_rows, {fl(*_METRICS, digits=4)}, train_rows, round(train_up_rate, 4) + 0.0 as train_up_rate
    from ({_CLASS.replace("from preds)", "from logistic_preds)")}) join (select fold, count(*) as train_rows, avg(up) as train_up_rate from vectors where role = 'train' group by 1) using (fold)""",
    "logistic_preds",
    "vectors",
)
ask(
    "m08_model_quintiles",
    f"""select model, probability_bucket, count(*) as observations, {", ".join(f"round({e}, 4) + 0.0 as {c}" for c, e in (
        ("mean_predicted_probability", "avg(probability)"), ("actual_positive_rate", "avg(actual_up)"),
        ("mean_forward_return_5", "avg(forward_return_5)"), ("median_forward_return_5", "median(forward_return_5)")))}
    from ({_quintiles("model").replace("from preds", "from logistic_preds")}) group by 1, 2""",
    "logistic_preds",
)
_INFLATED = ["return_5d", "rsi_14", "volatility_20d", "relative_volume", "distance_from_20d_high", "yield_10y", "yield_30y", "curve_10y_2y_bp"]
ask(
    "e12_variance_inflation",
    f"""select {_INFLATED}[i] as feature, round(m[i][{len(_INFLATED)} + i], 6) + 0.0 as vif from (
    select {_eliminated("m", str(len(_INFLATED)))} as m from (select list(r order by i) as m from (
    select i, list(c order by j) as r from (
    select i, j, corr(v[i], v[j]) as c from (select [{", ".join(f"{f}::double" for f in _INFLATED)}] as v from panel_feat where {" and ".join(f"{f} is not null" for f in _INFLATED)}),
    range(1, {len(_INFLATED) + 1}) a(i), range(1, {len(_INFLATED) + 1}) b(j) group by 1, 2
    union all select i, {len(_INFLATED)} + j, case when i = j then 1.0 else 0.0 end from range(1, {len(_INFLATED) + 1}) a(i), range(1, {len(_INFLATED) + 1}) b(j))
    group by 1))), range(1, {len(_INFLATED) + 1}) a(i)""",
    "panel_feat",
)
# three columns: 1 / (1 - R2) with R2 from the three correlations
ask(
    "e12_variance_inflation_yields",
    """select feature, round(1 / (1 - (a * a + b * b - 2 * a * b * c) / (1 - c * c)), 6) + 0.0 as vif from (
    select 'yield_2y' as feature, corr(yield_2y, yield_10y) as a, corr(yield_2y, yield_30y) as b, corr(yield_10y, yield_30y) as c from curve
    union all select 'yield_10y', corr(yield_2y, yield_10y), corr(yield_10y, yield_30y), corr(yield_2y, yield_30y) from curve
    union all select 'yield_30y', corr(yield_2y, yield_30y), corr(yield_10y, yield_30y), corr(yield_2y, yield_10y) from curve)""",
    "curve",
)
ask("e10_train_only_scaling", f"select fold, feature, {fl('median', 'mean', 'deviation')} from scaling", "scaling")
ask(
    "e11_inversion_spells",
    """select min(curve_date) as first_date, max(curve_date) as last_date, count(*) as observations, round(min(x), 6) + 0.0 as deepest, round(avg(x), 6) + 0.0 as mean_spread
    from (select curve_date, x, row_number() over (order by curve_date) - row_number() over (partition by x < 0 order by curve_date) as g
    from (select curve_date, curve_slope_30y_3m_bp as x from curve_feat)) where x < 0 group by g""",
    "curve_feat",
)
ask(
    "e11_spread_percentile",
    f"""with s as (select curve_date, round(curve_10y_2y_bp, 6) as x, row_number() over (order by curve_date) as n from ({sql("select * from curve_feat", "curve_feat")}))
    select a.curve_date, a.x + 0.0 as curve_10y_2y_bp, round(case when a.n >= 52 then (select count(*) from s b where b.n between a.n - 51 and a.n and b.x <= a.x) / 52.0::double end, 6) as curve_10y_2y_bp_percentile from s a""",
)
ask(
    "e11_growth_rates",
    """select a.series_name, a.reference_date, round(a.value, 6) + 0.0 as value, round(a.value / nullif(y.value, 0) - 1, 6) + 0.0 as yoy,
    round(power(a.value / nullif(q.value, 0), 4) - 1, 6) + 0.0 as annualized_3m from obs a
    left join obs y on y.series_name = a.series_name and y.reference_date = a.reference_date - interval 12 months
    left join obs q on q.series_name = a.series_name and q.reference_date = a.reference_date - interval 3 months""",
    "obs",
)
_LEGS = {"nominal_5y": ("view", 2), "real_5y": ("click", 1), "nominal_10y": ("signup", 2), "real_10y": ("purchase", 1)}
ask(
    "e11_inflation_compensation",
    "with daily as (select event_type, cast(ts as date) as day, arg_max(value, (ts, event_id)) / 100 as v from events where value > 200 group by 1, 2), "
    "days as (select distinct cast(ts as date) as market_date from events), "
    "legs as (select d.market_date, "
    + ", ".join(f"case when d.market_date - {leg}.day <= {limit} then {leg}.v end as {leg}" for leg, (_, limit) in _LEGS.items())
    + " from days d "
    + " ".join(f"asof left join (select * from daily where event_type = '{of}') {leg} on d.market_date >= {leg}.day" for leg, (of, _) in _LEGS.items())
    + """), c as (select *, nominal_5y - real_5y as c5, nominal_10y - real_10y as c10 from legs)
    select market_date, round(nominal_5y, 6) + 0.0 as nominal_5y, round(real_5y, 6) + 0.0 as real_5y, round(nominal_10y, 6) + 0.0 as nominal_10y, round(real_10y, 6) + 0.0 as real_10y,
    round(c5, 6) + 0.0 as inflation_compensation_5y, round(c10, 6) + 0.0 as inflation_compensation_10y,
    round(100 * (power(1 + c10 / 100, 2) / (1 + c5 / 100) - 1), 6) + 0.0 as forward_5y5y,
    round(100 * (c5 - lag(c5, 5) over (order by market_date)), 6) + 0.0 as inflation_compensation_5y_change_5d_bp,
    round(100 * (c10 - lag(c10, 5) over (order by market_date)), 6) + 0.0 as inflation_compensation_10y_change_5d_bp from c""",
)
ask(
    "e13_quintile_spread",
    f"""select model, round(avg(forward_return_5) filter (probability_bucket = 'Q5_highest') - avg(forward_return_5) filter (probability_bucket = 'Q1_lowest'), 6) + 0.0 as q5_minus_q1
    from ({_quintiles("model")}) group by 1""",
    "preds",
)
ask(
    "e13_strong_forecasts",
    """select model, count(*) filter (p > sd) as strong_forecasts, round(avg(case when forward_return_5 > 0 then 1.0::double else 0 end) filter (p > sd), 6) + 0.0 as hit_rate
    from (select *, probability - 0.5 as p, stddev_samp(probability - 0.5) over (partition by model) as sd from preds) group by 1""",
    "preds",
)
ask(
    "e14_forecast_outcomes",
    """select symbol, target_date, market_date as origin_date, close as origin_close, 0.01::double as forecast_return, next_close as realized_close,
    round(next_close / nullif(close, 0) - 1, 6) + 0.0 as realized_return, round(next_close / nullif(close, 0) - 1 - 0.01::double, 6) + 0.0 as forecast_error
    from (select *, lead(market_date, 5) over w as target_date, lead(close, 5) over w as next_close from bars window w as (partition by symbol order by market_date))""",
    "bars",
)

# ------------------------------------------------- scans and reconciliation

ask(
    "s03_raw_observations",
    "select cast(o_orderdate as date) as reference_date, count(o_totalprice) as observations, "
    "round(max(o_totalprice::double), 6) + 0.0 as greatest from orders group by 1",
)
ask(
    "v15_reconciled_copies",
    """with known as (select l_orderkey, l_linenumber, l_quantity,
        case when l_orderkey % 71 <> 0 and l_orderkey % 73 <> 0 then l_returnflag end as l_returnflag from lineitem),
    faulty as (select l_orderkey, l_linenumber, case when l_orderkey % 79 = 0 then l_quantity + 1 else l_quantity end as l_quantity,
        case when l_orderkey % 73 <> 0 then l_returnflag end as l_returnflag
        from lineitem, (values (1), (2)) as copy(nth)
        where nth <= case when l_orderkey % 97 = 0 or (l_orderkey % 89 = 0 and l_linenumber = 1) then 0
            when l_orderkey % 83 = 0 and l_linenumber = 2 then 2 else 1 end),
    met as (select l_orderkey, l_linenumber, l_quantity, l_returnflag, sum(a) as a, sum(b) as b
        from (select *, 1 as a, 0 as b from known union all select *, 0, 1 from faulty) group by 1, 2, 3, 4),
    sums as (select l_orderkey, sum(a)::bigint as left_rows, sum(b)::bigint as right_rows, max(case when a <> b then 1 else 0 end) as other
        from met group by 1)
    select l_orderkey, left_rows, right_rows, case when right_rows = 0 then 'missing_right' when left_rows = 0 then 'missing_left'
        when left_rows <> right_rows then 'row_count' else 'values' end as difference from sums where other = 1""",
)
ask(
    "v15_coverage_disagreements",
    """select series_name, count(value) as non_null_observations, count(*) filter (value is not null and release_date is not null) as matched_release_events,
    count(*) filter (value is not null and release_date is null) as unmatched_observations, 0::bigint as detail_rows
    from obs left join part_cal using (series_name, reference_date) where series_name like '1%' group by 1
    having count(*) filter (value is not null and release_date is null) > 0""",
    "obs",
    "part_cal",
)

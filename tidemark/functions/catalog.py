"""Names shared across operators: feature sets, maturities, series registry."""

from __future__ import annotations

# Forward-return horizons, in rows.
HORIZONS = (1, 3, 5, 10, 20)

# Published series id of each maturity and its term in years.
CURVE_SERIES = {
    "3m": ("DGS3MO", 0.25),
    "6m": ("DGS6MO", 0.5),
    "1y": ("DGS1", 1.0),
    "2y": ("DGS2", 2.0),
    "3y": ("DGS3", 3.0),
    "5y": ("DGS5", 5.0),
    "7y": ("DGS7", 7.0),
    "10y": ("DGS10", 10.0),
    "20y": ("DGS20", 20.0),
    "30y": ("DGS30", 30.0),
}
MATURITIES = tuple(CURVE_SERIES)
YIELDS = tuple(f"yield_{m}" for m in MATURITIES)
TERMS = tuple(term for _, term in CURVE_SERIES.values())

# Fixed value: Nelson-Siegel decay, 0.0609 per month on a grid in years.
NELSON_SIEGEL_DECAY = 0.0609 * 12.0

CURVE_STEPS = (1, 5, 20)

# Model and research feature sets.
TECHNICAL_FEATURES = (
    "return_1d", "return_3d", "return_5d", "return_10d", "ema_spread_pct", "close_vs_ema9",
    "close_vs_ema21", "rsi_14", "momentum_5d_pct", "momentum_10d_pct", "volatility_5d",
    "volatility_20d", "range_pct", "relative_volume", "log_volume", "distance_from_20d_high",
    "distance_from_20d_low",
)
RESEARCH_TECHNICAL_FEATURES = (
    "return_1d", "return_3d", "return_5d", "return_10d", "ema_spread_pct", "close_vs_ema9",
    "close_vs_ema21", "rsi_14", "rsi_centered", "momentum_5d_pct", "momentum_10d_pct",
    "volatility_5d", "volatility_20d", "range_pct", "relative_volume", "log_volume",
    "distance_from_20d_high", "distance_from_20d_low",
)
_KEY_MATURITIES = ("2y", "5y", "10y", "30y")
_SLOPES = ("curve_10y_2y_bp", "curve_30y_2y_bp", "curve_30y_5y_bp", "curve_30y_10y_bp")
TREASURY_FEATURES = (
    tuple(f"yield_{m}" for m in _KEY_MATURITIES)
    + tuple(f"change_{m}_{k}d_bp" for k in CURVE_STEPS for m in _KEY_MATURITIES)
    + _SLOPES
    + tuple(f"{s}_change_5d" for s in _SLOPES)
    + ("yield_10y_volatility_20d", "yield_30y_volatility_20d")
)
SELECTED_TECHNICAL = (
    "return_5d", "rsi_14", "volatility_20d", "relative_volume", "distance_from_20d_high",
)
SELECTED_TREASURY = (
    "yield_10y", "yield_30y", "change_2y_5d_bp", "change_30y_5d_bp", "curve_10y_2y_bp",
    "curve_30y_2y_bp", "yield_30y_volatility_20d", "bear_flattening",
)
CURVE_FACTORS = ("curve_level", "curve_slope_30y_3m_bp", "curve_curvature_5y_bp")
CURVE_FACTOR_FEATURES = (
    CURVE_FACTORS
    + ("curve_level_change_5d_bp", "curve_slope_change_5d_bp", "curve_curvature_change_5d_bp")
    + ("curve_level_volatility_20d", "curve_slope_volatility_20d", "curve_curvature_volatility_20d")
)
NS_FACTORS = ("ns_beta0_level", "ns_beta1_slope", "ns_beta2_curvature")
NS_FEATURES = (
    NS_FACTORS
    + tuple(f"{f}_change_5d_bp" for f in NS_FACTORS)
    + tuple(f"{f}_volatility_20d" for f in NS_FACTORS)
)
RIDGE_MODELS = {
    "technical_ridge": TECHNICAL_FEATURES,
    "treasury_ridge": TREASURY_FEATURES,
    "combined_ridge": TECHNICAL_FEATURES + TREASURY_FEATURES,
    "selected_technical_ridge": SELECTED_TECHNICAL,
    "selected_treasury_ridge": SELECTED_TREASURY,
    "selected_combined_ridge": SELECTED_TECHNICAL + SELECTED_TREASURY,
}
LOGISTIC_MODELS = {
    "technical_logistic": SELECTED_TECHNICAL,
    "treasury_logistic": SELECTED_TREASURY,
    "combined_logistic": SELECTED_TECHNICAL + SELECTED_TREASURY,
    "v2a_curve_logistic": CURVE_FACTOR_FEATURES,
    "technical_v2a_curve_logistic": SELECTED_TECHNICAL + CURVE_FACTOR_FEATURES,
    "v2b_nelson_siegel_logistic": NS_FEATURES,
    "technical_v2b_nelson_siegel_logistic": SELECTED_TECHNICAL + NS_FEATURES,
}
PAYROLL_FEATURES = (
    "payroll_change_1m", "payroll_change_z", "payroll_revision_1m", "payroll_revision_2m",
    "payroll_revision_total", "payroll_revision_z", "days_since_payroll_release",
)
PAYROLL_CANDIDATES = {
    "PAYEMS-A": ("payroll_change_1m", "payroll_revision_total", "payroll_broad_revision_event"),
    "PAYEMS-B": ("payroll_change_1m", "payroll_revision_2m", "payroll_broad_revision_event"),
}
PAYROLL_RESEARCH_ONLY = (
    "payroll_change_z", "payroll_revision_z", "payroll_revision_1m", "payroll_revised_periods",
    "payroll_initial_periods", "days_since_payroll_release", "payroll_release_day",
)
VALIDATION_YEARS = (2023, 2024, 2025)
LOCKED_YEAR = 2026

# Employment report series, those of its establishment survey,
# and the one documented late release.
EMPLOYMENT_SERIES = (
    "nonfarm_payrolls", "unemployment_rate", "u6_unemployment_rate", "labor_force_participation",
    "part_time_economic_reasons", "average_weekly_hours", "average_hourly_earnings",
)
ESTABLISHMENT_SERIES = ("nonfarm_payrolls", "average_weekly_hours", "average_hourly_earnings")
LATE_RELEASE = ("2025-10-01", "2025-12-16", "08:30", "America/New_York")

# Registry of macro series
# (name, id, title, category, frequency, units).
_SERIES = (
    ("nonfarm_payrolls", "PAYEMS", "Total Nonfarm Payroll Employment", "labor_demand", "monthly", "thousands_of_persons"),
    ("job_openings", "JTSJOL", "Total Nonfarm Job Openings", "labor_demand", "monthly", "thousands"),
    ("job_openings_rate", "JTSJOR", "Total Nonfarm Job Openings Rate", "labor_demand", "monthly", "percent"),
    ("unemployment_rate", "UNRATE", "Civilian Unemployment Rate", "labor_slack", "monthly", "percent"),
    ("u6_unemployment_rate", "U6RATE", "U-6 Unemployment Rate", "labor_slack", "monthly", "percent"),
    ("quits_rate", "JTSQUR", "Total Nonfarm Quits Rate", "labor_tightness", "monthly", "percent"),
    ("labor_force_participation", "CIVPART", "Labor Force Participation Rate", "labor_supply", "monthly", "percent"),
    ("part_time_economic_reasons", "LNS12032194", "Employed Part Time for Economic Reasons", "labor_slack", "monthly", "thousands_of_persons"),
    ("average_weekly_hours", "AWHAETP", "Average Weekly Hours of All Employees", "labor_hours", "monthly", "hours"),
    ("average_hourly_earnings", "CES0500000003", "Average Hourly Earnings of All Employees", "wages", "monthly", "dollars_per_hour"),
    ("employment_cost_index", "ECIWAG", "Employment Cost Index: Wages and Salaries", "wages", "quarterly", "index"),
    ("retail_sales", "RSAFS", "Advance Retail Sales: Retail and Food Services", "consumer_growth", "monthly", "millions_of_dollars"),
    ("industrial_production", "INDPRO", "Industrial Production Index", "growth", "monthly", "index"),
    ("cpi", "CPIAUCSL", "Consumer Price Index", "inflation", "monthly", "index"),
    ("core_cpi", "CPILFESL", "Core Consumer Price Index", "inflation", "monthly", "index"),
    ("pce_price_index", "PCEPI", "PCE Price Index", "inflation", "monthly", "index"),
    ("core_pce_price_index", "PCEPILFE", "Core PCE Price Index", "inflation", "monthly", "index"),
    ("breakeven_5y", "T5YIE", "5-Year Breakeven Inflation Rate", "inflation_compensation", "daily", "percent"),
    ("breakeven_10y", "T10YIE", "10-Year Breakeven Inflation Rate", "inflation_compensation", "daily", "percent"),
    ("forward_inflation_5y5y", "T5YIFR", "5-Year, 5-Year Forward Inflation Expectation Rate", "inflation_compensation", "daily", "percent"),
    ("real_yield_5y", "DFII5", "5-Year Treasury Inflation-Indexed Yield", "real_rates", "daily", "percent"),
    ("real_yield_10y", "DFII10", "10-Year Treasury Inflation-Indexed Yield", "real_rates", "daily", "percent"),
    ("real_yield_20y", "DFII20", "20-Year Treasury Inflation-Indexed Yield", "real_rates", "daily", "percent"),
    ("real_yield_30y", "DFII30", "30-Year Treasury Inflation-Indexed Yield", "real_rates", "daily", "percent"),
)


def series_registry() -> list[dict]:
    """Registry rows; market-observed (daily) series need no release handling."""
    return [
        {
            "series_name": name,
            "series_id": series_id,
            "name": title,
            "category": category,
            "source": "FRED",
            "frequency": frequency,
            "units": units,
            "transformation": "level",
            "requires_release_alignment": frequency != "daily",
            "requires_vintage_tracking": frequency != "daily",
        }
        for name, series_id, title, category, frequency, units in _SERIES
    ]


def requires_release_alignment(series_name: str) -> bool:
    for row in series_registry():
        if row["series_name"] == series_name:
            return row["requires_release_alignment"]
    raise ValueError(f"unknown macro series: {series_name}")

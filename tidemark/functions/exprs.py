"""Column expressions shared by the operators. Missing evidence gives null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Tolerance of comparisons, index coverage and the neutral bands.
TOLERANCE = 1e-12
NEUTRAL_BAND, TREND_BAND = 0.10, 0.5
FAIR_WEIGHTS = {"vwap": 0.5, "median": 0.3, "last5": 0.2}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """A finite double, or null for anything that cannot be read as one."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def positive_finite(c: Column | str) -> Column:
    """A finite double above zero, or null."""
    x = number(c)
    return F.when(x > 0, x)


def unit_price(money: Column | str, quantity: Column | str) -> Column:
    return F.when(col(quantity) > 0, col(money) / col(quantity))


def close_to(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(TOLERANCE * F.greatest(F.abs(a), F.abs(b)), F.lit(TOLERANCE))


def strictly_greater(a: Column, b: Column) -> Column:
    return (a > b) & ~close_to(a, b)


def strictly_less(a: Column, b: Column) -> Column:
    return (a < b) & ~close_to(a, b)


def at_least(a: Column, b: Column) -> Column:
    return (a >= b) | close_to(a, b)


def in_window(ts: Column | str, start: Column, end: Column) -> Column:
    """Half-open, to the microsecond."""
    return (col(ts) >= start) & (col(ts) < end)


def change_pct(new: Column | str, old: Column | str) -> Column:
    return F.when(col(old) > 0, (col(new) - col(old)) / col(old) * 100)


def price_gap_pct(price: Column | str, fair: Column | str) -> Column:
    p, f = positive_finite(price), positive_finite(fair)
    return (p / f - 1) * 100


def mid_price(bid: Column | str, ask: Column | str) -> Column:
    return (col(bid) + col(ask)) / 2


def imbalance_pct(bid_depth: Column | str, ask_depth: Column | str) -> Column:
    total = col(bid_depth) + col(ask_depth)
    return F.when(total > 0, (col(bid_depth) - col(ask_depth)) / total * 100)


def liquidity(depth: Column | str, spread_pct: Column | str) -> Column:
    spread = F.greatest(F.coalesce(col(spread_pct), F.lit(0.5)), F.lit(0.5))
    return F.when(col(depth) > 0, col(depth) / (1 + spread / 100)).otherwise(F.lit(0.0))


def range_position_pct(last: Column | str, low: Column | str, high: Column | str) -> Column:
    last, low, high = number(last), number(low), number(high)
    return F.when((high > low) & last.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), (last - low) / (high - low) * 100)))


def rail_position(value: Column, lower: Column, upper: Column, scale: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 + (value - (lower + upper) / 2) / scale * 60))


def inflation_class(change: Column | str, band: float = NEUTRAL_BAND) -> Column:
    c = number(change)
    return F.when(c.isNull(), "Insufficient data").when(c > band, "Inflation").when(c < -band, "Deflation").otherwise("Stable")


def purchasing_power_pct(change: Column | str) -> Column:
    c = number(change)
    return F.when(c > -100, (1 / (1 + c / 100) - 1) * 100)


def annualized_pct(change: Column | str, days: float) -> Column:
    c = number(change)
    return F.when(c > -100, (F.pow(1 + c / 100, F.lit(365.0 / days)) - 1) * 100)


def pressure_label(pct: Column | str, band: float = 5.0) -> Column:
    p = col(pct)
    return F.when(p.isNull(), "—").when(p > band, "Buy-heavy").when(p < -band, "Sell-heavy").otherwise("Balanced")


def position_label(pct: Column | str) -> Column:
    p = col(pct)
    return F.when(p.isNull(), "N/A").when(p <= 33, "Near floor").when(p <= 66, "Middle").otherwise("Near ceiling")


def change_arrow(pct: Column | str, band: float = TREND_BAND) -> Column:
    p = col(pct)
    return F.when(p.isNull(), "N/A").when(p > band, "▲").when(p < -band, "▼").otherwise("●")


def category_text(code: Column | str, stats: Column | str) -> Column:
    """A category in words: its code and its sorted stats, unknown if there are none on record."""
    entries = F.array_sort(F.map_entries(col(stats)))
    known = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    text = F.when(col(stats).isNull(), "unknown").when(F.size(col(stats)) == 0, "none").otherwise(known)
    return F.concat(col(code), F.lit("; stats: "), text)


def equipment_category(code: Column | str, item: Column | str, stats: Column | str, state: Column | str, max_state: Column | str) -> Column:
    """What equipment is alike: kind, code, sorted stats and condition; maps cannot be grouped."""
    return F.struct(F.lit("equipment-v1").alias("kind"), F.coalesce(col(code), col(item)).alias("code"), F.array_sort(F.map_entries(col(stats))).alias("stats"), col(state).alias("state"), col(max_state).alias("max_state"))


def settlement(money: Column | str, verified: Column | str, role: Column | str, fee: Column | str, side: str) -> Column:
    """Struct (gross, net) by verified evidence only; an amount below zero is unknown."""
    known = lambda x: F.when(x >= 0, x)
    m, f, sign = known(number(money)), known(number(fee)), 1 if side == "buy" else -1
    gross = F.when(col(role) == "gross", m).when(col(role) == "settled", known(m - sign * f))
    net = F.when(col(role) == "settled", m).when(col(role) == "gross", known(m + sign * f))
    return F.struct(F.when(col(verified), gross).alias("gross"), F.when(col(verified), net).alias("net"))


def fee_known(verified: Column | str, role: Column | str, fee: Column | str) -> Column:
    """Whether fees are known: in a settled amount they are included, beside a gross one they must be given."""
    f = number(fee)
    return F.coalesce(col(verified) & ((col(role) == "settled") | ((col(role) == "gross") & (f >= 0))), F.lit(False))


#: Production points of an item with all that goes into it.
UPSTREAM_POINTS = {
    "grain": 1.0, "limestone": 1.0, "lead": 1.0, "petroleum": 1.0, "mysteriousplant": 1.0, "coca": 1.0, "iron": 1.0, "wood": 1.0,
    "livestock": 20.0, "fish": 40.0, "steel": 20.0, "concrete": 20.0, "oil": 2.0, "paper": 2.0, "bread": 20.0, "steak": 40.0, "cookedfish": 80.0,
    "lightammo": 2.0, "ammo": 8.0, "heavyammo": 32.0, "pill": 400.0, "cocain": 400.0, "cocaine": 400.0,
}


def production_points(code: Column | str, table: dict[str, float] = UPSTREAM_POINTS, name: Column | str | None = None) -> Column:
    """Points of an item by its code in lower-case letters and digits, or else by its name."""
    points = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))))
    at = lambda c: F.try_element_at(points, F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", ""))
    return at(code) if name is None else F.coalesce(at(code), at(name))


def passive_limit(bid: Column | str, ask: Column | str, tick: Column | float) -> Column:
    bid, ask = positive_finite(bid), positive_finite(ask)
    tick = F.lit(tick) if isinstance(tick, float) else tick
    better = bid + tick
    near = F.abs(better - ask) <= 1e-9 * F.greatest(F.abs(better), F.abs(ask))
    return F.when((bid < ask) & (tick >= 0), F.when((better < ask) & ~near, better).otherwise(bid))


def stable_fair(vwap: Column | str, median: Column | str, last5: Column | str) -> Column:
    """Weighted mean of the measures that are there, weights renormalized."""
    parts = [(col(c), w) for c, w in zip((vwap, median, last5), FAIR_WEIGHTS.values(), strict=True)]
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def labels(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.filter(F.array(*(F.when(cond, name) for cond, name in pairs)), lambda x: x.isNotNull())


def tendency_labels(open_: str, close: str, low: str, high: str, average: str, rolling: str, trades: str, volume: str, stable_range: str, spread_pct: Column | str | None = None) -> Column:
    o, c, r = col(open_), col(close), F.coalesce(F.when(col(rolling) != 0, col(rolling)), col(average))
    n, v = F.coalesce(col(trades), F.lit(0)), F.coalesce(col(volume), F.lit(0.0))
    width = F.coalesce(col(stable_range), F.when(col(average) > 0, (col(high) - col(low)) / col(average) * 100))
    change = F.when(o > 0, (c - o) / o * 100)
    spread_ok = F.lit(True) if spread_pct is None else F.coalesce(col(spread_pct) <= 3, F.lit(True))
    found = labels(
        ((n < 3) | (v <= 0), "Thin"),
        ((change >= 2) & (c >= r), "Rising"),
        ((change <= -2) & (c <= r), "Falling"),
        (width >= 12, "Volatile"),
        (width <= 3, "Range-bound"),
        ((width <= 3) & (n >= 3) & (v > 0) & spread_ok, "Stable"),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Stable")))


def trend_pattern(d1: Column | str, d7: Column | str, d30: Column | str, band: float = TREND_BAND) -> Column:
    """Persistence or reversal over three horizons; null horizons are left out."""
    way = lambda c: F.when(number(c) > band, 1).when(number(c) < -band, -1).when(number(c).isNotNull(), 0)
    ways = [way(d1), way(d7), way(d30)]
    count = lambda v, some: sum((F.coalesce((w == v).cast("int"), F.lit(0)) for w in some), F.lit(0))
    usable = sum((w.isNotNull().cast("int") for w in ways), F.lit(0))
    ups, downs, flats = (count(v, ways) for v in (1, -1, 0))
    return (
        F.when(usable < 2, "Insufficient history").when(flats == usable, "Flat")
        .when((ups >= 2) & (downs == 0), "Persistent rise").when((downs >= 2) & (ups == 0), "Persistent fall")
        .when((ways[0] == 1) & (count(-1, ways[1:]) > 0) & (count(1, ways[1:]) == 0), "Rebound")
        .when((ways[0] == -1) & (count(1, ways[1:]) > 0) & (count(-1, ways[1:]) == 0), "Pullback").otherwise("Mixed")
    )


def direction_score(momentum: Column | str, fair_gap: Column | str) -> Column:
    m, g = number(momentum), number(fair_gap)
    by_momentum = F.when(m >= 6, 2).when(m >= 1, 1).when(m <= -6, -2).when(m <= -1, -1).otherwise(0)
    return by_momentum + F.when(g <= -2, 1).when(g >= 2, -1).otherwise(0)


def direction_signal(score: Column | str) -> Column:
    return F.when(col(score) >= 1, "Up").when(col(score) <= -1, "Down").otherwise("No clear move")


def direction_reasons(momentum: Column | str, fair_gap: Column | str) -> Column:
    m, g = number(momentum), number(fair_gap)
    return labels(
        (m >= 6, "strong_positive_momentum"), ((m >= 1) & (m < 6), "positive_momentum"),
        (m <= -6, "strong_negative_momentum"), ((m <= -1) & (m > -6), "negative_momentum"),
        (g <= -2, "below_fair"), (g >= 2, "above_fair"),
    )


def bid_outcome(current: Column | str, future: Column | str, tick: float = 0.001) -> Column:
    delta = col(future) - col(current)
    t = F.lit(tick)
    return F.when(strictly_greater(delta, t), "Up").when(strictly_less(delta, -t), "Down").when(delta.isNotNull(), "Flat")


def evidence_label(samples: Column | str, accuracy: Column | str, baseline: Column | str, least: int = 30) -> Column:
    edge = col(accuracy) - col(baseline)
    return F.when(col(samples) < least, "Insufficient").when(edge.isNull() | (edge <= 0), "Weak").when(edge < 5, "Limited").otherwise("Supported")


def evidence_rank(evidence: Column | str, accuracy: Column | str, baseline: Column | str, samples: Column | str) -> Column:
    """What forecasts are ordered by: evidence, edge over the baseline, samples; higher is better."""
    names = ["Insufficient", "Weak", "Limited", "Supported"]
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, names)), col(evidence)) - 1, F.lit(-1))
    edge = F.coalesce(number(accuracy) - number(baseline), F.lit(float("-inf")))
    return F.struct(rank.alias("evidence"), edge.alias("edge"), F.coalesce(number(samples), F.lit(0.0)).alias("samples"))


def spreadsheet_safe(c: Column | str) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(col(c).rlike(r"^[\t\r\n]|^\s*[=+\-@]"), F.concat(F.lit("'"), col(c))).otherwise(col(c))


def display_name(code: Column | str, known: list[str] | None = None) -> Column:
    """A code in camel case, dashes or underlines as title words; of ``known`` codes only, if given."""
    words = F.initcap(F.translate(F.regexp_replace(col(code), "(?<!^)(?=[A-Z])", " "), "_-", "  "))
    return words if known is None else F.when(col(code).isin(known), words).otherwise(col(code))


def commodity(transaction_type: Column | str = "transaction_type") -> Column:
    return col(transaction_type) == "trading"


def quote_gap_pct(last: Column | str, quote: Column | str) -> Column:
    return F.when(col(last) != 0, (col(quote) - col(last)) / col(last) * 100)


def complete_midnight(ts: Column | str) -> Column:
    """The last UTC midnight that is not after a time."""
    return F.date_trunc("DAY", col(ts))


#: Rules that SQL texts may use too, by name: parameters and body.
SQL_FUNCTIONS = {
    "positive_finite": ("x DOUBLE", "DOUBLE", "CASE WHEN x > 0 AND x < double('infinity') AND NOT isnan(x) THEN x END"),
    "close_to": ("a DOUBLE, b DOUBLE", "BOOLEAN", f"abs(a - b) <= greatest({TOLERANCE} * greatest(abs(a), abs(b)), {TOLERANCE})"),
    "price_gap_pct": ("price DOUBLE, fair DOUBLE", "DOUBLE", "CASE WHEN price > 0 AND fair > 0 THEN (price / fair - 1) * 100 END"),
    "inflation_class": ("change DOUBLE", "STRING", f"CASE WHEN change IS NULL OR isnan(change) THEN 'Insufficient data' WHEN change > {NEUTRAL_BAND} THEN 'Inflation' WHEN change < -{NEUTRAL_BAND} THEN 'Deflation' ELSE 'Stable' END"),
}


def register(spark: SparkSession, prefix: str = "market_") -> list[str]:
    """Make the rules callable from SQL texts of this session; they are inlined, so nothing leaves the engine."""
    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {returns} RETURN {body}")
    return [prefix + name for name in SQL_FUNCTIONS]


def latest_by(columns: list[str], order: list[str]) -> Column:
    """The struct of columns from the row that is last in a total order."""
    return F.max_by(F.struct(*columns), F.struct(*order))

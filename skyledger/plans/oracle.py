"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Written from the definitions of the operators, not from their Spark plans:
plain joins, built-in quantiles, closed-form t probabilities.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

from .published import MEASURES, PUBLISHED_TRENDS

# Fixed values, stated apart from the engine's so that a slip in one of them shows.
COMPLETE_ROWS = 4
FIRST_YEAR, LAST_YEAR = 1994, 2022
HIGH_SD, EVENT_SD = 4.0, 8.0
MEAN_DIGITS = 9
KDE_POINTS, KDE_CUT, BANDWIDTH_FACTOR, IQR_PER_SD = 512, 4.0, 0.9, 1.34
BAD_POSITIONS = [(1, 1), (3, 3), (17, 250), (251, 260), (700, 705), (4000, 9000), (99000, 1000000000000)]
BAD_TIMES = [
    ("click", "2024-01-03 05:00:00", "2024-01-03 07:30:00"),
    ("view", "2024-01-10 22:00:00", "2024-01-12 03:00:00"),
    ("error", "2024-01-20 00:00:00", "2024-01-20 00:00:00"),
]


class Model(NamedTuple):
    """Response, terms, Normal priors (mean, sd; None: flat), rate of sigma's prior; centred: intercept at the means."""

    response: str
    terms: tuple[str, ...]
    intercept: tuple[float, float]
    slopes: tuple
    sigma_rate: float
    centred: bool = False


_T, _W, _D = ("t_2m", "t_2m^2"), ("wind_spd", "wind_spd^2"), ("t_difference", "t_difference^2")
MODELS = {
    "gust_t": Model("gust_time", _T, (5, 5), ((0, 1), (0, 1)), 0.05),
    "gust_w": Model("gust_time", _W, (5, 5), ((0, 1), (0, 1)), 0.05),
    "gust_t_formula": Model("gust_time", _T, (5, 5), ((0, 1), None), 0.05, True),
    "gust_w_formula": Model("gust_time", _W, (5, 5), ((0, 1), None), 0.05, True),
    "gust_d_formula": Model("gust_time", _D, (5, 5), ((0, 1), None), 0.05, True),
    "sd_t": Model("wind_sd", _T, (5, 5), ((0, 1), (0, 1)), 0.05),
    "sd_t_tight": Model("wind_sd", _T, (0.5, 2), ((0, 0.1), (0, 0.1)), 1.0),
    "sd_t_mid": Model("wind_sd", _T, (1, 1), ((0, 0.3), (0, 0.3)), 1.0),
    "sd_t_wide": Model("wind_sd", _T, (5, 5), ((0, 0.3), (0, 0.3)), 1.0),
    "sd_w": Model("wind_sd", _W, (5, 5), ((0, 1), (0, 1)), 0.05),
    "sd_w_tight": Model("wind_sd", _W, (5, 5), ((0, 0.3), (0, 0.3)), 1.0),
    "sd_multi": Model("wind_sd", ("wind_spd", "t_2m"), (0.5, 0.5), ((0, 0.02), (0, 0.05)), 1.0),
    "sd_multi_ri": Model("wind_sd", ("wind_spd", "t_2m", "richardson_bulk"), (0.5, 0.5), ((0, 0.02), (0, 0.05), (0, 0.04)), 1.0),
    "sd_t_formula": Model("wind_sd", _T, (5, 5), ((0, 1), None), 0.05, True),
    "sd_w_formula": Model("wind_sd", _W, (5, 5), ((0, 1), None), 0.05, True),
    "sd_d_formula": Model("wind_sd", _D, (5, 5), ((0, 1), None), 0.05, True),
}
TWO_TERM_MODELS = [name for name, model in MODELS.items() if len(model.terms) == 2]

KEYS = "site, year, month, day, hour"


def _calendar(key: str) -> str:
    return f"""
        'S' || CAST({key} % 3 + 3 * ({key} // 3 // 233856) + 1 AS VARCHAR) AS site,
        CAST(1994 + {key} // 3 % 29 AS INTEGER) AS year,
        CAST({key} // 3 // 29 % 12 + 1 AS INTEGER) AS month,
        CAST({key} // 3 // 8352 % 28 + 1 AS INTEGER) AS day,
        CAST({key} // 3 // 348 % 24 AS INTEGER) AS hour"""


def _temperature(amount: str) -> str:
    return f"((CAST(floor({amount}) AS BIGINT) % 719 - 490) / 10::DOUBLE)"


_HOURS = f"""hours AS (
    SELECT {_calendar('o_orderkey')},
        CASE WHEN o_custkey % 31 = 0 THEN -99 ELSE o_custkey % 360 END::DOUBLE AS wind_dir,
        (o_orderkey % 200) / 10::DOUBLE AS wind_spd,
        CASE WHEN o_custkey % 13 = 0 THEN -9 ELSE o_custkey % 100 END::DOUBLE AS wind_stead,
        (990 + o_custkey % 40)::DOUBLE AS p,
        {_temperature('o_totalprice')} AS t_2m,
        {_temperature('o_totalprice')} + (o_custkey % 41 - 20) / 10::DOUBLE AS t_10m,
        CASE WHEN o_custkey % 17 = 0 THEN -99::DOUBLE ELSE {_temperature('o_totalprice')} + 0.5::DOUBLE END AS t_top,
        CASE WHEN o_custkey % 19 = 0 THEN -99 ELSE o_custkey % 101 END::DOUBLE AS rh,
        CASE WHEN o_custkey % 23 = 0 THEN -99::DOUBLE ELSE (o_orderkey % 7) / 2::DOUBLE END AS precip
    FROM orders)"""

_MINUTES = f"""minutes AS (
    SELECT {_calendar('l_orderkey')},
        l_linenumber AS minute,
        CASE WHEN l_suppkey % 37 = 0 THEN -999 ELSE l_suppkey % 360 END::DOUBLE AS wind_dir,
        CASE WHEN l_partkey % 29 = 0 THEN -999::DOUBLE ELSE l_quantity / 4::DOUBLE END AS wind_spd,
        CASE WHEN l_suppkey % 11 = 0 THEN -9 ELSE l_suppkey % 100 END::DOUBLE AS wind_stead,
        (990 + l_partkey % 40)::DOUBLE AS p,
        CASE WHEN l_partkey % 43 = 0 THEN -999::DOUBLE ELSE {_temperature('l_extendedprice')} END AS t_2m,
        {_temperature('l_extendedprice')} + (l_partkey % 41 - 20) / 10::DOUBLE AS t_10m,
        {_temperature('l_extendedprice')} + 0.5::DOUBLE AS t_top,
        CASE WHEN l_suppkey % 13 = 0 THEN -99 ELSE l_suppkey % 101 END::DOUBLE AS rh,
        CASE WHEN l_partkey % 23 = 0 THEN -99::DOUBLE ELSE (l_partkey % 7) / 2::DOUBLE END AS precip
    FROM lineitem)"""

_OBS = """obs AS (
    SELECT event_id, ts, event_type AS site, value / 10::DOUBLE AS wind_spd,
        CAST(props ->> '$.k' AS INTEGER) AS k
    FROM events)"""

_INSTANT = "make_timestamp(year, month, day, hour, 0, 0.0)"
_STATISTICS = ["wind_mean", "gust_time", "wind_sd", "wind_max", "wind_min", "wind_med"]


def _summary(source: str, name: str, propagate: bool = True, refined: bool = False) -> str:
    def masked(expression: str) -> str:
        return f"CASE WHEN count(*) = count(v) THEN {expression} END" if propagate else expression

    gust = "count(*) FILTER (WHERE v >= 10 AND v >= 1.5::DOUBLE * m)" if refined else "count(*) FILTER (WHERE v >= 10)"
    return f"""{name}_readings AS (
        SELECT {KEYS}, v, avg(v) OVER (PARTITION BY {KEYS}) AS m
        FROM (SELECT {KEYS}, CASE WHEN wind_spd >= 0 THEN wind_spd END AS v FROM {source})),
    {name} AS (
        SELECT {KEYS},
            {masked('avg(v)')} AS wind_mean, {masked(gust)} AS gust_time, {masked('stddev_samp(v)')} AS wind_sd,
            {masked('max(v)')} AS wind_max, {masked('min(v)')} AS wind_min, {masked('median(v)')} AS wind_med,
            count(*) AS nrow, count(*) - count(v) AS na_ct, {_INSTANT} AS date
        FROM {name}_readings GROUP BY {KEYS})"""


def _complete(refined: bool = False) -> str:
    return f"""{_MINUTES}, {_summary('minutes', 'summary', refined=refined)},
    complete AS (SELECT * FROM summary WHERE nrow = {COMPLETE_ROWS} AND na_ct = 0)"""


_COMBINED = f"""{_HOURS}, {_complete()},
    combined AS (
        SELECT h.*, {', '.join(f's.{c}' for c in _STATISTICS)}, s.nrow, s.na_ct,
            make_timestamp(h.year, h.month, h.day, h.hour, 0, 0.0) AS date
        FROM hours h LEFT JOIN complete s USING ({KEYS})
        WHERE s.gust_time IS NOT NULL AND h.t_2m IS NOT NULL
            AND make_timestamp(h.year, h.month, h.day, h.hour, 0, 0.0) IN (SELECT date FROM complete))"""

_KELVIN = "((t_2m + t_10m) / 2 + 273.15::DOUBLE)"
_STABLE = f"""{_COMBINED},
    pressures AS (
        SELECT *, t_10m - t_2m AS t_difference, {_KELVIN} AS "avg_temp_K",
            -9.81::DOUBLE * (p / (8.314::DOUBLE * NULLIF({_KELVIN}, 0))) * 8 AS delta_p
        FROM combined),
    temperatures AS (
        SELECT *, delta_p + p AS p_10m,
            t_2m * pow(1000::DOUBLE / NULLIF(p, 0), 0.286::DOUBLE) AS pot_temp_2m,
            t_10m * pow(1000::DOUBLE / NULLIF(delta_p + p, 0), 0.286::DOUBLE) AS pot_temp_10m
        FROM pressures),
    stable AS (
        SELECT *, pot_temp_10m - pot_temp_2m AS delta_theta,
            9.81::DOUBLE / NULLIF(t_2m, 0) * t_difference * 8 / NULLIF(wind_spd * wind_spd, 0) AS richardson_bulk,
            9.81::DOUBLE / NULLIF(t_2m, 0) * (pot_temp_10m - pot_temp_2m) * 8 / NULLIF(wind_spd * wind_spd, 0)
                AS richardson_potential
        FROM temperatures)"""

# Output columns: a trailing ~ marks a double, rounded like the Spark side.


def _out(columns: str, digits: int = 6) -> str:
    return ", ".join(
        f'round("{c[:-1]}", {digits}) + 0.0::DOUBLE AS "{c[:-1]}"' if c.endswith("~") else f'"{c}"' for c in columns.split()
    )


def _select(columns: str, source: str, ctes: str = "", where: str = "", recursive: bool = False, digits: int = 6) -> str:
    head = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n" if ctes else ""
    tail = f"\nWHERE {where}" if where else ""
    return f"{head}SELECT {_out(columns, digits)}\nFROM {source}{tail}"


_KEY_COLUMNS = "site year month day hour"
_READINGS = "wind_dir~ wind_spd~ wind_stead~ p~ t_2m~ t_10m~ t_top~ rh~ precip~"
_RAW_READINGS = _READINGS.replace("~", "")
_SUMMARY_COLUMNS = f"{_KEY_COLUMNS} wind_mean~ gust_time wind_sd~ wind_max~ wind_min~ wind_med~ nrow na_ct date"
_STAT_COLUMNS = "wind_mean~ gust_time wind_sd~ wind_max~ wind_min~ wind_med~ nrow na_ct"


def _cleaned(source: str, sentinel: int, negative: bool) -> str:
    floors = dict.fromkeys(["wind_dir", "wind_spd", "p", "t_2m", "t_10m", "t_top"], sentinel)
    floors |= {"wind_stead": -9, "rh": -99, "precip": -99}
    rules = [f"CASE WHEN {c} > {s} THEN {c} END AS {c}" for c, s in floors.items() if not (negative and c == "wind_spd")]
    if negative:
        rules.append("CASE WHEN wind_spd >= 0 THEN wind_spd END AS wind_spd")
    return f"cleaned AS (SELECT * REPLACE ({', '.join(rules)}) FROM {source})"


def _index(x: str, lo: str, hi: str, count: int) -> str:
    width = f"(({hi} - {lo}) / {count})"
    guess = f"least(greatest(ceil(({x} - {lo}) / NULLIF({width}, 0)), 1), {count})"
    return f"""CAST(CASE WHEN {hi} = {lo} THEN {(count + 1) // 2}
        WHEN {x} <= {lo} + ({guess} - 1) * {width} AND {guess} > 1 THEN {guess} - 1
        WHEN {x} > {lo} + {guess} * {width} AND {guess} < {count} THEN {guess} + 1
        ELSE {guess} END AS INTEGER)"""


def _counts(source: str, condition: str, span: str) -> str:
    return f"""span AS ({span}),
    counted AS (SELECT month, year, count(*) AS k FROM {source} WHERE {condition} GROUP BY month, year),
    filled AS (SELECT s.month, s.year, coalesce(c.k, 0) AS n FROM span s LEFT JOIN counted c USING (month, year))"""


_SPAN = f"""SELECT CAST(m AS INTEGER) AS month, CAST(y AS INTEGER) AS year
        FROM range(1, 13) a(m), range({FIRST_YEAR}, {LAST_YEAR + 1}) b(y)"""
_SEEN_SPAN = """SELECT CAST(m AS INTEGER) AS month, CAST(y AS INTEGER) AS year
        FROM range(1, 13) a(m), (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM combined)"""


def _line(source: str, by: str, x: str = "x", y: str = "y") -> str:
    """Lines with errors; `lines` holds one row per group."""
    return f"""line_sums AS (
        SELECT {by}, count(*) AS n, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy,
            avg({x}) AS mx, avg({y}) AS my
        FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {by}),
    line_slopes AS (SELECT *, sxy / NULLIF(sxx, 0) AS slope, n - 2 AS df FROM line_sums),
    line_fits AS (
        SELECT *, my - slope * mx AS intercept,
            CASE WHEN df > 0 THEN sqrt(greatest(syy - slope * sxy, 0) / df) END AS sigma,
            slope * sxy / NULLIF(syy, 0) AS r2
        FROM line_slopes),
    line_errors AS (
        SELECT *, sigma / sqrt(NULLIF(sxx, 0)) AS std_error,
            sigma * sqrt(1 / n + mx * mx / NULLIF(sxx, 0)) AS intercept_error,
            CASE WHEN df > 0 THEN 1 - (1 - r2) * (n - 1) / df END AS adj_r2
        FROM line_fits),
    lines AS (
        SELECT *, slope / NULLIF(std_error, 0) AS t_value, slope - std_error AS lo, slope + std_error AS hi
        FROM line_errors)"""


_METRICS = f"""{_COMBINED}, {_counts('combined', f'wind_sd > {HIGH_SD}', _SPAN)},
    thaw_counted AS (SELECT month, year, count(*) AS k FROM combined WHERE t_2m > -1.8::DOUBLE GROUP BY month, year),
    metrics AS (
        SELECT 'gust_count' AS metric, month, year::DOUBLE AS x, n::DOUBLE AS y FROM filled
        UNION ALL SELECT 'thaw_count', s.month, s.year::DOUBLE, coalesce(c.k, 0)::DOUBLE
            FROM span s LEFT JOIN thaw_counted c USING (month, year)
        UNION ALL SELECT 't_2m', month, year::DOUBLE, t_2m FROM combined
        UNION ALL SELECT 'wind_spd', month, year::DOUBLE, wind_spd FROM combined
        UNION ALL SELECT 'wind_sd', month, year::DOUBLE, wind_sd FROM combined),
    {_line('metrics', 'metric, month')}"""


def _t_share(theta: str, df: str) -> str:
    """P(|T| <= t) for theta = atan(|t| / sqrt(df)), by the finite series for whole df."""
    odd = f"""CASE WHEN {df} = 1 THEN 2 / pi() * {theta} ELSE 2 / pi() * ({theta} + sin({theta}) * cos({theta}) *
        list_sum([exp(lgamma(i + 1) - lgamma(i + 1.5::DOUBLE)) * sqrt(pi()) / 2 * pow(cos({theta}), 2 * i)
            FOR i IN range(0, ({df} - 1) // 2)])) END"""
    even = f"""sin({theta}) * list_sum([exp(lgamma(i + 0.5::DOUBLE) - lgamma(i + 1)) / sqrt(pi()) * pow(cos({theta}), 2 * i)
            FOR i IN range(0, {df} // 2)])"""
    return f"(CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END)"


def _p_value(t: str = "t_value", df: str = "df") -> str:
    return f"(1 - {_t_share(f'atan(abs({t}) / sqrt({df}))', df)})"


def _regression(source: str, response: str, terms: dict[str, str]) -> str:
    """`fit`: one row per term, from the correlation matrix by Gauss-Jordan elimination. Needs RECURSIVE."""
    p = len(terms)
    columns = [*(f"t{i}" for i in range(p)), "y"]
    usable = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    matrix = ", ".join(
        "[" + ", ".join(
            [f"corr(t{i}, {c})" for c in columns] + ["1::DOUBLE" if i == j else "0::DOUBLE" for j in range(p)]
        ) + "]"
        for i in range(p)
    )
    names = ", ".join(f"'{t}'" for t in terms)
    means, sds = (", ".join(f"{f}(t{i})" for i in range(p)) for f in ("avg", "stddev_pop"))
    slope = f"(m[i][{p + 1}] * sd_y / sds[i])"
    return f"""frame AS (
        SELECT * FROM (SELECT {', '.join(f'({e})::DOUBLE AS t{i}' for i, e in enumerate(terms.values()))}, {response} AS y
        FROM {source}) WHERE {usable}),
    moments AS (
        SELECT count(*) AS n, [{matrix}] AS m, [{means}] AS means, [{sds}] AS sds, avg(y) AS my, stddev_pop(y) AS sd_y
        FROM frame),
    steps AS (
        SELECT 1 AS k, m FROM moments
        UNION ALL
        SELECT k + 1, [[CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END
            FOR j IN range(1, {2 * p + 2})] FOR i IN range(1, {p + 1})]
        FROM steps WHERE k <= {p}),
    solved AS (
        SELECT s.m, o.m AS c, n, n - {p + 1} AS df, means, sds, my, sd_y,
            list_sum([s.m[i][{p + 1}] * o.m[i][{p + 1}] FOR i IN range(1, {p + 1})]) AS r2
        FROM steps s, moments o WHERE k = {p + 1}),
    sized AS (SELECT *, sqrt((1 - r2) / df) * sd_y * sqrt(n) AS sigma FROM solved),
    fit AS (
        SELECT 'intercept' AS term, n, df, r2, sigma,
            my - list_sum([{slope} * means[i] FOR i IN range(1, {p + 1})]) AS estimate,
            sigma * sqrt((1 + list_sum([list_sum([means[i] / sds[i] * m[i][{p + 1} + j] * means[j] / sds[j]
                FOR j IN range(1, {p + 1})]) FOR i IN range(1, {p + 1})])) / n) AS std_error
        FROM sized
        UNION ALL
        SELECT ([{names}])[i], n, df, r2, sigma, {slope}, sigma * sqrt(m[i][{p + 1} + i] / n) / sds[i]
        FROM sized, range(1, {p + 1}) r(i)),
    fit_t AS (SELECT *, estimate / std_error AS t_value FROM fit)"""


_TWO_TERMS = {"wind_spd": "wind_spd", "t_2m": "t_2m"}
_FACTORIAL = {
    ":".join(s): " * ".join(s)
    for size in (1, 2, 3)
    for s in combinations(["wind_spd", "t_2m", "richardson_bulk"], size)
}


def _determinant(rows: list[int], columns: list[int]) -> str:
    """Of the symmetric matrix of columns ``q00, q01, ...``, expanded along its first row."""
    if not rows:
        return "1::DOUBLE"
    first, rest = rows[0], rows[1:]
    parts = []
    for k, c in enumerate(columns):
        minor = _determinant(rest, [x for x in columns if x != c])
        parts.append(f"{'-' if k % 2 else '+'} q{min(first, c)}{max(first, c)} * {minor}")
    return "(" + " ".join(parts).removeprefix("+ ") + ")"


def _normal_share(z: str) -> str:
    """Phi(z) for z of moderate size."""
    odd = "list_transform(range(80, 0, -1), lambda k: 2 * k::DOUBLE + 1)"
    return f"(0.5::DOUBLE + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {z} * list_reduce(list_prepend(1::DOUBLE, {odd}), lambda v, d: 1 + {z} * {z} / d * v))"


def _mixture_ends(name: str, source: str, keys: str, level: float) -> str:
    """`name`: ``keys``, mean, sd, lower and upper of the mixtures of normal distributions (w, mu, sd) in ``source``."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return f"""{name}_parts AS (SELECT {keys}, w, mu, sd AS s FROM {source}),
    {name}_means AS (
        SELECT {keys}, sum(w * mu) AS mean, sqrt(sum(w * (s * s + mu * mu)) - sum(w * mu) * sum(w * mu)) AS sd FROM {name}_parts GROUP BY {keys}),
    {name}_steps AS (
        SELECT {keys}, 0 AS step, share, mean + z * sd AS x FROM {name}_means, (VALUES ({lo!r}::DOUBLE, -1.6::DOUBLE), ({hi!r}::DOUBLE, 1.6::DOUBLE)) e(share, z)
        UNION ALL
        SELECT {keys}, step + 1, share, x - (sum(w * phi) - share) / sum(w * exp(-z * z / 2) / (s * sqrt(2 * pi()))) FROM (
            SELECT *, {_normal_share('z')} AS phi FROM (
                SELECT *, (x - mu) / s AS z FROM (SELECT * FROM {name}_steps WHERE step < 8) JOIN {name}_parts USING ({keys})))
        GROUP BY {keys}, step, share, x),
    {name} AS (
        SELECT {keys}, mean, sd, min(x) AS lower, max(x) AS upper FROM {name}_means JOIN (SELECT * FROM {name}_steps WHERE step = 8) USING ({keys})
        GROUP BY {keys}, mean, sd)"""


def _map_model(name: str, source: str, nodes: bool = False) -> str:
    """`mode`: posterior mode and sds of a model, by turns over sigma and the rest. Needs RECURSIVE.

    With ``nodes``, `map_nodes` has the coefficients at 193 steps of log sigma and `map_dense` sigma's density at 8,001.

    Everything is around the means of the terms (d1, d2, ...), where the
    intercept a becomes c = a + b1 m1 + b2 m2 + ...; `map_sigma` keeps those numbers.
    """
    model = MODELS[name]
    size = len(model.terms) + 1
    every, slopes = range(size), range(1, size)
    x = {i: f"({t[:-2]} * {t[:-2]})" if t.endswith("^2") else t for i, t in enumerate(model.terms, start=1)}
    priors = [model.intercept, *model.slopes]
    weight = ["0::DOUBLE" if p is None else f"{p[1] ** -2.0!r}::DOUBLE" for p in priors]
    centre = [0.0 if p is None else p[0] for p in priors]
    rate = f"{model.sigma_rate!r}::DOUBLE"

    def mean(i: int) -> str:
        return "(-1)" if i == 0 else "0" if model.centred else f"m{i}"

    # prior on a = c - b1 m1 - b2 m2, spelled out in (c, b1, b2); a centred model has it on c
    prior = {
        (i, j): f"({weight[0]} * {mean(i)} * {mean(j)}" + (f" + {weight[i]})" if i == j and i else ")")
        for i in every for j in every
    }
    pull = [f"(- {weight[0]} * {mean(i)} * {centre[0]}" + (f" + {weight[i]} * {centre[i]})" if i else ")") for i in every]
    data = {(i, j): "n" if i == j == 0 else "0" if 0 in (i, j) else f"s{i}{j}" for i in every for j in every if i <= j}
    cross = ["n * my", *(f"s{i}y" for i in slopes)]

    pairs = [(i, j) for i in every for j in every if i <= j]
    entries = ", ".join(f"({data[i, j]} / (sigma * sigma) + {prior[i, j]}) AS q{i}{j}" for i, j in pairs)
    targets = ", ".join(f"({cross[i]} / (sigma * sigma) + {pull[i]}) AS r{i}" for i in every)
    others = lambda i: [k for k in every if k != i]
    inverse = {(i, j): f"({'-' if (i + j) % 2 else ''}{_determinant(others(i), others(j))} / det)" for i, j in pairs}
    det = f"{_determinant(list(every), list(every))} AS det"
    inv = ", ".join(f"{e} AS v{i}{j}" for (i, j), e in inverse.items())
    theta = ", ".join("(" + " + ".join(f"v{min(i, j)}{max(i, j)} * r{j}" for j in every) + f") AS h{i}" for i in every)
    moments = ["n", "my", "syy", *(f"m{i}" for i in slopes), *(f"s{i}y" for i in slopes)]
    moments = ", ".join([*moments, *(f"s{i}{j}" for i in slopes for j in slopes if i <= j)])

    def solved(inner: str) -> str:
        return f"SELECT *, {theta} FROM (SELECT *, {inv} FROM (SELECT *, {det} FROM ({inner})))"

    fitted = " + ".join(f"h{i} * h{j} * s{min(i, j)}{max(i, j)}" for i in slopes for j in slopes)
    shared = " + ".join(f"h{i} * s{i}y" for i in slopes)
    rss = f"(syy - 2 * ({shared}) + {fitted} + n * (my - h0) * (my - h0))"
    # sigma solves rate s^3 + n s^2 = rss: a few Newton steps from above
    newton = "sqrt(rss / n)"
    for _ in range(4):
        newton = f"(SELECT s - ({rate} * s * s * s + n * s * s - rss) / (3 * {rate} * s * s + 2 * n * s) FROM (SELECT {newton} AS s))"
    # mixed second derivatives with sigma
    mixed = ", ".join(
        f"2 * ({' + '.join(f'{prior[min(i, j), max(i, j)]} * h{j}' for j in every)} - {pull[i]}) / sigma AS g{i}" for i in every
    )
    u = {i: "(" + " + ".join(f"v{min(i, j)}{max(i, j)} * g{j}" for j in every) + ")" for i in every}
    back = ["1", *(f"(-m{i})" for i in slopes)]
    variance = " + ".join(f"v{min(i, j)}{max(i, j)} * {back[i]} * {back[j]}" for i in every for j in every)
    along = " + ".join(f"u{i} * {back[i]}" for i in every)
    sums = ", ".join(
        [*(f"avg(x{i}) AS m{i}" for i in slopes), *(f"count(*) * covar_pop(x{i}, y) AS s{i}y" for i in slopes)]
        + [f"count(*) * covar_pop(x{i}, x{j}) AS s{i}{j}" for i in slopes for j in slopes if i <= j]
    )
    used = " AND ".join(f"x{i} IS NOT NULL" for i in slopes)
    inside = " + ".join(f"{prior[min(i, j), max(i, j)]} * h{i} * h{j}" for i in every for j in every)
    pulled = " + ".join(f"{pull[i]} * h{i}" for i in every)

    def density(table: str, steps: int) -> str:
        grid = f"""SELECT i, p.sigma * exp(12::DOUBLE / sqrt(2 * (n - {size - 1})) * (2 * i / {steps}::DOUBLE - 1)) AS sigma FROM map_peak p, range({steps + 1}) r(i)"""
        return f""",
    {table}_raw AS (
        SELECT *, (1 - n) * ln(sigma) - {rate} * sigma - ln(det) / 2 - ({rss} / (sigma * sigma) + {inside} - 2 * ({pulled})) / 2 AS value
        FROM ({solved(f"SELECT i, g.sigma, {moments}, {entries}, {targets} FROM (SELECT i, sigma FROM ({grid})) g, map_sums")})),
    {table} AS (SELECT *, exp(value - max(value) OVER ()) / sum(exp(value - top)) OVER () AS w FROM (SELECT *, max(value) OVER () AS top FROM {table}_raw))"""

    extra = density("map_nodes", 192) + density("map_dense", 8000) if nodes else ""
    return f"""map_frame AS (SELECT {', '.join(f'{e} AS x{i}' for i, e in x.items())}, {model.response} AS y FROM {source}),
    map_sums AS (
        SELECT count(*) AS n, avg(y) AS my, count(*) * covar_pop(y, y) AS syy, {sums}
        FROM map_frame WHERE {used} AND y IS NOT NULL),
    map_steps AS (
        SELECT 0 AS k, sqrt(syy / n) AS sigma FROM map_sums
        UNION ALL
        SELECT k + 1, {newton} FROM (
            SELECT k, n, {rss} AS rss FROM (
                {solved(f"SELECT k, sigma, {moments}, {entries}, {targets} FROM map_steps, map_sums WHERE k < 60")}))),
    map_peak AS ({solved(f"SELECT sigma, {moments}, {entries}, {targets} FROM map_steps, map_sums WHERE k = 60")}),
    map_mixed AS (
        SELECT *, {mixed}, -n / (sigma * sigma) + 3 * {rss} / (sigma * sigma * sigma * sigma) AS gss FROM map_peak),
    map_sigma AS (
        SELECT *, 1 / (gss - ({' + '.join(f'g{i} * {u[i]}' for i in every)})) AS vs, {', '.join(f'{u[i]} AS u{i}' for i in every)}
        FROM map_mixed),
    mode AS (
        SELECT 'a' AS parameter, h0 - ({' + '.join(f'm{i} * h{i}' for i in slopes)}) AS mean,
            sqrt({variance} + vs * ({along}) * ({along})) AS sd FROM map_sigma
        {' '.join(f"UNION ALL SELECT 'b{i}', h{i}, sqrt(v{i}{i} + vs * u{i} * u{i}) FROM map_sigma" for i in slopes)}
        UNION ALL SELECT 'sigma', sigma, sqrt(vs) FROM map_sigma),
    mode_interval AS (
        SELECT *, mean - 1.5981931399228173::DOUBLE * sd AS lower, mean + 1.5981931399228173::DOUBLE * sd AS upper FROM mode){extra}"""


def _marginals(name: str) -> str:
    """`marginals` of a model of `_map_model` with nodes: one row per parameter."""
    slopes = range(1, len(MODELS[name].terms) + 1)
    every = range(len(slopes) + 1)
    back = ["1", *(f"(-m{i})" for i in slopes)]
    variance = " + ".join(f"v{min(i, j)}{max(i, j)} * {back[i]} * {back[j]}" for i in every for j in every)
    parts = [f"SELECT 'a' AS parameter, w, h0 - ({' + '.join(f'm{i} * h{i}' for i in slopes)}) AS mu, sqrt({variance}) AS sd FROM map_nodes"]
    parts += [f"SELECT 'b{i}', w, h{i}, sqrt(v{i}{i}) FROM map_nodes" for i in slopes]
    return f"""mix_source AS ({' UNION ALL '.join(parts)}),
    {_mixture_ends('mix', 'mix_source', 'parameter', 0.89)},
    passed AS (SELECT i, w, ln(sigma) AS s, sigma, sum(w) OVER (ORDER BY i) - w / 2 AS upto FROM map_dense),
    crossed AS (SELECT s, upto, lead(s) OVER (ORDER BY i) AS s2, lead(upto) OVER (ORDER BY i) AS upto2 FROM passed),
    sigma_ends AS (
        SELECT min(exp(s + (share - upto) / (upto2 - upto) * (s2 - s))) AS lower, max(exp(s + (share - upto) / (upto2 - upto) * (s2 - s))) AS upper
        FROM crossed, (VALUES (0.055::DOUBLE), (0.945::DOUBLE)) e(share) WHERE upto <= share AND share < upto2),
    marginals AS (
        SELECT parameter, mean, sd, lower, upper FROM mix
        UNION ALL
        SELECT 'sigma', mean, sqrt((SELECT sum(w * (sigma - mean) * (sigma - mean)) FROM passed)), lower, upper
        FROM (SELECT sum(w * sigma) AS mean FROM passed), sigma_ends)"""


def _exact_band(name: str, rows: str, columns: str) -> str:
    """`exact_band`: mean and 90 % band of the mean of a model of `_map_model` with nodes at every row of ``rows``."""
    terms = [f"({t[:-2]} * {t[:-2]})" if t.endswith("^2") else t for t in MODELS[name].terms]
    d = ["1", *(f"({t} - m{i})" for i, t in enumerate(terms, start=1))]
    every = range(len(d))
    mu = " + ".join(f"h{i} * {d[i]}" for i in every)
    spread = " + ".join(f"v{min(i, j)}{max(i, j)} * {d[i]} * {d[j]}" for i in every for j in every)
    return f"""band_source AS (SELECT {columns}, w, {mu} AS mu, sqrt({spread}) AS sd FROM {rows}, map_nodes),
    {_mixture_ends('exact_band', 'band_source', columns, 0.90)}"""


def _map_band(name: str, rows: str, columns: str, predictive: bool = False) -> str:
    """Mean and 90 % band of a model of `_map_model` at every row of ``rows``."""
    model = MODELS[name]
    terms = [f"({t[:-2]} * {t[:-2]})" if t.endswith("^2") else t for t in model.terms]
    d = ["1", *(f"({t} - m{i})" for i, t in enumerate(terms, start=1))]
    every = range(len(d))
    spread = " + ".join(f"v{min(i, j)}{max(i, j)} * {d[i]} * {d[j]}" for i in every for j in every)
    along = " + ".join(f"u{i} * {d[i]}" for i in every)
    variance = f"{spread} + vs * ({along}) * ({along})" + (" + sigma * sigma" if predictive else "")
    return f"""(SELECT {columns}, mean, mean - 1.6448536269514722::DOUBLE * sqrt(var) AS lower,
            mean + 1.6448536269514722::DOUBLE * sqrt(var) AS upper
        FROM (SELECT {columns}, {' + '.join(f'h{i} * {d[i]}' for i in every)} AS mean, {variance} AS var FROM {rows}, map_sigma))"""


def _bounded() -> str:
    """`bounded`: the floor model of the temperature, its value at the means held at 0. Needs RECURSIVE."""
    newton = "sqrt(rss / n)"
    for _ in range(4):
        newton = f"(SELECT s - (0.05::DOUBLE * s * s * s + n * s * s - rss) / (0.15::DOUBLE * s * s + 2 * n * s) FROM (SELECT {newton} AS s))"

    def solved(source: str) -> str:
        return f"""SELECT *, syy - 2 * (b1 * s1y + b2 * s2y) + b1 * b1 * s11 + 2 * b1 * b2 * s12 + b2 * b2 * s22 + n * my * my AS rss FROM (
            SELECT *, (q22 * s1y - q12 * s2y) / (v * (q11 * q22 - q12 * q12)) AS b1, (q11 * s2y - q12 * s1y) / (v * (q11 * q22 - q12 * q12)) AS b2
            FROM (SELECT *, s11 / v + 1 AS q11, s12 / v AS q12, s22 / v AS q22 FROM (SELECT *, sigma * sigma AS v FROM {source})))"""

    def mills(x: str) -> str:
        down = "list_transform(range(200, 0, -1), lambda k: k::DOUBLE)"
        return f"(1 / list_reduce(list_prepend({x}, {down}), lambda v, k: {x} + k / v))"

    z = "1.5981931399228173::DOUBLE"
    return f"""floor_frame AS (
        SELECT wind_spd AS x1, wind_spd * wind_spd AS x2, t_2m AS y FROM combined WHERE wind_spd IS NOT NULL AND t_2m IS NOT NULL),
    floor_sums AS (
        SELECT count(*) AS n, avg(y) AS my, count(*) * var_pop(y) AS syy, count(*) * var_pop(x1) AS s11,
            count(*) * covar_pop(x1, x2) AS s12, count(*) * var_pop(x2) AS s22, count(*) * covar_pop(x1, y) AS s1y,
            count(*) * covar_pop(x2, y) AS s2y
        FROM floor_frame),
    floor_steps AS (
        SELECT 0 AS k, sqrt(syy / n) AS sigma FROM floor_sums
        UNION ALL
        SELECT k + 1, {newton} FROM (SELECT k, n, rss FROM ({solved('floor_steps, floor_sums')}) WHERE k < 60)),
    floor_peak AS (
        SELECT *, n * my / v + 0.2::DOUBLE AS fall, sqrt(1 / (n / v + 0.04::DOUBLE)) AS s, 2 * b1 / sigma AS t1s,
            -n / v + 3 * rss / (v * v) AS tss
        FROM ({solved('(SELECT * FROM floor_steps WHERE k = 60), floor_sums')})),
    floor_cut AS (
        SELECT *, -fall * s AS alpha, q11 * q22 * tss - q12 * q12 * tss - t1s * t1s * q22 AS det FROM floor_peak),
    floor_tail AS (SELECT *, {mills('alpha')} AS m FROM floor_cut),
    floor_roots AS (
        SELECT 0 AS k, share, alpha, ln(1 - share) + ln(m) - alpha * alpha / 2 AS target, alpha + 3 AS x
        FROM floor_tail, (VALUES (0.055::DOUBLE), (0.945::DOUBLE)) shares(share)
        UNION ALL
        SELECT k + 1, share, alpha, target, x + (ln(m) - x * x / 2 - target) * m
        FROM (SELECT *, {mills('x')} AS m FROM floor_roots WHERE k < 60)),
    floor_ends AS (
        SELECT max(x) FILTER (share < 0.5) AS lo, max(x) FILTER (share > 0.5) AS hi FROM floor_roots WHERE k = 60),
    bounded_plain AS (
        SELECT 'b1' AS parameter, b1 AS mode, sqrt(q22 * tss / det) AS sd FROM floor_cut
        UNION ALL SELECT 'b2', b2, sqrt((q11 * tss - t1s * t1s) / det) FROM floor_cut
        UNION ALL SELECT 'sigma', sigma, sqrt((q11 * q22 - q12 * q12) / det) FROM floor_cut),
    bounded AS (
        SELECT 'c' AS parameter, 0::DOUBLE AS mode, s * (1 / m - alpha) AS mean, s * sqrt(1 + alpha / m - 1 / (m * m)) AS sd,
            s * (lo - alpha) AS lower, s * (hi - alpha) AS upper, fall < 0 AS bound FROM floor_tail, floor_ends
        UNION ALL SELECT parameter, mode, mode, sd, mode - {z} * sd, mode + {z} * sd, false FROM bounded_plain)"""


def _zero_inflated(trials: int) -> str:
    """`zi`: mode and spreads of the zero-inflated model of gust_time on t_2m by Newton's steps. Needs RECURSIVE.

    Works in u = (t_2m - h) / c; priors: a ~ Normal(5, 5), b1 and b2 ~ Normal(0, 1), p_zero ~ Beta(3, 3).
    """
    every = range(4)
    pairs = [(i, j) for i in every for j in every if i <= j]
    others = lambda i: [k for k in every if k != i]
    inverse = {(i, j): f"({'-' if (i + j) % 2 else ''}{_determinant(others(i), others(j))} / det)" for i, j in pairs}
    inv = lambda i, j: f"v{min(i, j)}{max(i, j)}"
    prior = {
        "11": "0.04::DOUBLE", "12": "-h / c * 0.04::DOUBLE", "13": "h * h / c / c * 0.04::DOUBLE", "22": "(h * h * 0.04::DOUBLE + 1) / c / c",
        "23": "-(h * h * h * 0.04::DOUBLE + 2 * h) / c / c / c", "33": "(h * h * h * h * 0.04::DOUBLE + 4 * h * h + 1) / c / c / c / c",
    }
    u = ["1", "u", "u * u"]
    bent = ", ".join(f"sum(w * (bend - unsure * mean * mean) * {u[i - 1]} * {u[j - 1]}) + {prior[f'{i}{j}']} AS q{i}{j}" for i, j in pairs if i)
    crossed = ", ".join(f"-sum(w * unsure * mean * {u[j - 1]}) AS q0{j}" for j in (1, 2, 3))
    pulled = ", ".join(f"sum(w * pull * {u[j - 1]}) AS d{j}" for j in (1, 2, 3))
    state = "step, t0, t1, t2, t3"

    def sums(source: str) -> str:
        return f"""SELECT *, {', '.join(f'{e} AS v{i}{j}' for (i, j), e in inverse.items())} FROM (
            SELECT *, {_determinant(list(every), list(every))} AS det, d1 - f0 * 0.04::DOUBLE AS g1,
                d2 + h / c * f0 * 0.04::DOUBLE - f1 / c AS g2,
                d3 - h * h / c / c * f0 * 0.04::DOUBLE + 2 * h / c / c * f1 - f2 / c / c AS g3
            FROM (SELECT *, t1 - h / c * t2 + h * h / c / c * t3 - 5 AS f0, t2 / c - 2 * h / c / c * t3 AS f1, t3 / c / c AS f2
                FROM (SELECT {state}, h, c, share, sum(w * (structural - share)) + 2 - 4 * share AS g0,
                    -sum(w * unsure) + (sum(w) + 4) * share * (1 - share) AS q00, {crossed}, {bent}, {pulled}
                    FROM (SELECT *, structural * (1 - structural) AS unsure, (1 - structural) * spread AS bend,
                            CASE WHEN k = 0 THEN -(1 - structural) * mean ELSE k - mean END AS pull
                        FROM (SELECT *, CASE WHEN k = 0 THEN 1 / (1 + exp(ln(1 - share) - ln(share) - {trials} * (greatest(eta, 0) + ln(1 + exp(-abs(eta)))))) ELSE 0 END AS structural,
                                {trials} / (1 + exp(-eta)) AS mean, {trials} / (1 + exp(-eta)) / (1 + exp(eta)) AS spread
                            FROM (SELECT *, t1 + t2 * u + t3 * u * u AS eta, 1 / (1 + exp(-t0)) AS share FROM {source}, zi_cells)))
                    GROUP BY {state}, h, c, share)))"""

    moves = ", ".join(f"t{i} + " + " + ".join(f"{inv(i, j)} * g{j}" for j in every) for i in every)
    spread_a = f"v11 + h * h / c / c * v22 + h * h * h * h / c / c / c / c * v33 - 2 * h / c * v12 + 2 * h * h / c / c * v13 - 2 * h * h * h / c / c / c * v23"
    return f"""zi_rows AS (
        SELECT t_2m::DOUBLE AS x, gust_time::DOUBLE AS k, count(*)::DOUBLE AS w FROM stable
        WHERE t_2m IS NOT NULL AND gust_time BETWEEN 0 AND {trials} GROUP BY ALL),
    zi_shape AS (
        SELECT sum(w) AS n, sum(w * k) AS hits, sum(w * x) / sum(w) AS shift0, avg(x) AS h, stddev_pop(x) AS c FROM zi_rows),
    zi_cells AS (SELECT k, w, h, c, (x - h) / c AS u FROM zi_rows, zi_shape),
    zi_steps AS (
        SELECT 0 AS step, ln(0.1::DOUBLE / 0.9::DOUBLE) AS t0, ln(hits / (n * {trials} - hits)) AS t1, 0::DOUBLE AS t2, 0::DOUBLE AS t3 FROM zi_shape
        UNION ALL
        SELECT step + 1, {moves} FROM ({sums('(SELECT * FROM zi_steps WHERE step < 25) s')})),
    zi_last AS ({sums('(SELECT * FROM zi_steps WHERE step = 25) s')}),
    zi AS (
        SELECT share AS p_zero, t1 - h / c * t2 + h * h / c / c * t3 AS a, t2 / c - 2 * h / c / c * t3 AS b1, t3 / c / c AS b2,
            share * (1 - share) * sqrt(v00) AS p_zero_sd, sqrt({spread_a}) AS a_sd,
            sqrt(v22 / c / c + 4 * h * h / c / c / c / c * v33 - 4 * h / c / c / c * v23) AS b1_sd, sqrt(v33) / c / c AS b2_sd
        FROM zi_last)"""


def _expected(bins: int, edges: int, lo: float, hi: float) -> str:
    """`below`: responses expected up to each of even edges among the predictions of each bin of wind_spd on [0, 20]."""
    z = _normal_share("least(greatest((y - mean) / sd, -8), 8)")
    return f"""moments AS (
        SELECT wind_spd, mean, (upper - mean) / 1.6448536269514722::DOUBLE AS sd
        FROM {_map_band('sd_w', '(SELECT * FROM combined WHERE wind_spd BETWEEN 0 AND 20)', 'wind_spd', predictive=True)}),
    below AS (
        SELECT x_bin, edge, sum({z}) AS below, count(*) AS n FROM (
            SELECT {_index('wind_spd', '0::DOUBLE', '20::DOUBLE', bins)} AS x_bin, mean, sd FROM moments),
            (SELECT i AS edge, {lo!r}::DOUBLE + i * {(hi - lo) / edges!r}::DOUBLE AS y FROM range({edges + 1}) r(i))
        GROUP BY x_bin, edge)"""


def _expected_boxes(edges: int, lo: float, hi: float) -> str:
    step = (hi - lo) / edges

    def quantile(q: float) -> str:
        return f"max({lo!r}::DOUBLE + (edge + ({q} - share) / (next - share)) * {step!r}::DOUBLE) FILTER (WHERE share <= {q} AND next > {q})"

    def reached(y: str) -> str:
        place = f"(({y} - {lo!r}::DOUBLE) / {step!r}::DOUBLE)"
        own = f"least(greatest(floor({place}), 0), {edges - 1})"
        return f"max(share + least(greatest({place} - edge, 0), 1) * (next - share)) FILTER (WHERE edge = {own})"

    return f"""shares AS (
        SELECT x_bin, n, edge, below / n AS share, lead(below / n) OVER (PARTITION BY x_bin ORDER BY edge) AS next FROM below),
    predicted_quartiles AS (
        SELECT x_bin, n, {quantile(0.25)} AS q1, {quantile(0.5)} AS median, {quantile(0.75)} AS q3 FROM shares GROUP BY x_bin, n),
    predicted_fences AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS fence_lo, q3 + 1.5::DOUBLE * (q3 - q1) AS fence_hi FROM predicted_quartiles),
    predicted_boxes AS (
        SELECT x_bin, f.n, q1, median, q3, fence_lo, fence_hi, f.n * ({reached('fence_lo')} + 1 - {reached('fence_hi')}) AS outside
        FROM predicted_fences f JOIN shares s USING (x_bin) WHERE next IS NOT NULL
        GROUP BY x_bin, f.n, q1, median, q3, fence_lo, fence_hi)"""


def _boxes(source: str, bin_column: str, y: str) -> str:
    return f"""quartiles AS (
        SELECT {bin_column}, count({y}) AS n, quantile_cont({y}, 0.25) AS q1, quantile_cont({y}, 0.5) AS median,
            quantile_cont({y}, 0.75) AS q3
        FROM {source} WHERE {y} IS NOT NULL GROUP BY {bin_column}),
    fenced AS (
        SELECT s.*, q.n, q1, median, q3,
            s.{y} BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS near
        FROM {source} s JOIN quartiles q USING ({bin_column}) WHERE s.{y} IS NOT NULL),
    boxes AS (
        SELECT {bin_column}, n, q1, median, q3, min({y}) FILTER (WHERE near) AS whisker_lo,
            max({y}) FILTER (WHERE near) AS whisker_hi, count(*) FILTER (WHERE NOT near) AS outliers
        FROM fenced GROUP BY ALL)"""


def _bins(source: str, x: str, count: int) -> str:
    width = f"((hi - lo) / {count})"
    return f"""bin_range AS (SELECT min({x}) AS lo, max({x}) AS hi FROM {source}),
    indexed AS (SELECT s.*, lo, hi, {_index(x, 'lo', 'hi', count)} AS bin FROM {source} s, bin_range),
    binned AS (
        SELECT *, CASE WHEN bin = 1 THEN lo - (hi - lo) / 1000 ELSE lo + (bin - 1) * {width} END AS bin_lo,
            CASE WHEN bin = {count} THEN hi + (hi - lo) / 1000 ELSE lo + bin * {width} END AS bin_hi
        FROM indexed)"""


def _cells(source: str, x: str, y: str, bins: tuple[int, int], limits: tuple | None) -> str:
    if limits:
        (xa, xb), (ya, yb) = limits
        ranges = f"SELECT {xa}::DOUBLE AS xlo, {xb}::DOUBLE AS xhi, {ya}::DOUBLE AS ylo, {yb}::DOUBLE AS yhi"
    else:
        ranges = "SELECT min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi FROM points"
    xw, yw = f"((xhi - xlo) / {bins[0]})", f"((yhi - ylo) / {bins[1]})"
    return f"""points AS (SELECT {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
    ranges AS ({ranges}),
    cells AS (
        SELECT {_index('x', 'xlo', 'xhi', bins[0])} AS x_bin, {_index('y', 'ylo', 'yhi', bins[1])} AS y_bin,
            xlo, xhi, ylo, yhi, count(*) AS n
        FROM points, ranges WHERE x BETWEEN xlo AND xhi AND y BETWEEN ylo AND yhi GROUP BY ALL),
    density AS (
        SELECT x_bin, y_bin, xlo + (x_bin - 1) * {xw} AS x_lo, xlo + x_bin * {xw} AS x_hi,
            ylo + (y_bin - 1) * {yw} AS y_lo, ylo + y_bin * {yw} AS y_hi, n,
            n / sum(n) OVER () AS density, n / max(n) OVER ()::DOUBLE AS ndensity, ln(n / max(n) OVER ()::DOUBLE) AS log_ndensity
        FROM cells)"""


_CELL_COLUMNS = "x_bin y_bin x_lo~ x_hi~ y_lo~ y_hi~ n density~ ndensity~ log_ndensity~"


def _kde(source: str, by: str | None, limits: tuple[float, float] | None) -> str:
    key = by or "'all'"
    where = f"WHERE wind_spd BETWEEN {limits[0]} AND {limits[1]}" if limits else ""
    ends = f"{limits[0]}::DOUBLE AS a, {limits[1]}::DOUBLE AS b" if limits else "min(v) AS a, max(v) AS b"
    last = KDE_POINTS - 1
    return f"""kde_values AS (SELECT {key} AS g, wind_spd AS v FROM {source} {where}),
    kde_range AS (SELECT {ends} FROM kde_values {'LIMIT 1' if limits else ''}),
    kde_shape AS (
        SELECT g, count(*) AS n,
            {BANDWIDTH_FACTOR}::DOUBLE * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / {IQR_PER_SD}::DOUBLE)
                * pow(count(*), -0.2::DOUBLE) AS bw
        FROM kde_values GROUP BY g),
    kde_grid AS (
        SELECT *, a - {KDE_CUT}::DOUBLE * bw AS low, (b - a + 2 * {KDE_CUT}::DOUBLE * bw) / {last} AS step FROM kde_shape, kde_range),
    kde_split AS (
        SELECT g, CAST(floor((v - low) / step) AS INTEGER) AS cell, (v - low) / step - floor((v - low) / step) AS share
        FROM kde_values JOIN kde_grid USING (g)),
    kde_mass AS (
        SELECT g, cell, sum(w) AS w FROM (
            SELECT g, cell, 1 - share AS w FROM kde_split UNION ALL SELECT g, cell + 1, share FROM kde_split)
        GROUP BY g, cell),
    kde_smooth AS (
        SELECT g, i, sum(w * exp(-0.5::DOUBLE * pow((i - cell) * step / bw, 2))) / (n * bw * sqrt(2 * pi())) AS f
        FROM kde_mass JOIN kde_grid USING (g), range({KDE_POINTS}) r(i) GROUP BY g, i, n, bw),
    kde_places AS (
        SELECT g, n, bw, i AS point, a + i * (b - a) / {last} AS x, (a + i * (b - a) / {last} - low) / step AS place
        FROM kde_grid, range({KDE_POINTS}) r(i)),
    kde AS (
        SELECT p.g AS site, CAST(point AS INTEGER) AS point, x, l.f + (place - floor(place)) * (u.f - l.f) AS density, bw, n
        FROM kde_places p
        JOIN kde_smooth l ON l.g = p.g AND l.i = CAST(floor(place) AS BIGINT)
        JOIN kde_smooth u ON u.g = p.g AND u.i = CAST(floor(place) AS BIGINT) + 1)"""


def _inverse(name: str, source: str, keys: str, matrix: str, size: int) -> str:
    """`name`: ``keys`` and ``inv``, the inverse of each row's ``matrix``, by Gauss-Jordan elimination. Needs RECURSIVE."""
    unit = "[CASE WHEN i = j THEN 1::DOUBLE ELSE 0::DOUBLE END FOR j IN range(1, {0})]".format(size + 1)
    return f"""{name}_steps AS (
        SELECT {keys}, 1 AS step, [list_concat(m[i], {unit}) FOR i IN range(1, {size + 1})] AS a FROM (SELECT {keys}, {matrix} AS m FROM {source})
        UNION ALL
        SELECT {keys}, step + 1, [[CASE WHEN i = step THEN a[step][j] / a[step][step] ELSE a[i][j] - a[i][step] * a[step][j] / a[step][step] END
            FOR j IN range(1, {2 * size + 1})] FOR i IN range(1, {size + 1})]
        FROM {name}_steps WHERE step <= {size}),
    {name} AS (SELECT {keys}, [a[i][{size + 1}:{2 * size}] FOR i IN range(1, {size + 1})] AS inv FROM {name}_steps WHERE step = {size + 1})"""


def _product(a: str, b: str, rows: int, inner: int, columns: int, transposed: str = "") -> str:
    """Of two matrices; ``transposed`` names those that enter the other way round."""
    left = f"{a}[l][i]" if "a" in transposed else f"{a}[i][l]"
    right = f"{b}[j][l]" if "b" in transposed else f"{b}[l][j]"
    return f"[[list_sum([{left} * {right} FOR l IN range(1, {inner + 1})]) FOR j IN range(1, {columns + 1})] FOR i IN range(1, {rows + 1})]"


def _smooth(source: str) -> str:
    """`smooth`: penalised natural cubic splines with ten knots through the points (g, x, y) of ``source``. Needs RECURSIVE."""
    k, inner = 10, 8
    total = lambda e, n: f"list_sum([{e} FOR i IN range(1, {n + 1})])"
    here = " + ".join(f"CASE WHEN x > k[{i}] THEN 1 ELSE 0 END" for i in range(2, k))
    basis = f"""[CASE WHEN j = i THEN r / h WHEN j = i + 1 THEN l / h ELSE 0 END + (r * r * r / h - h * r) / 6 * bend[i][j]
        + (l * l * l / h - h * l) / 6 * bend[i + 1][j] FOR j IN range(1, {k + 1})]"""
    placed = lambda rows: f"""SELECT * EXCLUDE (h, l, r, i, bend), {basis} AS b FROM (
        SELECT *, k[i + 1] - k[i] AS h, x - k[i] AS l, k[i + 1] - x AS r FROM (SELECT *, 1 + {here} AS i FROM {rows} JOIN sm_bend USING (g)))"""  # noqa: E731
    gram = "[" + ", ".join("[" + ", ".join(f"sum(b[{min(i, j)}] * b[{max(i, j)}])" for j in range(1, k + 1)) + "]" for i in range(1, k + 1)) + "]"
    cross = "[" + ", ".join(f"sum(b[{i}] * y)" for i in range(1, k + 1)) + "]"

    def scored(level: int, penalties: str) -> str:
        """`sm_best{level}`: the penalty of the least score among ``penalties`` (g, p)."""
        system = f"[[band[i][j] / (pow(10::DOUBLE, p) * weight) + middle[i][j] FOR j IN range(1, {inner + 1})] FOR i IN range(1, {inner + 1})]"
        return f"""sm_try{level} AS ({penalties}),
    {_inverse(f'sm_bent{level}', f'(SELECT * FROM sm_try{level} JOIN sm_system USING (g))', 'g, p', system, inner)},
    sm_fit{level} AS (
        SELECT *, yy - 2 * {total('beta[i] * c[i]', k)} + {total('beta[i] * gb[i]', k)} AS rss FROM (
            SELECT *, [list_sum([gram[i][j] * beta[j] FOR j IN range(1, {k + 1})]) FOR i IN range(1, {k + 1})] AS gb FROM (
                SELECT *, [start[i] - list_sum([across[j][i] * d[j] FOR j IN range(1, {inner + 1})]) FOR i IN range(1, {k + 1})] AS beta,
                    {k} - {total(f'list_sum([inv[i][j] * middle[j][i] FOR j IN range(1, {inner + 1})])', inner)} AS edf
                FROM (SELECT *, [list_sum([inv[i][j] * wanted[j] FOR j IN range(1, {inner + 1})]) FOR i IN range(1, {inner + 1})] AS d
                    FROM sm_bent{level} JOIN sm_system USING (g))))),
    sm_best{level} AS (SELECT g, arg_min(p, n * greatest(rss, 0) / pow(n - edf, 2)) AS best FROM sm_fit{level} GROUP BY g)"""

    finer = lambda level, reach: f"SELECT g, best - {reach}::DOUBLE + i * {reach}::DOUBLE / 20 AS p FROM sm_best{level}, range(41) r(i)"
    return f"""sm_points AS ({source}),
    sm_knots AS (
        SELECT g, quantile_cont(x, [{', '.join(f'{i / (k - 1)!r}' for i in range(k))}]) AS k FROM (SELECT DISTINCT g, x FROM sm_points) GROUP BY g),
    sm_bands AS (
        SELECT *, [[CASE WHEN j = i THEN 1 / h[i] WHEN j = i + 1 THEN -1 / h[i] - 1 / h[i + 1] WHEN j = i + 2 THEN 1 / h[i + 1] ELSE 0 END
                FOR j IN range(1, {k + 1})] FOR i IN range(1, {inner + 1})] AS diffs,
            [[CASE WHEN j = i THEN (h[i] + h[i + 1]) / 3 WHEN j = i + 1 THEN h[j] / 6 WHEN j = i - 1 THEN h[i] / 6 ELSE 0 END
                FOR j IN range(1, {inner + 1})] FOR i IN range(1, {inner + 1})] AS band
        FROM (SELECT *, [k[i + 1] - k[i] FOR i IN range(1, {k})] AS h FROM sm_knots)),
    {_inverse('sm_band', 'sm_bands', 'g', 'band', inner)},
    sm_bend AS (
        SELECT g, k, diffs, band, list_concat([[0::DOUBLE FOR j IN range({k})]], list_concat(solved, [[0::DOUBLE FOR j IN range({k})]])) AS bend,
            {total(f'list_sum([diffs[j][i] * solved[j][i] FOR j IN range(1, {inner + 1})])', k)} AS bending
        FROM (SELECT *, {_product('inv', 'diffs', inner, inner, k)} AS solved FROM sm_bands JOIN sm_band USING (g))),
    sm_sums AS (
        SELECT g, count(*) AS n, sum(y * y) AS yy, {gram} AS gram, {cross} AS c FROM ({placed('sm_points')}) GROUP BY g),
    {_inverse('sm_free', 'sm_sums', 'g', 'gram', k)},
    sm_system AS (
        SELECT *, {_product('across', 'diffs', inner, k, inner, 'b')} AS middle,
            [list_sum([across[i][j] * c[j] FOR j IN range(1, {k + 1})]) FOR i IN range(1, {inner + 1})] AS wanted
        FROM (SELECT g, n, yy, gram, c, band, diffs, {total('gram[i][i]', k)} / bending AS weight, inv AS free,
                [list_sum([inv[i][j] * c[j] FOR j IN range(1, {k + 1})]) FOR i IN range(1, {k + 1})] AS start,
                {_product('diffs', 'inv', inner, k, k)} AS across
            FROM sm_sums JOIN sm_free USING (g) JOIN sm_bend USING (g))),
    {scored(1, 'SELECT g, -8 + i * 0.25::DOUBLE AS p FROM sm_sums, range(81) r(i)')},
    {scored(2, finer(1, 0.25))},
    {scored(3, finer(2, 0.0125))},
    sm_last AS (
        SELECT f.g, f.beta, f.edf, f.rss / (f.n - f.edf) AS scale,
            [[f.free[i][j] - list_sum([list_sum([f.across[a][i] * f.inv[a][b] FOR a IN range(1, {inner + 1})]) * f.across[b][j] FOR b IN range(1, {inner + 1})])
                FOR j IN range(1, {k + 1})] FOR i IN range(1, {k + 1})] AS spread
        FROM sm_fit3 f JOIN sm_best3 o ON f.g = o.g AND f.p = o.best),
    sm_grid AS (SELECT g, i AS point, k[1] + i * (k[{k}] - k[1]) / 79 AS x FROM sm_knots, range(80) r(i)),
    smooth AS (
        SELECT g, CAST(point AS INTEGER) AS point, x, fit, se, fit - 2 * se AS lower, fit + 2 * se AS upper, edf FROM (
            SELECT *, {total('b[i] * beta[i]', k)} AS fit,
                sqrt(greatest(scale * {total(f'b[i] * list_sum([spread[i][j] * b[j] FOR j IN range(1, {k + 1})])', k)}, 0)) AS se
            FROM ({placed('sm_grid')}) JOIN sm_last USING (g)))"""


def _published() -> str:
    rows = [
        f"('{metric}', {month + 1}, {PUBLISHED_TRENDS[f'{name}_slope'][month]}::DOUBLE, "
        f"{PUBLISHED_TRENDS[f'{name}_slope_error'][month]}::DOUBLE)"
        for metric, name in MEASURES.items()
        for month in range(12)
    ]
    return f"published(metric, month, published_slope, published_error) AS (VALUES {', '.join(rows)})"


def _positions(source: str, order: str = "event_id") -> str:
    kept = " AND ".join(f"NOT pos BETWEEN {lo} AND {hi}" for lo, hi in BAD_POSITIONS)
    return f"""numbered AS (SELECT *, row_number() OVER (ORDER BY {order}) AS pos FROM {source}),
    kept AS (SELECT * FROM numbered WHERE {kept})"""


_MONTHS = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"
_LONG = "SELECT site, date, wind_spd, '{0}' AS var, {0}::DOUBLE AS value FROM combined"


def oracle_queries() -> dict[str, str]:
    bad_times = " AND ".join(
        f"NOT (site = '{s}' AND ts BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}')" for s, a, b in BAD_TIMES
    )
    band_line = _line("combined", "month", "year", "wind_sd")
    obs_parts = f"""{_OBS}, parts AS (
        SELECT *, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, hour(ts)::INTEGER AS hour
        FROM obs)"""
    regression = _regression("combined", "wind_sd", _TWO_TERMS)
    predicted = f"""{_COMBINED}, {regression},
    checked AS (
        SELECT site, date, wind_sd AS actual, (SELECT estimate FROM fit WHERE term = 'intercept')
            + wind_spd * (SELECT estimate FROM fit WHERE term = 'wind_spd')
            + t_2m * (SELECT estimate FROM fit WHERE term = 't_2m') AS predicted
        FROM combined)"""
    trends = _select("metric month n slope~ intercept~ std_error~ t_value~ r2~ adj_r2~ lo~ hi~", "lines", _METRICS)
    mean_trends = _select(
        "metric month n slope~ std_error~ r2~", "lines",
        f"""{_COMBINED}, month_means AS (
            SELECT month, year, avg(wind_spd) AS a, avg(p) AS b, avg(wind_sd) AS c, avg(t_2m) AS d
            FROM combined GROUP BY month, year),
        long_means AS (
            SELECT 'mean_wind_spd' AS metric, month, year AS x, a AS y FROM month_means
            UNION ALL SELECT 'mean_p', month, year, b FROM month_means
            UNION ALL SELECT 'mean_wind_sd', month, year, c FROM month_means
            UNION ALL SELECT 'mean_t_2m', month, year, d FROM month_means),
        {_line('long_means', 'metric, month')}""",
    )
    return {
        "scan_clean_minutes": _select(
            f"{_KEY_COLUMNS} minute {_RAW_READINGS}", "cleaned", f"{_MINUTES}, {_cleaned('minutes', -999, True)}"
        ),
        "scan_clean_hours": _select(
            f"{_KEY_COLUMNS} {_RAW_READINGS}", "cleaned", f"{_HOURS}, {_cleaned('hours', -99, True)}"
        ),
        "text_minutes": _select(
            f"{_KEY_COLUMNS} minute {_RAW_READINGS}", "cleaned", f"{_MINUTES}, {_cleaned('minutes', -999, False)}"
        ),
        "text_hours": _select(
            f"{_KEY_COLUMNS} {_RAW_READINGS}", "cleaned", f"{_HOURS}, {_cleaned('hours', -99, False)}"
        ),
        "stored_hours": _select(
            f"{_KEY_COLUMNS} date t_2m~ wind_spd~ wind_sd~ gust_time", "combined", _COMBINED, "year >= 2015"
        ),
        "hour_timestamps": f"""WITH {_HOURS}
            SELECT {KEYS}, {_INSTANT} AS date, CAST({_INSTANT} AS DATE) AS calendar_day FROM hours""",
        "minute_timestamps": """SELECT event_id, date_trunc('minute', ts) AS date, CAST(ts AS DATE) AS calendar_day
            FROM events""",
        "hourly_summary": _select(_SUMMARY_COLUMNS, "summary", f"{_MINUTES}, {_summary('minutes', 'summary')}"),
        "hourly_summary_skipna": _select(
            _SUMMARY_COLUMNS, "summary", f"{_MINUTES}, {_summary('minutes', 'summary', propagate=False)}"
        ),
        "hourly_summary_refined": _select(
            _SUMMARY_COLUMNS, "summary", f"{_MINUTES}, {_summary('minutes', 'summary', refined=True)}"
        ),
        "complete_hours": _select(_SUMMARY_COLUMNS, "complete", _complete()),
        "combined": _select(
            f"{_KEY_COLUMNS} {_READINGS} {_STAT_COLUMNS} date",
            f"(SELECT h.*, s.* EXCLUDE ({KEYS}) FROM hours h LEFT JOIN complete s USING ({KEYS}))",
            f"{_HOURS}, {_complete()}",
        ),
        "combined_complete": _select(f"{_KEY_COLUMNS} {_READINGS} {_STAT_COLUMNS} date", "combined", _COMBINED),
        "combined_refined": _select(
            f"{_KEY_COLUMNS} {_READINGS} {_STAT_COLUMNS} date",
            f"(SELECT h.*, s.* EXCLUDE ({KEYS}) FROM hours h JOIN complete s USING ({KEYS}))",
            f"{_HOURS}, {_complete(refined=True)}",
            "t_2m IS NOT NULL AND wind_spd IS NOT NULL",
        ),
        "combined_any_site": _select(
            f"{_KEY_COLUMNS} {_READINGS} {_STAT_COLUMNS} date",
            f"""(SELECT h.*, s.* EXCLUDE ({KEYS}, date), {_INSTANT.replace('(', '(h.').replace(', ', ', h.').replace('h.0', '0')} AS date
            FROM hours h LEFT JOIN complete s USING ({KEYS})
            WHERE h.t_2m IS NOT NULL AND h.wind_spd IS NOT NULL
                AND {_INSTANT.replace('(', '(h.').replace(', ', ', h.').replace('h.0', '0')} IN (SELECT date FROM complete))""",
            f"{_HOURS}, {_complete()}",
        ),
        "left_join_suffixed": _select(
            "site date t_2m~ gust_time new_gust_time wind_mean_x~ wind_mean_y~ wind_sd_x~ wind_sd_y~ wind_max_x~ "
            "wind_max_y~ wind_min_x~ wind_min_y~ wind_med_x~ wind_med_y~",
            """(SELECT c.site, c.date, c.t_2m, c.gust_time, s.gust_time AS new_gust_time,
                c.wind_mean AS wind_mean_x, s.wind_mean AS wind_mean_y, c.wind_sd AS wind_sd_x, s.wind_sd AS wind_sd_y,
                c.wind_max AS wind_max_x, s.wind_max AS wind_max_y, c.wind_min AS wind_min_x, s.wind_min AS wind_min_y,
                c.wind_med AS wind_med_x, s.wind_med AS wind_med_y
            FROM combined c LEFT JOIN complete s ON c.site = s.site AND c.date = s.date)""",
            _COMBINED,
        ),
        "stored_join": _select(
            f"{_KEY_COLUMNS} t_2m~ wind_spd~ wind_sd~ gust_time nrow", f"(SELECT * FROM hours h LEFT JOIN complete s USING ({KEYS}))",
            f"{_HOURS}, {_complete()}",
        ),
        "stored_join_suffixed": _select(
            f"{_KEY_COLUMNS} wind_mean_x~ wind_mean_y~ wind_max_x~ wind_max_y~",
            f"""(SELECT a.*, b.wind_mean AS wind_mean_y, b.wind_max AS wind_max_y
            FROM (SELECT {KEYS}, wind_mean AS wind_mean_x, wind_max AS wind_max_x FROM complete) a
            LEFT JOIN (SELECT {KEYS}, wind_mean, wind_max FROM complete WHERE wind_max > 5) b USING ({KEYS}))""",
            _complete(),
        ),
        "stability": _select(
            "site date t_difference~ richardson_bulk~ avg_temp_K~ delta_p~ p_10m~ pot_temp_2m~ pot_temp_10m~ "
            "delta_theta~ richardson_potential~",
            "stable", _STABLE,
        ),
        "finite_complete_cases": _select(
            f"{_KEY_COLUMNS} wind_dir~ rh~ ratio~ inverse~",
            f"""(SELECT {KEYS}, CASE WHEN wind_dir > -99 THEN wind_dir END AS wind_dir, CASE WHEN rh > -99 THEN rh END AS rh,
                t_2m / NULLIF(wind_spd, 0) AS ratio, 9.81::DOUBLE / NULLIF(t_2m, 0) AS inverse FROM hours)""",
            _HOURS,
            "wind_dir IS NOT NULL AND rh IS NOT NULL AND ratio IS NOT NULL AND inverse IS NOT NULL",
        ),
        "plausibility_caps": _select(
            "site date wind_sd~ wind_max~ wind_min~", "combined", _COMBINED,
            "wind_sd <= 5 AND wind_max <= 11 AND wind_min > 1",
        ),
        "drop_negative_raw": _select(f"{_KEY_COLUMNS} minute wind_spd", "minutes", _MINUTES, "wind_spd >= 0"),
        "row_numbers": "SELECT event_id, row_number() OVER (ORDER BY event_id) AS row FROM events",
        "minute_positions": f"""WITH {_MINUTES} SELECT {KEYS}, minute, wind_spd,
            row_number() OVER (ORDER BY {KEYS}, minute, wind_spd) AS row FROM minutes""",
        "combined_exclusions": _select(
            f"{_KEY_COLUMNS} t_2m~ wind_sd~", "kept", f"{_COMBINED}, {_positions('combined', KEYS + ', t_2m, wind_sd')}"
        ),
        "clean_station_minutes": _select(
            f"{_KEY_COLUMNS} minute wind_spd t_2m", "kept",
            f"{_MINUTES}, usable AS (SELECT * FROM minutes WHERE wind_spd >= 0), {_positions('usable', KEYS + ', minute, wind_spd, t_2m')}",
        ),
        "exclude_ranges": _select("event_id site wind_spd~", "kept", f"{_OBS}, {_positions('obs')}"),
        "exclude_time_ranges": _select("event_id site wind_spd~", "obs", _OBS, bad_times),
        "clean_minute_rows": _select(
            "event_id wind_spd~", "kept",
            f"""{_OBS}, lowered AS (SELECT event_id, wind_spd - 0.5::DOUBLE AS wind_spd FROM obs WHERE wind_spd - 0.5::DOUBLE >= 0),
            {_positions('lowered')}""",
        ),
        "high_gusts": _select("site date month t_2m~ wind_sd~", "combined", _COMBINED, "wind_sd > 3 AND wind_sd < 5"),
        "high_gust_mean_temp": _select(
            "mean_t_2m~", "(SELECT avg(t_2m) AS mean_t_2m FROM combined WHERE wind_sd > 3 AND wind_sd < 5)", _COMBINED
        ),
        "month_view": _select("site date year t_2m~ wind_sd~", "combined", _COMBINED, "month = 8"),
        "time_slice": _select(
            "event_id ts wind_spd~", "obs", _OBS, "CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'"
        ),
        "hour_slice_band": _select(
            "event_id ts wind_spd~", "obs", _OBS,
            "ts BETWEEN TIMESTAMP '2024-01-11 00:00:00' AND TIMESTAMP '2024-01-11 23:00:00' AND wind_spd BETWEEN 2 AND 9",
        ),
        "event_windows": _select(
            "site event_hour event_id ts wind_spd~",
            f"""(SELECT o.site, s.date AS event_hour, o.event_id, o.ts, o.wind_spd
            FROM obs o JOIN summary s ON o.site = s.site AND s.wind_sd > {EVENT_SD}
                AND o.ts BETWEEN s.date - INTERVAL 6 HOURS AND s.date + INTERVAL 6 HOURS)""",
            f"{obs_parts}, {_summary('parts', 'summary')}",
        ),
        "gust_counts": f"""WITH {_COMBINED} SELECT month, year, count(*) AS n FROM combined WHERE wind_sd > {HIGH_SD}
            GROUP BY month, year""",
        "gust_counts_zero_filled": f"""WITH {_COMBINED}, {_counts('combined', f'wind_sd > {HIGH_SD}', _SPAN)}
            SELECT month, year, n FROM filled""",
        "thaw_counts_zero_filled": f"""WITH {_COMBINED}, {_counts('combined', 't_2m > -1.8::DOUBLE', _SEEN_SPAN)}
            SELECT month, year, n FROM filled""",
        "counts_excluding_day": f"""WITH {_COMBINED},
            {_counts('combined', f'wind_sd > {HIGH_SD} AND NOT (month = 8 AND day = 1)', _SPAN)}
            SELECT month, year, n FROM filled""",
        "annual_means": _select(
            "year mean_wind_spd~", "(SELECT year, avg(wind_spd) AS mean_wind_spd FROM combined GROUP BY year)", _COMBINED,
            digits=MEAN_DIGITS,
        ),
        "month_year_means": _select(
            "month year mean_wind_spd~ mean_p~ mean_wind_sd~ mean_t_2m~",
            """(SELECT month, year, avg(wind_spd) AS mean_wind_spd, avg(p) AS mean_p, avg(wind_sd) AS mean_wind_sd,
                avg(t_2m) AS mean_t_2m FROM combined GROUP BY month, year)""",
            _COMBINED, digits=MEAN_DIGITS,
        ),
        "correlation": _select(
            "correlation~ pairs", "(SELECT corr(wind_sd, p) AS correlation, count(*) AS pairs FROM combined)", _COMBINED
        ),
        "monthly_trends": trends,
        "trends_of_stored_cells": trends,
        "mean_trends_of_stored_cells": mean_trends,
        "trend_significance": _select(
            "metric month df t_value~ p_value~", f"(SELECT *, {_p_value()} AS p_value FROM lines)", _METRICS
        ),
        "gust_trend_figure": _select(
            "month label slope~ lo~ hi~", f"(SELECT *, ({_MONTHS})[month] AS label FROM lines WHERE metric = 'gust_count')",
            _METRICS,
        ),
        "literal_trend_table": _select(
            "metric month published_slope~ published_error~ slope_gap~",
            "(SELECT *, slope - published_slope AS slope_gap FROM lines JOIN published USING (metric, month))",
            f"{_METRICS}, {_published()}",
        ),
        "month_mean_trends": mean_trends,
        "high_gust_trend": _select(
            "month n slope~ intercept~ std_error~ intercept_error~ sigma~ r2~", "lines",
            f"{_COMBINED}, high AS (SELECT * FROM combined WHERE wind_sd > {HIGH_SD}), {_line('high', 'month', 'year', 'wind_sd')}",
        ),
        "trend_band": _select(
            "month x~ fit~ se_fit~ lower~ upper~",
            """(SELECT month, x, fit, se_fit, fit - t * se_fit AS lower, fit + t * se_fit AS upper FROM (
                SELECT month, y::DOUBLE AS x, intercept + slope * y AS fit, tan(lo) * sqrt(df) AS t,
                    sigma * sqrt(1 / n + (y - mx) * (y - mx) / sxx) AS se_fit
                FROM line_fits JOIN (SELECT month, lo FROM bisection WHERE k = 55) USING (month), years))""",
            f"""{_COMBINED}, {band_line},
            years AS (SELECT unnest(range({FIRST_YEAR}, {LAST_YEAR + 1})) AS y),
            bisection AS (
                SELECT month, df, 0 AS k, 0::DOUBLE AS lo, pi() / 2 AS hi FROM line_fits
                UNION ALL
                SELECT month, df, k + 1, CASE WHEN share < 0.95::DOUBLE THEN mid ELSE lo END, CASE WHEN share < 0.95::DOUBLE THEN hi ELSE mid END
                FROM (SELECT *, {_t_share('mid', 'df')} AS share FROM (SELECT *, (lo + hi) / 2 AS mid FROM bisection WHERE k < 55)))""",
            recursive=True,
        ),
        "sufficient_statistics": _select(
            "row col row_mean~ col_mean~ n comoment~",
            "(" + " UNION ALL ".join(
                f"""SELECT '{a}' AS row, '{b}' AS col, avg({a}) AS row_mean, avg({b}) AS col_mean, count(*) AS n,
                count(*) * covar_pop({a}, {b}) AS comoment FROM frame"""
                for a, b in [("wind_spd", "wind_spd"), ("wind_spd", "t_2m"), ("wind_spd", "wind_sd"), ("t_2m", "t_2m"),
                             ("t_2m", "wind_sd"), ("wind_sd", "wind_sd")]
            ) + ")",
            f"""{_COMBINED}, frame AS (SELECT wind_spd, t_2m, wind_sd FROM combined
                WHERE wind_spd IS NOT NULL AND t_2m IS NOT NULL AND wind_sd IS NOT NULL)""",
        ),
        "multiple_regression": _select(
            "term n df estimate~ std_error~ t_value~ p_value~ r2~ sigma~",
            f"(SELECT *, {_p_value()} AS p_value FROM fit_t)", f"{_COMBINED}, {regression}", recursive=True,
        ),
        "predicted_vs_actual": _select("site date actual~ predicted~", "checked", predicted, recursive=True),
        "prediction_correlation": _select(
            "correlation~ pairs", "(SELECT corr(predicted, actual) AS correlation, count(*) AS pairs FROM checked)",
            predicted, recursive=True,
        ),
        "factorial_regression": _select(
            "term n df estimate~ std_error~ t_value~ r2~", "fit_t",
            f"{_STABLE}, {_regression('stable', 'wind_sd', _FACTORIAL)}", recursive=True,
        ),
        "equal_width_bins": _select(
            "site date wind_spd~ bin bin_lo~ bin_hi~", "binned", f"{_COMBINED}, {_bins('combined', 'wind_spd', 20)}"
        ),
        "boxplot_stats": _select(
            "bin n q1~ median~ q3~ whisker_lo~ whisker_hi~ outliers bin_lo~ bin_hi~",
            "(SELECT b.*, e.bin_lo, e.bin_hi FROM boxes b JOIN (SELECT DISTINCT bin, bin_lo, bin_hi FROM binned) e USING (bin))",
            f"{_COMBINED}, {_bins('combined', 't_2m', 20)}, {_boxes('binned', 'bin', 'wind_sd')}",
        ),
        "boxplot_by_month": _select(
            "month n q1~ median~ q3~ whisker_lo~ whisker_hi~ outliers", "boxes",
            f"{_COMBINED}, month_values AS (SELECT month, wind_max FROM combined), {_boxes('month_values', 'month', 'wind_max')}",
        ),
        "boxplot_with_gaps": _select(
            "month n q1~ median~ q3~ whisker_lo~ whisker_hi~ outliers", "boxes",
            f"{_HOURS}, inverses AS (SELECT month, 100::DOUBLE / NULLIF(t_2m, 0) AS inverse FROM hours), {_boxes('inverses', 'month', 'inverse')}",
        ),
        "boxplot_outliers": _select(
            "event_id hour wind_spd~", "fenced",
            f"""{_OBS}, by_hour AS (SELECT event_id, wind_spd, CAST(hour(ts) AS INTEGER) AS hour FROM obs),
            {_boxes('by_hour', 'hour', 'wind_spd')}""",
            "NOT near",
        ),
        "density_2d": _select(
            _CELL_COLUMNS, "density",
            f"{_COMBINED}, {_cells('combined', 'wind_spd', 'round(wind_sd, 6)', (30, 30), ((0, 25), (0, 5)))}",
        ),
        "density_cells_free": _select(
            _CELL_COLUMNS, "density", f"{_STABLE}, {_cells('stable', 't_difference', 'round(wind_sd, 6)', (100, 100), None)}"
        ),
        "kde": _select("point x~ density~ bw~ n", "kde", f"{_OBS}, {_kde('obs', None, (0.0, 20.0))}"),
        "kde_by_group": _select("site point x~ density~ bw~ n", "kde", f"{_OBS}, {_kde('obs', 'site', None)}"),
        "scatter_data": _select("date p~ wind_sd~", "combined", _COMBINED, "wind_sd <= 5"),
        "sample_rows": _select(
            "event_id wind_spd~",
            "(SELECT * FROM obs ORDER BY md5(CAST(event_id AS VARCHAR) || ':0'), event_id LIMIT 200)", _OBS,
        ),
        "minute_stats_long": _select(
            "site date wind_spd~ var value~",
            "(" + " UNION ALL ".join(_LONG.format(c) for c in ("wind_max", "wind_min", "wind_sd", "gust_time")) + ")",
            _COMBINED,
        ),
        "gust_indicator": f"WITH {_COMBINED} SELECT site, date, gust_time > 0 AS has_gusts FROM combined",
        "model_frame": _select(
            "wind_sd~ t_2m~ wind_spd~ bulk_richardson~ t_2m_squared~",
            "(SELECT wind_sd, t_2m, wind_spd, richardson_bulk AS bulk_richardson, t_2m * t_2m AS t_2m_squared FROM stable)",
            _STABLE,
            "wind_spd IS NOT NULL AND wind_sd IS NOT NULL AND t_2m IS NOT NULL AND bulk_richardson IS NOT NULL",
        ),
        "prediction_grid": _select(
            "point t_2m~",
            """(SELECT CAST(i AS INTEGER) AS point, lo + i * ((hi - lo) / 29) AS t_2m
            FROM (SELECT min(t_2m) AS lo, max(t_2m) AS hi FROM combined), range(30) r(i))""",
            _COMBINED,
        ),
        "draw_intervals": _select(
            f"{_KEY_COLUMNS} mean~ lower~ upper~",
            f"""(SELECT {KEYS}, avg(wind_spd) AS mean, quantile_cont(wind_spd, 0.05) AS lower,
                quantile_cont(wind_spd, 0.95) AS upper FROM minutes WHERE wind_spd >= 0 GROUP BY {KEYS})""",
            _MINUTES,
        ),
        "posterior_map": _select(
            "parameter mean~ sd~ lower~ upper~", "mode_interval",
            f"{_COMBINED}, {_map_model('sd_multi', 'combined')}", recursive=True,
        ),
        "posterior_map_quadratic": _select(
            "parameter mean~ sd~ lower~ upper~", "mode_interval",
            f"{_COMBINED}, {_map_model('sd_t', 'combined')}", recursive=True,
        ),
        "posterior_map_richardson": _select(
            "parameter mean~ sd~ lower~ upper~", "mode_interval",
            f"{_STABLE}, {_map_model('sd_multi_ri', 'stable')}", recursive=True,
        ),
        "posterior_mean_band": _select(
            "point t_2m~ mean~ lower~ upper~",
            _map_band(
                "sd_t",
                """(SELECT CAST(i AS INTEGER) AS point, lo + i * ((hi - lo) / 29) AS t_2m
                FROM (SELECT min(t_2m) AS lo, max(t_2m) AS hi FROM combined), range(30) r(i))""",
                "point, t_2m",
            ),
            f"{_COMBINED}, {_map_model('sd_t', 'combined')}", recursive=True,
        ),
        "predictive_density": _select(
            "x_bin y_bin x_lo~ y_lo~ expected~ density~ ndensity~ log_ndensity~",
            """(SELECT x_bin, CAST(edge AS INTEGER) AS y_bin, (x_bin - 1)::DOUBLE AS x_lo, -2 + (edge - 1) * 0.4::DOUBLE AS y_lo, expected,
                expected / sum(expected) OVER () AS density, expected / max(expected) OVER () AS ndensity,
                ln(expected / max(expected) OVER ()) AS log_ndensity
            FROM (SELECT *, below - lag(below) OVER (PARTITION BY x_bin ORDER BY edge) AS expected FROM below) WHERE edge > 0)""",
            f"{_COMBINED}, {_map_model('sd_w', 'combined')}, {_expected(20, 25, -2.0, 8.0)}", recursive=True,
        ),
        "predictive_boxes": _select(
            "x_bin n q1~ median~ q3~ fence_lo~ fence_hi~ outside~", "predicted_boxes",
            f"{_COMBINED}, {_map_model('sd_w', 'combined')}, {_expected(10, 128, -4.0, 12.0)}, {_expected_boxes(128, -4.0, 12.0)}", recursive=True,
        ),
        "posterior_marginals": _select(
            "parameter mean~ sd~ lower~ upper~", "marginals",
            f"{_COMBINED}, {_map_model('sd_t', 'combined', nodes=True)}, {_marginals('sd_t')}", recursive=True,
        ),
        "posterior_mean_band_exact": _select(
            "point t_2m~ mean~ lower~ upper~", "exact_band",
            f"""{_COMBINED}, {_map_model('sd_t', 'combined', nodes=True)},
            {_exact_band('sd_t', '''(SELECT CAST(i AS INTEGER) AS point, lo + i * ((hi - lo) / 29) AS t_2m
                FROM (SELECT min(t_2m) AS lo, max(t_2m) AS hi FROM combined), range(30) r(i))''', 'point, t_2m')}""",
            recursive=True,
        ),
        "posterior_map_bounded": _select(
            "parameter mode~ mean~ sd~ lower~ upper~ bound", "bounded", f"{_COMBINED}, {_bounded()}", recursive=True,
        ),
        "smooth_curve": _select(
            "point x~ fit~ se~ lower~ upper~ edf~", "smooth",
            f"{_COMBINED}, {_smooth('SELECT 1 AS g, t_2m AS x, wind_sd AS y FROM combined')}", recursive=True,
        ),
        "smooth_by_variable": _select(
            "var point x~ fit~ se~ lower~ upper~ edf~", "(SELECT g AS var, * EXCLUDE (g) FROM smooth)",
            _COMBINED + ", long AS (" + " UNION ALL ".join(_LONG.format(c) for c in ("wind_max", "wind_min", "wind_sd", "gust_time")) + "), "
            + _smooth("SELECT var AS g, wind_spd AS x, value AS y FROM long WHERE wind_spd BETWEEN 0 AND 19"), recursive=True,
        ),
        "smooth_figure": _select(
            "point x~ fit~ se~ lower~ upper~ edf~", "smooth",
            f"{_COMBINED}, {_smooth('SELECT 1 AS g, t_2m + t_2m * t_2m AS x, wind_sd AS y FROM combined WHERE t_2m + t_2m * t_2m BETWEEN 0 AND 1600')}",
            recursive=True,
        ),
        "zero_inflated_parameters": _select(
            "n p_zero~ a~ b1~ b2~ p_zero_sd~ a_sd~ b1_sd~ b2_sd~",
            "(SELECT CAST((SELECT n FROM zi_shape) AS BIGINT) AS n, * FROM zi)", f"{_STABLE}, {_zero_inflated(4)}", recursive=True,
        ),
        "zero_inflated_fit": _select(
            "t_2m~ p~ expected~",
            """(SELECT t_2m, 1 / (1 + exp(-(a + b1 * t_2m + b2 * t_2m * t_2m))) AS p,
                (1 - p_zero) * 4 / (1 + exp(-(a + b1 * t_2m + b2 * t_2m * t_2m))) AS expected
            FROM zi, (SELECT lo + i * ((hi - lo) / 29) AS t_2m
                FROM (SELECT min(t_2m) AS lo, max(t_2m) AS hi FROM stable), range(30) r(i)))""",
            f"{_STABLE}, {_zero_inflated(4)}", recursive=True,
        ),
        "predictive_band": _select(
            "site date wind_spd~ wind_sd~ mean~ lower~ upper~",
            _map_band("sd_w", "combined", "site, date, wind_spd, wind_sd", predictive=True),
            f"{_COMBINED}, {_map_model('sd_w', 'combined')}", recursive=True,
        ),
        "posterior_map_models": _select(
            "model parameter mean~ sd~",
            "(" + " UNION ALL ".join(
                f"(WITH RECURSIVE {_map_model(name, 'stable')} SELECT '{name}' AS model, parameter, mean, sd FROM mode)"
                for name in TWO_TERM_MODELS
            ) + ")",
            _STABLE,
        ),
    }

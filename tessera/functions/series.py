"""Time-axis and cross-section operators as SQL fragments.

``x`` is any SQL expression over a dense panel (symbol, t_idx, ...); missing
is NULL throughout. Fragments nest only through named stages, because a window
may not hold a window.
"""

from __future__ import annotations

EPS = "1e-12"
#: Sessions a year, whatever their real spacing: annualised figures are by convention.
YEAR = 252
_BY = "partition by symbol order by t_idx"


def at_least(x: str, eps: str = EPS) -> str:
    """max(x, eps) that keeps missing values missing."""
    return f"case when ({x}) is not null then greatest({x}, {eps}) end"


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def shift(x: str, k: int) -> str:
    return f"lag({x}, {k}) over ({_BY})" if k >= 0 else f"lead({x}, {-k}) over ({_BY})"


def trailing(w: int) -> str:
    """The inclusive frame of ``w`` sessions."""
    return f"({_BY} rows between {w - 1} preceding and current row)"


def before(w: int) -> str:
    """The ``w`` sessions strictly before the current one."""
    return f"({_BY} rows between {w} preceding and 1 preceding)"


def roll(agg: str, x: str, w: int) -> str:
    return f"{agg}({x}) over {trailing(w)}"


def roll_mean(x: str, w: int) -> str:
    return roll("avg", x, w)


def roll_std(x: str, w: int) -> str:
    return roll("stddev_pop", x, w)


def strict_past(agg: str, x: str, w: int) -> str:
    """``agg`` over the ``w`` sessions before this one; missing until there are ``w``."""
    return f"case when t_idx >= {w} then {agg}({x}) over {before(w)} end"


def pct_change(x: str, k: int) -> str:
    prev = shift(x, k)
    return f"(({x}) - {prev}) / ({at_least(f'abs({prev})')})"


def ffill(x: str) -> str:
    """Last present value up to here, by grouping on the count of present values (see ``ffill_group``)."""
    return f"max({x}) over (partition by symbol, {x}_grp)"


def ffill_group(x: str) -> str:
    return f"count({x}) over ({_BY} rows between unbounded preceding and current row)"


def z_trailing(x: str, w: int, least: int) -> str:
    """Trailing z-score with the sample deviation and a least number of values."""
    f = trailing(w)
    return f"case when count({x}) over {f} >= {least} then (({x}) - avg({x}) over {f}) / nullif(stddev_samp({x}) over {f}, 0) end"


def cs_rank(x: str, by: str = "t_idx", tie: str = "symbol") -> str:
    """Ordinal rank in 0..1 of the present values of one session; ties by symbol. One sort: missing values come last."""
    w = f"partition by {by} order by {x} nulls last, {tie}"
    n = f"greatest(count({x}) over ({w} rows between unbounded preceding and unbounded following) - 1, 1)"
    return f"case when ({x}) is not null then cast(row_number() over ({w}) - 1 as double) / {n} end"


def cs_rank_avg(x: str, by: str = "t_idx") -> str:
    """Average-tie rank in (0, 1]: the mean of a tie's first and last place. One sort serves all three counts."""
    w = f"partition by {by} order by {x} nulls last"
    last = f"count({x}) over ({w} range between unbounded preceding and current row)"
    n = f"count({x}) over ({w} rows between unbounded preceding and unbounded following)"
    return f"case when ({x}) is not null then (rank() over ({w}) + {last}) / 2.0 / {n} end"


def cs_zscore(x: str, by: str = "t_idx") -> str:
    w = f"(partition by {by})"
    return f"(({x}) - avg({x}) over {w}) / ({at_least(f'stddev_pop({x}) over {w}')})"


def cs_demean(x: str, by: str = "t_idx") -> str:
    return f"(({x}) - avg({x}) over (partition by {by}))"


def growth(r: str, over: str = "") -> str:
    """Product of 1 + r; nothing is left from a return of -100 % or less on."""
    o = f" over {over}" if over else ""
    return f"case when min(1 + {r}){o} <= 0 then 0e0 else exp(sum(ln(case when 1 + {r} > 0 then 1 + {r} end)){o}) end"


def residual_std(y: str, x: str, w: int) -> str:
    """Deviation of what a regression of ``y`` on ``x`` leaves, over the ``w`` sessions before this one."""
    f = before(w)
    left = f"var_pop({y}) over {f} - pow(covar_pop({y}, {x}) over {f}, 2) / nullif(var_pop({x}) over {f}, 0)"
    return f"case when t_idx >= {w} then sqrt(greatest({left}, 0)) end"


def roll_least(agg: str, x: str, w: int, least: int) -> str:
    """``agg`` over a trailing frame once it holds ``least`` values."""
    return f"case when count({x}) over {trailing(w)} >= {least} then {agg}({x}) over {trailing(w)} end"


def corr(x: str, y: str) -> str:
    """Correlation; missing where either side does not vary."""
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def clip(x: str, lo: str, hi: str) -> str:
    return f"case when ({x}) is not null then least(greatest({x}, {lo}), {hi}) end"

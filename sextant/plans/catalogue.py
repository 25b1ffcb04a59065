"""Collects queries and their SQL."""

from __future__ import annotations


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function (spark, sf_dir) -> DataFrame under its name, with SQL that gives the same rows."""

        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def normal_sql(x: str) -> str:
    """The normal distribution function as SQL: a series that converges for all |x| below 7."""
    series = f"list_sum(list_transform(range(0, 110), lambda i: power({x}, 2 * i + 1) * 1.7724538509055159 / (power(2.0, i + 1) * gamma(i + 1.5))))"
    return f"(CASE WHEN {x} >= 7 THEN 1.0 WHEN {x} <= -7 THEN 0.0 ELSE 0.5 + exp(-({x}) * ({x}) / 2) / 2.5066282746310002 * {series} END)"


def wilder_sql(rows: str, n: int) -> str:
    """Recursive Wilder means m of x, with c values seen so far, of rows (symbol, pos, x); a missing x keeps m and fades its weight."""
    keep = f"(1 - 1.0::DOUBLE / {n})"
    return f"""SELECT symbol, pos, x::DOUBLE AS m, 1.0::DOUBLE AS w, (x IS NOT NULL)::INT AS c FROM {rows} WHERE pos = 1
 UNION ALL SELECT r.symbol, r.pos, CASE WHEN e.m IS NULL THEN r.x WHEN r.x IS NULL THEN e.m ELSE (e.w * {keep} * e.m + r.x / {n}) / (e.w * {keep} + 1.0 / {n}) END,
  CASE WHEN e.m IS NULL OR r.x IS NOT NULL THEN 1.0 ELSE e.w * {keep} END, e.c + (r.x IS NOT NULL)::INT FROM"""


def t_tail_sql(t: str, df: str) -> str:
    """P(T > t) of Student's distribution as SQL, by Simpson's rule over [0, |t|]."""
    density = f"power(1 + u * u / ({df}), -(({df}) + 1) / 2.0)"
    scale = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
    points = f"list_sum(list_transform(range(0, 801), lambda i: (CASE WHEN i IN (0, 800) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.replace('u * u', f'power(abs({t}) * i / 800.0, 2)')}))"
    return f"(0.5 - sign({t}) * {scale} * abs({t}) / 2400.0 * {points})"

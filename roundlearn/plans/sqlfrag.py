"""SQL fragments for the oracle side (DuckDB dialect)."""

from __future__ import annotations

from fractions import Fraction


def hash_sql(key: str, seed="42") -> str:
    return f"md5(concat('{seed}:', CAST({key} AS VARCHAR)))"


def rank_sql(key: str, seed="42", part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY {hash_sql(key, seed)}, {key})"


def ceil_frac_sql(n: str, frac) -> str:
    q = Fraction(str(frac))
    return f"((({n}) * {q.numerator} + {q.denominator - 1}) // {q.denominator})"


def split_case_sql(rank: str, n: str, test, val=None) -> str:
    t = ceil_frac_sql(n, test)
    if val is None:
        return f"CASE WHEN {rank} <= {t} THEN 'test' ELSE 'train' END"
    v = ceil_frac_sql(f"({n}) - {t}", val)
    return (f"CASE WHEN {rank} <= {t} THEN 'test' WHEN {rank} <= {t} + {v} THEN 'val' "
            f"ELSE 'train' END")


def prf_ctes(src: str, universe: str | None = None) -> str:
    """CTEs conf, sup, pp, tp, uni, pcm over ``src`` with columns (y, pred).
    ``pcm``: class, tp, pp, support, precision, recall, f1."""
    uni = universe or "SELECT y AS class FROM conf UNION SELECT pred FROM conf"
    return f"""conf AS (SELECT CAST(y AS VARCHAR) AS y, CAST(pred AS VARCHAR) AS pred, count(*) AS n
               FROM {src} GROUP BY 1, 2),
sup AS (SELECT y AS class, sum(n) AS support FROM conf GROUP BY y),
ppc AS (SELECT pred AS class, sum(n) AS pp FROM conf GROUP BY pred),
tpc AS (SELECT y AS class, sum(n) AS tp FROM conf WHERE y = pred GROUP BY y),
uni AS ({uni}),
pc AS (SELECT u.class, CAST(coalesce(tpc.tp, 0) AS BIGINT) AS tp, CAST(coalesce(ppc.pp, 0) AS BIGINT) AS pp,
              CAST(coalesce(sup.support, 0) AS BIGINT) AS support
       FROM uni u LEFT JOIN sup ON u.class = sup.class LEFT JOIN ppc ON u.class = ppc.class
       LEFT JOIN tpc ON u.class = tpc.class),
pcm AS (SELECT *, CASE WHEN pp > 0 THEN CAST(tp AS DOUBLE) / pp ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall,
               CASE WHEN pp + support > 0 THEN 2.0 * tp / (pp + support) ELSE 0.0 END AS f1 FROM pc)"""


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def bce_sql(x: str, z: str) -> str:
    return f"(greatest({x}, 0.0) - ({x}) * ({z}) + ln(1.0 + exp(-abs({x}))))"

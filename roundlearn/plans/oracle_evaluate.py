"""Independent SQL (DuckDB dialect) for the round evaluation: a global
window rank instead of buckets, unnested vectors instead of arrays, and
long-form windows instead of wide arrays. Used only as a test oracle."""

from roundlearn.operators.gradient import RIDGE, descent_sql
from roundlearn.operators.rounds import EMBEDDING_ROUNDS, config_sql, registry_rows

DESCENT_STEPS = 200            # of the SQL twins of fitted heads: enough for ten digits at the curvatures used
UNIT_CURVATURE = 0.5 * 2.001 + RIDGE      # features of length 1 and the constant


def heads_ctes(rounds=EMBEDDING_ROUNDS, test="0.4") -> str:
    """CTEs cfg, first, reg0, reg, d, r, s, tr, mu, heads (no leading WITH)."""
    from roundlearn.plans.sqlfrag import ceil_frac_sql
    return f"""cfg AS (SELECT * FROM {config_sql(rounds)}),
first AS (SELECT class, min(round) AS r0 FROM cfg GROUP BY class),
reg0 AS (SELECT c.round, c.pos, c.class FROM cfg c JOIN first f ON c.class = f.class AND c.round = f.r0),
reg AS (SELECT dense_rank() OVER (ORDER BY round) - 1 AS round,
               row_number() OVER (PARTITION BY round ORDER BY pos) AS pos, class,
               row_number() OVER (ORDER BY round, pos) AS class_order FROM reg0),
d AS (SELECT vec_id AS key, CAST(label AS VARCHAR) AS y, embedding,
             md5(concat('42:', CAST(vec_id AS VARCHAR))) AS h FROM embeddings),
r AS (SELECT *, row_number() OVER (ORDER BY h, key) AS rk, count(*) OVER () AS n FROM d),
s AS (SELECT *, CASE WHEN rk <= {ceil_frac_sql('n', test)} THEN 'test' ELSE 'train' END AS split FROM r),
tr AS (SELECT s.y AS class, CAST(u.v AS DOUBLE) AS v, u.i AS dim
       FROM s, (SELECT unnest(s.embedding) AS v, generate_subscripts(s.embedding, 1) AS i) u
       WHERE s.split = 'train' AND s.y IN (SELECT class FROM reg)),
mu AS (SELECT class, dim, avg(v) AS mu FROM tr GROUP BY class, dim),
heads AS (SELECT m.class, g.class_order, g.round, -0.5 * sum(m.mu * m.mu) AS bias
          FROM mu m JOIN reg g ON m.class = g.class GROUP BY m.class, g.class_order, g.round),
"""


def trained_ctes(rounds, kinds: dict[int, str]) -> str:
    """CTEs mu_t and heads_t: trained heads of the softmax rounds (descents
    over each round's training rows) beside the centroids of the others, and
    the objective ``o<round>`` of each; no leading WITH, trailing comma."""
    trained = [r for r in sorted({x[0] for x in registry_rows(rounds)}) if kinds.get(r) == "softmax"]
    fits = ",\n".join(descent_sql(
        f"SELECT s.key AS id, s.split, g.pos - 1 AS y FROM s JOIN reg g ON s.y = g.class WHERE g.round = {r} AND s.split = 'train'",
        f"""SELECT s.key AS id, u.j, CAST(u.v AS DOUBLE) AS v FROM s JOIN reg g ON s.y = g.class,
  (SELECT unnest(s.embedding) AS v, generate_subscripts(s.embedding, 1) AS j) u WHERE g.round = {r} AND s.split = 'train'
  UNION ALL SELECT s.key, 0, 1.0 FROM s JOIN reg g ON s.y = g.class WHERE g.round = {r} AND s.split = 'train'""",
        f"(SELECT count(*) FROM reg WHERE round = {r})", DESCENT_STEPS, UNIT_CURVATURE, name=str(r)) for r in trained)
    of = ", ".join(map(str, trained)) or "-1"
    weights = "".join(f"""
  UNION ALL SELECT g.class, w.j, w.w FROM w{r} w JOIN reg g ON g.round = {r} AND g.pos = w.k + 1 WHERE w.t = {DESCENT_STEPS} AND w.j > 0""" for r in trained)
    biases = "".join(f"""
  UNION ALL SELECT g.class, g.class_order, g.round, w.w FROM w{r} w JOIN reg g ON g.round = {r} AND g.pos = w.k + 1
  WHERE w.t = {DESCENT_STEPS} AND w.j = 0""" for r in trained)
    return f"""{fits},
mu_t AS (SELECT mu.class, mu.dim, mu.mu FROM mu JOIN reg g ON mu.class = g.class WHERE g.round NOT IN ({of}){weights}),
heads_t AS (SELECT class, class_order, round, bias FROM heads WHERE round NOT IN ({of}){biases}),
"""


def fused_ctes(rounds=EMBEDDING_ROUNDS, zscore: str = "batch", kinds: dict[int, str] | None = None) -> str:
    """CTEs through ``zz`` (long scores with z) and ``pr`` (key, y, pred),
    ``lo`` (per-row loss); no leading WITH, trailing comma."""
    if kinds is not None:
        base = fused_ctes(rounds, zscore)
        head = heads_ctes(rounds)
        rest = base[len(head):].replace("JOIN mu m ", "JOIN mu_t m ").replace("JOIN heads h ", "JOIN heads_t h ").replace("FROM heads)", "FROM heads_t)")
        return head + trained_ctes(rounds, kinds) + rest
    part = {"batch": "PARTITION BY t.batch_id, t.hclass", "global": "PARTITION BY t.hclass",
            "row": "PARTITION BY t.key", "none": None}[zscore]
    zexpr = ("t.logit" if part is None else
             f"(t.logit - avg(t.logit) OVER ({part})) / (stddev_pop(t.logit) OVER ({part}) + 1e-6)")
    return f"""{heads_ctes(rounds)}te AS (SELECT key, y, h, embedding FROM s WHERE split = 'test' AND y IN (SELECT class FROM reg)),
tb AS (SELECT *, (row_number() OVER (ORDER BY h, key) - 1) // 32 AS batch_id FROM te),
tx AS (SELECT tb.key, tb.y, tb.batch_id, CAST(u.v AS DOUBLE) AS x, u.i AS dim
       FROM tb, (SELECT unnest(tb.embedding) AS v, generate_subscripts(tb.embedding, 1) AS i) u),
lg AS (SELECT t.key, t.y, t.batch_id, m.class, sum(t.x * m.mu) AS dotp
       FROM tx t JOIN mu m ON t.dim = m.dim GROUP BY t.key, t.y, t.batch_id, m.class),
sc AS (SELECT t.key, t.y, t.batch_id, h.class, h.class_order, t.dotp + h.bias AS logit
       FROM lg t JOIN heads h ON t.class = h.class),
zz AS (SELECT t.*, {zexpr} AS z FROM (SELECT sc.*, sc.class AS hclass FROM sc) t),
pr AS (SELECT key, y, class AS pred FROM
         (SELECT key, y, class, row_number() OVER (PARTITION BY key ORDER BY z DESC, class_order) AS rn FROM zz)
       WHERE rn = 1),
ls AS (SELECT key, max(z) AS m FROM zz GROUP BY key),
lo AS (SELECT z.key, ln(sum(exp(z.z - l.m))) + l.m - max(CASE WHEN z.class = z.y THEN z.z END) AS loss
       FROM zz z JOIN ls l ON z.key = l.key
       WHERE z.batch_id NOT IN (SELECT batch_id FROM tb WHERE y NOT IN (SELECT class FROM heads)) GROUP BY z.key, l.m),
"""


def trained_rounds_sql(rounds, kinds: dict[int, str]) -> str:
    fit = "".join(f"""UNION ALL SELECT 'fit', '{r}', NULL, 'objective', round(objective, 4) FROM o{r} WHERE t = {DESCENT_STEPS}
UNION ALL SELECT 'fit', '{r}', NULL, 'converged', 1.0
""" for r in sorted(kinds) if kinds[r] == "softmax")
    return evaluate_rounds_sql(rounds, "batch", kinds) + fit


def evaluate_rounds_sql(rounds=EMBEDDING_ROUNDS, zscore: str = "batch", kinds: dict[int, str] | None = None) -> str:
    return f"""WITH {'RECURSIVE ' if kinds is not None else ''}{fused_ctes(rounds, zscore, kinds)}
conf AS (SELECT y, pred, count(*) AS n FROM pr GROUP BY y, pred),
sup AS (SELECT y AS class, sum(n) AS support FROM conf GROUP BY y),
pp AS (SELECT pred AS class, sum(n) AS pp FROM conf GROUP BY pred),
tp AS (SELECT y AS class, sum(n) AS tp FROM conf WHERE y = pred GROUP BY y),
pc AS (SELECT h.class, h.class_order, coalesce(tp.tp, 0) AS tp, coalesce(pp.pp, 0) AS pp,
              CAST(coalesce(sup.support, 0) AS DOUBLE) AS support
       FROM reg h LEFT JOIN sup ON h.class = sup.class LEFT JOIN pp ON h.class = pp.class
       LEFT JOIN tp ON h.class = tp.class),
pcm AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
               CASE WHEN pp + support > 0 THEN 2.0 * tp / (pp + support) ELSE 0.0 END AS f1 FROM pc),
ovr AS (SELECT sum(support) AS s, sum(precision * support) AS wp, sum(recall * support) AS wr,
               sum(f1 * support) AS wf, sum(tp) AS tp FROM pcm)
SELECT 'class' AS scope, class, CAST(class_order AS INTEGER) AS class_order, metric, round(CAST(value AS DOUBLE), 6) AS value
FROM pcm UNPIVOT (value FOR metric IN (precision, recall, f1, support))
UNION ALL SELECT 'overall', NULL, NULL, 'accuracy', round(tp / s, 6) FROM ovr
UNION ALL SELECT 'overall', NULL, NULL, 'weighted_precision', round(wp / s, 6) FROM ovr
UNION ALL SELECT 'overall', NULL, NULL, 'weighted_recall', round(wr / s, 6) FROM ovr
UNION ALL SELECT 'overall', NULL, NULL, 'weighted_f1', round(wf / s, 6) FROM ovr
UNION ALL SELECT 'overall', NULL, NULL, 'loss', round(avg(loss), 6) FROM lo
"""

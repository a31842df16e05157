"""Quality rules whose cutoffs carry a risk guarantee.

Every document gets base counts and a few rule features. For each stratum,
rule and cutoff of a fixed grid, the labelled holdout says how many good
documents the cutoff would reject (k of n). A cutoff is certified when the
exact binomial test rejects "false rejection rate >= alpha / rules" at level
delta / (strata * rules * cutoffs), a Bonferroni correction over every test
made. Of the certified cutoffs the one with the best balance (share of bad
caught minus share of good rejected) is used, the stricter test value on
ties; a stratum or rule without a certified cutoff that helps rejects nothing.
With probability 1 - delta, all rules together then reject at most a share
alpha of the good documents of every stratum.

DataFrame functions only. Cases: null and empty texts have no words and fail
the base rule; a null stratum is a stratum of its own; rows with null labels
are not part of the holdout; a document labelled more than once counts once,
as good only if every label says so; a text of one long line or word is
handled whole; equal rows get equal verdicts; no labels: only the base rule
holds; columns of the caller are kept under their names, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundlearn.llm.common import free_name, written

WINDOW = 8
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
ALPHA, DELTA = 0.05, 0.05
#: Rule features (a higher value is worse) and the cutoffs that are tested.
GRID = {
    "symbol_share": [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3],
    "repeat_share": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3],
    "dup_line_share": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7],
    "upper_share": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7],
    "shout_share": [0.02, 0.04, 0.08, 0.12, 0.2],
    "word_length": [8.0, 10.0, 12.0, 15.0, 20.0],
}


def _removed(text: Column, chars: str) -> Column:
    """Number of code points of ``text`` that are in ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of 8 words found more than once. Windows
    are compared by a 64-bit hash; a text without repeats (the usual case)
    needs no sort."""
    n = F.size(words)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                                             lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    def cover(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        def repeats(ps):
            same = F.filter(ps, lambda p, j: (p["h"] == F.get(ps, j - 1)["h"]) | (p["h"] == F.get(ps, j + 1)["h"]))
            starts = F.sort_array(F.transform(same, lambda p: p["i"]))
            return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")),
                               lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["end"])).alias("n"),
                                                     s.alias("end")),
                               lambda a: a["n"])
        return F.transform(F.array(pairs), repeats)[0]
    return F.transform(F.array(hashes), lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), cover(h)).otherwise(F.lit(0)))[0]


def features(text: Column) -> Column:
    """A struct of the base counts and the rule features of one text."""
    t = F.coalesce(text.cast("string"), F.lit(""))

    def of(t):
        words = F.filter(F.split(t, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda s: F.length(F.translate(s, SPACES, "")) > 0)
        return F.struct(t.alias("t"), words.alias("words"), lines.alias("lines"))

    def counts(p):
        t, words, lines = p["t"], p["words"], p["lines"]
        bare = F.translate(t, SPACES, "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            _removed(t, SYMBOLS).alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.coalesce(repeated_words(words), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.length(F.regexp_replace(bare, "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
            _removed(t, "!").alias("n_shout"))

    return F.transform(F.transform(F.array(t), of), counts)[0]


def rule_values(f: Column) -> dict[str, Column]:
    """Rule name -> value (0 where a text has no words)."""
    share = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    return {
        "symbol_share": share(f["n_symbols"], f["word_chars"]),
        "repeat_share": share(f["n_repeat_words"], f["n_words"]),
        "dup_line_share": share(f["n_dup_lines"], f["n_lines"]),
        "upper_share": share(f["n_upper"], f["word_chars"]),
        "shout_share": share(f["n_shout"], f["word_chars"]),
        "word_length": share(f["word_chars"], f["n_words"]),
    }


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series after a shift by 8 (error under 1e-12)."""
    x = n.cast("double") + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) \
        + 1 / (1260 * x * x * x * x * x)
    shift = sum((F.log(n.cast("double") + float(i)) for i in range(1, 9)), F.lit(0.0))
    return series - shift


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed from the term at k
    downwards; terms beyond 64 * sqrt(n) + 64 steps are below 1e-300 of the
    largest and change nothing. Meant for k <= n p; 1 beyond that."""
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) \
        + k * float(_ln(p)) + (n - k) * float(_ln(1 - p))
    steps = F.least(k, (F.sqrt(n.cast("double")) * 64 + 64).cast("long"))
    odds = (1 - p) / p
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * (k - i) / (n - k + i + 1) * odds).alias("term"),
                              (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def _ln(x: float) -> float:
    from math import log
    return log(x)


def certified_cutoffs(holdout: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
                      grid: dict[str, list[float]] = GRID) -> DataFrame:
    """``holdout``: stratum, good (boolean) and one column for each rule.
    Returns the chosen (stratum, rule, cutoff) and the counts and tail
    probability behind each choice: a row per stratum and rule at most."""
    tests = [(r, c) for r, cs in grid.items() for c in cs]
    hits = [F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"),
                     F.count_if(F.col("good") & (F.col(r) > c)).alias("k_good"),
                     F.count_if(~F.col("good") & (F.col(r) > c)).alias("k_bad")) for r, c in tests]
    per = holdout.groupBy("stratum").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"),
                                         *[h.alias(f"h{i}") for i, h in enumerate(hits)])
    per = written(per, "quality-strata")                  # one row per stratum
    strata = max(per.count(), 1)
    level = delta / (strata * len(tests))
    cells = per.select("stratum", "n_good", "n_bad", F.explode(F.array(*[f"h{i}" for i in range(len(tests))]))
                       .alias("h")).select("stratum", "n_good", "n_bad", "h.*")
    tail = binomial_tail(F.col("n_good"), F.col("k_good"), alpha / len(grid))
    gain = F.col("k_bad") / F.greatest("n_bad", F.lit(1)) - F.col("k_good") / F.greatest("n_good", F.lit(1))
    ok = (cells.withColumn("tail", tail).where((F.col("tail") <= level) & (F.col("k_bad") > 0))
          .withColumn("gain", gain).where("gain > 0"))
    best = ok.groupBy("stratum", "rule").agg(F.max(F.struct(
        F.round("gain", 9).alias("gain"), "cutoff", "k_good", "n_good", "k_bad", "n_bad", "tail")).alias("b"))
    return best.select("stratum", "rule", "b.*")


def _holdout(rows: DataFrame, labels: DataFrame, id_col: str, label_id: str, label_col: str) -> DataFrame:
    """rows (id, stratum, rules) of labelled documents, each label id once."""
    lab = (labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
           .groupBy(F.col(label_id).alias("l_id")).agg((F.min(F.col(label_col)) == 1).alias("good")))
    return rows.join(lab, rows[id_col] == lab["l_id"]).drop("l_id")


def rule_table(rows: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality",
               alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Fits the cutoffs on ``rows`` (id, stratum, base_failed, rules): one row
    for each stratum with the map rule -> cutoff. Documents that fail the base
    rule are rejected in any case, so they are not part of the tests."""
    holdout = _holdout(rows.where(~F.col("base_failed")), labels, "id", label_id, label_col)
    chosen = certified_cutoffs(holdout, alpha, delta)
    return chosen.groupBy(F.col("stratum").alias("s")).agg(F.map_from_entries(
        F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def _with_cutoffs(rows: DataFrame, table: DataFrame, stratum: str, out: str = "cutoffs") -> DataFrame:
    """Joins the cutoffs (a row per stratum) to all rows as column ``out``;
    broadcast when the counted strata are few, else a join that Spark may
    split where skewed."""
    key = free_name([*rows.columns, out], "s")
    table = written(table.toDF(key, out), "quality-cutoffs")
    small = F.broadcast(table) if table.count() <= 100_000 else table
    return rows.join(small, F.col(stratum) == F.col(key), "left").drop(key)


def _broken(values: dict[str, Column], cutoffs: Column) -> Column:
    """Names of the rules whose value is over the stratum's cutoff."""
    names = [F.when(v > F.element_at(cutoffs, r), F.lit(r)) for r, v in values.items()]
    return F.array_compact(F.array(*names))


def _stratum(stratum_col: str | None) -> Column:
    return F.coalesce(F.col(stratum_col).cast("string"), F.lit("(none)")) if stratum_col else F.lit("(all)")


def verdicts(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             stratum_col: str | None = "lang", label_id: str = "doc_id", label_col: str = "quality",
             alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: id, the base counts, base_failed, kept and the
    names of the rules it breaks. Only narrow rows are stored or moved."""
    f = written(df.select(F.col(id_col).alias("id"), _stratum(stratum_col).alias("stratum"),
                          features(F.col(text_col)).alias("f")).select("id", "stratum", "f.*"), "quality-features")
    counts = {c: F.col(c) for c in f.columns}
    rows = f.withColumn("base_failed", base_failed(counts))
    values = rule_values(counts)
    table = rule_table(rows.select("id", "stratum", "base_failed", *[v.alias(r) for r, v in values.items()]),
                       labels, label_id, label_col, alpha, delta)
    return (_with_cutoffs(rows, table, "stratum").withColumn("broken", _broken(values, F.col("cutoffs")))
            .select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", (~F.col("base_failed") & (F.coalesce(F.size("broken"), F.lit(0)) == 0)).alias("kept"),
                    F.coalesce("broken", F.array().cast("array<string>")).alias("broken")))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stratum_col: str | None = "lang", label_id: str = "doc_id", label_col: str = "quality",
              alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The kept documents with all their columns. The cutoffs are fitted in a
    first pass over the labelled documents; the second pass is a filter that
    moves no text."""
    def once(text: Column, fn) -> Column:
        """``fn`` of the features of a text as one expression, which the
        optimizer cannot take apart and evaluate several times."""
        return F.transform(F.array(features(text)), fn)[0]

    def passing(f: Column) -> Column:
        return F.when(~base_failed(f), F.struct(*[v.alias(r) for r, v in rule_values(f).items()]))

    # a generator is evaluated once a row, whatever later steps filter on
    own = df.select(F.col(id_col).alias("id"), _stratum(stratum_col).alias("stratum"),
                    F.explode_outer(F.array(once(F.col(text_col), passing))).alias("v"))
    rows = own.select("id", "stratum", F.col("v").isNull().alias("base_failed"), "v.*")
    table = rule_table(rows, labels, label_id, label_col, alpha, delta)
    st, cut = (free_name(df.columns, x) for x in ("stratum__", "cutoffs__"))
    out = _with_cutoffs(df.withColumn(st, _stratum(stratum_col)), table, st, cut)

    def good(f: Column) -> Column:
        broken = F.coalesce(F.size(_broken(rule_values(f), F.col(cut))), F.lit(0))
        return ~base_failed(f) & (broken == 0)

    return out.where(once(F.col(text_col), good)).select(*[F.col(f"`{c}`") for c in df.columns])

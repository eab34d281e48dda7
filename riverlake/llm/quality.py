"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Every rule rejects a document whose measure reaches a cutoff. Cutoffs are chosen from fixed
grids by labelled documents, apart for each stratum: a cutoff is certified if a binomial test
on the good documents shows that it rejects less than a stated share of them. The tests are
exact, and their level is divided by the number of chains of tests (strata times rules). Along
a chain the count of false rejections only grows with strictness, so its tests form a fixed
sequence that needs no more correction. Shares of the rules add up to ``MAX_FALSE_REJECTION``,
which therefore bounds the false rejections of all rules together in each stratum, with
probability ``1 - ERROR`` for all strata at once. Among certified cutoffs the one that rejects
most bad documents, less ten times the good ones, is taken; without any gain the rule is off in that stratum.

Defined results: a null or empty text has no words and fails the base rules. A null stratum is
a stratum of its own. Strata with too few labels certify nothing and keep what the base rules
keep. An empty table certifies nothing and gives no rows. A text of any length is counted whole,
in its own row. Copies of a text count once in the tests. Of several labels of a document the lowest
holds; labels without an id or a value are passed over. Repeated rows give equal rows. Extra
columns are not read. Windows of words are compared as 64-bit hashes within a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlake.llm.rows import stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
MAX_FALSE_REJECTION = 0.05
ERROR = 0.05
GOOD_WEIGHT = 10  # bad documents that must go for one good one
SALTS = 64

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Measures (high is bad) and the cutoffs that are tried, set before any data is seen.
SHARES = [0.02, 0.03, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
GRIDS: dict[str, list[float]] = {
    "symbol_share": SHARES,
    "dup_line_share": SHARES,
    "repeat_share": SHARES,
    "capital_share": SHARES,
    "exclaim_share": SHARES,
    "mean_word": [7.0, 7.5, 8.0, 8.5, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0, 20.0, 30.0],
    "same_word_share": SHARES,
}


def _chars(text: Column, letters: str) -> Column:
    """How many characters of the text are among ``letters``."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def base_features(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
) -> DataFrame:
    """Counts of each document's words, symbols and repetitions, and the measures of the rules."""
    text = F.col("text")
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    cut = source.select(
        "*",
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(
            F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0
        ).alias("lines"),
    )
    hashed = cut.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.expr(
            "case when size(words) < 3 then cast(array() as array<bigint>) else transform("
            "sequence(0, size(words) - 3),"
            " i -> xxhash64(words[i], words[i + 1], words[i + 2])) end"
        ).alias("windows"),
    )
    # Places of windows found before or after, in order; each covers up to the next place.
    repeats = hashed.select(
        "*",
        F.expr(
            "case when size(array_distinct(windows)) = size(windows) then cast(array() as array<int>)"
            " else sort_array(transform(repeated(windows), x -> x.i)) end".replace(
                "repeated(windows)",
                "aggregate(array(sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))),"
                " cast(array() as array<struct<h: bigint, i: int>>),"
                " (none, s) -> filter(s, (x, k) -> (k > 0 and s[k - 1].h = x.h)"
                " or (k < size(s) - 1 and s[k + 1].h = x.h)))",
            )
        ).alias("places"),
    )
    counted = repeats.select(
        "doc_id",
        "stratum",
        F.xxhash64("text").alias("digest"),
        "n_words",
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        _chars(text, SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "aggregate(transform(places, (p, k) -> case when k < size(places) - 1"
            " then least(3, places[k + 1] - p) else 3 end), 0L, (s, x) -> s + x)"
        ).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        _chars(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        _chars(text, "!?").alias("n_exclaims"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
    )
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    return counted.select(
        "doc_id",
        "stratum",
        "digest",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share("n_symbols", "n_words").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_exclaims", "n_words").alias("exclaim_share"),
        share("word_chars", "n_words").alias("mean_word"),
        (F.lit(1.0) - share("n_distinct", "n_words")).alias("same_word_share"),
        (
            (F.col("n_words") < MIN_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
        ).alias("base_failed"),
    )


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series ten places further up."""
    z = x + 10
    series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z)
    series = series + 1 / (1260 * z * z * z * z * z)
    for k in range(10):
        series = series - F.ln(x + k)
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most k of n) at rate ``p``, to the precision of a double. 1 if k is not under the mean.

    Terms are summed from that of k downwards. Under the mean the t-th of them is at most
    ``exp(-t (t - 1) / (2 k))`` of the first, so after ``10 sqrt(k) + 60`` nothing that a double
    could hold is left.
    """
    k, n = k.cast("double"), n.cast("double")
    log_top = (
        _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
        + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p))
    )
    ratio = lambda t: (k - t) * (1 - p) / ((n - k + t + 1) * p)
    terms = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.floor(F.sqrt(k) * 10) + 60).cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, t: F.struct(
            (s["term"] * ratio(t)).alias("term"), (s["sum"] + s["term"]).alias("sum")
        ),
    )
    tail = F.exp(log_top) * terms["sum"]
    return F.when(n <= 0, 1.0).when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), tail))


def certified_cutoffs(
    features: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    quality_col: str = "quality",
    max_false_rejection: float = MAX_FALSE_REJECTION,
    error: float = ERROR,
) -> DataFrame:
    """(stratum, rule, cutoff) of the rules that are on."""
    marks = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(quality_col).cast("int").alias("quality"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    level = lambda rule: F.size(
        F.filter(F.array(*map(F.lit, GRIDS[rule])), lambda cutoff: F.col(rule) >= cutoff)
    ).alias(rule)
    levels = (
        features.where("not base_failed")
        .select("doc_id", "stratum", "digest", *[level(rule) for rule in GRIDS])
        .join(marks, "doc_id")
        .groupBy("stratum", "digest")
        .agg(F.min("quality").alias("quality"), *[F.max(rule).alias(rule) for rule in GRIDS])
    )
    good = F.sum(F.when(F.col("quality") > 0, 1).otherwise(0))
    bad = F.sum(F.when(F.col("quality") > 0, 0).otherwise(1))
    totals = levels.groupBy("stratum").agg(good.alias("n"))
    reached = levels.select(
        "stratum",
        "quality",
        F.explode(
            F.array(
                *[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("level")) for rule in GRIDS]
            )
        ).alias("r"),
    ).select("stratum", "quality", "r.rule", "r.level")
    counts = (
        reached.where("level > 0")
        .groupBy("stratum", "rule", "level")
        .agg(good.alias("good"), bad.alias("bad"))
        .select("stratum", "rule", "good", "bad", F.explode(F.expr("sequence(1, level)")).alias("step"))
        .groupBy("stratum", "rule", "step")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    )
    tail = binomial_tail(F.col("good"), F.col("n"), max_false_rejection / len(GRIDS))
    tested = (
        counts.join(totals, "stratum")
        .where(tail * totals.count() * len(GRIDS) <= error)
        .where(F.col("bad") > F.col("good") * GOOD_WEIGHT)
    )
    cutoffs = F.create_map(
        *[x for rule, grid in GRIDS.items() for x in (F.lit(rule), F.array(*map(F.lit, grid)))]
    )
    best = F.max(F.struct(F.col("bad") - F.col("good") * GOOD_WEIGHT, F.col("step"))).alias("best")
    return (
        tested.groupBy("stratum", "rule")
        .agg(best)
        .select("stratum", "rule", F.element_at(cutoffs[F.col("rule")], F.col("best.step")).alias("cutoff"))
    )


def _judged(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    stratum_col: str,
    quality_col: str,
) -> DataFrame:
    features = stored(base_features(docs, id_col, text_col, stratum_col), "quality")
    chosen = certified_cutoffs(features, labels, id_col, quality_col)
    # A stratum may hold most rows, so its cutoffs are there for every salt and its rows
    # are dealt out over them.
    by_stratum = (
        chosen.groupBy("stratum")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = features.withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("int"))
    failed = F.lit(False)
    for rule in GRIDS:
        failed = failed | F.coalesce(F.col(rule) >= F.col("cutoffs")[rule], F.lit(False))
    kept = (~(F.col("base_failed") | failed)).alias("kept")
    return salted.join(by_stratum, ["stratum", "salt"], "left").select("*", kept)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    quality_col: str = "quality",
) -> DataFrame:
    """Per row: id, counts, whether the base rules fail, and whether the document is kept."""
    return _judged(docs, labels, id_col, text_col, stratum_col, quality_col).select(
        F.col("doc_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    quality_col: str = "quality",
) -> DataFrame:
    """The rows of ``docs`` that are kept; equal rows share their fate."""
    kept = (
        _judged(docs, labels, id_col, text_col, stratum_col, quality_col)
        .where("kept")
        .select("doc_id", "stratum", "digest")
        .distinct()
    )
    same = (
        docs[id_col].eqNullSafe(kept["doc_id"])
        & (F.coalesce(docs[stratum_col].cast("string"), F.lit("")) == kept["stratum"])
        & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == kept["digest"])
    )
    return docs.join(kept, same, "left_semi")

"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule has a score from counts of the whole text and a grid of cutoffs. On
labelled documents, for every stratum (language) and rule, cutoffs are tested
from the most lenient to the strictest: the hypothesis "more than ``alpha`` /
rules of the good documents score above the cutoff" is rejected if the exact
binomial tail P(X <= rejected good) is at most ``delta`` / (tested strata x rules), that
is, if the exact (Clopper-Pearson) upper bound of the false rejection rate lies
under the limit. Testing stops at the first cutoff that fails (a fixed sequence
needs no further correction); the division by strata x rules corrects for the
other tests, where a stratum is tested if it has a label. So with probability 1 - delta, at most ``alpha`` of the good documents
of each stratum are rejected. Among certified cutoffs, the one that separates
the labelled bad from the good best is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecast.llm.files import written

#: Cutoffs of a rule are j / GRID for j from 0; a score of x fails those below x.
GRID = 50
#: Share of good documents of a stratum that all rules together may reject, and the chance of exceeding it.
ALPHA, DELTA = 0.03, 0.05
#: Base rule: fewer words than this, or more than this share (percent) of words in repeated windows.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

RULES = ("symbols", "capitals", "marks", "repeats", "lines")
_SPACE = r"[\\x20\\x09-\\x0D]"


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts of the whole text of each row, and each rule's grid place.

    Columns ``id_col, _stratum, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words`` and ``_symbols`` .. ``_lines``. A null text has no words; a null
    stratum is the empty one.
    """
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), stratum.alias("_stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    split = base.select(
        "*",
        F.expr(f"filter(split(_text, '{_SPACE}+'), w -> w != '')").alias("_words"),
        F.expr(rf"filter(split(_text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("_rows"),
    )
    joined = ", ".join(f"_words[i + {k}]" for k in range(WINDOW))
    counted = split.select(
        "_id",
        "_stratum",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("long").alias("_n_capitals"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[!?=~^_@]+", ""))).cast("long").alias("_n_marks"),
        F.size("_rows").cast("long").alias("_n_lines"),
        (F.size("_rows") - F.size(F.array_distinct("_rows"))).cast("long").alias("n_dup_lines"),
        # Windows with their places, sorted, so that equal windows lie side by side.
        F.expr(
            f"CASE WHEN size(_words) >= {WINDOW} THEN sort_array(transform(sequence(0, size(_words) - {WINDOW}),"
            f" i -> struct(concat_ws(' ', {joined}) AS w, i AS i))) ELSE array() END"
        ).alias("_sorted"),
    )
    twice = "(j > 0 AND _sorted[j].w = _sorted[j - 1].w) OR (j < size(_sorted) - 1 AND _sorted[j].w = _sorted[j + 1].w)"
    placed = counted.select(
        "*",
        F.expr(
            f"CASE WHEN size(_sorted) > 1 THEN sort_array(filter(transform(sequence(0, size(_sorted) - 1),"
            f" j -> CASE WHEN {twice} THEN _sorted[j].i END), x -> x IS NOT NULL)) ELSE array() END"
        ).alias("_repeated"),
    ).drop("_sorted")
    covered = placed.withColumn(
        "n_repeat_words",
        F.expr(
            f"aggregate(_repeated, named_struct('n', 0L, 'last', -{WINDOW}),"
            f" (a, x) -> named_struct('n', a.n + least({WINDOW}, x - a.last), 'last', x), a -> a.n)"
        ),
    ).drop("_repeated")

    def place(part: str, whole: str) -> Column:
        share = F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
        return (F.ceil(F.least(share, F.lit(1.0)) * GRID) - 1).cast("int")

    parts = dict(zip(RULES, (("n_symbols", "word_chars"), ("_n_capitals", "word_chars"), ("_n_marks", "word_chars"), ("n_repeat_words", "n_words"), ("n_dup_lines", "_n_lines")), strict=True))
    return covered.select(
        F.col("_id").alias(id_col), "_stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(place(*parts[r]).alias(f"_{r}") for r in RULES)
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), summed in logarithms; 1 where k > n p, as no test passes there."""
    return F.when(k > n * p, F.lit(1.0)).otherwise(
        F.exp(
            F.aggregate(
                F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
                F.struct((n * F.log1p(F.lit(-p))).alias("t"), (n * F.log1p(F.lit(-p))).alias("s")),
                lambda a, i: _add(a, a["t"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))),
                lambda a: a["s"],
            )
        )
    )


def _add(state: Column, term: Column) -> Column:
    top, low = F.greatest(state["s"], term), F.least(state["s"], term)
    return F.struct(term.alias("t"), (top + F.log1p(F.exp(low - top))).alias("s"))


def certified_cutoffs(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(_stratum, _rule, cutoff int)`` for each stratum and rule with a certified cutoff.

    Labels: 1 is good, 0 is bad; a document with several labels counts by the
    least; null labels and ids are left out. Documents that fail the base rule
    are not tested, as no cutoff decides on them.
    """
    # `found` is read by stratum and place, so that only counts are shuffled beyond the join by id.
    truth = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_key")).agg(F.min(label_col).alias("_label"))
    known = found.where(~base_failed()).join(truth, F.col(id_col) == F.col("_key"))
    rows = known.select("_stratum", "_label", F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.col(f"_{r}").alias("at")) for r in RULES))).alias("x"))
    tally = rows.groupBy("_stratum", F.col("x.r").alias("_rule"), F.col("x.at").alias("_at")).agg(
        F.sum((F.col("_label") == 1).cast("long")).alias("_good"), F.sum((F.col("_label") != 1).cast("long")).alias("_bad")
    )
    tally = written(tally, "rule-tallies")
    n_strata = tally.select("_stratum").distinct().count()
    grid = tally.select("_stratum", "_rule").distinct().select("*", F.explode(F.sequence(F.lit(-1), F.lit(GRID - 1))).alias("_at"))
    full = grid.join(tally, ["_stratum", "_rule", "_at"], "left").fillna(0, ["_good", "_bad"])
    each = Window.partitionBy("_stratum", "_rule")
    down = each.orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    limit, level = alpha / len(RULES), delta / (max(1, n_strata) * len(RULES))
    summed = full.select(
        "_stratum", "_rule", "_at", F.sum("_good").over(each).alias("n"), F.sum("_good").over(down).alias("k"), F.sum("_bad").over(each).alias("nb"), F.sum("_bad").over(down).alias("kb")
    ).where("_at >= 0")
    tested = summed.withColumn("_fails", (binomial_tail(F.col("n"), F.col("k"), limit) > level).cast("int"))
    certain = tested.withColumn("_failed", F.max("_fails").over(down)).where("_failed = 0 AND kb > 0")
    gain = F.col("kb") / F.col("nb") - F.col("k") / F.col("n")
    return certain.groupBy("_stratum", "_rule").agg(F.max_by("_at", F.struct(gain, F.col("_at"))).alias("cutoff"))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row of ``docs``.

    Null texts have no words and fail; rows with a null id are judged, and a null
    stratum counts as the empty one; repeated rows are kept as they come; other
    columns are ignored, whatever their names; an empty table gives an empty
    result. Without labels enough for a certificate in a row's stratum, a rule
    rejects nothing there.
    """
    found = written(counts(docs, id_col, text_col, stratum_col), "rule-counts")
    certain = certified_cutoffs(found, labels, id_col, "quality", alpha, delta)
    # One row for each stratum with a cutoff, written, so that Spark knows its size and broadcasts it only below its threshold.
    cutoffs = written(certain.groupBy("_stratum").agg(*(F.max(F.when(F.col("_rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES)), "rule-cutoffs")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(f"_{r}") >= F.col(f"_cut_{r}"), F.lit(False))
    return found.join(cutoffs, "_stratum", "left").select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept")
    )

"""Quality rules: a threshold table compiled into one projection of native Spark columns.

No user function runs: words, lines and 8-word windows are arrays inside the row, so the plan is a scan and
projections without any shuffle. Windows are compared by 64-bit hashes within one text.

Cases: a null text counts as a text without words (all counts 0, base_failed true, kept false); so does an empty or
blank one. Repeated rows each give their own row. Columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, documents, let, words_of

NAME = "op1_quality_rules"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are or this not an at from which but have had his they you were "
    "der die das und in zu den mit von für ist im des dem nicht ein eine auf sich auch als an es "
    "le la les de des du et en un une que qui dans pour par sur est au pas avec ne se "
    "el los las del y por con para su al lo como más o pero sus una"
).split()


@dataclass(frozen=True)
class Rule:
    """A row passes if low <= numerator / denominator <= high; a zero denominator passes nothing but a zero numerator."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None

    def ratio(self) -> Column:
        if self.denominator is None:
            return F.col(self.numerator).cast("double")
        return F.coalesce(F.col(self.numerator) / F.nullif(F.col(self.denominator), F.lit(0)).cast("double"), F.lit(0.0))

    def passes(self) -> Column:
        tests = [self.ratio() >= self.low] if self.low is not None else []
        tests += [self.ratio() <= self.high] if self.high is not None else []
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


#: The table of thresholds; every text that passes the base must pass all of them.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.15),
    Rule("bang_ratio", "n_bangs", "n_words", None, 0.3),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeated_word_ratio", "n_repeat_words", "n_words", None, 0.3),
)


def _removed(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _pairs(values: Column, step: int, f) -> Column:
    """f over the elements that stand step apart."""
    n = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, step + 1, n), f)


def _windows(words: Column) -> Column:
    """Hashes of all WINDOW-word windows, by doubling: 1, 2, 4, 8 words."""
    mix = lambda a, b: F.xxhash64(a, b)
    one = F.transform(words, lambda w: F.xxhash64(w))
    return let(one, lambda h: let(_pairs(h, 1, mix), lambda h2: let(_pairs(h2, 2, mix), lambda h4: _pairs(h4, 4, mix))))


def _covered(windows: Column) -> Column:
    """Words that lie in windows found more than once."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(placed, lambda p: F.flatten(_pairs(p, 1, lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))))
    starts = F.sort_array(F.array_distinct(twice))
    new_words = let(starts, lambda s: _pairs(s, 1, lambda a, b: F.least(b - a, F.lit(WINDOW))))
    return F.aggregate(new_words, F.lit(WINDOW).cast("long"), lambda acc, x: acc + x)


def quality(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """df's columns and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the other counts the rules use,
    base_failed, failed_rules (names) and kept. An input column named as one of these is replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    made = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_stop_words n_bangs n_lines base_failed failed_rules kept".split()
    kept = [c for c in df.columns if c not in made]
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    base = df.select(
        *kept,
        words_of(F.col(text)).alias("__words"),
        lines.alias("__lines"),
        _removed(body, BLANKS).cast("long").alias("word_chars"),
        (F.length(body) - _removed(body, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(body) - _removed(body, "!")).cast("long").alias("n_bangs"),
    ).select(
        *kept, "word_chars", "n_symbols", "n_bangs",
        F.size("__words").cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        _windows(F.col("__words")).alias("__windows"),
    )
    repeats = F.size("__windows") > F.size(F.array_distinct("__windows"))
    counted = base.withColumn("n_repeat_words", F.when(repeats, _covered(F.col("__windows"))).otherwise(F.lit(0).cast("long"))).drop("__windows")
    failed = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]))
    return counted.select(
        "*",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        failed.alias("failed_rules"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words n_stop_words n_bangs n_lines base_failed kept".split()
    return quality(documents(spark, sf_dir).select("doc_id", "text")).select(*columns)


def _oracle() -> str:
    quoted = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    tests = []
    for r in RULES:
        ratio = f"coalesce({r.numerator} / nullif({r.denominator}, 0)::double, 0.0)"
        tests += [f"{ratio} >= {r.low}"] if r.low is not None else []
        tests += [f"{ratio} <= {r.high}"] if r.high is not None else []
    return f"""
    WITH w AS (
      SELECT doc_id, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM documents),
    g AS (
      SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8) x),
    d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) x WHERE c > 1),
    r AS (
      SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) x GROUP BY doc_id),
    c AS (
      SELECT w.doc_id, len(words)::bigint AS n_words,
        length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
        coalesce(r.n, 0)::bigint AS n_repeat_words,
        len(list_filter(words, lambda x: lower(x) IN ({quoted})))::bigint AS n_stop_words,
        (length(t) - length(replace(t, '!', '')))::bigint AS n_bangs,
        len(lines)::bigint AS n_lines
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
    SELECT *, NOT base_failed AND {" AND ".join(tests)} AS kept
    FROM (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM c) x
    """


ORACLE_SQL = _oracle()

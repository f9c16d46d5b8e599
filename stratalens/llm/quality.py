"""Quality rules: a threshold table compiled into one projection of built-in functions.

All statistics of a text are computed inside its row with higher-order functions, so the
operator is a map without a shuffle: its cost is linear in the text and no key can be hot.

Defined cases: null text counts as the empty text (0 words: rejected by the base rule); repeated
rows are judged separately and alike; an empty table gives an empty result; further columns of
the input are kept unless they clash with an output name, where the output column wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: The ASCII white space that separates words, and the characters counted as symbols.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of the supported languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "this", "are"],
    "de": ["der", "die", "das", "und", "ist", "von", "mit", "den", "ein", "eine", "zu", "nicht", "sich", "auf", "für", "des"],
    "fr": ["le", "la", "les", "de", "et", "un", "une", "des", "en", "que", "est", "pour", "dans", "qui", "sur", "par"],
    "es": ["el", "la", "los", "de", "y", "un", "una", "en", "que", "es", "por", "con", "las", "del", "al", "para"],
}


@dataclass(frozen=True)
class Rule:
    """Keep a text while ``low <= numerator / denominator <= high``; an open side is None."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    at_least: int = 0  # the rule holds for texts of that many words only


#: The threshold table. Ratios are compared as products, so no division by zero can occur.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols", "word_chars", None, 0.10),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None, at_least=60),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.30),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 0.90),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 0.30),
)


def rule_holds(rule: Rule) -> Column:
    n, d = F.col(rule.numerator).cast("double"), F.col(rule.denominator).cast("double")
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (n >= d * rule.low)
    if rule.high is not None:
        ok = ok & (n <= d * rule.high)
    return ok if not rule.at_least else (F.col("n_words") < rule.at_least) | ok


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")


def _covered(words: Column) -> Column:
    """Words inside 8-word windows that occur at least twice in the text, first ones included.

    Windows are compared by 64-bit hashes built by doubling (2, 4, 8 words). Only texts whose
    hashes are not all distinct pay for sorting them.
    """

    def doubled(h: Column, width: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + width)))

    def repeated(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(starts(s), coverage))

    def starts(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def coverage(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def covered(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated(h))

    whole = lambda h8: F.slice(h8, 1, F.size(words) - WINDOW + 1)  # noqa: E731  without those that pass the end
    by_doubling = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h1: let(doubled(h1, 1), lambda h2: let(doubled(h2, 2), lambda h4: let(whole(doubled(h4, 4)), covered))),
    )
    return F.when(F.size(words) > WINDOW, by_doubling).otherwise(F.lit(0).cast("long"))


def text_stats(text: Column, stop_words: list[str] | None = None) -> Column:
    """A struct of all counts that rules refer to."""
    stop = stop_words or sorted({w for ws in STOP_WORDS.values() for w in ws})
    stop = sorted({*stop, *(w.capitalize() for w in stop), *(w.upper() for w in stop)})
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(pair: Column) -> Column:
        w, ln = pair["w"], pair["l"]
        count = lambda a, f: F.size(F.filter(a, f)).cast("long")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(ln).cast("long").alias("n_lines"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            _covered(w).alias("n_repeat_words"),
            count(w, lambda x: x.isin(stop)).alias("n_stop_words"),
            count(ln, lambda x: x.rlike(r"^\s*[-*•‣◦]\s")).alias("n_bullet_lines"),
            count(ln, lambda x: x.rlike(r"(\.\.\.|…)\s*$")).alias("n_ellipsis_lines"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        )

    return let(F.struct(_words(text).alias("w"), lines.alias("l")), counts)


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, the names of ``failed_rules`` and ``kept``."""
    made = ["n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines"]
    taken = {*made, "base_failed", "failed_rules", "kept", "_s"}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken or c == text]
    out = docs.select(*rest, text_stats(F.col(text)).alias("_s"), F.coalesce(F.regexp_count(F.col(text), F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"))
    out = out.select(*[F.col(f"`{c}`") for c in out.columns if c != "_s"], *[F.col("_s")[c].alias(c) for c in made if c != "n_symbols"])
    failed = F.filter(F.array(*[F.when(~rule_holds(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    out = quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql(rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> str:
    """The query in DuckDB SQL, with the same table of rules compiled into it."""
    word, stop = r"[^\x20\x09-\x0D]", sorted({w for ws in STOP_WORDS.values() for w in ws})
    stop = ", ".join(f"'{w}'" for w in sorted({*stop, *(w.capitalize() for w in stop), *(w.upper() for w in stop)}))

    def holds(rule: Rule) -> str:
        sides = [f"{rule.numerator} {sign} {rule.denominator} * CAST({bound} AS DOUBLE)" for sign, bound in ((">=", rule.low), ("<=", rule.high)) if bound is not None]
        return f"(n_words < {rule.at_least} OR ({' AND '.join(sides)}))"

    lines = lambda pattern: f"len(list_filter(l, lambda x: regexp_matches(x, '{pattern}')))"
    blank = r"[\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, regexp_extract_all(t, '{word}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM a)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, sum(step) AS n FROM (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS step FROM r) GROUP BY doc_id),
s AS (SELECT a.doc_id, len(w) AS n_words, len(l) AS n_lines, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words, {lines(f"^{blank}*[-*•‣◦]{blank}")} AS n_bullet_lines, {lines(rf"(\.\.\.|…){blank}*$")} AS n_ellipsis_lines
  FROM a LEFT JOIN c ON a.doc_id = c.doc_id),
b AS (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(map(holds, rules))} AS kept FROM b
"""


ORACLE = oracle_sql()

"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Null and empty texts have no words, so they fail min_words. Rows stay one to one; repeated rows
are judged alike; columns other than the two named ones are not looked at.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with", "on", "by", "be", "this", "was", "are", "at", "from", "or", "an",
    "de", "la", "le", "les", "et", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "ou", "avec",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "aus",
    "el", "los", "del", "las", "se", "y", "con", "para", "su", "al", "lo", "no", "como", "sus",
)

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document fails when the value, an SQL expression over the measures, is outside low..high."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None

    def fails(self) -> str:
        return " or ".join([f"({self.value}) < {self.low}"] * (self.low is not None) + [f"({self.value}) > {self.high}"] * (self.high is not None))


#: The two that every use shares.
BASE_RULES = (Rule("min_words", "n_words", low=20), Rule("repeated_words", "100 * n_repeat_words - 30 * n_words", high=0))
#: Length, symbol, stop-word and line ratios, as differences so that nothing divides by zero.
RULES = (
    Rule("word_length_low", "word_chars - 2 * n_words", low=0),
    Rule("word_length_high", "word_chars - 12 * n_words", high=0),
    Rule("symbols", "10 * n_symbols - 3 * n_words", high=0),
    Rule("exclamations", "10 * n_bangs - 3 * n_words", high=0),
    Rule("stop_words", "n_stop_words", low=1),
    Rule("repeated_lines", "10 * n_dup_lines - 5 * n_lines", high=0),
)
SPACE = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, its text (null: empty), the measures that rules may name and, as carried, another column."""
    also = [docs[carry].alias("carried")] if carry else []
    df = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.coalesce(docs[text], F.lit("")).alias("t"), *also)
    own = ["doc_id", "text", *(["carried"] if carry else [])]
    has_word = F.col("t") != ""
    df = df.select(
        *own,
        F.when(has_word, words_of(F.col("t"))).otherwise(F.array().cast("array<string>")).alias("w"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        _removed(F.col("t"), "#*$%&|<>").cast("long").alias("n_symbols"),
        _removed(F.col("t"), "!").cast("long").alias("n_bangs"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACE, "") != "").alias("lines"),
    )
    n = F.size("w")
    df = df.select(
        *own, "word_chars", "n_symbols", "n_bangs",
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_intersect("w", F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
    )
    starts = F.when(F.size("wh") >= WINDOW, F.sequence(F.lit(1), F.size("wh") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(F.slice("wh", i, WINDOW)))).drop("wh")
    # Only a text with a repeated window pays for the sort.
    paired = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(paired))).drop("windows")
    twice = F.filter("sorted", lambda x, i: (F.get("sorted", i - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get("sorted", i + 1)["h"] == x["h"]).eqNullSafe(True))
    df = df.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["p"]))).drop("sorted")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered"))
    covered = F.aggregate(
        "places", start,
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["covered"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("covered")),
        lambda a: a["covered"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("places")
    # The outer form of a generator of one row: a filter on a measure stays above it. Below, Spark would copy all that a
    # measure is made from into the filter, again and again, until the plan has no end.
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, text, the measures, base_failed, failed (names of the rules that failed) and kept."""
    df = measured(docs, doc_id, text, carry)
    base = F.expr(" or ".join(f"({r.fails()})" for r in BASE_RULES))
    failed = F.array_compact(F.array(*(F.when(F.expr(r.fails()), F.lit(r.name)) for r in (*BASE_RULES, *rules))))
    return df.withColumns({"base_failed": base, "failed": failed}).withColumn("kept", F.size("failed") == 0)


def kept_rows(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    judged = apply_rules(whole, rules, carry="row")
    return judged.filter("kept").select("carried.*")


def sql(table: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for doc_id, text, the contract's measures, base_failed and kept."""
    fails = " or ".join(f"({r.fails()})" for r in (*BASE_RULES, *rules))
    base = " or ".join(f"({r.fails()})" for r in BASE_RULES)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(text, '') AS t FROM {table}),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \\t\\n\\x0B\\x0C\\r]+', '', 'g') <> '') AS lines FROM t),
p AS (SELECT r, i, array_to_string(list_slice(w, i + 1, i + {WINDOW}), ' ') AS x
      FROM (SELECT r, w, unnest(range(len(w) - {WINDOW - 1})) AS i FROM w WHERE len(w) >= {WINDOW})),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM p),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM h, range({WINDOW}) AS g(k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, text, len(w)::BIGINT AS n_words,
             length(regexp_replace(t, '[ \\t\\n\\x0B\\x0C\\r]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(list_distinct(list_filter(w, lambda x: list_contains([{stop}], x))))::BIGINT AS n_stop_words,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (r))
SELECT doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({fails}) AS kept FROM m"""

"""Quality rules: a threshold table compiled into one Spark projection.

Main path: DataFrame functions only. Nothing is shuffled; every document is judged on its own row.

Definitions. A word is a maximal run of characters other than space and U+0009 to U+000D. A null text counts as
an empty one: it has no words and fails the base rules. Ties and repeated rows do not matter, as each row is judged
alone. Extra columns of the input pass through `with_quality` untouched.

The share of stop words is asked only of texts at least half of whose letters are Latin, the script of the four languages whose stop words are listed. Prose
of other languages in that script (Polish, Finnish) mostly fails it: pass other STOP_WORDS, or RULES without that line, for corpora that hold such texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import let

GAP = r"[\x20\x09-\x0D]+"
#: Letters of the Latin script, as a class of both regular expression dialects.
LATIN = "A-Za-zÀ-ɏ"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it was for on are as with by at from be this an or not "
    "der die das und zu den von ist nicht ein eine mit auf für im dem des sich auch es "
    "le la les de et un une des est en que qui dans pour pas sur du au avec il elle "
    "el los las que y en un una del se por con para al lo su es no como más"
).split()


@dataclass(frozen=True)
class Rule:
    """`numerator` / `denominator` must lie in [low, high], where the denominator is `least` or more; of Latin texts only if `latin` is set."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float
    least: int = 1
    latin: bool = False


#: The threshold table. Measures are the columns that `measures` returns.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1.5, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.25),
    Rule("exclamations_per_word", "n_exclamations", "n_words", 0.0, 0.5),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.02, 1.0, 30, True),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.4),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _covered(starts: Column, width: int) -> Column:
    """How many positions the windows at these ascending starts cover."""
    reach = F.transform(starts, lambda p, i: F.least(F.lit(width), F.get(starts, i + 1) - p))
    return F.aggregate(reach, F.lit(0), lambda acc, x: acc + x)


def _repeated(words: Column) -> Column:
    """Words inside windows of five that occur twice or more; windows are compared by a 64-bit hash of their words."""

    def windows(h: Column) -> Column:
        return F.transform(
            F.slice(h, 1, F.size(h) - (WINDOW - 1)),
            lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))),
        )

    def marked(win: Column) -> Column:
        ordered = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, i: (F.when(i > 0, F.get(s, i - 1)["h"]) == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]),
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        return let(let(ordered, starts), lambda p: _covered(p, WINDOW))

    some = let(
        let(F.transform(words, lambda w: F.xxhash64(w)), windows),
        lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(marked(win)),
    )
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(some)


def measures(text: Column) -> Column:
    """A struct of the counts that the rules weigh, all bigint."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    def counted(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    return F.struct(
        let(words_of(text), of_words).alias("words"),
        let(lines, of_lines).alias("lines"),
        counted("[^#*$%&|<>]+").alias("n_symbols"),
        counted("[^!]+").alias("n_exclamations"),
    )


def _mostly_latin(text: Column) -> Column:
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    return 2 * left(f"[^{LATIN}]+") >= left(r"\P{L}+")


def with_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, out_col: str = "quality") -> DataFrame:
    """docs with one struct column more: the measures, base_failed and kept."""
    m = docs.withColumn("__q", measures(F.col(text_col)))
    names = ("words.n_words", "words.word_chars", "n_symbols", "lines.n_dup_lines", "words.n_repeat_words", "words.n_stop_words", "lines.n_lines", "n_exclamations")
    base = (F.col("__q.words.n_words") < MIN_WORDS) | (100 * F.col("__q.words.n_repeat_words") > MAX_REPEATED_PERCENT * F.col("__q.words.n_words"))
    good = F.lit(True)
    where = {n.rsplit(".", 1)[-1]: F.col(f"__q.{n}") for n in names}
    for r in rules:
        share = where[r.numerator].cast("double") / F.when(where[r.denominator] >= r.least, where[r.denominator]).cast("double")
        within = F.coalesce(share.between(r.low, r.high), F.lit(True))
        # Letters are counted only where the share is out of range.
        good = good & (within | ~_mostly_latin(F.coalesce(F.col(text_col), F.lit(""))) if r.latin else within)
    fields = [c.alias(n) for n, c in where.items()]
    return m.withColumn(out_col, F.struct(*fields, base.alias("base_failed"), (~base & good).alias("kept"))).drop("__q")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of each row: counts, base_failed and kept."""
    q = with_quality(docs.select(id_col, text_col), text_col)
    return q.select(
        F.col(id_col),
        *(F.col(f"quality.{n}") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")),
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text passes; columns as given."""
    return with_quality(docs, text_col, out_col="__quality").where("__quality.kept").select(*docs.columns)


def _sql_list(items: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in items)


def oracle_sql() -> str:
    latin = f" OR 2 * length(regexp_replace(t, '[^{LATIN}]+', '', 'g')) < length(regexp_replace(t, '\\P{{L}}+', '', 'g'))"
    checks = " AND ".join(
        f"(coalesce({r.numerator}::double / (CASE WHEN {r.denominator} >= {r.least} THEN {r.denominator} END)::double BETWEEN {r.low} AND {r.high}, true){latin if r.latin else ''})" for r in RULES
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d),
win AS (SELECT rid, i, list_slice(w, i, i + 4) AS g FROM w, unnest(range(1, len(w) - 3)) AS r(i) WHERE len(w) >= 5),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY rid),
m AS (SELECT doc_id, t, len(w)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclamations,
        len(list_filter(w, lambda x: lower(x) IN ({_sql_list(sorted(set(STOP_WORDS)))})))::BIGINT AS n_stop_words,
        len(ln)::BIGINT AS n_lines, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {checks}) AS kept
FROM b"""

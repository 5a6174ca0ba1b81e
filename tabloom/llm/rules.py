"""Line-first cleaning: quality rules as SQL expressions, in one pass without a shuffle.

Every line with a word is held against the line rules below; lines that fail go, and a document that loses
too much of its text is rejected. Documents that fail the base rules (too few words, or too many
words in repeated windows) are rejected whatever their lines are.

Line rules: symbols (a line of mark-up or filler characters), navigation (items between separators), shouting
(capitals or repeated exclamation marks), boilerplate (short lines with a site's stock phrases) and
punctuation (a short line that doesn't end as a sentence does).

Defined results: a null text has no words and is rejected; equal rows get equal results; a text of any length
is worked on whole, in memory of a few times its own size; an empty table gives an empty table. Columns are
read by name; working columns are beside the row and not in it, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space as a character class body.
BLANK = r" \t-\r"
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Most symbols for each word, capitals for each letter (of lines of some words), exclamation pairs for each word.
MOST_SYMBOLS, MOST_CAPITALS, MOST_SHOUTS = 0.3, 0.7, 0.3
#: Words from which a line may lack a sentence end, and up to which it may be boilerplate.
LONG, SHORT = 8, 30
#: The least share of the characters in lines that must stay.
LEAST_KEPT = 0.5
#: Stock phrases of sites, lower case.
BOILERPLATE = r"\b(privacy policy|cookie policy|use of cookies|terms of (use|service)|all rights reserved|enable javascript|lorem ipsum|click here|sign (in|up)|log in|subscribe now|newsletter|read more|share (on|this)|skip to content|back to top)\b"
SENTENCE_END = r"[.!?:;…。！？][\"'”’»)\]]*[ \t-\r]*$"
#: Separators between the items of a menu.
NAVIGATION = r"( [|>»›·•] [^|>»›·•]{1,40}){3,}"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once, however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{BLANK}]+"), "")


def count_of(text: Column, characters: str) -> Column:
    """Characters of text that are in the class body."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("bigint")


def line_passes(line: Column) -> Column:
    """The line rules for a line that has a word."""
    words = F.size(words_of(line))
    letters, capitals = count_of(line, r"\p{L}"), count_of(line, r"\p{Lu}")
    shouts = F.length(line) - F.length(F.regexp_replace(line, "!!", "!"))
    symbols = count_of(line, SYMBOLS) <= MOST_SYMBOLS * words
    shouting = ~((words >= 3) & (capitals > MOST_CAPITALS * letters)) & (shouts <= MOST_SHOUTS * words)
    boilerplate = ~((words <= SHORT) & F.lower(line).rlike(BOILERPLATE))
    return symbols & ~line.rlike(NAVIGATION) & shouting & boilerplate & ((words >= LONG) | line.rlike(SENTENCE_END))


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words that lie in some window found twice or more: windows are compared by hash, found pairs by sorting, O(n log n)."""

    def covered(starts: Column) -> Column:
        """Places covered by windows at ascending starts."""
        return F.aggregate(starts, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-window).cast("int").alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    def found(sorted_: Column) -> Column:
        n = F.size(sorted_)
        same = lambda x, at: F.get(sorted_, at)["h"].eqNullSafe(x["h"])
        starts = F.transform(sorted_, lambda x, at: F.when(((at > 0) & same(x, at - 1)) | ((at < n - 1) & same(x, at + 1)), x["at"]).otherwise(-1))
        return covered(F.sort_array(F.array_remove(starts, -1)))

    def of(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(window))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), found)))

    return F.when(F.size(words) < window + 1, F.lit(0).cast("bigint")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of))


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (row: all columns of docs; q: the base figures, base_failed, lines, kept_lines, kept and clean_text, the lines that stay)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def base(words: Column) -> list[Column]:
        return [F.size(words).cast("bigint").alias("n_words"), repeated_words(words).alias("n_repeat_words")]

    def lines(all_: Column) -> Column:
        return let(F.filter(all_, lambda x: x.rlike(f"[^{BLANK}]")), lambda worded: let(F.filter(worded, line_passes), lambda passed: F.struct(
            F.size(worded).cast("bigint").alias("lines"),
            F.size(passed).cast("bigint").alias("kept_lines"),
            (F.size(worded) - F.size(F.array_distinct(worded))).cast("bigint").alias("n_dup_lines"),
            chars(worded).alias("chars"),
            chars(passed).alias("kept_chars"),
            F.array_join(passed, "\n").alias("clean_text"),
        )))

    def chars(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, line: a + F.length(line))

    first = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(
        let(words_of(text), lambda w: F.struct(*base(w))).alias("w"),
        let(F.split(text, "\n"), lines).alias("l"),
        F.length(F.regexp_replace(text, f"[{BLANK}]+", "")).cast("bigint").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
    ).alias("q"))
    w, line = F.col("q.w"), F.col("q.l")
    failed = (w["n_words"] < 10) | (100 * w["n_repeat_words"] > 20 * w["n_words"])
    return first.select("row", F.struct(
        w["n_words"].alias("n_words"), F.col("q.word_chars").alias("word_chars"), F.col("q.n_symbols").alias("n_symbols"), line["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"), line["lines"].alias("n_lines"), line["kept_lines"].alias("n_kept_lines"),
        (~failed & (line["kept_chars"] >= LEAST_KEPT * line["chars"])).alias("kept"), line["clean_text"].alias("clean_text"),
    ).alias("q"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the figures of every row."""
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_lines n_kept_lines".split()
    return judged(docs, text_col).select(F.col("row")[id_col].alias(id_col), *(F.col(f"q.{x}") for x in names))


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are kept, their texts without the lines that failed; all columns stay, n_chars (if there is one) follows the text."""
    # exploding a list that is empty for rejected rows: a filter would work the rules out a second time
    one = judged(docs, text_col).select("row", F.explode(F.filter(F.array("q"), lambda q: q["kept"])).alias("q"))
    new = {text_col: F.col("q.clean_text")}
    if "n_chars" in docs.columns and text_col != "n_chars":
        new["n_chars"] = F.length("q.clean_text").cast(docs.schema["n_chars"].dataType)
    return one.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _sql_line_rules(line: str) -> str:
    n = f"len(regexp_extract_all({line}, '[^{BLANK}]+'))"
    end, nav, stock = (x.replace("'", "''") for x in (SENTENCE_END, NAVIGATION, BOILERPLATE))
    of = lambda c: f"length(regexp_replace({line}, '[^{c}]+', '', 'g'))"
    return f"""({of(SYMBOLS)} <= {MOST_SYMBOLS} * {n} AND NOT regexp_matches({line}, '{nav}')
        AND NOT ({n} >= 3 AND {of(r'\p{Lu}')} > {MOST_CAPITALS} * {of(r'\p{L}')})
        AND length({line}) - length(replace({line}, '!!', '!')) <= {MOST_SHOUTS} * {n}
        AND NOT ({n} <= {SHORT} AND regexp_matches(lower({line}), '{stock}'))
        AND ({n} >= {LONG} OR regexp_matches({line}, '{end}')))"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^{BLANK}]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{BLANK}]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(words) - 3)) AS pos, words FROM w WHERE len(words) >= 5),
h AS (SELECT r, pos, count(*) OVER (PARTITION BY r, array_to_string(words[pos:pos + 4], ' ')) AS c FROM g),
c AS (SELECT r, pos, pos - lag(pos, 1, -9) OVER (PARTITION BY r ORDER BY pos) AS gap FROM h WHERE c > 1),
p AS (SELECT r, CAST(sum(least(5, gap)) AS BIGINT) AS n_repeat_words FROM c GROUP BY r),
l AS (SELECT w.*, list_filter(lines, lambda x: {_sql_line_rules('x')}) AS passed, coalesce(p.n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN p USING (r)),
f AS (SELECT *, len(words) < 10 OR 100 * n_repeat_words > 20 * len(words) AS base_failed FROM l)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[{BLANK}]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(list_sum(list_transform(passed, lambda x: length(x))), 0) >= {LEAST_KEPT} * coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS kept,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(passed) AS BIGINT) AS n_kept_lines
FROM f
"""

"""Quality rules, line first: navigation, boilerplate and unfinished lines go, then texts that lost too much are rejected.

Everything is a native expression over one row; nothing is shuffled. Each array that several expressions need is bound once
(``let``), so that no lambda computes it anew for each element.
"""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from hydroq.llm.catalog import query, table

# Fixed values.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
NAVIGATION_WORDS = "home|menu|main menu|log ?in|log ?out|sign (in|up|out)|register|subscribe|search|site ?map|next|previous|back( to top)?|read more|see more|show more|load more|click here|share( this)?|contact( us)?|about( us)?|skip to (main )?content"
BOILERPLATE = (
    "all rights reserved", "copyright ©", "copyright (c)", "©", "privacy policy", "cookie policy", "cookie settings", "cookie notice", "use of cookies", "uses cookies", "terms of use",
    "terms of service", "terms and conditions", "enable javascript", "javascript is disabled", "powered by ", "lorem ipsum",
)
LICENSE_STARTS = ("licensed under ", "released under ", "this work is licensed under ", "this work is released under ")
SEPARATORS = r"[|»›•·→]"
MARKS = ".!?:;…。！？；：؟۔।॥"
CLOSERS = "\"')]}*_”’»›」』）"
RULES = ("navigation", "boilerplate", "punctuation")
NAVIGATION = rf"(?i)^[^\p{{L}}\p{{N}}]*({NAVIGATION_WORDS})[^\p{{L}}\p{{N}}]*$"
MENU = rf"{SEPARATORS}[^|»›•·→]*{SEPARATORS}"
SHORT_LINE = 12  # words; longer lines with separators are tables or lists


def let(value, use):
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def word_chars(text):
    return F.length(F.translate(text, SPACES, ""))


def words_of(text):
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def boilerplate(low):
    return reduce(or_, [*(low.contains(x) for x in BOILERPLATE), *(low.startswith(x) for x in LICENSE_STARTS)])


def broken_rule(line):
    """The first rule that the line breaks; null for lines that stay, blank ones among them."""

    def rule(t):
        menu = t.rlike(MENU) & (F.size(F.split(t, r"[\x20\x09-\x0D]+")) <= SHORT_LINE)
        finished = F.instr(F.lit(MARKS), F.right(F.rtrim(t, F.lit(CLOSERS)), F.lit(1))) > 0
        return F.when(t == "", None).when(t.rlike(NAVIGATION) | menu, "navigation").when(let(F.lower(t), boilerplate), "boilerplate").when(~finished | (F.rtrim(t, F.lit(CLOSERS)) == ""), "punctuation")

    return let(F.trim(line, F.lit(SPACES)), rule)


def repeated_words(words):
    """How many of the words lie in a window of three that occurs twice or more.

    Windows are sorted with their places; neighbours in that order tell which occur again. n log n steps for n words.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(s):
        again = F.filter(F.transform(s, lambda x, j: F.when((x["w"] == F.get(s, j - 1)["w"]) | (x["w"] == F.get(s, j + 1)["w"]), x["i"])), lambda i: i.isNotNull())
        return let(again, lambda a: F.size(F.array_distinct(F.flatten(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.transform(a, lambda i: i + k))))))

    # most texts repeat no window, which a set of hashes shows (the two short windows at the end never equal a full one)
    again = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((F.size(words) > 3) & again, let(F.sort_array(windows), covered)).otherwise(0)


def judged(docs, most_lost=0.3, id_col="doc_id", text_col="text"):
    """One row for every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_navigation, n_boilerplate, n_punctuation (lines removed by each rule), lost_chars (their characters in words), kept and clean_text.

    base_failed: under 50 words, or over half of them in windows of three words that occur again. kept: not base_failed, and the
    lines removed hold at most ``most_lost`` of the characters in words. clean_text: the lines that stay, with line feeds between
    them; blank lines stay. Null and empty texts have no words and fail; repeated rows are judged alike; other columns stay out.
    Empty table: no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))

    def breaks(rule):
        return lambda x: F.coalesce(x["rule"] == rule, F.lit(False))

    def line_facts(lines):
        marked = F.transform(lines, lambda x: F.struct(x.alias("line"), broken_rule(x).alias("rule")))
        return let(marked, lambda m: F.struct(
            F.size(m).cast("long").alias("n_lines"),
            *(F.size(F.filter(m, breaks(rule))).cast("long").alias(f"n_{rule}") for rule in RULES),
            F.aggregate(m, F.lit(0).cast("long"), lambda total, x: total + F.when(x["rule"].isNotNull(), word_chars(x["line"])).otherwise(0)).alias("lost_chars"),
            F.array_join(F.transform(F.filter(m, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
            let(F.filter(m["line"], lambda x: F.trim(x, F.lit(SPACES)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ))

    words = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")))
    facts = rows.select(
        "doc_id", words.alias("w"), let(F.split("text", "\n"), line_facts).alias("l"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    out = facts.select("doc_id", "w.*", "l.*", "n_symbols")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("lost_chars") <= most_lost * F.col("word_chars"))
    return out.withColumns({"base_failed": failed, "kept": kept})


def keep_good(docs, most_lost=0.3, text_col="text"):
    """The rows of ``docs`` that are kept, with the cleaned text; all columns stay."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    out = judged(packed, most_lost, "row").where("kept")
    return out.select(*((F.col("clean_text") if c == text_col else F.col("doc_id").getField(c)).alias(c) for c in docs.columns))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_navigation", "n_boilerplate", "n_punctuation", "lost_chars")


@query(
    "op12_line_quality_rules",
    rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT row, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM texts)
), ruled AS (
  SELECT *, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, CASE WHEN t = '' THEN NULL
    WHEN regexp_matches(t, '{NAVIGATION}') OR regexp_matches(t, '{MENU}') AND len(string_split_regex(t, '[\x20\x09-\x0D]+')) <= {SHORT_LINE} THEN 'navigation'
    WHEN {' OR '.join([f"contains(lower(t), '{x}')" for x in BOILERPLATE] + [f"starts_with(lower(t), '{x}')" for x in LICENSE_STARTS])} THEN 'boilerplate'
    WHEN instr('{MARKS}', right(rtrim(t, '{CLOSERS.replace("'", "''")}'), 1)) = 0 OR rtrim(t, '{CLOSERS.replace("'", "''")}') = '' THEN 'punctuation' END AS rule FROM lines
), by_line AS (
  SELECT row, count(*) AS n_lines, count(*) FILTER (rule = 'navigation') AS n_navigation, count(*) FILTER (rule = 'boilerplate') AS n_boilerplate,
    count(*) FILTER (rule = 'punctuation') AS n_punctuation, coalesce(CAST(sum(chars) FILTER (rule IS NOT NULL) AS BIGINT), 0) AS lost_chars,
    count(*) FILTER (t <> '') - count(DISTINCT line) FILTER (t <> '') AS n_dup_lines FROM ruled GROUP BY row
), words AS (
  SELECT row, generate_subscripts(w, 1) AS pos, unnest(w) AS w FROM (
    SELECT row, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts)
), windows AS (
  SELECT row, pos, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS x FROM words WINDOW o AS (PARTITION BY row ORDER BY pos)
), again AS (
  SELECT row, pos FROM windows WHERE x IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row, x) > 1
), repeated AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([pos, pos + 1, pos + 2]) AS p FROM again) GROUP BY row
), counts AS (
  SELECT row, count(*) AS n_words FROM words GROUP BY row
), facts AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    n_dup_lines, coalesce(n, 0) AS n_repeat_words, n_lines, n_navigation, n_boilerplate, n_punctuation, lost_chars
  FROM texts JOIN by_line USING (row) LEFT JOIN counts USING (row) LEFT JOIN repeated USING (row)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.3 * word_chars AS kept FROM facts
""",
)
def op12(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *BASE)

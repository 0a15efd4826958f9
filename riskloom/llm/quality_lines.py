"""Quality rules, line first: drop failing lines, then documents that lost too much.

A line fails if it is navigation (several bars or arrows between short pieces), symbol noise,
shouting, a licence or rights notice, a short menu entry or a bare fragment without closing
punctuation (of any script).  A long line fails only for what it is as a whole, never for one word in it.  What is left is the cleaned text; a document whose failing lines hold more than
`MOST_LOST` of its characters is rejected.  Everything is built from DataFrame functions inside
the document's own row: nothing is shuffled, so copies and long texts cause no skew.

Defined cases: null text has no words and fails the base rules; lines without a word are kept as
they are and count nowhere; repeated rows get equal results; an empty table gives no rows; other
columns are passed over, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions.plan import computed_once
from riskloom.llm.shared import GAP, WORD, table, text_or_empty

LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of words
WINDOW = 8
MOST_LOST = 0.5

NAVIGATION_LEAST, NAVIGATION_PIECE = 3, 30  # separators, characters from one to the next
NOISE = r"[#*$%&<>]{3,}[^#*$%&<>]{0,60}[#*$%&<>]{3,}"
NOISE_SHARE = 5  # a symbol in so many characters
LOWER, UPPER, SHOUT = r"\p{Ll}", r"\p{Lu}\p{Lu}", "!!"
# Notices fail a line of up to so many characters; menu words only a short one that is no sentence.
NOTICE = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|lorem ipsum|licensed under|redistribution and use)"
)
NOTICE_CHARS = 240
MENU = r"(?i)\b(cookies?|javascript|subscribe|sign (in|up)|log ?in|read more|click here)\b"
MENU_CHARS = 80
SENTENCE = r"[.!?…。！？।॥۔؟][\"'”’»)\]」』）]*[\x20\x09-\x0D]*$"
CLOSED = r"[.!?…:;,\"'”’»)\]}。！？、；：」』）】》।॥۔؟،؛][\x20\x09-\x0D]*$"
FRAGMENT_WORDS = 8
# Scripts that do not put spaces between words: a line of so many characters is no fragment.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]{4}"
UNSPACED_CHARS = 16


def _count(line: Column, signs: str) -> Column:
    """How many characters of the line are among the signs."""
    return F.length(line) - F.length(F.translate(line, signs, ""))


def line_fails(line: Column) -> Column:
    """Whether the line as a whole is furniture: one word or sign in a long line does not decide."""
    size = F.length(line)
    # A closing guillemet is an arrow only where no opening one makes it a quotation.
    arrows = F.when(line.contains("«"), F.lit(0)).otherwise(_count(line, "»"))
    bars = _count(line, "|>›•·") + arrows
    navigation = line.rlike("[|>»›•·]") & (bars >= NAVIGATION_LEAST) & (size <= (bars + 1) * NAVIGATION_PIECE)
    noise = line.rlike(NOISE) & (_count(line, "#*$%&<>") * NOISE_SHARE >= size)
    shout = line.contains(SHOUT) & line.rlike(UPPER) & ~line.rlike(LOWER)
    notice = (size <= NOTICE_CHARS) & line.rlike(NOTICE)
    menu = (size <= MENU_CHARS) & line.rlike(MENU) & ~line.rlike(SENTENCE)
    worded = line.rlike(rf"({WORD}{GAP}){{{FRAGMENT_WORDS}}}") | ((size >= UNSPACED_CHARS) & line.rlike(UNSPACED))
    return navigation | noise | shout | notice | menu | (~line.rlike(CLOSED) & ~worded)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def measured(documents: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, the base measures, the verdict and the cleaned text of every document."""
    text = text_or_empty()
    one = computed_once(
        documents.select(*keep, text.alias("_text")),
        _words=F.transform(
            F.regexp_extract_all(F.col("_text"), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)
        ),
        _lines=F.transform(
            F.split("_text", "\n"),
            lambda x: F.struct(x.alias("line"), F.when(_has_word(x), line_fails(x)).alias("fails")),
        ),
    )
    worded = F.filter("_lines", lambda x: x["fails"].isNotNull())
    chars = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + F.length(x["line"]))
    two = computed_once(
        one.select(
            *keep,
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.regexp_replace("_text", GAP, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(worded) - F.size(F.array_distinct(F.transform(worded, lambda x: x["line"]))))
            .cast("long").alias("n_dup_lines"),
            chars(worded).alias("_chars"),
            chars(F.filter("_lines", lambda x: x["fails"])).alias("_lost"),
            F.array_join(
                F.transform(
                    F.filter("_lines", lambda x: ~F.coalesce(x["fails"], F.lit(False))), lambda x: x["line"]
                ),
                "\n",
            ).alias("cleaned"),
            "_words",
        ),
        _windows=F.when(
            F.size("_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice("_words", i, WINDOW)),
            ),
        ),
    ).drop("_words")
    # Only texts with a repeated window sort their windows.
    three = computed_once(
        two,
        _sorted=F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("_windows")
    again = F.transform(
        "_sorted",
        lambda x, j: F.when(
            (F.get("_sorted", j - 1)["h"] == x["h"]) | (F.get("_sorted", j + 1)["h"] == x["h"]), x["i"]
        ),
    )
    four = computed_once(three, _again=F.sort_array(F.filter(again, lambda i: i.isNotNull())))
    covered = F.aggregate(
        "_again",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(
            (i + WINDOW).alias("end"),
            (s["n"] + i + WINDOW - F.greatest(i, s["end"])).cast("long").alias("n"),
        ),
        lambda s: s["n"],
    )
    five = four.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED
    )
    return five.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("_lost") <= F.col("_chars") * MOST_LOST)
    ).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", F.col("_lost").alias("lost_chars"), "cleaned",
    )


def cleaned_documents(documents: DataFrame) -> DataFrame:
    """The kept documents, all columns, their texts without the failing lines."""
    whole = documents.select(F.struct(*documents.columns).alias("_row"), "text")
    kept = measured(whole, "_row").filter("kept")
    text = lambda c: F.when(F.col("lost_chars") > 0, F.col("cleaned")).otherwise(F.col("_row.text")) if c == "text" else F.col("_row")[c]
    return kept.select(*[text(c).alias(c) for c in documents.columns])


def op2_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents"), "doc_id").drop("cleaned")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), f AS (
  SELECT *, list_filter(lines, lambda x:
    (len(regexp_extract_all(x, '[|>›•·]')) + CASE WHEN contains(x, '«') THEN 0 ELSE len(string_split(x, '»')) - 1 END >= 3
      AND length(x) <= 30 * (1 + len(regexp_extract_all(x, '[|>›•·]')) + CASE WHEN contains(x, '«') THEN 0 ELSE len(string_split(x, '»')) - 1 END))
    OR (regexp_matches(x, '[#*$%&<>]{3,}[^#*$%&<>]{0,60}[#*$%&<>]{3,}') AND 5 * len(regexp_extract_all(x, '[#*$%&<>]')) >= length(x))
    OR (contains(x, '!!') AND regexp_matches(x, '\p{Lu}{2}') AND NOT regexp_matches(x, '\p{Ll}'))
    OR (length(x) <= 240 AND (contains(lower(x), 'all rights reserved') OR contains(lower(x), 'terms of use')
      OR contains(lower(x), 'terms of service') OR contains(lower(x), 'privacy policy') OR contains(lower(x), 'lorem ipsum')
      OR contains(lower(x), 'licensed under') OR contains(lower(x), 'redistribution and use')))
    OR (length(x) <= 80 AND NOT regexp_matches(x, '[.!?…。！？।॥۔؟]["''”’»)\]」』）]*[ \t\n\x0b\f\r]*$')
      AND regexp_matches(x, '(?i)(^|[^0-9a-z_])(cookie|cookies|javascript|subscribe|sign in|sign up|login|log in|read more|click here)($|[^0-9a-z_])'))
    OR (NOT regexp_matches(x, '[.!?…:;,"''”’»)\]}。！？、；：」』）】》।॥۔؟،؛][ \t\n\x0b\f\r]*$')
      AND NOT regexp_matches(x, '(\x20|[\t\n\x0b\f\r]|^)([^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]+){8}')
      AND NOT (length(x) >= 16 AND regexp_matches(x, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]{4}')))
  ) AS failing
  FROM w
), p AS (
  SELECT r, i, list_aggregate(words[i : i + 7], 'string_agg', ' ') AS win
  FROM w, unnest(range(1, len(words) - 6)) AS t(i) WHERE len(words) >= 8
), q AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM p) WHERE n > 1
), c AS (
  SELECT r, sum(least(8, coalesce(nxt, i + 8) - i))::BIGINT AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM q) GROUP BY r
), m AS (
  SELECT f.r, doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0)::BIGINT AS chars,
    coalesce(list_sum(list_transform(failing, lambda x: length(x))), 0)::BIGINT AS lost_chars
  FROM f LEFT JOIN c ON f.r = c.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
  NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND lost_chars <= chars * 0.5 AS kept,
  lost_chars
FROM m
"""

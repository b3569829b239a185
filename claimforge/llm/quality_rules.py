"""Quality rules, line first: each line is judged, failing lines go, and documents that lose too much text go.

DataFrame functions only. Line rules, each over one ``\\n``-split line that holds a word:

* punctuation: symbols ``#*$%&|<>`` make up at least ``max_symbol_pct`` percent of the characters, or ``!!`` occurs at least three times for every ten words;
* navigation: at least ``nav_separators`` separators `` | ``;
* boilerplate: a line of under ``boilerplate_chars`` characters that holds a phrase of ``BOILERPLATE``.

A document is kept if it passes the base rules (``min_words``; at most half of its words in repeated 3-word windows)
and its failing lines hold at most ``max_lost_pct`` percent of its characters.

Cases: null and empty texts have no words and fail the base rules; a very long text is judged whole, in one row. Repeated
rows are judged each on its own. An empty table gives no rows. Input columns are kept, whatever their names; columns of
the same name as a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, hidden, native_words, read_table

#: Phrases of site furniture (lower case); our own list.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "click here", "sign in to", "sign up for", "subscribe to our", "skip to content", "share this page",
)
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbol_pct: int = 10
    nav_separators: int = 3
    boilerplate_chars: int = 200
    max_lost_pct: int = 50


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _line_fails(line: Column, rules: QualityRules) -> Column:
    lowered = F.lower(line)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | lowered.contains(p)
    marked = line.rlike("[#*$%&|<>!]") & (
        (F.regexp_count(line, F.lit(SYMBOLS)) * 100 >= F.length(line) * rules.max_symbol_pct)
        | ((F.regexp_count(line, F.lit("!!")) * 10 >= F.regexp_count(line, F.lit(WORD_PATTERN)) * 3) & line.contains("!!"))
        | (F.regexp_count(line, F.lit(r" \| ")) >= rules.nav_separators)
    )
    return marked | ((F.length(line) < rules.boilerplate_chars) & phrase)


#: Bits of a packed window that hold its position; the rest hold hash bits.
POSITION_BITS = 31


def _covered(starts: Column) -> Column:
    """Number of words under the 3-word windows that start at ``starts`` (ascending)."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda total, x: total + x))


def _repeated(items: str, key) -> Column:
    """Of an array sorted by key, the entries whose key an entry beside them has too."""
    return F.filter(
        items,
        lambda x, i: key(F.get(items, i + 1)).eqNullSafe(key(x)) | key(F.get(items, i - 1)).eqNullSafe(key(x)),
    )


def with_repeat_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds the number of words in 3-word windows that occur twice or more in the array ``words``.

    Windows are sorted as longs that pack hash bits and a position; those whose hash bits repeat are sorted once more
    by their words, which decides. Work is n log n in the words of a text.
    """
    n = F.size(words)
    window = lambda i: [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]
    packed = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.xxhash64(*window(i)), POSITION_BITS).bitwiseOR(i.cast("long"))
    )
    out = df.withColumn("__packed", F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<long>")))
    out = out.withColumn("__seeds", _repeated("__packed", lambda x: F.shiftright(x, POSITION_BITS)))
    out = out.withColumn(
        "__exact",
        F.sort_array(
            F.transform(
                "__seeds",
                lambda x: (lambda p: F.struct(F.array(*window(p)).alias("w"), p.alias("p")))(
                    x.bitwiseAND((1 << POSITION_BITS) - 1).cast("int")
                ),
            )
        ),
    )
    out = out.withColumn("__starts", F.sort_array(F.transform(_repeated("__exact", lambda x: x["w"]), lambda x: x["p"])))
    return out.withColumn(name, _covered(F.col("__starts")).cast("long")).drop("__packed", "__seeds", "__exact", "__starts")


def apply_quality_rules(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, cleaned_text, kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "cleaned_text", "kept"]
    docs, own = hidden(docs.drop(*new), "text")
    out = docs.withColumns({"__words": native_words(text), "__lines": F.split(text, "\n")})
    out = out.withColumns(
        {
            "__word_lines": F.filter("__lines", _has_word),
            "__good": F.filter("__lines", lambda x: ~_line_fails(x, rules)),
        }
    )
    out = with_repeat_words(out, "__words", "n_repeat_words")
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__word_lines") - F.size(F.array_distinct("__word_lines"))).cast("long"),
            "cleaned_text": F.when(F.col("text").isNotNull(), F.array_join("__good", "\n")),
            "lost_chars": (
                F.length(F.array_join("__lines", "")) - F.length(F.array_join("__good", ""))
            ).cast("long"),
        }
    )
    base_failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_pct
    )
    lost = F.col("lost_chars") * 100 > F.length(text) * rules.max_lost_pct
    # A filter on the verdict would be pushed down through all columns above, each put into the next, and their nested
    # expressions grow without bound. What isn't deterministic isn't pushed; this one is always true.
    stay = F.monotonically_increasing_id() >= 0
    out = out.withColumns({"base_failed": base_failed, "kept": ~base_failed & ~lost & stay})
    return out.select(*own, *new)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return apply_quality_rules(docs).select("doc_id", *names)


def op6_sql(rules: QualityRules = QualityRules()) -> str:
    words = lambda x: f"regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+')"
    count = lambda x, pattern: f"len(regexp_extract_all({x}, '{pattern}'))"
    phrases = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
    base = f"(n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_pct} * n_words)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {words('t')} AS ws FROM d),
win AS (SELECT r, p, w.ws[p] AS a, w.ws[p + 1] AS b, w.ws[p + 2] AS c
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3) w),
hit AS (SELECT r, p FROM win QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
cov AS (SELECT r, count(DISTINCT p + o) AS n FROM hit, (VALUES (0), (1), (2)) v(o) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
fl AS (SELECT r, l, len({words('l')}) > 0 AS worded, length(l) AS n,
         ({count('l', SYMBOLS)} * 100 >= length(l) * {rules.max_symbol_pct} AND regexp_matches(l, '[#*$%&|<>!]')
          OR {count('l', '!!')} * 10 >= len({words('l')}) * 3 AND contains(l, '!!')
          OR {count('l', r' \| ')} >= {rules.nav_separators}
          OR length(l) < {rules.boilerplate_chars} AND ({phrases})) AS fails FROM lines),
la AS (SELECT r, count(*) FILTER (worded) - count(DISTINCT l) FILTER (worded) AS n_dup,
         sum(CASE WHEN fails THEN n ELSE 0 END) AS lost FROM fl GROUP BY r),
b AS (SELECT w.doc_id, length(t) AS n_chars, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        {count('t', SYMBOLS)}::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN cov USING (r) LEFT JOIN la USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {base} AS base_failed, (NOT {base} AND lost * 100 <= n_chars * {rules.max_lost_pct}) AS kept
FROM b"""

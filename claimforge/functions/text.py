"""Text functions as columns: claims, relation cues, tokens, values, and the value-guarded overlap score.

All stay in the JVM but for `normalize`, whose Unicode composition Spark lacks: texts of ASCII only skip it.
Python's strip, \\w and \\s are matched by Unicode classes.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The relation cues of the claim extractor.
RELATION_CUES = (
    "was written by", "were written by", "is written by", "written by", "was authored by", "authored by",
    "is the author of", "author of", "wrote", "is a", "is an", "is the", "was a", "was an", "was the", "is", "was",
    "are", "were", "belongs to", "is part of", "was published in", "published in", "was published by", "published by",
)
# The stop words that are never reported as unresolved.
STOP_WORDS = (
    "a", "an", "the", "is", "was", "were", "are", "be", "been", "being", "has", "have", "had", "of", "in", "on", "at",
    "to", "for", "and", "or", "but", "with", "by", "from", "it", "its", "this", "that", "which", "who", "whom", "what",
    "when", "where", "how", "not", "no", "as", "also", "both",
)
# Month names that count as dates.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december",
)

CUES_LONGEST_FIRST = tuple(sorted(RELATION_CUES, key=lambda c: (-len(c), c)))
CUE_PATTERN = rf"(?isU)^(.*?)(?<!\w)({'|'.join(CUES_LONGEST_FIRST)})(?!\w)(.*)$"


def strip(c: Column) -> Column:
    """Python's str.strip()."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """The claims of a text: cut after . ! ? followed by white space, and after a semicolon."""
    parts = F.split(strip(text), r"(?U)(?<=[.!?])\s+|(?<=;)\s*", -1)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def cue_parts(claim: Column) -> Column:
    """struct(head, relation, tail): around the first relation cue, the longest where several start; without a cue the
    whole claim is the head."""
    found = claim.rlike(CUE_PATTERN)
    part = lambda k: strip(F.regexp_extract(claim, CUE_PATTERN, k))
    return F.struct(
        F.when(found, part(1)).otherwise(claim).alias("head"),
        F.when(found, F.lower(F.regexp_extract(claim, CUE_PATTERN, 2))).otherwise("").alias("relation"),
        F.when(found, strip(F.regexp_replace(part(3), r"\.+$", ""))).otherwise("").alias("tail"),
    )


def listed_triples(answer: Column) -> Column:
    """array<struct(head, relation, tail)> from lines ``head ; relation ; tail``; shorter and empty lines are left out."""
    clean = lambda x: strip(F.regexp_replace(strip(x), r"\.+$", ""))
    rows = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.split(x, ";")), lambda p: F.size(p) >= 3)
    made = F.transform(rows, lambda p: F.struct(clean(p[0]).alias("head"), clean(p[1]).alias("relation"), clean(p[2]).alias("tail")))
    return F.filter(made, lambda t: (t["head"] != "") | (t["relation"] != "") | (t["tail"] != ""))


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower))


def values(text: Column) -> Column:
    """Distinct values that a claim commits to: years and months, numbers, capitalised phrases (lower case)."""
    find = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    dates = find(rf"(?iU)\b\d{{4}}\b|\b(?:{'|'.join(MONTHS)})\b")
    numbers = find(r"(?U)\b\d+(?:\.\d+)?\b")
    # ++ finds the same as +, since nothing follows, and doesn't recurse on long phrases.
    names = find(r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)++")
    return F.array_distinct(F.concat(F.transform(dates, F.lower), numbers, F.transform(names, F.lower)))


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalize(text: Column) -> Column:
    """Stripped, lower case, composed."""
    lowered = F.lower(strip(text))
    # Python is handed nulls for ASCII texts; a condition around the call alone would not keep them from it.
    return F.coalesce(_composed(F.when(lowered.rlike(r"[^\x00-\x7F]"), lowered)), lowered)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two token arrays; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def guard_blocks(premise: Column, hypothesis_values: Column) -> Column:
    """Whether some value of the hypothesis is neither inside the premise nor one of its values."""
    return blocked(F.lower(premise), values(premise), hypothesis_values)


def blocked(low: Column, own: Column, hypothesis_values: Column) -> Column:
    """The same for a premise in lower case and its values."""
    return F.exists(hypothesis_values, lambda v: ~(low.contains(v) | F.array_contains(own, v)))


def guarded_score(premise: Column, hypothesis: Column) -> Column:
    """The overlap of premise and hypothesis, or 0 where the value guard blocks."""
    return F.when(guard_blocks(premise, values(hypothesis)), F.lit(0.0)).otherwise(overlap(tokens(premise), tokens(hypothesis)))


def proportion_se(p: Column, n: Column) -> Column:
    """Standard error of a proportion; 0 without observations."""
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.when(n > 0, F.sqrt(q * (1 - q) / n)).otherwise(0.0)


def triple_key(s: Column, p: Column, o: Column) -> Column:
    """``s|p|o``; a null object reads ``None``."""
    return F.concat_ws("|", s, p, F.coalesce(o, F.lit("None")))

"""Text functions: folding, natural order, search text, keywords, names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_one(text: str | None) -> str | None:
    """Compatibility decomposition without combining marks, lower case, of one text."""
    return text if text is None else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """fold_one() of each text."""
    return text.map(fold_one)


# Latin letters with marks, and the plain letters they fold to.
MARKED = "áàâäãåāăąçćčďéèêëēėęěíìîïīįñńňóòôöõōőřśšşťţúùûüūůűųýÿžźżğ"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiinnnooooooorsssttuuuuuuuuyyzzzg"


def folded(text: Column) -> Column:
    """Lower case, Latin letters without their marks, by Spark's own functions; fold() does so for all scripts."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def casefolded(text: Column) -> Column:
    """folded(), with ß as ss: the variant that names of places and lists are compared by."""
    return F.replace(folded(text), F.lit("ß"), F.lit("ss"))


def contains_folded(column: str, word: str) -> Column:
    """Whether a text holds a word, regardless of case and accents, by collation: no Python."""
    return F.contains(F.collate(F.coalesce(F.col(column), F.lit("")), "UNICODE_CI_AI"), F.collate(F.lit(word), "UNICODE_CI_AI"))


def contains_all(haystack: str, words: list[str], without: list[str] = ()) -> Column:
    """Whether already folded text holds every word and none of ``without``."""
    text = F.coalesce(F.col(haystack), F.lit(""))
    out = F.lit(True)
    for w in words:
        out = out & F.contains(text, F.lit(w))
    for w in without:
        out = out & ~F.contains(text, F.lit(w))
    return out


def natural_key(column: str) -> Column:
    """A key that sorts runs of digits as numbers, however long, before other runs; case is ignored.

    A run of digits is (0, its length without zeros in front, its digits), another (1, 0, the run).
    """
    runs = F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit("([0-9]+|[^0-9]+)"), 1)
    number = lambda r: F.regexp_replace(r, "^0+", "")
    part = lambda kind, size, run: F.struct(kind.alias("kind"), size.alias("size"), run.alias("run"))
    return F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), part(F.lit(0), F.length(number(r)), number(r))).otherwise(part(F.lit(1), F.lit(0), r)))


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def words_match(name: Column, typed: Column) -> Column:
    """Whether every typed word starts some word of the name (both folded)."""
    words, of = F.split(F.trim(typed), r"\s+"), F.split(F.trim(name), r"\s+")
    return F.forall(words, lambda t: F.exists(of, lambda w: F.startswith(w, t)))


def keywords(text: Column) -> Column:
    """The keywords of a list separated by ; or , in order, each once, regardless of case."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda s: F.trim(s)), lambda s: s != "")
    # sorted by what is compared, the first of each is the one before which another stands; a lambda's own variable is counted once
    once = lambda column, then: F.get(F.transform(F.array(column), then), F.lit(0))
    keyed = F.sort_array(F.transform(parts, lambda s, i: F.struct(F.lower(s).alias("key"), i.alias("at"), s.alias("word"))))
    first = once(keyed, lambda z: F.filter(z, lambda x, j: (j == 0) | (F.get(z, j - 1)["key"] != x["key"])))
    return F.transform(F.sort_array(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["word"].alias("word")))), lambda x: x["word"])


def merge_keywords(mine: Column, more: Column) -> Column:
    return F.array_join(keywords(F.concat_ws(";", mine, more)), "; ")


def search_text(*columns: str, date: Column | None = None) -> Column:
    """Lower-case text to search in: columns, and a date as year, month and day in numbers and month names."""
    parts = [F.col(c).cast("string") for c in columns]
    if date is not None:
        parts += [F.date_format(date, p) for p in ("yyyy-MM-dd", "yyyy", "MMMM", "MM/yyyy")]
    return F.lower(F.concat_ws(" ", *parts))


def duration_text(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.round(seconds).cast("long")
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(short)


def size_text(size: Column) -> Column:
    """Decimal units, one digit after the point from kB on."""
    out = F.format_string("%d B", size.cast("long"))
    for power, unit in ((1e3, "kB"), (1e6, "MB"), (1e9, "GB"), (1e12, "TB")):
        out = F.when(size >= power, F.format_string(f"%.1f {unit}", size / power)).otherwise(out)
    return out

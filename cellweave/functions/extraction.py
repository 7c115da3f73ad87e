"""Entities read off model answers: the extractors of the evaluation drivers, which differ in what they accept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.text import blank_if_null, collapse, let, short_marker, strip

# Forms of an entity in an answer, from the fullest to the loosest.
LONG_FORM = r"<[^>]+\[DESCRIPTION\][^>]+\[TYPE\][^>]*>"
SHORT_FORM = r"<[^>]+\[DESC\][^>]+\[TYPE\][^>]*>"
ANY_FORM = r"<[^>]+>"
SPACED_FORM = r"(?s)<\s*[^<>]+?\s*\[DESCRIPTION\]\s*[^<>]+?\s*\[TYPE\]\s*[^<>]+?>"
# Where a model begins to repeat its prompt.
ECHOES = ("\n### Input:\n", "\n### Question:\n", "\n[TLE] ")
_MOST_CHARS = 500  # of an answer without any entity


def answer_part(x: Column) -> Column:
    """What follows the last closing think tag, white space collapsed."""
    return collapse(F.substring_index(blank_if_null(x), "</think>", -1))


def in_brackets(x: Column) -> Column:
    return let(strip(x), lambda s: F.when(s == "", s).otherwise(F.concat(F.when(F.startswith(s, F.lit("<")), "").otherwise("<"), s, F.when(F.endswith(s, F.lit(">")), "").otherwise(">"))))


def _first_match(x: Column, forms: list[str]) -> Column:
    """The first match of the first form that has one, else null."""
    return F.coalesce(*(F.nullif(strip(F.regexp_extract(x, f, 0)), F.lit("")) for f in forms))


def _held(text: Column, candidates: Column) -> Column:
    """The first candidate that stands in the text, else null."""
    return F.get(F.filter(F.transform(candidates, strip), lambda c: (c != "") & F.contains(text, c)), F.lit(0))


def candidate_entity(raw: Column, candidates: Column) -> Column:
    """The first candidate in the answer, else its first entity, else its first 500 characters; in angle brackets."""
    def of(t: Column) -> Column:
        found = F.coalesce(in_brackets(_held(t, candidates)), _first_match(t, [LONG_FORM, ANY_FORM]), in_brackets(F.left(t, F.lit(_MOST_CHARS))))
        return F.when(t == "", "").otherwise(found)

    return let(answer_part(raw), of)


def before_echo(raw: Column) -> Column:
    """An answer up to where it repeats its prompt."""
    x = blank_if_null(raw)
    for mark in ECHOES:
        x = F.substring_index(x, mark, 1)
    return x


def table_entity(raw: Column, candidates: Column) -> Column:
    """The longest candidate whose text, with either spelling of its marker, stands in the answer before any echo of the
    prompt; empty if none does. Quoted, bracketed and loose forms all hold that text, so none needs a rule of its own."""
    wrapped = F.filter(F.transform(candidates, lambda c: in_brackets(blank_if_null(c))), lambda c: F.length(c) >= 3)
    inner = F.transform(wrapped, lambda c, i: F.struct((-F.length(c)).alias("size"), i.alias("at"), c.alias("c"), F.substring(c, F.lit(2), F.length(c) - 2).alias("inner")))

    def of(t: Column) -> Column:
        def there(x: Column) -> Column:
            spellings = F.array(x, F.replace(x, F.lit("[DESC]"), F.lit("[DESCRIPTION]")), short_marker(x))
            return F.exists(spellings, lambda v: F.contains(t, v) | F.contains(t, collapse(v)))

        return F.when(t == "", "").otherwise(F.coalesce(F.get(F.filter(F.array_sort(inner), lambda x: there(x["inner"])), F.lit(0))["c"], F.lit("")))

    return let(answer_part(before_echo(raw)), of)


def plain_entity(raw: Column, candidates: Column) -> Column:
    """The first candidate in the answer as it is, else its first entity with the short marker, else empty."""
    of = lambda t: F.when(t == "", "").otherwise(F.coalesce(_held(t, candidates), short_marker(_first_match(t, [SHORT_FORM, LONG_FORM, ANY_FORM])), F.lit("")))
    return let(answer_part(raw), of)


def written_entity(content: Column) -> Column:
    """The first full entity of a text, else its first in angle brackets, else all of it; white space collapsed."""
    of = lambda t: collapse(F.coalesce(_first_match(t, [SPACED_FORM, r"(?s)<[^<>]+>"]), t))
    return let(strip(blank_if_null(content)), of)


def compared_form(x: Column) -> Column:
    """For comparison: white space collapsed, no outer angle brackets."""
    return let(collapse(blank_if_null(x)), lambda s: F.when((F.length(s) >= 2) & F.startswith(s, F.lit("<")) & F.endswith(s, F.lit(">")), strip(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(s))


def bracketed_answer(x: Column) -> Column:
    """An answer in angle brackets if it has a marker of candidates."""
    marked = lambda s: F.contains(s, F.lit("[DESCRIPTION]")) | F.contains(s, F.lit("[TYPE]"))
    whole = lambda s: F.startswith(s, F.lit("<")) & F.endswith(s, F.lit(">"))
    return let(collapse(blank_if_null(x)), lambda s: F.when(~whole(s) & marked(s), F.concat(F.lit("<"), s, F.lit(">"))).otherwise(s))


def candidate_names(x: Column) -> Column:
    """Names of two characters and more that stand before a description marker."""
    names = F.regexp_extract_all(blank_if_null(x), F.lit(r"(?i)<\s*([^<>\[]+?)\s*\[DESC"), F.lit(1))
    return F.filter(F.transform(names, strip), lambda n: F.length(n) >= 2)

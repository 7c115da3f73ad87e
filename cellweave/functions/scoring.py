"""Scores of candidates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.text import collapse, let, strip, tokens

# Weights of the candidate score.
WEIGHTS = {"exact": 3.8, "contains": 1.3, "sim": 2.3, "prior": 1.8, "type": 1.0, "ctx": 0.9, "bm25": 1.4}
# Column words and the type names that go with them.
TYPE_GROUPS = [
    (["member", "athlete", "player", "person", "winner", "name"], ["human", "person", "athlete"]),
    (["city", "country", "state", "location", "place", "address"], ["city", "country", "settlement", "location"]),
    (["album", "song", "film", "book", "work"], ["album", "song", "film", "book", "work"]),
    (["team", "club"], ["sports team", "club"]),
    (["school", "university", "college"], ["university", "college", "school"]),
]


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings share from the start."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(at, F.lit(0)) - 1, n))


def similarity(a: Column, b: Column) -> Column:
    """Of two normalised names: 1 if equal, else 0.75 token Jaccard + 0.25 shared prefix by the longer length."""
    mixed = 0.75 * jaccard(F.array_distinct(tokens(a)), F.array_distinct(tokens(b))) + 0.25 * common_prefix(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(mixed)


def type_match(column_norm: Column, type_norm: Column) -> Column:
    of = tokens(column_norm)
    matched = F.lit(False)
    for keys, types in TYPE_GROUPS:
        named = F.lit(False)
        for t in types:
            named = named | F.contains(type_norm, F.lit(t))
        matched = matched | (F.arrays_overlap(of, F.array(*map(F.lit, keys))) & named)
    return F.when((column_norm == "") | (type_norm == ""), 0.0).otherwise(matched.cast("double"))


def candidate_score(features: dict[str, Column]) -> Column:
    return sum((w * features[k] for k, w in WEIGHTS.items() if k in features), F.lit(0.0))


def remote_rank(label: Column, mention: Column, score: Column, sitelinks: Column, statements: Column, disambiguation: Column) -> Column:
    exact, prefix, contains = (label == mention), F.startswith(label, mention), F.contains(label, mention)
    return (
        1000 * exact.cast("double") + 200 * prefix.cast("double") + 50 * contains.cast("double") + 25 * jaccard(F.array_distinct(tokens(label)), F.array_distinct(tokens(mention)))
        + score + F.log1p(sitelinks.cast("double")) + 8 * F.log1p(statements.cast("double")) - 400 * disambiguation.cast("double")
    )


def is_disambiguation(type_id: Column, description: Column) -> Column:
    return (F.coalesce(type_id, F.lit("")) == "Q4167410") | F.contains(F.lower(F.coalesce(description, F.lit(""))), F.lit("disambiguation"))


def bm25_term(tf: Column, df: Column, length: Column, average: Column, n: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """Contribution of a query term; the inverse frequency has a floor, so common terms never count against a match."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.greatest(idf, F.lit(1e-6)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def safe_double(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def safe_long(x: Column) -> Column:
    return F.coalesce(x.try_cast("double").cast("long"), F.lit(0))


def length_ratio(chosen: Column, rejected: Column) -> Column:
    return chosen / F.greatest(F.lit(1), rejected)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers of equal length; 0 if one is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def char_ngrams(x: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """All character n-grams of the text; a text that is shorter is its own only one."""
    grams = []
    for n in sizes:
        grams.append(F.when((F.length(x) < n) & (x != ""), F.array(x)).when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), _gram(x, n))).otherwise(F.array().cast("array<string>")))
    return F.concat(*grams)


def _gram(x: Column, n: int):
    return lambda i: F.substring(x, i, F.lit(n))


def gram_set(grams: Column) -> Column:
    """struct(once, again, norm) of a gram array: its distinct grams, those of them that occur more than once beside how
    often, and the length of the vector of counts. Only repeated grams are counted one by one."""
    def of(g: Column) -> Column:
        repeated = let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
        again = F.map_from_entries(F.transform(repeated, lambda x: F.struct(x, F.size(F.filter(g, lambda h: h == x)).cast("double"))))
        return let(F.struct(F.array_distinct(g).alias("once"), again.alias("again")), lambda r: F.struct(r["once"].alias("once"), r["again"].alias("again"), _norm(r).alias("norm")))

    return let(grams, of)


def _norm(r: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(r["again"]), F.size(r["once"]).cast("double"), lambda s, n: s + n * n - 1))


def set_cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts of two gram sets: shared grams count one, repeated ones what their counts add to that."""
    often = lambda r, g: F.coalesce(F.try_element_at(r["again"], g), F.lit(1.0))
    more = F.array_union(F.map_keys(a["again"]), F.map_keys(b["again"]))
    dot = let(F.array_intersect(a["once"], b["once"]), lambda both: F.aggregate(F.array_intersect(more, both), F.size(both).cast("double"), lambda s, g: s + often(a, g) * often(b, g) - 1))
    return F.when((F.size(a["once"]) == 0) | (F.size(b["once"]) == 0), 0.0).otherwise(dot / (a["norm"] * b["norm"]))


def gram_cosine(a: Column, b: Column) -> Column:
    """Cosine of the n-gram counts of two gram arrays."""
    return let(gram_set(a), lambda x: let(gram_set(b), lambda y: set_cosine(x, y)))


def name_cosine(a: Column, b: Column) -> Column:
    """Cosine of two names by their character 3- and 4-grams."""
    return let(char_ngrams(a), lambda x: let(char_ngrams(b), lambda y: gram_cosine(x, y)))


def hard_negatives(candidates: Column, gold: Column, others: int) -> Column:
    """The gold answer, then the `others` candidates most like it by character n-grams, each once; of equal ones the
    first in the list."""
    inner = lambda c: collapse(F.lower(F.regexp_replace(c, r"(?s)^\s*<(.*)>\s*$", "$1")))
    grams = lambda c: let(inner(c), lambda x: gram_set(char_ngrams(x)))

    def picked(own: Column, of_gold: Column) -> Column:
        rest = F.filter(F.array_distinct(candidates), lambda c: strip(c) != own)
        ranked = F.transform(rest, lambda c, i: F.struct((-F.round(let(grams(c), lambda g: set_cosine(g, of_gold)), 9)).alias("s"), i.alias("i"), c.alias("c")))
        return F.concat(F.array(own), F.transform(F.slice(F.array_sort(ranked), 1, others), lambda r: r["c"]))

    return let(strip(gold), lambda own: let(grams(own), lambda of_gold: picked(own, of_gold)))

"""Secret scan with a trigram inverted index, in SQL functions only.

Each rule's regex is parsed into a Boolean query of trigrams that every match must contain (a rule may yield none:
such a rule scans every text). The index files, for each trigram that some query asks for, the texts that contain it;
intersecting the postings gives the candidate texts of each rule, and only there the rule's regex runs. Texts are filed by their
64-bit hash, so copies are filed once; a collision could only add a candidate, which the regex then rejects.

Matches are leftmost and non-overlapping per kind; those whose checked group is too short are dropped. Spans are code
points, ends exclusive. Null text counts as empty. Repeated rows give repeated results, an empty table an empty one;
other columns are ignored.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.scratch import cut

_BROADCAST_TEXTS = 200_000  # candidate texts whose hashes go to all tasks; more are joined by a shuffle
_BLOCK = 256  # matches of a text placed together
_EXACT = 64  # strings that a part of a regex may stand for before it counts as open


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0  # the group whose length is checked
    least: int = 0  # its least length
    base: bool = True


# Base rules first, in the order in which ties at a start are listed. Lengths that no failing match can hide are part
# of the regex: a run of hex digits, or of an access key, is as long from its start as it gets.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
)

# A query is None (no condition) or a list of alternatives, each a set of trigrams that must all be there.
Query = list[frozenset[str]] | None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return list(dict.fromkeys(x | y for x in a for y in b))


def _of_strings(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    return sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted)


def _part(op, arg) -> tuple[set[str] | None, Query]:
    """(the strings a part stands for, if they are few; the query of a part that stands for more)."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < _EXACT:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 6 else (None, None)
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), None
        queries = [q if s is None else _of_strings(s) for s, q in parts]
        return None, None if None in queries else [x for q in queries for x in q]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if least == 0:
            return (strings | {""}, None) if strings is not None and most == 1 else (None, None)
        if strings is not None and least == most == 1:
            return strings, None
        return None, query if strings is None else _of_strings(strings)
    return None, None


def _sequence(items) -> tuple[set[str] | None, Query]:
    run, query, exact = {""}, None, True
    for op, arg in items:
        strings, own = _part(op, arg)
        if strings is not None and len(run) * len(strings) <= _EXACT:
            run = {a + b for a in run for b in strings}
            continue
        query = _both(query, _of_strings(run))
        run, exact = ({""}, False) if strings is None else (strings, False)
        query = _both(query, own)
    return (run, None) if exact else (None, _both(query, _of_strings(run)))


def trigram_query(regex: str) -> Query:
    """Alternatives of trigrams, in lower case, that a text with a match must contain; None if there are none."""
    strings, query = _sequence(parser.parse(regex))
    return query if strings is None else _of_strings(strings)


def build_index(texts: Column, df: DataFrame, rules=RULES) -> DataFrame:
    """The postings (trigram, text_hash) of the trigrams that the rules ask for."""
    asked = sorted({t for r in rules for alternative in trigram_query(r.regex) or [] for t in alternative})
    # One pass finds all trigrams where they start, overlaps included; they branch on their first character.
    by_first: dict[str, list[str]] = {}
    for t in asked:
        by_first.setdefault(t[0], []).append(re.escape(t[1:]))
    anywhere = "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + "))"
    # Columns that aren't deterministic keep the filter that explode implies from computing all this again.
    low = df.select(F.xxhash64(texts).alias("text_hash"), F.lower(texts).alias("low"), F.spark_partition_id().alias("p"))
    there = F.array_distinct(F.regexp_extract_all("low", F.lit(anywhere), F.lit(1))) if asked else F.array().cast("array<string>")
    filed = low.select("text_hash", there.alias("there"), F.spark_partition_id().alias("p"))
    return filed.select("text_hash", F.explode("there").alias("trigram")).distinct()


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """Intersect postings: (text_hash, rules) with the kinds whose query the text meets."""
    of_text = postings.groupBy("text_hash").agg(F.collect_set("trigram").alias("grams"))
    met = []
    for r in rules:
        if query := trigram_query(r.regex):
            meets = F.lit(False)
            for alternative in query:
                wanted = F.array(*map(F.lit, sorted(alternative)))
                meets = meets | (F.size(F.array_intersect("grams", wanted)) == len(alternative))
            met.append(F.when(meets, F.lit(r.kind)))
    if not met:
        return of_text.select("text_hash", F.array().cast("array<string>").alias("rules")).limit(0)
    return of_text.select("text_hash", F.array_compact(F.array(*met)).alias("rules")).where(F.size("rules") > 0)


def _length(x: Column) -> Column:
    return F.char_length(x)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, rule: Rule, place: int, active: Column) -> Column:
    """array<struct<start, place, end, kind, base>> of one rule. Gaps between matches, found by splitting, and the
    matches' own lengths add up to positions: within blocks of _BLOCK matches, and over the blocks by their totals, so
    that no array grows element by element for longer than a block."""
    regex = F.lit(rule.regex)
    none = F.array().cast("array<string>")
    found = F.when(active, F.regexp_extract_all(text, regex, F.lit(0))).otherwise(none)
    checked = F.when(active, F.regexp_extract_all(text, regex, F.lit(rule.group))).otherwise(none) if rule.least else found
    item = "struct<start:int,place:int,end:int,kind:string,base:boolean>"

    def steps(found: Column) -> Column:
        gaps = F.when(F.size(found) > 0, F.split(text, rule.regex, -1)).otherwise(none)
        kept = F.transform(checked, lambda c: _length(c) >= rule.least)
        return F.arrays_zip(F.transform(found, _length).alias("m"), kept.alias("keep"), F.transform(F.slice(gaps, 1, F.size(found)), _length).alias("g"))

    def blocks(steps: Column) -> Column:
        last = F.floor((F.size(steps) - 1) / _BLOCK).cast("int")
        return F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(steps, b * _BLOCK + 1, _BLOCK)))

    def bases(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["g"] + x["m"]))
        return F.aggregate(totals, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def placed(block: Column, base: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["g"]
            end = start + x["m"]
            span = F.array(F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.base).alias("base")))
            return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(base.alias("at"), F.array().cast(f"array<{item}>").alias("out")), step, lambda acc: acc["out"])

    whole = lambda parts: F.flatten(F.zip_with(parts, F.slice(bases(parts), 1, F.size(parts)), placed))
    spans = _let(found, lambda m: _let(steps(m), lambda s: _let(blocks(s), whole)))
    return F.coalesce(spans, F.array().cast(f"array<{item}>"))


def scan(df: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_<kind> of the base rules, base_sha256, spans (all rules' spans by start)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("__id"), text.alias("__text"))
    postings = cut(build_index(F.col("__text"), docs, rules), "postings")
    met = cut(candidates(postings, rules), "candidates")
    docs = docs.withColumn("text_hash", F.xxhash64("__text"))
    docs = docs.join(F.broadcast(met) if met.count() <= _BROADCAST_TEXTS else met, "text_hash", "left")
    found = []
    for place, r in enumerate(rules):
        active = F.lit(True) if trigram_query(r.regex) is None else F.coalesce(F.array_contains("rules", r.kind), F.lit(False))
        found.append(_spans(F.col("__text"), r, place, active))
    docs = docs.select("__id", F.array_sort(F.concat(*found)).alias("found"))
    name = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["base"])
    kinds = F.transform("found", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return docs.select(F.col("__id").alias(id_col), *counts, F.sha2(name(base), 256).alias("base_sha256"), name(F.col("found")).alias("spans"))


def oracle(rules=RULES) -> str:
    """The scan of documents in DuckDB, every rule over every text."""
    parts, quote = [], lambda s: s.replace("'", "''")
    for place, r in enumerate(rules):
        parts.append(f"""
SELECT doc_id, i AS nth, '{r.kind}' AS kind, {place} AS place, {str(r.base).lower()} AS base, length(checked[i]) >= {r.least} AS kept,
  list_sum([0] || list_transform(gaps[1:i], lambda x: length(x))) + list_sum([0] || list_transform(found[1:i-1], lambda x: length(x))) AS start, length(found[i]) AS size
FROM (SELECT doc_id, found, checked, gaps, unnest(range(1, len(found) + 1)) AS i FROM
  (SELECT doc_id, regexp_extract_all(t, '{quote(r.regex)}') AS found, regexp_extract_all(t, '{quote(r.regex)}', {r.group}) AS checked, string_split_regex(t, '{quote(r.regex)}') AS gaps FROM d))""")
    name = "kind || ':' || start || ':' || (start + size)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {counts}, string_agg({name}, ',' ORDER BY start, place) FILTER (base) AS base_spans, string_agg({name}, ',' ORDER BY start, place) AS spans FROM s WHERE kept GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

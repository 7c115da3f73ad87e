"""Text functions as Column expressions. White space and word classes follow Unicode, as do case rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

WS = r"(?U)[\s\x1c-\x1f]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once; inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_if_null(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def strip(x: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.regexp_replace(x, rf"^{WS}+|{WS}+$", "")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, rf"{WS}+", " "))


def clean_text(x: Column) -> Column:
    """Collapse white space; null becomes empty."""
    return collapse(blank_if_null(x))


def is_blank(x: Column) -> Column:
    return strip(blank_if_null(x)) == ""


@pandas_udf(T.StringType())
def _without_marks(x: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining characters; there is no SQL function for it."""
    return x.str.normalize("NFKD").str.replace(r"[̀-ͯ҃-֑҇-ֽً-ٟऀ-ः᪰-᫿᷀-᷿⃐-⃿゙゚︠-︯]", "", regex=True)


def normalize_text(x: Column, ascii_only: bool = False) -> Column:
    """Match form of a name: no accents, lower case, no parenthesised part, letters a-z, digits and single spaces.

    ascii_only skips the accent step, which is the one that leaves the JVM, for columns known to be ASCII.
    """
    x = blank_if_null(x)
    if not ascii_only:
        x = _without_marks(x)
    x = F.regexp_replace(F.lower(x), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\s]", " "), r"\s+", " "))


def lower_collapse(x: Column) -> Column:
    return collapse(F.lower(blank_if_null(x)))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def words(x: Column) -> Column:
    return F.filter(F.split(blank_if_null(x), rf"{WS}+"), lambda t: t != "")


def candidate_text(label: Column, qid: Column, description: Column, type_label: Column) -> Column:
    """<LABEL [DESCRIPTION] ... [TYPE] ...>; the label falls back to the id, empty parts read None."""
    part = lambda c: F.when(is_blank(c), F.lit("None")).otherwise(clean_text(c))
    name = F.when(is_blank(label), qid).otherwise(clean_text(label))
    return F.concat(F.lit("<"), name, F.lit(" [DESCRIPTION] "), part(description), F.lit(" [TYPE] "), part(type_label), F.lit(">"))


def row_context(cells: Column) -> Column:
    """A row's cells that aren't blank, joined by bars."""
    return F.array_join(F.filter(F.transform(cells, clean_text), lambda c: c != ""), " | ")


def question(mention: Column, column_name: Column, candidates: Column) -> Column:
    return F.concat(
        F.lit("The selected entity mention in the table cell is: "), mention, F.lit(". The column name for '"), mention, F.lit("' is "), column_name,
        F.lit(". The referent entity candidates are: "), F.array_join(candidates, ", "),
        F.lit(" What is the correct referent entity for the entity mention '"), mention, F.lit("'?"),
    )


def question_mention(q: Column) -> Column:
    return F.regexp_extract(q, r"(?is)selected entity mention in the table cell is:\s*(.*?)\.\s*The column name", 1)


def question_column(q: Column) -> Column:
    return strip(F.regexp_extract(q, r"(?i)The column name for '.+?' is\s*([^.]+)\.", 1))


def question_candidates(q: Column) -> Column:
    """The <...> candidates between the list's opening and the closing question."""
    segment = F.regexp_extract(q, r"(?is)the referent entity candidates are:(.*?)(?:what is|$)", 1)
    return F.regexp_extract_all(segment, F.lit(r"<[^>]+>"), F.lit(0))


def with_candidates(q: Column, candidates: Column) -> Column:
    """A question with other candidates in its list."""
    whole = r"(?is)^(.*?the referent entity candidates are:)(.*?)((?:what is).*)$"
    return F.when(q.rlike(whole), F.concat(F.regexp_extract(q, whole, 1), F.lit(" "), F.array_join(candidates, ", "), F.lit(" "), F.regexp_extract(q, whole, 3))).otherwise(q)


def strict_candidates(q: Column, expected: Column) -> Column:
    """Candidates in the full form if there are as many as expected (-1: one or more); null if not."""
    segment = strip(F.regexp_extract(q, r"(?is)the referent entity candidates are:(.*?)(?:what is the correct|$)", 1))
    found = F.regexp_extract_all(segment, F.lit(r"(?s)<.*? \[DESCRIPTION\] .*? \[TYPE\] .*?>"), F.lit(0))
    right = F.when(expected == -1, (F.size(found) >= 1) | (segment == "")).when(expected == 0, segment == "").otherwise(F.size(found) == expected)
    return F.when(right, found)


def page_key(input_seg: Column) -> Column:
    """(page, section) as one key; a title ends at its first period."""
    page = F.regexp_extract(input_seg, r"(?is)The Wikipedia page is about\s+(.*?)\.", 1)
    section = F.regexp_extract(input_seg, r"(?is)The Wikipedia section is about\s+(.*?)\.", 1)
    return F.concat_ws("\x1f", strip(page), strip(section))


def page_title(html: Column) -> Column:
    return clean_text(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))


def prompt(instruction: Column, input_seg: Column, q: Column) -> Column:
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Input:\n"), input_seg, F.lit("\n\n### Question:\n"), q, F.lit("\n\n### Response:\n"))


# The instructions of the prompt templates, and the rules that one of them adds to its question.
PLAIN_TASK = "entity linking task. choose only the correct one from the referent entity candidates."
HINT = " In the Input below, the table content only contains the caption (if any), all column headers, and the cells from the same row and same column as the selected entity mention."
REASONING_RULES = (
    "Reasoning requirements:\n"
    "1) Use context evidence only (page/section/caption + row/column + candidate [DESCRIPTION]/[TYPE]).\n"
    "2) Keep reasoning concise; do NOT restate the full table/question/candidate list.\n"
    "3) Do NOT copy/paste candidate lists from the input; only cite minimal distinguishing evidence.\n"
    "4) The reasoning should support the same final entity you output after </think>.\n"
    "5) Reasoning is mandatory: include non-empty reasoning content before the final entity; do not output answer-only.\n\n"
    "After reasoning, output exactly one referent entity in candidate format (e.g. <EntityName [DESCRIPTION] ... [TYPE] ...>)."
)


def task_prompt(input_seg: Column, q: Column, template: str = "hint") -> Column:
    """A prompt for one sample: "plain", with a "hint" on what the table holds, or with the hint and "rules" for reasoning.
    It ends where the response is to begin."""
    task = PLAIN_TASK + ("" if template == "plain" else HINT)
    rules = f"\n\n{REASONING_RULES}" if template == "rules" else ""
    return F.concat(F.lit(f"### Instruction:\n{task}\n\n### Input:\n"), blank_if_null(input_seg), F.lit("\n\n### Question:\n"), blank_if_null(q), F.lit(f"{rules}\n\n### Response:"))


def prompt_question(p: Column) -> Column:
    return F.regexp_extract(p, r"(?s)### Question:\n(.*?)\n\n### Response:", 1)


def short_marker(x: Column) -> Column:
    return F.replace(x, F.lit("[DESCRIPTION]"), F.lit("[DESC]"))


def name_variants(mention: Column) -> Column:
    return F.array_distinct(F.array(mention, title_case(mention), F.lower(mention)))


def title_case(x: Column) -> Column:
    """Every run of letters with its first letter upper and the rest lower; apostrophes and digits end a run."""
    parts = F.regexp_extract_all(x, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))), "")


def qid_of_uri(uri: Column) -> Column:
    return F.regexp_extract(uri, r"/entity/(Q\d+)$", 1)


def query_literal(x: Column) -> Column:
    """Escape a string for an English literal of a graph query."""
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


# The units of a wait in seconds, and what marks a message as one about limits.
UNITS = {"ms": 0.001, "millisecond": 0.001, "milliseconds": 0.001, "m": 60.0, "min": 60.0, "mins": 60.0, "minute": 60.0, "minutes": 60.0, "h": 3600.0, "hr": 3600.0, "hrs": 3600.0, "hour": 3600.0, "hours": 3600.0}
LIMIT_WORDS = ("rate limit", "too many requests", "quota", "requests limit", "request limit")


def _positive(x: Column) -> Column:
    number = x.try_cast("double")
    return F.when(number > 0, number)


def _told(message: Column, words: str) -> Column:
    """Seconds after some words of a message, null if they aren't there."""
    form = rf"(?i){words}\s+([0-9]+(?:\.[0-9]+)?)\s*(milliseconds?|ms|minutes?|mins?|m|hours?|hrs?|h)?"
    unit = F.lower(F.regexp_extract(message, form, 2))
    factor = F.lit(1.0)
    for name, seconds in UNITS.items():
        factor = F.when(unit == name, seconds).otherwise(factor)
    return _positive(_positive(F.regexp_extract(message, form, 1)) * factor)


def wait_seconds(message: Column, headers: Column | None = None, now: Column | None = None, default: float = 600.0) -> Column:
    """Seconds to wait after a limit: what the headers (a map, lower-case names) say, else what the message says ("try
    again in 3 m", "resets in 90s"), else the default. A reset is a moment if it lies after `now`, else a length."""
    ways = []
    if headers is not None:
        get = lambda name: F.try_element_at(headers, F.lit(name))
        ways += [_positive(get("retry-after-ms")) / 1000, _positive(get("retry-after"))]
        reset = F.coalesce(*(F.nullif(get(n), F.lit("")) for n in ("x-ratelimit-reset", "x-rate-limit-reset", "ratelimit-reset"))).try_cast("double")
        at = F.unix_timestamp().cast("double") if now is None else now
        ways.append(_positive(F.when(reset > at + 1, reset - at).otherwise(reset)))
    return F.coalesce(*ways, _told(message, "try again in"), _told(message, r"resets?\s+in"), F.lit(default))


def is_limit_error(message: Column, status: Column | None = None) -> Column:
    """Whether an error is about limits: by its status, or by its words."""
    low = F.lower(blank_if_null(message))
    said = F.lit(False)
    for w in LIMIT_WORDS:
        said = said | F.contains(low, F.lit(w))
    return said if status is None else F.coalesce(status == 429, F.lit(False)) | said

"""Functions on answers of the form <think>reasoning</think><ENTITY>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.text import WS, blank_if_null, collapse, is_blank, let, strip, words

ENTITY = r"(?is)<\s*[^<>]+?\s*\[(?:DESC|DESCRIPTION)\]\s*[^<>]*?\s*\[TYPE\]\s*[^<>]*?>"

# The patterns that score reasoning; a hit counts once per pattern.
TEMPLATE = [
    r"now output after reasoning", r"output reasoning within", r"we('| wi)ll output (that|it|the)", r"we should output that (one|entity)",
    r"thus,?\s+the output should be that entity", r"i'?ll (just )?(select|choose|output|pick) (that|it|this)( candidate| entity| one)?\.?\s*$",
    r"looking at candidates\b", r"因此选择该实体", r"下面给出答案",
]
EVIDENCE = [
    r"\bcolumn\b", r"\brow\b", r"\btable\b", r"\bcontext\b", r"\bsection\b", r"\bpage\b", r"\bcaption\b", r"\byear\b", r"\btype\b", r"\bdescription\b",
    r"候选", r"列", r"行", r"表格", r"上下文", r"章节|页面|年份|类型|描述",
]
JUSTIFY = [
    r"\bbecause\b", r"\bsince\b", r"\bso\b", r"\bthus\b", r"\btherefore\b", r"refers?\s+to", r"\bindicat(e|es|ing)\b", r"\bcorrespond(s|ing)?\b",
    r"consistent with", r"\bmatch(es|ing)?\b", r"\balign(s|ed)?\b", r"\bfits?\b", r"points? to", r"\bsuggests?\b", r"given that", r"因为|所以|因此|对应|匹配|表明|说明",
]
CONCLUSION = (
    r"(?:final answer|the (?:correct |right )?(?:answer|entity|referent)(?:\s+(?:is|should be))|so (?:the )?(?:answer|correct)(?:\s+is)?|"
    r"therefore[, ]|thus[, ]|i(?:'| a)?ll (?:choose|select|go with)|最终答案|正确(?:答案|实体)(?:是|为)?)"
)
CONTRAST = [
    r"other candidate", r"\bunlike\b", r"\bwhereas\b", r"rather than", r"instead of", r"distinguish", r"rule[sd]?\s+out", r"eliminat(e|es|ed|ing)",
    r"exclud(e|es|ed|ing)", r"not relevant", r"(does not|doesn'?t)\s+(match|fit|refer|apply)", r"(are|is)\s+not\s+(consistent|relevant|correct)",
    r"(most|more)\s+specific", r"best\s+match", r"the only candidate", r"only one (that )?(match|fit)", r"narrow", r"排除|而不是|区别|相比|只有一个",
]
LEAKAGE = [
    r"\bverif(y|ies|ied|ication)\b", r"the solution (says|check|is)", r"must construct reasoning", r"reasoning that leads to (it|that|the)",
    r"given the (verif|solution|answer)", r"the (verified|provided|given|gold|correct)\s+(answer|entity|output|label)", r"i must comply", r"predetermined",
    r"answer key", r"as per the (solution|verification|answer)",
]
RAMBLE = [
    r"\bbut wait\b", r"\blet me reconsider\b", r"\blet'?s reconsider\b", r"\breconsider\b", r"\bon second thought\b", r"\bhold on\b", r"\bhmm+\b",
    r"\bwait,\s", r"\b(i'?m|i am) not sure\b",
]
REFUSAL = [r"^\s*(sorry|i am sorry|as an ai language model)", r"\b(can[ ]?not|can't)\s+(assist|help)\b"]
# Evidence words of sentence ranking; one of them counts twice.
SENTENCE_EVIDENCE = [r"\brow\b", r"\bcolumn\b", r"\bcaption\b", r"\bcontext\b", r"\bsection\b", r"\bpage\b", r"\btype\b", r"\bdescription\b", r"\bmatch(es|ed|ing)?\b", r"\bcontext\b"]


def hits(x: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, (x.rlike(f"(?iu){p}").cast("int") for p in patterns))


def entities(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(ENTITY), F.lit(0))


def has_think(x: Column) -> Column:
    return F.contains(x, F.lit("<think>")) & F.contains(x, F.lit("</think>"))


_BLOCK = r"(?is)<\s*think\s*>(.*?)<\s*/\s*think\s*>"


def think_of(x: Column) -> Column:
    """Body of the first think block, null without one."""
    x = blank_if_null(x)
    return F.when(x.rlike(_BLOCK), strip(F.regexp_extract(x, _BLOCK, 1)))


def after_think(x: Column) -> Column:
    x = blank_if_null(x)
    return F.when(x.rlike(_BLOCK), strip(F.regexp_extract(x, _BLOCK + r"(.*)$", 2))).otherwise(strip(x))


def parse_output(x: Column) -> Column:
    """struct(think, entity) of an answer with a closing tag and an entity after the last one, else null."""
    x = blank_if_null(x)
    post = F.regexp_extract(x, r"(?is)^.*</think>(.*)$", 1)
    pre = F.regexp_extract(x, r"(?is)^(.*)</think>", 1)
    entity = F.regexp_extract(post, ENTITY, 0)
    think = F.when(pre.rlike(r"(?i)<\s*think\s*>"), F.regexp_extract(pre, r"(?is)^.*?<\s*think\s*>(.*)$", 1)).otherwise(pre)
    return F.when(x.rlike(r"(?i)</think>") & (entity != ""), F.struct(strip(think).alias("think"), strip(entity).alias("entity")))


def build_output(think: Column, entity: Column) -> Column:
    return F.concat(F.lit("<think>\n"), strip(blank_if_null(think)), F.lit("\n</think>\n"), entity)


def sentences(x: Column) -> Column:
    parts = F.split(blank_if_null(x), rf"(?<=[.!?。！？]){WS}+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def is_dump(s: Column) -> Column:
    """A sentence that lists candidates instead of reasoning."""
    markers = F.size(F.regexp_extract_all(s, F.lit(r"(?i)\[(?:DESC|DESCRIPTION|TYPE)\]"), F.lit(0)))
    return s.rlike(ENTITY) | (markers >= 2) | (s.rlike(r"^\s*[-*•]\s") & F.contains(s, F.lit("<")))


def is_final_line(s: Column) -> Column:
    return s.rlike(r"(?i)^\s*(final answer|final|answer|答案|最终答案)\s*[:：]")


def distinct_sentences(parts: Column) -> Column:
    """First of each group that is equal up to case and white space, in order."""
    key = lambda s: collapse(F.lower(s))
    keyed = F.transform(parts, lambda s: F.struct(key(s).alias("k"), s.alias("s")))

    def firsts(kept: Column) -> Column:
        return let(F.transform(kept, lambda x: x["k"]), lambda keys: F.transform(F.filter(kept, lambda x, i: (x["k"] != "") & (F.array_position(keys, x["k"]) == i + 1)), lambda x: x["s"]))

    return let(keyed, firsts)


def repeat_ratio(x: Column, n: int) -> Column:
    """1 - distinct / all runs of n words; 0 with n words or fewer."""
    def ratio(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) <= n, F.lit(0.0)).otherwise(let(runs, lambda r: 1.0 - F.size(F.array_distinct(r)) / F.size(r)))

    return let(words(x), ratio)


def estimated_tokens(x: Column) -> Column:
    n = F.size(words(x))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n * 1.3).cast("int")))


def first_tokens(x: Column, most: Column) -> Column:
    return F.array_join(F.slice(words(x), 1, F.greatest(F.lit(1), F.floor(most / 1.3).cast("int"))), " ")


def marker_form(x: Column) -> Column:
    """One spelling of the markers, no outer angle brackets."""
    x = F.regexp_replace(blank_if_null(x), r"(?i)\[\s*(?:description|desc)\s*\]", "[DESC]")
    x = collapse(F.regexp_replace(x, r"(?i)\[\s*type\s*\]", "[TYPE]"))
    return strip(F.regexp_replace(x, r"^[<>]+|[<>]+$", ""))


def answer_form(x: Column) -> Column:
    """Canonical answer: the last entity after the reasoning if there is one, else the fullest <...> shape, with one
    spelling of markers, no quotes round the name, in one pair of angle brackets; empty if nothing is left.

    Whole texts are answers too, so a pattern runs only where plain searches say that it can match, and once white space is
    collapsed (blanks alone are left, markers have one spelling) plain searches do the rest."""
    has = lambda x, *parts: reduce(lambda a, b: a | b, (F.contains(x, F.lit(p)) for p in parts))
    once = lambda x, p: let(F.regexp_extract(x, p, 0), lambda found: F.nullif(found, F.lit("")))

    def edges(x: Column) -> Column:
        return F.when(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(WS), strip(x)).otherwise(x)

    def late(x: Column) -> Column:
        post = F.regexp_extract(x, r"(?is)^.*</think>(.*)$", 1)
        found = F.regexp_extract_all(post, F.lit(r"(?s)<[^<>]+>"), F.lit(0))
        return F.when(has(x, "</") & x.rlike(r"(?i)</think>"), F.coalesce(let(found, lambda f: F.get(f, F.size(f) - 1)), x)).otherwise(x)

    def markers(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?i)\[\s*(?:description|desc)\s*\]", "[DESC]")
        return F.regexp_replace(x, r"(?i)\[\s*type\s*\]", "[TYPE]")

    # A single blank stays as it is; other runs of white space become one.
    white = WS.removeprefix("(?U)")
    single = lambda x: F.regexp_replace(x, rf"(?U)[\s\x1c-\x1f&&[^ ]]{white}*+| {white}++", " ")

    def shaped(x: Column) -> Column:
        full = F.when(has(x, "[DESC]"), F.coalesce(F.when(has(x, "[TYPE]"), once(x, r"<[^<>]+\[DESC\][^<>]+\[TYPE\][^<>]+>")), once(x, r"<[^<>]+\[DESC\][^<>]+>")))
        return F.when(has(x, "<"), F.coalesce(full, once(x, r"<[^<>]+>"), F.substr(x, F.instr(x, F.lit("<"))))).otherwise(x)

    def wrapped(core: Column) -> Column:
        def parts(head: Column) -> Column:
            tail = F.substr(core, F.length(head) + 1)
            quoted = lambda n, q: F.startswith(n, F.lit(q)) & F.endswith(n, F.lit(q))
            bare = let(F.trim(head), lambda n: F.when((F.length(n) >= 2) & (quoted(n, "'") | quoted(n, '"')), F.trim(F.substring(n, F.lit(2), F.length(n) - 2))).otherwise(n))
            return F.concat(F.lit("<"), F.concat_ws(" ", let(bare, lambda n: F.nullif(n, F.lit(""))), let(tail, lambda t: F.nullif(t, F.lit("")))), F.lit(">"))

        head = F.substring_index(F.substring_index(core, "[DESC]", 1), "[TYPE]", 1)
        return F.when(core == "", "").otherwise(let(head, parts))

    x = let(let(blank_if_null(x), edges), lambda x: F.when(has(x, "s>", "S>"), F.regexp_replace(x, r"(?i)</?s>", " ")).otherwise(x))
    x = let(let(x, late), lambda x: F.when(has(x, "["), markers(x)).otherwise(x))
    x = let(let(single(x), F.trim), shaped)
    return let(F.btrim(x, F.lit(" <>")), wrapped)


def constrained(pred: Column, candidates: Column) -> Column:
    """The first candidate of the same canonical form, else the prediction."""
    same = let(answer_form(pred), lambda form: F.filter(candidates, lambda c: answer_form(c) == form))
    return F.coalesce(F.get(same, F.lit(0)), pred)


def is_collapsed(x: Column) -> Column:
    """Text goes on after the last end marker."""
    return x.rlike(r"(?i)</s>") & ~is_blank(F.regexp_extract(x, r"(?is)^.*</s>(.*)$", 1))


def without_end(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?i)</?s>\s*$", ""))


# Patterns that a reasoning line must not match, and one candidate in full form.
BANNED_LINES = [
    r"\b(the\s+)?provided\s+correct\s+answer\b",
    r"\bfor\s+verification\b",
    r"\bgold\s*(answer|label)?\b",
    r"\bwe\s+are\s+given\s+an?\s+entity\s+linking\s+task\b",
    r"\bi\s+should\s+output\s+exactly\b",
    r"^\s*candidates?\s*[:：]\s*$",
]
CANDIDATE = r"<[^<>]+?\[DESCRIPTION\][^<>]*?>"
CANDIDATE_HEADER = r"\bthe referent entity candidates are\b"


def sane_reasoning(x: Column) -> Column:
    """Lines, white space collapsed, without blank ones, giveaways, lists of candidates and their header."""
    def fit(line: Column) -> Column:
        banned = reduce(lambda a, b: a | b, (line.rlike(f"(?iuU){p}") for p in [*BANNED_LINES, CANDIDATE_HEADER]))
        return (line != "") & ~banned & (F.size(F.regexp_extract_all(line, F.lit(CANDIDATE), F.lit(0))) < 2)

    lines = F.transform(F.split(F.replace(blank_if_null(x), F.lit("\r\n"), F.lit("\n")), "\n"), collapse)
    return F.array_join(F.filter(lines, fit), "\n")


def augmented_output(reasoning: Column, answer: Column) -> Column:
    """Sane reasoning in a think block before the answer; the answer alone if none is left."""
    body = lambda r: F.when(r == "", strip(blank_if_null(answer))).otherwise(F.concat(F.lit("<think>\n"), r, F.lit("\n</think>\n"), strip(blank_if_null(answer))))
    return let(sane_reasoning(x=reasoning), body)


def split_content(x: Column) -> Column:
    """struct(reasoning, answer) of the first think block and what follows it; without one all is answer."""
    form = r"(?is)<think>[\s\x1c-\x1f]*(.*?)[\s\x1c-\x1f]*</think>[\s\x1c-\x1f]*(.*)$"
    part = lambda t, i: strip(F.regexp_extract(t, form, i))
    return let(strip(blank_if_null(x)), lambda t: F.struct(F.when(t.rlike(form), part(t, 1)).otherwise("").alias("reasoning"), F.when(t.rlike(form), part(t, 2)).otherwise(t).alias("answer")))


def is_candidate_bullet(s: Column) -> Column:
    """A bullet line that copies a candidate."""
    return s.rlike(r"^[-*•]\s") & s.rlike(CANDIDATE)


def shortened(x: Column, most_sentences: int, most_chars: int) -> Column:
    """Reasoning cut to most_sentences, of which bullets that copy candidates go first, unless there is nothing else;
    then to most_chars, back to the last sentence mark, or else the last blank."""
    def few(t: Column) -> Column:
        lines = F.flatten(F.transform(F.split(t, "\n"), lambda line: F.split(line, rf"(?<=[.!?。！？]){WS}+")))

        def kept(parts: Column) -> Column:
            real = F.filter(parts, lambda s: ~is_candidate_bullet(s))
            return F.when(F.size(parts) <= most_sentences, t).otherwise(F.array_join(F.slice(F.when(F.size(real) > 0, real).otherwise(parts), 1, most_sentences), "\n"))

        return let(F.filter(F.transform(lines, strip), lambda s: s != ""), kept)

    def short(t: Column) -> Column:
        cut = F.substring(t, 1, most_chars)
        at_mark, at_blank = F.regexp_extract(cut, r"(?s)^(.*[.!?。！？])", 1), F.regexp_extract(cut, r"(?s)^(.+)[ \n]", 1)
        end = F.coalesce(F.nullif(at_mark, F.lit("")), F.nullif(at_blank, F.lit("")), cut)
        return F.when(F.length(t) <= most_chars, t).otherwise(F.regexp_replace(end, rf"{WS}+$", ""))

    t = strip(blank_if_null(x))
    return let(let(t, few) if most_sentences > 0 else t, short) if most_chars > 0 else let(t, few)


def shortened_accept(x: Column, most_sentences: int, most_chars: int) -> Column:
    """An answer with its reasoning shortened and made sane; as it is without reasoning or without an answer."""
    new = lambda p: F.when((p["reasoning"] == "") | (p["answer"] == ""), x).otherwise(augmented_output(shortened(p["reasoning"], most_sentences, most_chars), p["answer"]))
    return let(split_content(x), new)


def shared_prefix(chosen: Column, rejected: Column, prefix: str = "<think>\n") -> Column:
    """struct(chosen, rejected) without the prefix that both start with, null if one doesn't."""
    both = F.startswith(chosen, F.lit(prefix)) & F.startswith(rejected, F.lit(prefix))
    rest = lambda x: F.substr(x, F.lit(len(prefix) + 1))
    return F.when(both, F.struct(rest(chosen).alias("chosen"), rest(rejected).alias("rejected")))

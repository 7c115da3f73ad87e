"""Personal data in texts: plain identifiers, and disguised ones found by offset-preserving deobfuscation.

Base kinds are read off the text itself. The disguised ones come from a cascade of small transducers, each of which maps a text
with offsets to a text with offsets:

1. characters: homoglyphs, full-width forms and digits of other scripts become ASCII; invisible characters go;
2. spelled digits: number words ("five five five ...") become their digits;
3. at and dot: "(at)", "[dot]", " at ... dot " and a " dot " between digits or in a local part become "@" and ".".

Every output character remembers the source span it came from, so what the same detectors find in the normalised text
maps back to code points of the source. A disguised span is added unless a base span of its kind is equal to it or holds it.

Null text counts as empty. Rows stand alone: repeated rows give repeated results, an empty table an empty one, and
other columns pass or are ignored as the function says. All detectors are linear in the text's length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm import worker

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like an ASCII letter.
HOMOGLYPHS = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсѕухԁԛԝһⅼΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανɡıℓ", "ABESIJKMHOPCTYXaeijopcsyxdqwhlABEZHIKMNOPTYXoavgil", strict=True))
# Characters without a width.
INVISIBLE = "­​‌‍⁠﻿"
# Number words.
NUMBER_WORDS = dict(zip("zero one two three four five six seven eight nine oh".split(), "01234567890", strict=True))

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A later start inside a run of digits can't match where the run's own start fails.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_CARD_HINT = re.compile(r"[0-9](?:[ -]?[0-9]){12}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Plain identifiers per kind, leftmost first and without overlap in a kind; ends are exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    if "." in text:
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    if _CARD_HINT.search(text):
        for m in _CARD.finditer(text):
            digits = _DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


class Mapped:
    """A text whose characters know the source span they came from."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]

    def replace(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Put other text at spans (ascending, apart); each new character stands for the whole span."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        return Mapped("".join(text), starts + self.starts[at:], ends + self.ends[at:])


def _character_table() -> dict[str, str]:
    table = dict(HOMOGLYPHS) | dict.fromkeys(INVISIBLE, "")
    for c in range(0x80, 0x20000):
        ch = chr(c)
        if unicodedata.category(ch) == "Nd":
            table[ch] = str(unicodedata.digit(ch))
        elif 0xFF01 <= c <= 0xFF5E:
            table[ch] = chr(c - 0xFEE0)
    return table


_TABLE = _character_table()
_ODD = re.compile("[" + "".join(map(re.escape, _TABLE)) + "]")
_WORD = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{_WORD})(?:[ ,.-]{{1,2}}(?:{_WORD}))*+(?![A-Za-z0-9])", re.I)
# A number word beside another one or a digit; beside a dot in words the text is looked at anyway.
_SPELLED_HINT = re.compile(rf"(?<![A-Za-z0-9])(?:{_WORD})[ ().,\t-]++(?:[0-9]|(?:{_WORD})(?![A-Za-z0-9]))|[0-9][ ().,\t-]++(?:{_WORD})(?![A-Za-z0-9])", re.I)
_ONE = re.compile(_WORD, re.I)
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{0,256}+@")
_MARKED_AT = re.compile(r"[ \t]?[\[({<][ \t]?at[ \t]?[\])}>][ \t]?", re.I)
_MARKED_DOT = re.compile(r"[ \t]?[\[({<][ \t]?(?:dot|punkt|punto|point)[ \t]?[\])}>][ \t]?", re.I)
# Bare words only inside an identifier: between digits, or in name at host dot name.
_BARE_DOT = re.compile(r"[ \t]{1,3}dot[ \t]{1,3}", re.I)
_DIGIT_DOT = re.compile(r"(?<=[0-9])[ \t]{1,3}dot[ \t]{1,3}(?=[0-9])", re.I)
_NAME = re.compile(r"[A-Za-z0-9._%+-]++(?:[ \t]{1,3}dot[ \t]{1,3}[A-Za-z0-9._%+-]++)*+", re.I)
_BARE_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])(?:[ \t]{1,3}at[ \t]{1,3}|@)(?=[A-Za-z0-9-])", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|[ \t]{1,3}dot[ \t]{1,3})[A-Za-z0-9-]++)*+", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_LAST_LABEL = re.compile(r"[A-Za-z]{2,10}")


def _characters(m: Mapped) -> Mapped:
    return m.replace([(x.start(), x.end(), _TABLE[x[0]]) for x in _ODD.finditer(m.text)])


def _spelled(m: Mapped, least: int) -> Mapped:
    """Runs of at least `least` number words as digits."""
    edits = []
    for run in _SPELLED.finditer(m.text):
        words = list(_ONE.finditer(m.text, *run.span()))
        # Before a plain address two words may be prose.
        if len(words) < least or (len(words) < 3 and _BEFORE_AT.match(m.text, run.end())):
            continue
        # Word by word, with the gap behind it, so that every digit keeps its own span.
        for w, after in zip(words, [*words[1:], None], strict=True):
            edits.append((w.start(), w.end(), NUMBER_WORDS[w[0].lower()]))
            if after:
                gap = m.text[w.end() : after.start()]
                edits.append((w.end(), after.start(), "." if "." in gap else ""))
    return m.replace(edits)


def _host_dots(text: str, at: int, plain: bool) -> tuple[int, list[tuple[int, int]]] | None:
    """The end of the host at `at` and its bare dots; without `plain` it must end in a bare dot and a name."""
    host = _HOST.match(text, at)
    labels = list(_LABEL.finditer(text, *host.span()))
    gaps = [(x.end(), y.start()) for x, y in zip(labels, labels[1:])]
    bare = [text[a:b] != "." for a, b in gaps]
    for n in reversed(range(len(gaps))):
        if bare[n] and _LAST_LABEL.fullmatch(labels[n + 1][0]):
            return labels[n + 1].end(), [g for g, is_bare in zip(gaps[: n + 1], bare) if is_bare]
    n = bare.index(True) if True in bare else len(gaps)
    return (labels[n].end(), []) if plain and n else None


def _at_dot(m: Mapped) -> Mapped:
    low = m.text.lower()
    if "dot" not in low and not _MARKED_AT.search(m.text) and not _MARKED_DOT.search(m.text):
        return m
    m = m.replace(sorted([(*x.span(), "@") for x in _MARKED_AT.finditer(m.text)] + [(*x.span(), ".") for x in _MARKED_DOT.finditer(m.text)]))
    if "dot" not in low:
        return m
    m = m.replace([(*x.span(), ".") for x in _DIGIT_DOT.finditer(m.text)])
    names = {x.end(): x.start() for x in _NAME.finditer(m.text)}
    edits, last = [], -1
    for x in _BARE_AT.finditer(m.text):
        if x.start() <= last or not (host := _host_dots(m.text, x.end(), x[0] == "@")):
            continue
        # What belongs to the address before stays with it.
        edits += [(*d.span(), ".") for d in _BARE_DOT.finditer(m.text, names.get(x.start(), x.start()), x.start()) if d.start() > last]
        last, dots = host
        edits += [(*x.span(), "@"), *((*d, ".") for d in dots)]
    return m.replace(edits)


def _disguised(text: str) -> bool:
    low = text if text.islower() else text.lower()
    return bool((not text.isascii() and _ODD.search(text)) or _SPELLED_HINT.search(text) or ("dot" in low and _BARE_DOT.search(text)) or _MARKED_AT.search(text) or _MARKED_DOT.search(text))


def _plain_forms(text: str) -> list[Mapped]:
    """The text without disguise: with all number words as digits, and with long runs of them only, as a host or a
    last label may be a number word."""
    m = _characters(Mapped(text))
    forms = [_spelled(m, 1), _spelled(m, 3)]
    return [_at_dot(x) for x in (forms if forms[0].text != forms[1].text else forms[:1])]


def _inside(a: int, b: int, spans: list[tuple[int, int]]) -> bool:
    """A span is equal to or inside one of `spans`, which are ascending and apart."""
    at = bisect_right(spans, a, key=lambda s: s[0]) - 1
    return at >= 0 and b <= spans[at][1]


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans as (kind, start, end, base), by kind as in KINDS, then start."""
    base = base_spans(text)
    out = [(k, a, b, True) for k in KINDS for a, b in base[k]]
    if _disguised(text):
        found: dict[str, set[tuple[int, int]]] = {k: set() for k in KINDS}
        for m in _plain_forms(text):
            if m.text != text:
                for k, own in base_spans(m.text).items():
                    found[k].update(m.source(a, b) for a, b in own)
        for k, own in found.items():
            end = -1
            for a, b in sorted(own, key=lambda s: (s[0], -s[1])):
                if b > end and not _inside(a, b, base[k]):
                    out.append((k, a, b, False))
                end = max(end, b)
        out.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return out


def joined(found: list[tuple[str, int, int, bool]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)


def _mapped(df: DataFrame, text_col: str, extra: list[T.StructField], row) -> DataFrame:
    """df's columns with more, computed per text; clashing names are replaced."""
    names = {f.name for f in extra}
    kept = [f for f in df.schema if f.name not in names]
    source = df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType(kept + extra)
    arrow = {"bigint": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in extra]
            for text in batch.column("__text"):
                for c, v in zip(cols, row(text.as_py() or ""), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(c, arrow[f.dataType.simpleString()]) for c, f in zip(cols, extra, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)


def detect(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df's columns (clashing ones replaced) with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans."""

    def row(text: str) -> list:
        found = spans(text)
        base = [s for s in found if s[3]]
        return [*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)]

    extra = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    return _mapped(df, text_col, extra, row)


def redact_text(text: str) -> str:
    """The text with every span, or run of overlapping spans, as its first kind in angle brackets."""
    merged: list[list] = []
    for k, a, b, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    out, at = [], 0
    for k, a, b in merged:
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df's columns in their order, the text redacted (null stays null)."""
    fields = df.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()  # what earlier stages left
        for batch in batches:
            cols = [batch.column(f.name) for f in fields]
            i = df_names.index(text_col)
            cols[i] = pa.array([None if x.as_py() is None else redact_text(x.as_py()) for x in cols[i]], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=df_names)

    df_names = df.columns
    return df.mapInArrow(run, df.schema)

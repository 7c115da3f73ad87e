"""Disguised personal data that the plain detectors see in part or not at all."""

from __future__ import annotations

import pytest

from cellweave.llm import pii


def sources(text):
    return [(k, text[a:b]) for k, a, b, _ in pii.spans(text)]


@pytest.mark.parametrize("address", ["jоhn.smith@example.com", "user@mail.exаmple.com", "user@mail.example.cоm", "user@mail.exam\u200bple.com"])
def test_partial_base_span_does_not_hide_the_whole(address):
    text = f"write to {address} now"
    assert ("email", address) in sources(text)
    assert pii.redact_text(text) == "write to <EMAIL> now"
    assert [(k, a, b) for k, a, b, base in pii.spans(text) if base] == [(k, *s) for k in pii.KINDS for s in pii.base_spans(text)[k]]


def test_equal_spans_are_listed_once():
    assert sources("адрес a@b.org и 10.0.0.1") == [("email", "a@b.org"), ("ip", "10.0.0.1")]


@pytest.mark.parametrize(("kind", "source"), [
    ("ip", "one nine two (dot) one six eight (dot) zero (dot) one"),
    ("ip", "192 dot 168 dot 0 dot 1"),
    ("ip", "one nine two dot 168 dot zero dot one"),
    ("ip", "192.168.zero.one"),
    ("card", "4111 1111 one one 11 1111"),
    ("phone", "+1 555 five five 5 0199"),
    ("email", "john dot smith at example dot com"),
    ("email", "john dot q dot smith (at) example (dot) com"),
    ("email", "john dot smith@example.com"),
    ("email", "jane (at) mail dot example dot org"),
    ("email", "jane dot four two at example dot com"),
    ("email", "user at example dot one"),
    ("email", "a" * 80 + " at example dot com"),
    ("email", "jane at " + "sub dot " * 12 + "example dot com"),
])
def test_disguise_is_undone_wherever_it_stands(kind, source):
    text = f"See {source}, please"
    assert (kind, source) in sources(text)
    assert pii.redact_text(text) == f"See <{kind.upper()}>, please"


def test_prose_with_number_words_stays():
    for t in ["One or two of them, then 3 more.", "Put one dot here and two dots there.", "We met at noon. Two dot three is not an address.", "The room has one door, 2 windows and zero, one or two chairs."]:
        assert pii.spans(t) == []
    assert sources("there are two jane@example.com, one two@example.com") == [("email", "jane@example.com"), ("email", "two@example.com")]


def test_long_runs_take_linear_time():
    for t in ["a dot " * 20_000, "a at " * 20_000, "one " * 20_000, "1 dot " * 20_000, "a@" * 20_000, "a at b dot " * 10_000, "one_" * 20_000, "1" + " " * 50_000]:
        pii.spans(t)

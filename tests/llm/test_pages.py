"""Pages as browsers read them, however broken, in time that grows with their length."""

from __future__ import annotations

import time

import pytest

from tablehaul.llm import extraction


def texts(source):
    return [t for t in extraction.parse(source).texts if t]


@pytest.mark.parametrize("source,wanted", [
    ("<p>a<!-->b<p>c", ["ab", "c"]),
    ("<p>a<!--->b<p>c", ["ab", "c"]),
    ("<p>a<!-- x --!>b<!-- <p>y --->c<!-- never closed <p>d", ["abc"]),
    ("<p>x<script>1</script foo>y<p>z", ["xy", "z"]),
    ("<p>x<script src='a>b'>1</scripts>2</SCRIPT\n>y<p>z", ["xy", "z"]),
    ("<p>x<style>1</style/><title>t</title>y", ["xy"]),
    ("<p>x<textarea>1<p>2", ["x"]),
    ("<p>a</p foo='x'>b", ["a", "b"]),
    ("a < b <3 </ c <!doctype html>d<?php x?>e", ["a < b <3 </ cde".replace("cd", "c d")]),
    ("<p>a<svg class=x/>b</svg>c<svg><p>no</svg>d", ["abcd"]),
    ("<p>a<svg>b<p>c", ["ab", "c"]),
    ("<p>a<template><p>b</template>c<iframe>d</iframe>e", ["ace"]),
    ("x<p a='1>y", ["x", "y"]),
    ("x<p a='1>2' b=\"3>4\">y<p c=5'>z", ["x", "y", "z"]),
    ("x<p", ["x<p"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e</p>f</div>", ["a", "b", "c", "d", "e", "f"]),
    ("", []),
])
def test_markup(source, wanted):
    assert texts(source) == wanted


BROKEN = [
    "<p a='", "<svg a='b'>", "<svg a='b", "<p a='>'", "<!--", "<svg>", "<p a=\"'\">", "</p", "<script>", "<", "<!", "<a b=c ", "</p>",
    "<ul>", "<p>x", "&", "<title", "<iframe>", "<p a=\"b' ", "<div></p>",
]


@pytest.mark.parametrize("unit", BROKEN)
@pytest.mark.parametrize("end", ["", ">", "'", "</svg></iframe>", '"'])
def test_time_grows_with_the_page(unit, end):
    """A megabyte of broken markup takes about a second or two."""
    source = unit * ((1 << 20) // len(unit)) + end
    started = time.process_time()
    extraction.parse(source)
    assert time.process_time() - started < 5


def test_long_pages_keep_their_text():
    """What looks like a tag and never ends is text: leaving it out could lose what comes after a "<"."""
    source = "<article>" + "".join(f"<p>word{i} & more" for i in range(50_000)) + "<p a='"
    held = texts(source)
    assert held[:-1] == [f"word{i} & more" for i in range(49_999)] and held[-1] == "word49999 & more<p a='"

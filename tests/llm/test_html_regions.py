"""Surge and dive points against brute force, and pages whose names mislead."""

import random

import pytest

from corpusmill.llm import html_text as H

LONG = "This is a long sentence of the body that goes on for quite a while and says things. " * 4
HEAD = "<nav><a href=a>Home</a></nav>"
#: page -> what the text holds
KEPT = {
    "words in quoted values": (f'<body><p title="it is hidden here">{LONG}</p></body>', "This is"),
    "words in other attributes": (f'<article data-x="a hidden thing" data-role=\'class="ad"\'><p>{LONG}</p></article>', "This is"),
    "form around the page": (f'<body><form id="aspnetForm"><h1>T</h1><p>{LONG}</p></form></body>', "T\n\nThis is"),
    "notice around the page": (f'<body>{HEAD}<div class="notice"><p>{LONG}</p></div></body>', "This is"),
    "comments page": (f'<body>{HEAD}<div id="comments-page"><article><h1>T</h1><p>{LONG}</p></article></div></body>', "T\n\nThis is"),
    "a linked sentence": ('<body><p><a href="x">One whole linked sentence stands here alone.</a></p></body>', "One whole linked sentence stands here alone."),
    "remark and related work": (f'<article><p>{LONG}</p><p class="comment">Inner remark.</p><section id="related"><p>Related work is text.</p></section></article>', "Inner remark.\n\nRelated work is text."),
    "conclusion behind an advert": (f'<body><div><p>{LONG}</p><div class="advert">Buy</div><p>So.</p></div></body>', "So."),
}
DROPPED = {
    "reader comments": (f'<article><p>{LONG}</p><div class="comments"><p>Nice post, all of you!</p></div></article>', "Nice"),
    "more reader comments than text": (f'<body><div><h1>T</h1><p>{LONG}</p></div><div id="comments"><p>Nice {LONG}</p><p>{LONG}</p><p>{LONG}</p></div></body>', "Nice"),
    "related links": (f'<article><p>{LONG}</p><section class="related"><ul><li><a href=q>Other page here</a></li></ul></section></article>', "Other"),
    "search form": (f'<body><p>{LONG}</p><form><p>Enter your words</p></form></body>', "Enter"),
    "unmarked menu": ("<body>" + "".join(f"<div><a href={x}>Topic {x}</a></div>" for x in range(6)) + f"<div id=x><p>{LONG}</p></div></body>", "Topic"),
    "hidden": (f'<body><p>{LONG}</p><p hidden>Secret</p><p aria-hidden=true>Secret</p></body>', "Secret"),
}


@pytest.mark.parametrize("name", KEPT)
def test_kept(name):
    page, part = KEPT[name]
    assert part in H.main_text(page)


@pytest.mark.parametrize("name", DROPPED)
def test_dropped(name):
    page, part = DROPPED[name]
    assert part not in H.main_text(page)
    assert "This is a long" in H.main_text(page)


def brute(weights, window, level):
    """A line is kept if some window from a surge on, before a dive, covers it or what weighs before it without a break."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    out, i = [], 0
    while i < n:
        if sums[i] > 0 and sums[i] >= level:
            end = next((j for j in range(i, n) if sums[j] <= 0), n)
            begin = i
            while begin and weights[begin - 1] > 0:
                begin -= 1
            some = [j for j in range(begin, end) if weights[j] > 0]
            out.append((some[0], some[-1] + 1))
            i = end
        i += 1
    return out


def test_surges_against_brute_force():
    rng = random.Random(8)
    for _ in range(3000):
        weights = [float(rng.choice([0, 0, 0, 1, 2, 5, 40, 100])) for _ in range(rng.randrange(25))]
        window, level = rng.randrange(1, 6), rng.choice([0, 1, 5, 50, 120, 1000])
        assert H.surges(weights, window, level) == brute(weights, window, level)


def test_the_curve_decides(monkeypatch):
    """Without helpful markup the window and the rise choose what is text."""
    short = "".join(f"<td>{x} km</td>" for x in range(4))
    page = f"<body><table><tr><td>Far away</td></tr></table><div>{HEAD * 3}</div><section><p>{LONG}</p><p>{LONG}</p></section><div>{HEAD}</div><table>{short}</table></body>"
    usual = H.main_text(page)
    assert "km" not in usual and "Far away" not in usual
    monkeypatch.setattr(H, "RISE", 0.0)
    assert "km" in H.main_text(page) and "Far away" in H.main_text(page)
    assert H.surges([9, 0, 0, 90], 2, 20) == [(3, 4)] and H.surges([9, 0, 0, 90], 4, 20) == [(0, 4)]

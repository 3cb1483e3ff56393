"""Pages of unlike shapes, written by hand, and the text that a reader would take from each."""

import time

import pytest

from palimpsest.llm import pages

A = "The area of the field is large."
B = "A second one says something else about it, and more."
C = "Prices rose by 4 % in May; nobody knows why."
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About us</a></li><li><a href='/c'>Contact</a></li></ul></nav>"
OLD_MENU = "<div class='menu'><a href='/'>Home</a> | <a href='/n'>News</a> | <a href='/c'>Contact</a></div>"
FOOT = "<footer>&copy; 2020 The Field Company</footer>"

#: What stands in the article, and its blocks.
ARTICLES = {
    "one paragraph": (f"<p>{A}</p>", [A]),
    "two paragraphs": (f"<p>{A}</p><p>{B}</p>", [A, B]),
    "heading and paragraph": (f"<h1>On fields</h1><p>{A}</p>", ["On fields", A]),
    "many paragraphs": (f"<h1>On fields</h1>" + f"<p>{A}</p><p>{B}</p>" * 10, ["On fields", *[A, B] * 10]),
    "unclosed": (f"<h1>On fields</h1><p>{A}<p>{B}", ["On fields", A, B]),
    "list": (f"<h2>What to do</h2><p>{A}</p><ul><li>Take the seeds out of the bag.</li><li>Put them into the ground.</li></ul><p>{C}</p>", ["What to do", A, "Take the seeds out of the bag.", "Put them into the ground.", C]),
    "table": (f"<h1>On fields</h1><p>{A}</p><table><tr><td>North</td><td>12 ha</td></tr><tr><td>South</td><td>7 ha</td></tr></table><p>{B}</p>", ["On fields", A, "North", "12 ha", "South", "7 ha", B]),
    "definitions": (f"<h1>Words</h1><p>{A}</p><dl><dt>Field</dt><dd>A piece of land that is worked on.</dd><dt>Hedge</dt><dd>What stands around it.</dd></dl>", ["Words", A, "Field", "A piece of land that is worked on.", "Hedge", "What stands around it."]),
    "quotation": (f"<p>{A}</p><blockquote><p>{C}</p></blockquote><p>{B}</p>", [A, C, B]),
    "sentence that is a link": (f"<h1>On fields</h1><p>{B}</p><p><a href='/x'>{A}</a></p><p>{C}</p>", ["On fields", B, A, C]),
    "links in the text": (f"<h1>On fields</h1><p>The <a href='/a'>area</a> of the <a href='/f'>field</a> is large.</p><p>{B}</p>", ["On fields", A, B]),
    "picture": (f"<h1>On fields</h1><p>{A}</p><figure><img src='x'><figcaption>The field in May, seen from the north.</figcaption></figure><p>{B}</p>", ["On fields", A, "The field in May, seen from the north.", B]),
    "drawing": (f"<p>{A}</p><svg viewBox='0 0 1 1'><text>axis</text></svg><p>{B}</p>", [A, B]),
}
#: What stands around it.
FRAMES = {
    "bare": lambda x, d: "<div>" * d + x + "</div>" * d,
    "without head": lambda x, d: f"{MENU}{'<div class=wrap>' * d}{x}{'</div>' * d}{FOOT}",
    "menu": lambda x, d: f"<html><head><title>t</title></head><body>{MENU}{'<div class=content>' * d}{x}{'</div>' * d}</body></html>",
    "old": lambda x, d: f"<html><body><div id=page>{OLD_MENU}{'<div>' * d}{x}{'</div>' * d}<div id=footer>&copy; me, all rights</div></div></body></html>",
    "article": lambda x, d: f"<html><body><header><h1>Field News</h1></header>{MENU}{'<div>' * d}<main><article>{x}</article></main>{'</div>' * d}{FOOT}</body></html>",
}


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("article", ARTICLES)
def test_shapes_at_every_depth(frame, article):
    body, blocks = ARTICLES[article]
    model = pages.trained()
    found = {depth: pages.extract(FRAMES[frame](body, depth), model) for depth in range(9)}
    assert {d: t for d, t in found.items() if t != "\n\n".join(blocks)} == {}


@pytest.mark.parametrize(
    ("name", "page", "blocks"),
    [
        ("forum", f"<html><body>{MENU}<article><h1>On fields</h1><p>{A}</p><p>{B}</p></article><section class='comments'><h2>Answers</h2><div class='comment'><p>I do not think so at all.</p></div><div class='comment'><p>Nor do I, to be honest.</p></div></section>{FOOT}</body></html>", ["On fields", A, B]),
        ("aside in the article", f"<html><body>{MENU}<article><h1>On fields</h1><p>{A}</p><aside class='related'><h3>See also</h3><ul><li><a href='/o'>Other fields</a></li></ul></aside><p>{B}</p></article>{FOOT}</body></html>", ["On fields", A, B]),
        ("short aside", f"<html><body>{MENU}<article><h1>On fields</h1><p>{A}</p><aside>See also: other fields.</aside><p>{B}</p></article>{FOOT}</body></html>", ["On fields", A, B]),
        ("cookies", f"<html><body><div class='cookie-banner'><p>We use cookies, as all do.</p><button>Fine</button></div><div><div><p>{A}</p><p>{B}</p></div></div></body></html>", [A, B]),
        ("sidebar", f"<html><body><div class='wrap'><div class='sidebar'><h3>More</h3><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></div><div class='post'><h1>On fields</h1><p>{A}</p><p>{B}</p></div></div></body></html>", ["On fields", A, B]),
        ("newsletter", f"<html><body>{MENU}<div id='content'><h1>On fields</h1><p>{A}</p><form class='newsletter'><p>Get all news by mail.</p><input><button>Send</button></form><p>{B}</p></div>{FOOT}</body></html>", ["On fields", A, B]),
        ("advert", f"<html><body>{MENU}<div><h1>On fields</h1><p>{A}</p><div class='advert'><p>Buy seeds now, they are cheap.</p></div><p>{B}</p></div>{FOOT}</body></html>", ["On fields", A, B]),
        ("menu alone", f"<html><body>{MENU}{FOOT}</body></html>", []),
    ],
)
def test_what_is_no_part_of_it_goes(name, page, blocks):
    assert pages.extract(page, pages.trained()) == "\n\n".join(blocks)


@pytest.mark.parametrize("make", [lambda n: "<p><button>" + "<div>" * n, lambda n: "<b><div>" + "<i>" * n + "</b>" * n, lambda n: "".join(f"<x{i}>" for i in range(n)) + "<p></i>" * n])
def test_hostile_pages_take_linear_time(make):
    def took(n):
        began = time.process_time()
        pages.parse(make(n))
        return time.process_time() - began

    assert took(24_000) < 18 * max(0.02, took(3_000))

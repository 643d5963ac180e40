"""Allow-list cleaning against a state machine that reads letter by letter."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandmill.functions.text import KEPT_TAGS, LINK_REL, clean_html

SPACE = " \t\n\x0b\x0c\r"


def escape(text):
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "&" and (m := re.match(r"&#?[a-zA-Z0-9]+;", text[i:])):
            out.append(m.group())
            i += len(m.group())
            continue
        out.append({"&": "&amp;", "<": "&lt;", ">": "&gt;"}.get(c, c))
        i += 1
    return "".join(out)


def without_blocks(text):
    """Each kind of dropped part in turn, each up to its end or the end of the text."""
    for opening, closing in ((r"<!--", r"-->"), (r"(?i)<script[\s/>]", r"(?i)</script[^>]*>"), (r"(?i)<style[\s/>]", r"(?i)</style[^>]*>"), (r"<[!?]", r">")):
        out, i = [], 0
        while i < len(text):
            if m := re.compile(opening).match(text, i):
                end = re.compile(closing).search(text, m.end())
                i = end.end() if end else len(text)
            else:
                out.append(text[i])
                i += 1
        text = "".join(out)
    return text


def tag_end(text, i):
    """Behind the tag that begins at ``i``; -1 if it isn't closed, or holds a bare angle bracket."""
    quote, j = None, i + 2
    while j < len(text):
        c = text[j]
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "<":
            return -1
        elif c == ">":
            return j + 1
        j += 1
    return -1


def attributes(rest):
    """(name, value) pairs, letter by letter."""
    found, i, n = [], 0, len(rest)
    while i < n:
        if rest[i] in SPACE + "\"'=<>/":
            i += 1
            continue
        j = i
        while j < n and rest[j] not in SPACE + "\"'=<>/":
            j += 1
        name, k, value = rest[i:j], j, None
        while k < n and rest[k] in SPACE:
            k += 1
        if k < n and rest[k] == "=":
            k += 1
            while k < n and rest[k] in SPACE:
                k += 1
            if k < n and rest[k] in "\"'":
                end = rest.find(rest[k], k + 1)
                value, j = (rest[k + 1 : end], end + 1) if end >= 0 else (None, j)
            else:
                end = k
                while end < n and rest[end] not in SPACE + "\"'<>`":
                    end += 1
                value, j = (rest[k:end], end) if end > k else (None, j)
        if value is not None:
            found.append((name.lower(), value))
        i = j
    return found


def clean(text):
    text, out, i = without_blocks(text.replace("\x01", "")), [], 0
    while i < len(text):
        if text[i] != "<":
            j = text.find("<", i)
            j = len(text) if j < 0 else j
            out.append(escape(text[i:j]))
            i = j
            continue
        end = tag_end(text, i) if re.match(r"<[a-zA-Z/]", text[i:]) else -1
        if end < 0:
            out.append("&lt;")
            i += 1
            continue
        tag, i = text[i:end], end
        name = re.match(r"</?([a-zA-Z]+)(?:[\s/>])", tag)
        name = name.group(1).lower() if name else ""
        if name not in KEPT_TAGS:
            continue
        if tag.startswith("</"):
            out.append(f"</{name}>")
            continue
        if name != "a":
            out.append(f"<{name}>")
            continue
        given = attributes(re.sub(r"^</?[a-zA-Z]+", "", tag)[:-1])
        first = lambda key: next((v for k, v in given if k == key), None)  # noqa: E731, B023
        href, target = first("href"), first("target")
        href = None if href is None else href.strip(" ")
        sound = href is not None and (re.match(r"(?i)https?:", href) or href[:1] in ("/", "?", "#") or not re.search("[:&\x00-\x20]", href))
        shown = lambda v: escape(v).replace('"', "&quot;")
        out.append("<a" + (f' href="{shown(href)}"' if sound else "") + (f' target="{shown(target)}"' if target is not None else "") + f' rel="{LINK_REL}">')
    return "".join(out)


HOSTILE = [
    '<a href="javascript:alert(1)">x</a>', "<a HREF=' JAVASCRIPT:x'>", '<a href="java&#115;cript:x">', '<a href="java\tscript:x">', "<a title=\" href='http://x'\" href=data:text/html>y</a>", '<a href=http://x/?a=1&b=2 target=_blank onclick="x">u</a>',
    "<img src=x onerror=alert(1)>", "<svg/onload=x><p onclick='>'>t</p >", "<scr<script>ipt>x</script>y", "<script>a</script", "<SCRIPT\n>a</script >b", "<style>p{}</style><!-- c --><!-- open", "<!doctype html><?php x ?>t", "a < b > c & d &amp; &#60;script&#62; &bad", "<p", "<p <em>x", '<a href="x"y\'>', "</p/><br/><BR><p\n>", "< p>", "</ p>", "<>", "\x01&amp;\x01<p>", "<ul><li>1<li>2</ul>", "<strongx>a</strong>", '<a href="//e.com/ä?q=1">', "<a href>", '<a href="">e</a>', "<a href = 'https://q'>z", '<a/href="/r">',
]


def test_hostile_markup_is_cleaned_as_by_a_state_machine(spark):
    draw = random.Random(11)
    bits = ["<", ">", "</", "a", "p", "em", " href=", "href='", '"', "'", "=", " ", "/", "&", ";", "http:", "javascript:", "<script>", "</script>", "<!--", "-->", "x", "target=b", "ä", "<br>", "\n"]
    rows = HOSTILE + ["".join(draw.choice(bits) for _ in range(draw.randint(1, 25))) for _ in range(1500)]
    found = spark.createDataFrame(list(enumerate(rows)), "i int, h string").select("i", clean_html(F.col("h")).alias("c")).collect()
    for r in found:
        assert r.c == clean(rows[r.i]), rows[r.i]
        # Nothing but allowed tags is left.
        assert set(re.findall(r"</?([a-z]*)", r.c)) <= set(KEPT_TAGS) and "javascript:" not in "".join(re.findall(r"<[^>]*>", r.c))


@pytest.mark.parametrize("given", [None, ""])
def test_nothing_stays_nothing(spark, given):
    assert spark.createDataFrame([(given,)], "h string").select(clean_html(F.col("h")).alias("c")).first().c == given

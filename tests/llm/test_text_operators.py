"""Decontamination, line deduplication, licence scans and main text, against plain Python."""
import hashlib
import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import empty, table
from wattloom.llm import decontaminate, html, licences, linededup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def contaminated_by_hand(text, items):
    words, hit, found = WORD.findall(low(text)), set(), set()
    for item_id, t in items:
        w = WORD.findall(low(t))
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j:j + k] == w[i:i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(item_id))
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def bench(spark):
    rnd = random.Random(4)
    items = [(i, " ".join(rnd.choice("ab Éa c2 D e! f").strip() or "g" for _ in range(n))) for i, n in enumerate([1, 2, 5, 13, 14, 20, 30])]
    items += [(50, items[4][1]), (51, ""), (52, None), (53, "!!"), (54, "Das Ürteil IST 3x gefällt")]
    return items, spark.createDataFrame(items, "item_id bigint, text string")


def test_contamination_by_hand(spark, bench):
    items, b = bench
    rnd = random.Random(5)
    texts = [(1, None), (2, ""), (3, "  "), (4, items[4][1].upper()), (5, "x y z " * 400 + items[5][1]), (5, "other " + items[6][1]), (5, "other " + items[6][1]),
             (None, "das ürteil ist 3X gefällt"), (8, "das Ürteil ist 3x gefällt"), (9, " ".join(rnd.choice("abcdefg") for _ in range(3000)))]
    texts += [(20 + i, " ".join(rnd.choice("a b c d e f g".split()) for _ in range(rnd.randint(1, 60)))) for i in range(30)]
    docs = table(spark, texts)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, list(r.items), r.contaminated) for r in decontaminate.contamination(docs, b).collect()))
    want = []
    for i, t in texts:
        n, h, f = contaminated_by_hand(t, items)
        want.append((i is None, i or 0, n, h, f, h > 0 and 20 * h >= n))
    assert got == sorted(want)
    kept = decontaminate.clean_documents(docs, b)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not w[5] for w in want)
    # the way without a broadcast gives the same
    other = decontaminate.contamination(docs, b, broadcast_windows=0)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, list(r.items), r.contaminated) for r in other.collect())) == got


def test_contamination_of_long_texts(spark, bench):
    """A passage at the end of a text of 20,000 words, on both sides of the broadcast's size."""
    items, bench = bench
    items = dict(items)
    item = 5
    text = "filler " * 20_000 + items[item]
    docs = table(spark, [(1, text), (2, "filler " * 20_000), (3, None)])
    for most in (10 ** 6, 0):
        got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, broadcast_windows=most).collect()}
        assert got[1].n_hit == len(WORD.findall(low(items[item]))) and str(item) in got[1]["items"] and not got[1].contaminated
        assert got[2].n_hit == got[3].n_hit == 0 and got[3].n_words == 0


def test_contamination_of_texts_full_of_hits(spark, bench):
    """Every word of 200,000 is hit; texts are split and hashed once, not once a place."""
    items, bench = bench
    item = dict(items)[5]
    n = len(WORD.findall(low(item)))
    times = 200_000 // n
    docs = table(spark, [(1, (item + " ") * times)])
    for most in (10 ** 6, 0):
        r, = decontaminate.contamination(docs, bench.filter("item_id = 5"), broadcast_windows=most).collect()
        assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == (n * times, n * times, ["5"], True)


def test_spans_are_cut(spark, bench):
    items, b = bench
    one = b.filter("item_id = 5")
    docs = table(spark, [(1, f"zz, yy. {items[5][1]}! ww-vv."), (2, "plain text"), (3, None)])
    got = {r.doc_id: r.text for r in decontaminate.cut_spans(docs, one).collect()}
    assert got[2] == "plain text" and got[3] is None
    assert WORD.findall(got[1]) == ["zz", "yy", "ww", "vv"] and got[1].startswith("zz, yy") and got[1].endswith(".")


def test_contamination_of_empty_tables(spark, bench):
    items, b = bench
    assert decontaminate.contamination(empty(spark), b).count() == 0
    none = decontaminate.contamination(table(spark, [(1, "a b")]), b.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in none] == [(2, 0, False)]


def lines_by_hand(texts):
    key = lambda d: (d[0] is not None, d[0] or 0, hashlib.md5(d[1].encode()).hexdigest())     # noqa: E731
    seen, out = {}, {}
    for d in sorted({t for t in texts if t[1] is not None}, key=key):
        rows, gone = d[1].split("\n"), set()
        for p in range(len(rows) - 2):
            w = tuple(rows[p:p + 3])
            if not "".join(w).strip():
                continue
            if w not in seen:
                seen[w] = (d, p)
            else:
                first, at = seen[w]
                gone |= set(range(max(p, at + 3) if first == d else p, p + 3))
        out[d] = "\n".join(r for i, r in enumerate(rows) if i not in gone) if gone else d[1]
    return out


def test_line_dedup_by_hand(spark):
    rnd = random.Random(6)
    texts = [(1, None), (2, ""), (3, "a\nb"), (4, "a\nb\nc\nd"), (5, "x\na\nb\nc\ny"), (5, "x\na\nb\nc\ny"), (6, "s\ns\ns\ns\ns\ns"), (7, "\n\n\n\n\n"), (None, "a\nb\nc"),
             (8, "z\n" * 2000)]
    texts += [(100 + i, "\n".join(rnd.choice("pqrst") for _ in range(rnd.randint(1, 14)))) for i in range(60)]
    docs = table(spark, texts)
    out = linededup.line_dedup(docs)
    assert set(docs.columns) <= set(out.columns)
    want = lines_by_hand(texts)
    rows = out.collect()
    assert len(rows) == len(texts)
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((t[0] or -1, "" if t[1] is None else want[t]) for t in texts)
    for r in rows:
        if r.text is not None and r.n_removed < r.n_lines:
            assert r.n_lines - r.n_removed == len(r.text.split("\n"))
    assert linededup.line_dedup(empty(spark)).count() == 0


def test_licences(spark):
    mit = ". ".join(s for s, i in licences.SENTENCES if i in ("mit-grant", "mit-notice", "mit-asis", "mit-liability"))
    docs = table(spark, [(1, "Some prose.\nLicensed under the  Apache License, Version 2.0.\nMore."), (2, mit.upper() + "."), (3, None), (4, ""), (5, "All rights reserved."),
                         (6, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (6, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
                         (7, "This work is licensed under the GNU General Public License, version 3."), (8, "I like the MIT license"), (9, "word " * 50000)])
    got = sorted((r.doc_id, tuple(r.licences), r.status) for r in licences.licence_scan(docs).collect())
    assert got == [(1, ("Apache-2.0",), "known"), (2, ("MIT",), "known"), (3, (), "none"), (4, (), "none"), (5, (), "unmatched"),
                   (6, ("CC-BY-NC-4.0", "MIT"), "known"), (6, ("CC-BY-NC-4.0", "MIT"), "known"), (7, ("GPL-3.0-only",), "known"), (8, (), "none"), (9, (), "none")]
    assert licences.licence_scan(empty(spark)).count() == 0


OFFICIAL = {
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Unlicense": "This is free and unencumbered software released into\nthe public domain.",
}
# the other full texts, from their sentences as printed: wrapped at 60 columns
GRANTS = {"MIT": ("mit-grant", "mit-notice", "mit-asis", "mit-liability"), "BSD-3-Clause": ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-asis"),
          "BSD-2-Clause": ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")}


def test_official_wrapped_texts(spark):
    full = OFFICIAL | {name: "\n".join("\n".join(textwrap.wrap(s.capitalize() + (":" if i.endswith("grant") else "."), 60)) for k in ids for s, i in licences.SENTENCES if i == k)
                       for name, ids in GRANTS.items()}
    assert set(full) < {name for name, _ in licences.RULES}
    forms = [lambda t: t, lambda t: "\n".join(f" * {x}" for x in t.split("\n")), lambda t: "/*\n" + t.replace("\n", "\r\n") + "\n*/\n",
             lambda t: "\n".join(f"//   {x}" for x in t.split("\n")), lambda t: "#" * 3000 + "\n" + t.replace(" ", " " * 40) + "\n" + "#" * 3000]
    texts = [(k, f(t)) for k, (t, f) in enumerate((t, f) for t in full.values() for f in forms)]
    want = [name for name in full for _ in forms]
    for r in licences.licence_scan(table(spark, texts)).collect():
        assert (r.licences, r.status) == ([want[r.doc_id]], "known"), (want[r.doc_id], r.doc_id % len(forms), r.sentence_ids)
    ids = {r.doc_id: r.sentence_ids for r in licences.licence_scan(table(spark, texts)).collect()}
    assert ids[15] == ["apache2-head", "apache-use", "apache-copy", "apache-asis", "apache-see"]


def test_rules_are_ordered(spark):
    seq = spark.createDataFrame([(["bsd-grant", "bsd-source", "bsd-binary", "bsd-asis", "mit-ref"],), (["mit-notice", "mit-grant"],)], "ids array<string>")
    assert [r[0] for r in seq.select(licences.apply_rules(F.col("ids"))).collect()] == [["BSD-2-Clause", "MIT"], []]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1><p>Tag, line, of the site</p></header>
<div id="cookie-notice">We use cookies, ok, fine, sure, accept.</div><nav><ul><li><a href=1>Home</a></ul></nav>
<div class="layout"><div class="sidebar"><p>Read, also, these, other, things on the side of the page, please.</p></div>
<div class="post-content"><h2>Head</h2><p>First para, with commas, and &eacute;&nbsp;things &amp; more.<br>Second   line</p><ul><li>one item<li>two item</ul><p>Short.</p>
<ul><li><a href=x>link a</a></li><li><a href=y>link b</a></li></ul><form><input><label>Your name</label></form><div class="ad">Buy, now, this</div>
<script>var x = "<p>no</p>";</script><p>Last <b>bold
text</b> here, and more words to count.</div><div class="comments"><p>I, as a reader, think, this is bad, very bad.</p></div></div><footer>foot</footer>"""


def test_main_text():
    assert html.main_text(PAGE).split("\n\n") == ["Head", "First para, with commas, and é things & more. Second line", "one item", "two item", "Short.", "link a", "link b",
                                                  "Last bold text here, and more words to count."]
    cases = {None: "", "": "", "plain, text": "plain, text", "<p": "", "<p>a<p>b": "a\n\nb", "a < b and c > d": "a < b and c > d", "<table><tr><td>x<td>y</table>": "x\n\ny",
             "<p>a<!-- <p>b --> c</p><!-- open": "a c", "<div hidden>no</div><p>yes</p>": "yes", "<p title='a > b'>q</p>": "q", "&lt;b&gt; &#233; &amp": "<b> é &"}
    for page, want in cases.items():
        assert html.main_text(page) == want, page
    assert html.main_text("<div>" * 20000 + "deep, text") == "deep, text"
    assert html.main_text("<p>" + "long, " * 200000 + "</p>") == ("long, " * 200000).strip()


@pytest.mark.parametrize("opening", ["<div class='content has-sidebar'>", "<div class='no-sidebar'>", "<div class='header-fixed'>", "<div class='social-article'>",
                                     "<div id='page-with-comments'>", "<form action=/x>"])
def test_wrapped_article_stays(opening):
    end = "</form>" if "form" in opening else "</div>"
    paras = [f"Paragraph {k} of the article, with commas, and enough words, to be read as prose by anybody." for k in range(4)]
    page = f"<body>{opening}" + "".join(f"<p>{x}</p>" for x in paras) + f"<div class='sidebar'><p>Other, things, here.</p></div>{end}<p>Short line.</p></body>"
    text = html.main_text(page)
    assert all(x in text for x in paras) and "Other" not in text


PROSE = "A paragraph of the article, with commas, and enough words, to be read as prose by anybody who looks at it."


@pytest.mark.parametrize("part,words", [
    ("<h2>Sources</h2><ul><li><a href=a>First source</a><li><a href=b>Second source</a></ul>", "First source|Second source|Sources"),
    ("<table><tr><td><a href=a>Cell one</a><td><a href=b>Cell two</a></table>", "Cell one|Cell two"),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p>", "Let x=1 hold."), ("<p><label>Labelled words</label> here</p>", "Labelled words here"),
    ("<p class='share-price'>The price of a share.</p>", "The price of a share."), ("<p class='notice-board'>What stood on the notice board that day, in short.</p>", "What stood on the notice board that day, in short."),
    ("<div class='related-work'><p>Related work was done before.</p></div>", "Related work was done before."), ("<blockquote>A quote.</blockquote>", "A quote."),
    ("<div class='table-header'>The head of a table that stands in the article.</div>", "The head of a table that stands in the article."), ("<pre>x  = 1</pre>", "x = 1")])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class=post>{}</div>"])
def test_all_of_the_article_stays(part, words, wrap):
    page = "<body><nav><a href=x>Home</a></nav>" + wrap.format(f"<p>{PROSE}</p>{part}<p>{PROSE}</p>") + "<footer>Foot</footer>"
    blocks = html.main_text(page).split("\n\n")
    assert blocks[0] == blocks[-1] == PROSE and all(w in blocks for w in words.split("|")) and "Home" not in blocks


@pytest.mark.parametrize("beside", ["Bare words of the page.", "<ul><li>Bare words of the page.</ul>", "<blockquote>Bare words of the page.</blockquote>",
                                    "<section><h2>More</h2><p>Bare words of the page.</p><p>" + PROSE + "</p></section>"])
def test_parts_beside_the_best_one(beside):
    page = "<body><section>" + f"<p>{PROSE}</p>" * 30 + f"</section>{beside}<div class=footer>Imprint</div></body>"
    blocks = html.main_text(page).split("\n\n")
    assert blocks[:30] == [PROSE] * 30 and "Bare words of the page." in blocks and "Imprint" not in blocks


def test_generated_pages():
    """Articles of known blocks within what is not the article: every block, in order, and nothing else."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))      # noqa: E731
    prose = lambda n: " ".join(word() + rnd.choice(["", "", "", ","]) for _ in range(n)).strip(",") + "."      # noqa: E731
    beside = [lambda: f"<nav><ul>{''.join(f'<li><a href=x>{word()}</a>' for _ in range(6))}</ul></nav>", lambda: f"<div class='{rnd.choice(['ad', 'ad-slot', 'adsense'])}'>{prose(8)}</div>",
              lambda: f"<form action=s><input name=q><select><option>{word()}</select></form>", lambda: f"<aside><p>{prose(30)}</p></aside>", lambda: f"<div id=cookie-notice>{prose(12)}</div>",
              lambda: f"<script>{word()}</script><style>{word()}</style><!-- {prose(5)} -->", lambda: f"<div class='sidebar left'><p>{prose(40)}</p></div>",
              lambda: f"<ul class=breadcrumbs><li><a href=x>{word()}</a></ul>"]
    for _ in range(150):
        want, parts = [], []
        for _ in range(rnd.randint(3, 12)):
            kind = rnd.choice(["p", "p", "p", "h2", "ul", "blockquote", "table", "links"])
            if kind in ("p", "blockquote"):
                want.append(prose(rnd.randint(4, 80)))
                parts.append(f"<{kind}>{want[-1]}</{kind}>")
            elif kind == "h2":
                want.append(word())
                parts.append(f"<h2>{want[-1]}</h2>")
            else:
                items = [prose(rnd.randint(1, 6)) for _ in range(rnd.randint(1, 4))]
                want += items
                body = [f"<a href=x>{x}</a>" if kind == "links" else x for x in items]
                parts.append("<table><tr>" + "".join(f"<td>{x}</td>" for x in body) + "</table>" if kind == "table" else "<ul>" + "".join(f"<li>{x}" for x in body) + "</ul>")
            if rnd.random() < .2:
                parts.append(rnd.choice(beside[1:6])())
        want += [prose(60)]
        parts.append(f"<p>{want[-1]}</p>")
        wrap = rnd.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div class='entry-content'>{}</div>", "<div class=wrap><div id=story>{}</div></div>"])
        around = lambda: "".join(rnd.choice(beside)() for _ in range(rnd.randint(0, 4)))      # noqa: E731
        page = f"<html><head><title>{word()}</title></head><body><header><h1>{word()}</h1></header>{around()}{wrap.format(''.join(parts))}<section class=comments><p>{prose(60)}</p></section>{around()}<footer><p>{prose(9)}</p></footer></body></html>"
        assert html.main_text(page).split("\n\n") == want, page


def test_main_text_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 1), (None, "v", "", 1), (1, "u", PAGE, 1)], "page_id bigint, url string, html string, text int")
    got = sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in html.extract(pages).collect())
    n = len(html.main_text(PAGE))
    assert got == [(0, 0, 0), (1, n, n), (1, n, n), (2, 0, 0)]
    assert html.extract(pages.limit(0)).count() == 0

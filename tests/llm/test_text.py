"""HTML extraction, licence scan and token counts against small cases and brute force."""

import random

import pytest

from parlance.llm import html_text, licenses, token_counts

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p><article>no</article>";</script></head>
<body class="has-sidebar"><header><h2>Site name and a slogan that is long enough</h2></header>
<nav><ul><li><a href="/a">Home of everything there is to read here</a></li></ul></nav><!-- a > comment <p>no</p> -->
<div class="ad">Buy this now and never look back again, a long advert.<div>inner advert</div></div>
<article class="has-comments"><header><h1>Title &amp; more</h1></header><p>First   paragraph<br>goes
on with <b>bold</b> and <a href="x">a link</a>.<p>Second &lt;one&gt; &#233;&#x41;.
<aside>side note that is not text of the article</aside><div class="cookie-notice">We use cookies, do you agree?</div>
<ul><li>Short.</li><li>Yes</li></ul><form><label>Name</label><input name=q><button>Go</button></form>
<p>Last paragraph.</p><section id="comments"><p>A reader says a lot of things that are quite long indeed.</p></section></article>
<div class="sidebar"><p>Other things to read</p></div><footer>&copy; 2024 All of us</footer></body></html>"""


def test_article():
    assert html_text.main_text(PAGE).split("\n") == ["Title & more", "First paragraph goes on with bold and a link.", "Second <one> éA.",
                                                     "Short.", "Yes", "Last paragraph."]


def test_page_without_article_keeps_the_surge():
    long = " ".join(["word"] * 60)
    page = f"<body><div><a href=1>{'menu ' * 12}</a></div><nav>x</nav><div><p>{long}</p><p>short</p><p>{long}</p></div><footer>f</footer><div>tiny</div></body>"
    assert html_text.main_text(page) == f"{long}\nshort\n{long}"


@pytest.mark.parametrize("page, text", [("", ""), ("plain text", "plain text"), ("<p>", ""), ("a < b & c &amp; d", "a < b & c & d"),
                                        ("<script>x", ""), ("<!-- never closed <p>x", ""), ("<article><p>is.</article>", "is."),
                                        ("<article><nav>m<p>in menu</article><p>out", "out"), ("<div class='x' <p>y", "y")])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


LONG = " ".join(["word"] * 60)


@pytest.mark.parametrize("page, text", [
    # no passage of the content goes for being short
    (f"<body><nav>m</nav><p>{LONG}</p><div class=ad>buy</div><p>A short last section of the text.</p><footer>f</footer></body>",
     f"{LONG}\nA short last section of the text."),
    (f"<body><div id=c><p>{LONG}</p><div class=ad>buy</div><p>Short.</p><aside>x</aside><p>{LONG}</p><aside>x</aside><p>End.</p></div></body>",
     f"{LONG}\nShort.\n{LONG}\nEnd."),
    # sibling articles, text of main beside an article
    (f"<main><h1>Head</h1><article><p>{LONG}</p></article><p>Beside.</p><article>Second</article></main>", f"Head\n{LONG}\nBeside.\nSecond"),
    # marked elements whose end tag is left out
    ("<article><p class=ad>x<p>real<p>more</article>", "real\nmore"),
    ("<article><p class=ad>x<div>real</div><p>more</article>", "real\nmore"),
    ("<article><ul><li class=share>x<ul><li>y<li>z</ul><li>real<li>more</ul>after</article>", "real\nmore\nafter"),
    ("<article><ul><li>real<li class=share>x</ul>after</article>", "real\nafter"),
    ("<article><dl><dt>a<dd class=ad>x<dt>b<dd>c</dl></article>", "a\nb\nc"),
    ("<article><table><tr><td class=ad>x<table><tr><td>y</table><td>real<tr><td>more</table>after</article>", "real\nmore\nafter"),
    ("<article><table><tr class=ad><td>x<tr><td>real</table></article>", "real"),
    ("<article><div><div class=ad><p>x</div>real</div></article>", "real"),
    # words that only contain a mark, or values of other attributes
    ("<article><p class=related-work>a<p class='post search-results'>b<p title='a hidden gem'>c<p data-role=header>d<p class=ad-300x250>x</article>",
     "a\nb\nc\nd"),
    # nothing is left: no filters
    (f"<body><div class=widget><p>{LONG}</p><nav>m</nav></div></body>", LONG),
    (f"<body><form id=f><p>{LONG}</p></form></body>", LONG),
    # captions, formulas, pages whose head or svg is not closed
    ("<article><figure><img src=i><figcaption>Seen</figcaption></figure><p>so <math><mi>x</mi></math>.</article>", "Seen\nso x."),
    (f"<html><head><title>T</title><body><p>{LONG}</body>", LONG),
    ("<article><svg class=i /><p>real</p><svg><text>x</text></svg></article>", "real"),
])
def test_no_text_of_the_content_is_dropped(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("word", """user-comments reader-comments comment-body comment-thread user-comment blog-comments entry-comments article-comments
sponsored-post advert-inline ad-text promo-text related-posts article-sidebar blog-footer sponsored-content comment ad-slot-1 cookie-notice
page-footer""".split())
def test_marked_parts_go(word):
    assert html_text.main_text(f"<article><p>Body</p><div class='{word}'>Other people's text<p>and more</p></div><p>End</p></article>") == "Body\nEnd"


@pytest.mark.parametrize("word", ["post-content", "entry-header", "content-sidebar-wrap", "post-body", "article-text", "blog-post", "has-sidebar"])
def test_holders_of_the_content_stay(word):
    assert html_text.main_text(f"<body><div class='{word}'><h1>Head</h1><p>{LONG}</p></div></body>") == f"Head\n{LONG}"


@pytest.mark.parametrize("piece", ["<a ", "<p class='", "<p class=\"", "<a '\"", "<svg ", "<script ", "</p ", "<!", "<", "<a b='>' ", "<p title=\"'<i '>", "<div>", "<ul><li>"])
def test_unfinished_tags_take_linear_time(piece):
    import time
    began = time.process_time()
    html_text.main_text("<p>text</p>" + piece * (300_000 // len(piece)))
    assert time.process_time() - began < 2


@pytest.mark.parametrize("page, text", [("<p>a <b c</p>", "a"), ("<p>one <b two", "one <b two"), ("<p title='x>one</p><p>two</p>", "<p title='x>one\ntwo"),
                                        ("<p>a</p><a '", "a\n<a '"), ("<p><![CDATA[x & y]]></p>", "x & y"), ("<svg a='1'/><p>x", "x"), ("<script>a</SCRIPT >b", "b")])
def test_unfinished_tags_are_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" + " " * 1_000_000 + "b"])
def test_long_white_space_is_counted(spark, text):
    df = spark.createDataFrame([(1, "s", "en", text)], "doc_id bigint, source string, lang string, text string")
    got = token_counts.count_tokens(df, fields=(("text", False),)).collect()
    assert len(got) == 1 and got[0].end_char == len(text) and got[0].n_tokens >= len(text) // 2


def test_link_lists_between_passages_go():
    menu = "".join(f"<li><a href=/{i}>a link to read</a></li>" for i in range(9))
    assert html_text.main_text(f"<body><p>{LONG}</p><nav>m</nav><ul>{menu}</ul><nav>m</nav><p>{LONG}</p></body>") == f"{LONG}\n{LONG}"


def test_sums_and_passages():
    assert html_text.passages([0, 0, 50, 5, 0, 60, 0, 0, 0, 70, 1], 3, 30) == [(2, 6), (9, 11)]
    assert html_text.passages([], 3, 30) == []


def test_extract_keeps_rows_and_columns(spark):
    rows = [(1, "u", PAGE, "clash", 5), (2, None, None, None, None), (3, "u", "", "", 1), (1, "u", PAGE, "clash", 5),
            (4, "v", "<p>" + "x" * 300_000, "", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = html_text.extract(df)
    assert set(got.columns) == {"page_id", "url", "html", "text", "n_chars"}
    assert sorted((r.page_id, r.n_chars, len(r.text)) for r in got.collect()) == [(1, 102, 102), (1, 102, 102), (2, 0, 0), (3, 0, 0), (4, 300_000, 300_000)]
    assert html_text.extract(df.limit(0)).count() == 0


def brute_licenses(text, templates, min_coverage):
    """Exact occurrences of whole templates, longest first, without overlap."""
    from parlance.llm.decontaminate import words_of
    w = words_of((text or "").encode())
    found = []
    for name, t in templates.items():
        p = words_of(t.encode())
        found += [(len(p), name, i, i + len(p)) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    out = []
    for n, name, a, b in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        if all(b <= x or a >= y for _, x, y in out):
            out.append((name, a, b))
    return sorted(out, key=lambda f: f[1])


def test_license_scan(spark):
    rng = random.Random(1)
    t = list(licenses.TEMPLATES.values())
    rows = []
    for i in range(80):
        parts = [" ".join(rng.choice(["licensed", "under", "the", "All", "été", "x1", "version", "3"]) for _ in range(rng.randint(0, 12)))
                 for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(t))
        if rng.random() < 0.3:
            parts.insert(rng.randint(0, 4), rng.choice(t).upper())
        rows.append((i, "\n".join(parts), "x"))
    rows += [(100, None, ""), (101, "", ""), (None, t[1], ""), (0, rows[0][1], "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, template string").repartition(3)
    got = licenses.scan(df, min_coverage=1.0).collect()
    want = [(i, *m) for i, text, _ in rows for m in brute_licenses(text, licenses.TEMPLATES, 1.0)]
    assert sorted(((r.doc_id, r.template, r.start_word, r.end_word) for r in got), key=repr) == sorted(want, key=repr)
    text = {i: x for i, x, _ in rows}
    from parlance.llm.decontaminate import words_of
    for r in got:
        piece = text[r.doc_id][r.start_char:r.end_char]
        assert words_of(piece.encode()) == words_of(licenses.TEMPLATES[r.template].encode())


def test_license_with_changes(spark):
    changed = ("foo bar. Permission is hereby granted, free of any charge, to each person obtaining a copy of this software and its "
               "associated documentation files (the Software), to deal in the Software without restriction. more text")
    df = spark.createDataFrame([(1, changed), (2, "Permission is hereby refused to any person"), (3, "all rights of ours and of others are, we think, reserved")], "doc_id bigint, text string")
    got = licenses.scan(df).collect()
    assert [(r.doc_id, r.template) for r in got] == [(1, "mit-permission")]
    assert 0.8 <= got[0].coverage < 1 and changed[got[0].start_char:got[0].end_char].startswith("Permission")
    assert licenses.scan(df, {"short": "two words"}).count() == 0 and licenses.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, template", [
    ("x. This work is licensed under the GNU Lesser General Public License, version 3. y", "lgpl"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007\n Copyright (C) 2007", "agpl-text"),
    ("/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU Affero General Public License as\n"
     " * published by the Free Software Foundation, either version 3 */", "agpl-header"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("Mozilla Public License Version 2.0\n====\n1. Definitions\n---", "mpl-2.0-text"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies.", "isc-permission"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy", "unlicense"),
    ("Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM", "cc0-1.0-text"),
    ("Released under the MIT License.", "mit"), ("Licensed under CC BY 4.0.", "cc-by-4.0"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0")])
def test_common_licenses(spark, text, template):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [r.template for r in licenses.scan(df).collect()] == [template]


DOCS = [(1, "src", "en", "Hello wörld.\n\nSecond line 123\n"), (2, None, None, None), (3, "", "", ""), (4, "s\nt", "é", "x" * 30_000 + "\n" + "日本語 " * 50),
        (1, "src", "en", "Hello wörld.\n\nSecond line 123\n"), (None, "a", "b", "   \n  \n")]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    import tiktoken
    import base64
    import public_tokenizers
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(*r, 7) for r in DOCS], "doc_id bigint, source string, lang string, text string, n_tokens int")
    got = {}
    for r in token_counts.count_tokens(df, rule=rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, *fields in DOCS:
        whole = "\n".join(f or "" for f in fields)
        n = sum(1 for d in DOCS if d[0] == i)
        assert sum(r.n_tokens for r in got[i]) == pytest.approx(n * len(enc.encode_ordinary(whole)))
        for name, f in zip(("source", "lang", "text"), fields):
            own = sorted({(r.section, r.start_char, r.end_char) for r in got[i] if r.field == name})
            assert "".join((f or "")[a:b] for _, a, b in own) == (f or "")
    # each token by hand
    i, *fields = DOCS[0]
    spans, at = [], 0
    for v, lines in zip(fields, (False, False, True)):
        cuts = [k + 1 for k, c in enumerate(v.encode()) if lines and c == 10 and k + 1 < len(v.encode())]
        for a in [0, *cuts]:
            spans.append(at + a)
        at += len(v.encode()) + 1
    spans.append(at - 1)
    want, at = [0.0] * (len(spans) - 1), 0
    for token in enc.encode_ordinary("\n".join(fields)):
        n = len(enc.decode_single_token_bytes(token))
        held = [max(0, min(at + n, b) - max(at, a)) for a, b in zip(spans, spans[1:])]
        inside = [k for k, h in enumerate(held) if h]
        if rule == "split":
            for k in inside:
                want[k] += held[k] / n
        else:
            want[inside[0] if rule == "first" else inside[-1] if rule == "last" else max(inside, key=lambda k: (held[k], -k))] += 1
        at += n
    order = {"source": 0, "lang": 1, "text": 2}
    rows = sorted(got[1], key=lambda r: (order[r.field], r.section))[::2]       # the row occurs twice
    assert [r.n_tokens for r in rows] == pytest.approx(want)


def test_token_counts_edges(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, lang string, text string")
    assert token_counts.count_tokens(df).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(df, rule="some")

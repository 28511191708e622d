"""Packing, archives, main text and licences."""

import base64
import glob
import gzip
import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from grafthorn.llm import html_text, licenses, packing, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_packing(docs_of):
    rng = random.Random(1)
    texts = ["", None, "Σας ΟΔΟΣ <|endoftext|> x y\tz é é don't  stop", "word " * 9000, "<|ENDOFTEXT|> THE End."]
    docs = [*enumerate(texts), (3, "word " * 9000), *((10 + k, " ".join(rng.choice(["alpha", "Beta.", "γάμμα", "d3lta,"]) for _ in range(rng.randrange(1500)))) for k in range(60))]
    got = packing.packed(packing.token_pieces(docs_of(docs), TOKENIZER), per_partition=20).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want, have, bins = defaultdict(list), defaultdict(list), defaultdict(list)
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[d] += [(p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    for r in got:
        have[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(x) for k, x in have.items()} == {k: sorted(x) for k, x in want.items()}
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in got]), 4096) + 2
    # Each partition's certificate: its bound proves how far from the fewest its count may be.
    assert all(0 < r.part_bound <= r.part_sequences and (r.part_sequences - r.part_bound <= 1 or r.round < max(x.round for x in got)) for r in got)
    assert all(sum(1 for r in got if (r.round, r.part) == k) < 60 for k in {(r.round, r.part) for r in got})
    assert packing.packed(packing.token_pieces(docs_of(docs).limit(0), TOKENIZER)).count() == 0


def test_chunks_encode_like_whole_texts():
    whole = Tokenizer.from_file(TOKENIZER)
    odd = ["İstanbul É Ñandú’s café, cafe\u0301 $5.00<|endoftext|>Foo bar", "Dž ß ẞ ﬁ x\r\nQ", "中文 テスト. привет, ½ ²x x_y_z _a it's. o'clock,' don't.'", "a" * 9000, "E\u0301.\u0301 e,\u0301", "×a÷ ªº µ.", "shndsh$$$ ok'll ('re)"]
    encoder = packing._Encoder(TOKENIZER)
    for _ in range(2):
        assert [np.frombuffer(i, "<u4").tolist() for i in encoder.ids(odd)] == [whole.encode(t, add_special_tokens=False).ids for t in odd]


@pytest.mark.parametrize("seed", range(30))
def test_bounds_hold(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 13) for _ in range(8)), reverse=True)

    def fewest(left, bins):
        if not left:
            return len(bins)
        best, tried = len(sizes), set()
        for i in range(len(bins) + 1):
            room = bins[i] if i < len(bins) else 12
            if room >= left[0] and room not in tried:
                tried.add(room)
                now = list(bins)
                now[i : i + 1] = [room - left[0]]
                best = min(best, fewest(left[1:], now))
        return best

    optimum = fewest(sizes, [])
    assert packing.lower_bound(np.array(sizes), 12) <= optimum <= len(packing.best_fit_decreasing(sizes, 12)[2])


def test_dual_feasible_bound_beats_the_sum():
    assert packing.lower_bound(np.array([7, 7, 7]), 12) == 3


def test_archives(spark):
    pages = [(1, "u", ""), (2, "u\r\nx", None), (3, None, "WARC/1.1\r\nContent-Length: 3\r\n\r\nab\r\n\r\nWARC/1.1"), (4, "u", "dup é"), (5, "u", "dup é"), (5, "u", "dup é"), (5, "u", "other"), (None, "u", "dup é"), (None, "u", "lone")]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.deduplicated_archive(frame).collect()]
    groups = defaultdict(list)
    for p, _, h in pages:
        groups[h or ""].append(p)
    want = []
    for h, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        raw = h.encode()
        want += [(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top) for i in ids]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = [r.record_type for r in warc.resolve(frame, min_bytes=6).collect()]
    # Of the payloads of 6 bytes or more only "dup é" (one without an id, two of the largest id) repeats: ids 4 and null revisit 5.
    assert kept.count("revisit") == 2 and kept.count("response") == len(pages) - 2
    back = {(r.page_id, bytes(r.payload).decode()) for r in warc.read_archive(spark, warc.write_archive(warc.resolve(frame, 10**9))).collect()}
    assert back == {(p, h or "") for p, _, h in pages}
    by_size = ((6, 2), (20, 1), (None, 1))
    path = warc.write_archive(warc.resolve(frame), records_per_file=by_size)
    assert sorted(r.record_type for r in warc.read_archive(spark, path).collect()) == sorted(w[3] for w in want)
    sizes = [sum(1 for _ in warc._records(gzip.open(f))) for f in glob.glob(f"{path.removeprefix('file:')}/*.gz")]
    assert sum(sizes) == len(pages) and max(sizes) <= 2
    assert warc.deduplicated_archive(frame.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><script>if (a < b) { x("<p>no</p>") }</script></head><body>
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=/a>A, b, c</a></ul></nav>
<div class="sidebar"><p>Side text, with many, many, commas, to, score, well.</p></div>
<div id=content><h1>Title &amp; more</h1><p>First   paragraph, with
a <a href=x>link</a> &mdash; and text.<p>Second one, long enough to be kept as text.<ul><li>item one<li>item two</ul>
<div class="ad-box ad">Buy, buy, buy</div><form><p>Name, please, now</p></form>
<table><tr><td>cell a<td>cell b</table></div>
<div id="comments"><p>Reader says, hello, there, everyone.</p></div><footer>&copy; 2020, all, rights</footer></body>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == ["Title & more", "First paragraph, with a link — and text.", "Second one, long enough to be kept as text.", "item one", "item two", "cell a", "cell b"]
    for odd in (None, "", "<", "<p", "<!-- open", "</p></div>", "<script>never closed", "&amp;" * 3):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("<p>one</p>") == "one" and html_text.main_text("<div>" * 3000 + "<p>deep, text</p>") == "deep, text"


def test_whole_article():
    page = "<body><div class=post><article><h1>Head</h1><section><p>Long text, with many, many, commas, in, it, so it scores well above.</p></section><section><p>Short.</p></section><ol class=commentlist><li>Reader, says, so</ol></article></div></body>"
    assert html_text.main_text(page) == "Head\nLong text, with many, many, commas, in, it, so it scores well above.\nShort."


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a b</p><p>é</p></article>", "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extracted(pages).collect()} == {(1, "u", "a b\né", 5), (2, None, "", 0)}


@pytest.mark.parametrize(
    "text,want,left",
    [
        ("foo\nLicensed under CC BY-NC 4.0.\nbar", ["CC-BY-NC-4.0"], []),
        ("x. This work is licensed under the GNU General Public License, version 3.\nabc", ["GPL-3.0"], []),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"], []),
        ("Released under the MIT License. Text. Released under the MIT License.", ["MIT", "MIT"], []),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\nin it.\n\nThe above copyright notice and this permission notice shall be included in\nall copies or substantial portions of the Software.", ["MIT"], []),
        ("Licensed under the Foo License.", [], ["other.licence"]),
        ("Nothing here. The license plate was found.", [], []),
        (None, [], []),
        ("", [], []),
    ],
)
def test_licences(text, want, left):
    assert licenses.match_rules(licenses.sentence_ids(text)) == (want, left)


def test_rule_order():
    both = ["bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse"]
    assert licenses.match_rules(both) == (["BSD-3-Clause"], [])
    assert licenses.match_rules(both[:3]) == (["BSD-2-Clause"], [])
    assert licenses.match_rules(both[1:]) == ([], both[1:])


def test_licence_rows(docs_of):
    got = licenses.licenses(docs_of([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None)])).collect()
    assert sorted((r.doc_id, r.licenses) for r in got) == [(1, ["MIT"]), (1, ["MIT"]), (2, [])]


def test_figures_and_attribute_values_are_kept():
    page = '<article><p title="a hidden treasure">One, two, three.</p><figure><img src=x><figcaption>A caption.</figcaption><svg><text>no</text></svg></figure><div class="commentary promontory" data-x="hidden"><p>Said of it, at length.</p></div><p hidden>gone</p><p data-a=1 hidden="">gone</p><ul class=commentlist><li>Reader</ul></article>'
    assert html_text.main_text(page) == "One, two, three.\nA caption.\nSaid of it, at length."


def test_licence_sentences_without_common_words(docs_of):
    want = [
        ("This software is released under the GNU GPL v3.", ["gpl-3.grant"]),
        ("Distributed under CC BY 4.0.", ["cc-by-4.grant"]),
        ("released under CC0 1.0", ["cc0.grant"]),
        ("All rights reserved.", ["rights.reserved"]),
        ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["mpl-2.copy"]),
        ("Published under AGPL 3.0.", ["agpl-3.grant"]),
        ("Nothing of the kind.", []),
    ]
    got = {r.doc_id: r.sentence_ids for r in licenses.licenses(docs_of(enumerate(t for t, _ in want))).collect()}
    assert [got[i] for i in range(len(want))] == [ids for _, ids in want]


def _every_expression(sentence):
    """Identifier of a sentence by trying every expression of every kind in turn."""
    plain = licenses.normalised(sentence)
    for name, expressions in licenses.SENTENCES.items():
        if any(re.match(x, plain) for x in expressions):
            return name
    if re.match(r"copyright \d{4}\b", plain):
        return "copyright.line"
    for name in licenses.SPDX:
        if plain in (f"spdx license identifier {licenses.normalised(name)}", f"spdx licence identifier {licenses.normalised(name)}"):
            return f"spdx.{name}"
    if re.match("spdx licen[cs]e identifier .", plain):
        return "other.licence"
    for name, expression in licenses.GRANTS.items():
        m = licenses._GRANT.match(plain)
        if m and re.fullmatch(expression, plain[m.end() :]):
            return name
    return None


def _brute_rules(ids):
    """Rules in their order, each taking its earliest runs, on a list that marks what is gone."""
    left, taken = list(ids), []
    for licence, wanted in licenses.RULES:
        for start in range(len(left)):
            own, at = [], start
            for w in wanted:
                if at < len(left) and left[at] == w.rstrip("?"):
                    own.append(at)
                    at += 1
                elif not w.endswith("?"):
                    own = None
                    break
            if own:
                for o in own:
                    left[o] = None
                taken.append((own[0], licence))
    return [x for _, x in sorted(taken)], [x for x in left if x]


def _example(expression, rng):
    """A sentence that an expression matches: each group's first or a later choice, optional parts kept or not."""
    x = expression.replace(r"\b", "").replace("$", "").replace(".* may", "the owner may").replace(r"\d{4}", "2020")
    while True:
        m = re.search(r"\(\?:([^()]*)\)(\??)", x)
        if not m:
            break
        pick = rng.choice(m[1].split("|")) if not m[2] or rng.random() < 0.5 else ""
        x = x[: m.start()] + pick + x[m.end() :]
    x = re.sub(r"\[cs\]", lambda _: rng.choice("cs"), x)
    return re.sub(r"(.)\?", lambda m: m[1] if rng.random() < 0.5 else "", x).replace(".*", "foo")


def test_every_sentence_is_known_and_none_is_skipped(docs_of):
    rng = random.Random(3)
    filler = ["The cat sat.", "This is free.", "You may go now.", "In no event.", "Permission is needed here.", "The license plate.", "under the MIT License", "Released under water."]
    known = [x for xs in licenses.SENTENCES.values() for x in xs]
    heads = ["Licensed under the ", "This work is licensed under the terms of the ", "released under ", "The software is made available to you under the terms and conditions of the ", "# Distributed under "]
    sentences = list(filler)
    for _ in range(3):
        sentences += [_example(x, rng).capitalize() + "." for x in known]
        sentences += [rng.choice(heads) + _example(rng.choice(g.split("|")) if "(" not in g else g, rng) + "." for g in licenses.GRANTS.values()]
        sentences += [f"SPDX-License-Identifier: {n}" for n in licenses.SPDX]
    for s in sentences:
        assert licenses.sentence_id(s) == _every_expression(s)
    for name, xs in licenses.SENTENCES.items():
        assert any(licenses.sentence_id(_example(x, rng)) == name for x in xs for _ in range(20)), name
    docs = [(i, "\n".join(rng.choice(sentences) for _ in range(rng.randrange(12)))) for i in range(60)] + [(60, None), (61, ""), (62, "MIT License\n" * 30_000), (62, "MIT License\n" * 3)]
    got = licenses.licenses(docs_of(docs)).collect()
    assert len(got) == len(docs)
    for (i, text), r in zip(docs, sorted(got, key=lambda r: (r.doc_id, -len(r.licenses))), strict=True):
        ids = [x for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if (x := _every_expression(s))]
        if i < 60 and ids == r.sentence_ids:
            assert (r.licenses, r.unmatched) == _brute_rules(ids)
        assert len(r.sentence_ids) >= len(ids)
    assert licenses.licenses(docs_of([(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("Released under the GPL v3.", ["GPL-3.0"]),
        ("Distributed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Released under CC0 1.0.", ["CC0-1.0"]),
        ("Released under the LGPL v3.", ["LGPL-3.0"]),
        ("// SPDX-License-Identifier: BSL-1.0", ["BSL-1.0"]),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even more.  See the GNU Lesser General Public License for more details.", ["LGPL-2.1-or-later"]),
        ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", ["Zlib"]),
        ("Boost Software License - Version 1.0 - August 17th, 2003", ["BSL-1.0"]),
    ],
)
def test_more_licences(text, want):
    assert licenses.match_rules(licenses.sentence_ids(text))[0] == want


def _brute_main_text(page):
    """Scores of a page of closed div, p and a elements from their definition: every block visits every ancestor."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(page)
    parents = {c: p for p in root.iter() for c in p}
    order = {e: n for n, e in enumerate(root.iter())}
    blocks = [(re.sub(r"\s+", " ", "".join(e.itertext())).strip(), sum(len("".join(a.itertext())) for a in e.iter("a")), e) for e in root.iter("p")]
    up = lambda e: [e] + (up(parents[e]) if e in parents else [])
    score, chars, linked = defaultdict(float), defaultdict(int), defaultdict(int)
    for text, links, e in blocks:
        for a in up(e):
            chars[a] += len(text)
            linked[a] += min(links, len(text))
        points = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - min(links, len(text)) / len(text))
        for level, a in enumerate(up(parents[e])[: html_text.REACH], 1):
            score[a] += points / level
    worth = lambda e: score[e] * (1 - linked[e] / max(1, chars[e]))
    best = min(score, key=lambda e: (-worth(e), order[e]))
    keep = {best}
    for x in parents[best] if best in parents else []:
        thin = chars[x] and linked[x] / chars[x] < 0.25
        if x is not best and chars[x] and (worth(x) >= html_text.SIBLING * worth(best) or x.tag == "p" and chars[x] > 80 and thin):
            keep.add(x)
    return "\n".join(t for t, _, e in blocks if any(a in keep for a in up(e)))


def test_scores_against_brute_force():
    rng = random.Random(12)

    def element(depth):
        if depth > 3 or rng.random() < 0.4:
            words = [rng.choice(["red", "green,", "blue", "<a>link words</a>", "sky,"]) for _ in range(rng.randrange(1, 40))]
            return "<p>" + " ".join(words) + "</p>"
        return "<div>" + "".join(element(depth + 1) for _ in range(rng.randrange(1, 5))) + "</div>"

    for _ in range(300):
        page = "<body><div>" + "".join(element(1) for _ in range(rng.randrange(1, 5))) + "</div></body>"
        assert html_text.main_text(page) == _brute_main_text(page)


def test_article_keeps_its_own():
    page = '<article><p class="legal">Law, text, here.</p><p class=tags>On tags.</p><div id=related><p>Is kept.</p></div><div class=ad>no</div></article><p class=legal>no</p>'
    assert html_text.main_text(page) == "Law, text, here.\nOn tags.\nIs kept."


@pytest.mark.parametrize("odd", ['<a href="y ', "<div>", "<p><table><td>", "<b>", "</x><i>", "<a href='", "<", "<!--x", "<li><ul>", "<div>a, b<p>", '<p class="x">a &amp; ', "</p>"])
def test_broken_pages_in_time(odd):
    page, began = odd * (400_000 // len(odd)) + "end", time.monotonic()
    assert isinstance(html_text.main_text(page), str)
    assert time.monotonic() - began < 20


def test_quotes_that_never_end():
    assert html_text.main_text('<p>One <a href="x>two</a> three.</p><p>Four, five, six.</p>') == "One two three.\nFour, five, six."


def test_page_rows(spark, docs_of):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, "<p>b</p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, n_chars string")
    assert sorted((str(r.page_id), r.text) for r in html_text.extracted(pages).collect()) == [("1", "a"), ("1", "a"), ("None", "b")]
    assert html_text.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("text, want", [
    ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', ["Apache-2.0"]),
    ("Licensed under GPL v3 or later.", ["GPL-3.0"]), ("Licensed under the Apache License 2.0 or the MIT license.", ["Apache-2.0", "MIT"]), ("Licensed under MIT and Apache-2.0.", ["MIT", "Apache-2.0"]), ("Dual licensed under the MIT and GPL v2 licenses.", ["MIT", "GPL-2.0"]),
    ("This software is licensed under the MIT license, which is permissive.", ["MIT"]), ("The code is MIT licensed.", ["MIT"]), ("MIT licensed", ["MIT"]), ("License: MIT", ["MIT"]), ("Licence: BSD 3-Clause", ["BSD-3-Clause"]),
    ("Released under the ISC license. See LICENSE.", ["ISC"]), ("The library is distributed under the terms of the GNU Lesser General Public License, version 2.1, as published by the Free Software Foundation.", ["LGPL-2.1"]),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", ["BSL-1.0"]), ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
    ("The license was revoked.", []), ("Released under the MITX license.", []), ("Licensed under the MIT license plate collection.", []), ("The driver is licensed", []), ("License: none", []), ("Licensed under the Foo License.", []),
])
def test_sentences_as_people_write_them(text, want):
    assert licenses.match_rules(licenses.sentence_ids(text))[0] == want


def test_comments_references_and_formulas():
    page = "<article><p>One, two<!--> and three.</p><p>Let <math><mi>x</mi></math> be AT&<b>amp;</b>T &amp; co.</p><p>A<!--->b<!-- c --!> d<!-- e --> f</p></article>"
    assert html_text.main_text(page) == "One, two and three.\nLet x be AT&amp;T & co.\nAb d f"


#: Written by hand, not made from the tables of the module.
_WRITTEN = [
    ("This project is licensed under the MIT License - see the LICENSE file for details.",["MIT"]),
    ("This project is licensed under the terms of the MIT license.",["MIT"]),
    ("This library is licensed under the [MIT License](LICENSE).",["MIT"]),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",["Apache-2.0"]),
    ("Licensed under the Apache License, Version 2.0 <LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0>",["Apache-2.0"]),
    ("Licensed under GPL v3 or later.",["GPL-3.0"]),
    ("Licensed under the Apache License 2.0 or the MIT license.",["Apache-2.0","MIT"]),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.",["Apache-2.0","MIT"]),
    ("Dual licensed under the MIT and GPL v2 licenses.",["MIT","GPL-2.0"]),
    ("This software is licensed under the MIT license, which is permissive.",["MIT"]),
    ("The code is MIT licensed.",["MIT"]),
    ("License: MIT",["MIT"]),
    ("License: Apache 2.0",["Apache-2.0"]),
    ("Licence: GPL-3.0",["GPL-3.0"]),
    ("This crate is licensed under the MIT license.",["MIT"]),
    ("The app is released under the GPLv3.",["GPL-3.0"]),
    ("Released under the GPLv2.",["GPL-2.0"]),
    ("Distributed under the MIT License. See LICENSE for more information.",["MIT"]),
    ("Distributed under the Boost Software License, Version 1.0.",["BSL-1.0"]),
    ("Distributed under the terms of the Modified BSD License.",["BSD-3-Clause"]),
    ("Use of this source code is governed by a BSD-3-Clause license that can be found in the LICENSE file.",["BSD-3-Clause"]),
    ("Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",["MIT"]),
    ("This file is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",["CC-BY-SA-4.0"]),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.",["CC-BY-4.0"]),
    ("Content on this site is licensed under CC BY-SA 3.0.",["CC-BY-SA-3.0"]),
    ("Text is available under the Creative Commons Attribution-ShareAlike License 4.0; additional terms may apply.",["CC-BY-SA-4.0"]),
    ("All content is available under CC BY 4.0 unless otherwise noted.",["CC-BY-4.0"]),
    ("Except where otherwise noted, this work is licensed under CC BY-NC 4.0.",["CC-BY-NC-4.0"]),
    ("Unless otherwise stated, the text is licensed under CC BY-NC-SA 4.0.",["CC-BY-NC-SA-4.0"]),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",["CC0-1.0"]),
    ("This data is dedicated to the public domain under CC0 1.0 Universal.",["CC0-1.0"]),
    ("Copyright 2019 Jane Doe. Licensed under the ISC license.",["ISC"]),
    ("It is licensed under the MIT license.",["MIT"]),
    ("We release the code under the Apache 2.0 license.",["Apache-2.0"]),
    ("Our code is released under the MIT License.",["MIT"]),
    ("The source code is licensed under the Mozilla Public License 2.0.",["MPL-2.0"]),
    ("The source code is available under the MPL 2.0.",["MPL-2.0"]),
    ("This program is licensed under the GNU AGPLv3.",["AGPL-3.0"]),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",["GPL-3.0-or-later"]),
    ("Licensed under the LGPL v2.1.",["LGPL-2.1"]),
    ("Licensed under the EUPL.",[]),
    ("The MIT License (MIT)",["MIT"]),
    ("MIT License",["MIT"]),
    ("BSD 3-Clause License",["BSD-3-Clause"]),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",["GPL-3.0"]),
    ("Mozilla Public License Version 2.0",["MPL-2.0"]),
    ("Apache License\nVersion 2.0, January 2004",["Apache-2.0"]),
    ("ISC License",["ISC"]),
    ("The Unlicense",["Unlicense"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0",["MIT","Apache-2.0"]),
    ("// SPDX-License-Identifier: GPL-2.0",["GPL-2.0"]),
    ("# SPDX-License-Identifier: BSD-3-Clause",["BSD-3-Clause"]),
    ("SPDX-License-Identifier: MIT",["MIT"]),
    ("The driving license was issued in Berlin.",[]),
    ("He was licensed under the old law.",[]),
    ("The film was released under the title Boost.",[]),
    ("She studied at MIT.",[]),
    ("The license of the bar was revoked in 2001.",[]),
    ("A gun license is required.",[]),
    ("The drug was licensed in 1990.",[]),
    ("The model was released under pressure.",[]),
    ("The report is available under the link below.",[]),
]


@pytest.mark.parametrize("text, want", _WRITTEN)
def test_licences_by_hand(text, want):
    assert licenses.match_rules(licenses.sentence_ids(text))[0] == want

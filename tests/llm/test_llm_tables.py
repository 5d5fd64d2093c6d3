"""HTML, licences, mixing, WARC, sharding and top-k against plain versions."""

import hashlib
import heapq
import math
import random
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import html_extract, licenses, mixing, sharding, topk, warc

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li><a>B</a></ul></nav><!-- ad --><div class="ad">Buy</div>'
    "<article><header><h1>Head &amp; line</h1></header><p><b>One\n  two &eacute;&#233;<br>three<p>Four<form>f<input></form></p><ul><li>x<li>y</ul>"
    '<div class="comments"><p>nice!</p></div></article><aside>side</aside><footer>&copy; me</footer></body></html>'
)


def test_main_text_leaves_the_rest_of_the_page_out():
    assert html_extract.main_text(PAGE) == "Head & line\nOne two éé three\nFour\nx\ny"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b", "a\nb"),
        ("a &lt;b&gt; &amp", "a <b> &"),
        ("<div>un<b>closed", "unclosed"),
        ("</p></div>x", "x"),
        ("<script>a<b", ""),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<main><p>in</p></main><p>out</p>", "in"),
        ('<div role="navigation">n</div><p>t</p>', "t"),
        ("<p>x" * 3, "x\nx\nx"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div><select><option>A<option>B</select></div><article><p>in</article>", "in"),
        ("<select><optgroup><option>A<optgroup><option>B</select>after", "after"),
        ("<div><button>Go</div><article><p>in</p></article>", "in"),
        ("<button><span>Go</span><article><p>in</p></article>", "in"),
        ("<div><svg><text>s</div><p>t", "t"),
        ("<svg><g><p>t</p>", "t"),
        ("<svg><foreignObject><p>no</p></foreignObject></svg>t", "t"),
        ("<div><video>no<p>no</p></div><p>t", "t"),
        ("<div><object><div>no</div>no</div><p>t", "t"),
        ("<object><object>no</object>no<article>no</article></object>t", "t"),
        ("<template><article>no</article></template>t", "t"),
        ("<table><tr><td><select><option>A<td>t</table>", "t"),
        ("</option></button></script>t", "t"),
    ],
)
def test_silent_elements_end_where_they_do(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='layout has-sidebar'><article><p>in</p></article><div class=sidebar>side</div></div>", "in"),
        ("<div id='search-results-page'><main><p>in</p></main></div>", "in"),
        ("<div class='layout has-sidebar'><p>in</p></div>", "in"),
        ("<article><h1 class='entry-header'>T</h1><p>in</p></article>", "T\nin"),
        ("<article><div class='post-header'><h2>T</h2></div><p>in</p></article>", "T\nin"),
        ("<article><p>in</p><div class='related-posts'><h2>Related</h2><article><p>other</p></article></div></article>", "in"),
        ("<main><div class='has-sidebar sidebar'><article><p>in</p></article></div></main>", "in"),
        ("<article><p>in</p><div class='related'><h2>Related</h2><p>other</p></div></article>", "in"),
        ("<article><p>in</p><div class='page-header related'><h2>Related</h2></div></article>", "in"),
        ("<nav class=menu><article><p>no</p></article></nav><p>t</p>", "t"),
        ("<div class=menu><p>no</p></div><p>t</p>", "t"),
    ],
)
def test_names_of_wrappers_and_titles_remove_nothing(page, text):
    assert html_extract.main_text(page) == text


def test_style_tree_removes_what_a_host_repeats(spark):
    pages = [(i, f"http://a.example/{i}", f"<body><div><p>Terms of this site apply</p></div><div class=c><p>own text {i}</p>" + "<p>more %d</p>" % (i * i) * (i % 3) + "</div></body>") for i in range(12)]
    pages += [(100, "http://b.example/x", "<body><div><p>Terms of this site apply</p></div></body>"), (101, None, None)]
    pages += [(200 + i, "http://c.example/", "<body><article><p>a copy</p></article></body>") for i in range(9)]
    rows = [(*p, "clash") for p in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[100] == "Terms of this site apply" and got[101] == "" and got[205] == "a copy"
    for i in range(12):
        lines = got[i].split("\n")
        assert f"own text {i}" in lines
    tree = {(r.host, r.path): r for r in html_extract.style_tree(df.withColumn("host", html_extract._host("url"))).collect()}
    assert tree["b.example", "body>div>p"].importance == 1.0
    again = [("r%d" % i, "http://d.example/", f"<body><section><p>Same words</p></section><div class=c><p>own {i}</p></div></body>") for i in range(8)]
    df = spark.createDataFrame(again, "page_id string, url string, html string")
    assert {r.text for r in html_extract.extract(df).collect()} == {f"own {i}" for i in range(8)}
    assert html_extract.extract(df.limit(0)).count() == 0


def plain_tree(pages):
    """Importance of every (path, seed) of one host's pages, by the formulas, node by node."""
    shown, styles, children, below = Counter(), defaultdict(Counter), Counter(), defaultdict(Counter)
    for page in pages:
        found, nodes = html_extract.blocks(page)
        kept = [n for n in nodes if n.seed or n.tag in html_extract.BLOCKS]
        for path, style in {((n.path, n.seed), tuple(n.children)) for n in kept}:
            shown[path] += 1
            styles[path][style] += 1
            children[path] += len(style)
        texts = set()
        for home, pieces in found:
            n = home
            while n is not None:
                texts.add(((n.path, n.seed), html_extract._text([raw for _, raw in pieces])))
                n = n.parent
        for path, text in texts:
            if path in shown:
                below[path][text] += 1
    out = {}
    for path, n in shown.items():
        m = min(n, len(pages))
        if m < html_extract.PAGES:
            out[path] = 0.0 if path[1] else 1.0
            continue
        entropy = -sum(c / n * math.log(c / n) for c in styles[path].values()) / math.log(n)
        content = 1 - min(1.0, sum(map(math.log, below[path].values())) / len(below[path]) / math.log(m)) if below[path] else 1.0
        share = 0.9 ** (children[path] / n)
        out[path] = html_extract.PRIORS[path[1]] * ((1 - share) * entropy + share * content if children[path] else content)
    return out


FURNITURE = "<nav class=top><ul><li>a{k}</li><li>b</li></ul></nav><div class=ad>buy {k}</div>"


def host_pages():
    """Pages on which only entropy tells: a box without a name that repeats, and two named alike that do and do not."""
    body = FURNITURE + "<article><h1>Title {k}</h1><p>text {k}</p>{more}<div class=share>{share}</div><div class=box><div>Read our terms of use</div></div><p>end</p></article><footer>foot {k}</footer>"
    rich = lambda k: "".join(f"<p>share price on day {k} {j} was {k * j}</p>" for j in range(1 + k % 5)) + "<ul><li>x</ul>" * (k % 3)
    a = [body.format(k=k, more="<p>more</p>" * (k % 3), share=rich(k)) for k in range(15)]
    b = [body.format(k=k, more="<p>more</p>" * (k % 3), share="<p>Tell your friends</p>") for k in range(15)]
    return a, b


def test_importances_match_the_formulas_node_by_node(spark):
    a, b = host_pages()
    rows = [("a", p) for p in a] + [("b", p) for p in b] + [("c", PAGE)] * 6 + [("d", PAGE)]
    tree = html_extract.style_tree(spark.createDataFrame(rows, "host string, html string").repartition(5)).collect()
    for host in "abcd":
        want = plain_tree([p for h, p in rows if h == host])
        got = {(r.path, r.seed): r.importance for r in tree if r.host == host}
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("most", [50_000, 0])
def test_the_tree_decides(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", most)  # both ways of the join
    a, b = host_pages()
    rows = [(i, "http://a.example/", p) for i, p in enumerate(a)] + [(100 + i, "http://b.example/", p) for i, p in enumerate(b)]
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(15):
        # Only entropy removes the box, and only entropy saves a class "share" with text of its own.
        assert "Read our terms of use" not in got[k] + got[100 + k]
        assert f"share price on day {k} 0 was 0" in got[k] and "Tell your friends" not in got[100 + k]
        assert got[k][:2] == [f"Title {k}", f"text {k}"] and got[k][-1] == "end"
        alone = html_extract.main_text(a[k]).split("\n")
        assert "Read our terms of use" in alone and f"share price on day {k} 0 was 0" not in alone


@pytest.mark.parametrize(
    ("name", "seed"),
    [("job-search-tips", 0), ("post side-effects", 0), ("share price", 1), ("menu-planning", 1), ("entry-content", 0), ("site-footer", 2), ("relatedPosts", 2), ("comments-area", 2), ("search-form", 2), ("ad", 2), ("shadow adapt", 0)],
)
def test_seeds_of_names(name, seed):
    assert html_extract.seed_of(name) == seed


@pytest.mark.parametrize("page", ['<a "' * 20000, "<a " * 60000, "<div>" * 60000 + "x</p>" * 60000, "<!" * 60000, "<aside><p><table>" * 20000 + "<aside>" * 20000, "<select><b><option>" * 20000, "<video><svg>" + "<g><div>" * 30000, "<b>x" * 60000, "<a b='" * 30000, "<script>" * 30000, "<article><main>" * 20000 + "x", "<p>" + "<b class=share>" * 30000 + "x" + "</i>" * 30000])
def test_hostile_pages_take_time_in_proportion(page):
    began = time.process_time()
    html_extract.main_text(page)
    html_extract.page_counts(page)
    assert time.process_time() - began < 5


def plain_licenses(texts, templates, threshold, whole=()):
    """(score, name) of each text's best unit, by the formula in plain Python."""
    marked = lambda x: any(m in x.lower() for m in licenses.MARKS)
    units = []
    for i, text in texts.items():
        if not text or not marked(text):
            continue
        lines = text.replace("\r\n", "\n").split("\n")
        runs, run = [], []
        for line in [*lines, ""]:
            if any(c.isascii() and (c.isalpha() or c.isdigit()) for c in line.lower()):
                run.append(line)
            else:
                runs.append(run)
                run = []
        every = lines + ["\n".join(r) for r in runs if len(r) > 1] + ([text] if i in whole else [])
        units += [(i, licenses.terms_of(u)) for u in every if marked(u)]
    units = [(i, u) for i, u in units if u]
    df = Counter(t for _, u in units for t in set(u))
    weight = lambda ts: {t: c * math.log(1 + len(units) / max(1, df[t])) for t, c in Counter(ts).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(n, weight(licenses.terms_of(x))) for n, xs in templates.items() for x in ([xs] if isinstance(xs, str) else xs)]
    out = dict.fromkeys(texts, (True, 0.0, None))
    for i, u in units:
        w = weight(u)
        for name, v in vectors:
            s = sum(x * v.get(t, 0) for t, x in w.items()) / (size(w) * size(v))
            if s >= threshold:
                out[i] = min(out[i], (name == licenses.RESERVED, -round(s, 9), name), key=lambda o: (o[2] is None, *o[:2], o[2] or ""))
    return {i: (-o[1], o[2]) for i, o in out.items()}


def wrapped(text, mark, width=60):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line += word + " "
    return "\n".join(f"{mark} {x}" for x in [*lines, line])


PROSE = "the market opened early and people came from far away\nto see what the reserved old man had to sell, right there\nby the river where the copyright office stood, with no rights to speak of"
SOURCES = {
    0: "x\nReleased under the MIT License.\ny",
    1: "licensed UNDER the apache license, version 2.0",
    2: "nothing",
    3: None,
    4: "",
    5: "All rights reserved.\nReleased under the MIT License.",
    6: "/*\n" + wrapped(licenses.TEMPLATES["GPL-3.0"][3], " *") + "\n */\n\nint main() { return 0; }\n",
    7: "#!/bin/sh\n# SPDX-License-Identifier: MPL-2.0\necho hi",
    8: "Mozilla Public License Version 2.0\n==================================\n",
    9: "// Copyright 2020 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style license that can be\n// found in the LICENSE file.\n\npackage x",
    10: PROSE,
    11: "\n\n".join(x for x in [licenses.TEMPLATES["MIT"][2].partition(" The above")[0], licenses.TEMPLATES["MIT"][2].partition("Software. ")[2]]),
    12: "--\r\n" + wrapped(licenses.TEMPLATES["AGPL-3.0"][3], "--").replace("\n", "\r\n") + "\r\n\r\nselect 1",
    13: wrapped(licenses.TEMPLATES["Unlicense"][1], "") + "\n",
    14: "licence " * 4000,
    15: "All rights reserved.",
    16: "rights " * 400,
    17: "# -*- coding -*-\n" + wrapped(licenses.TEMPLATES["Apache-2.0"][2], "#") + "\nimport os",
}
NAMES = {0: "MIT", 1: "Apache-2.0", 5: "MIT", 6: "GPL-3.0", 7: "MPL-2.0", 8: "MPL-2.0", 9: "BSD-3-Clause", 11: "MIT", 12: "AGPL-3.0", 13: "Unlicense", 15: "proprietary", 17: "Apache-2.0"}


def test_licenses_match_plain_cosines(spark):
    files = spark.createDataFrame([(i, t, "clash", i == 11) for i, t in SOURCES.items()], "id long, text string, license string, file boolean").repartition(3)
    got = {r.id: (r.score, r.license) for r in licenses.own_licenses(files, file_col="file").collect()}
    want = plain_licenses(SOURCES, licenses.TEMPLATES, licenses.THRESHOLD, whole={11})
    for i in SOURCES:
        assert got[i][1] == want[i][1] == NAMES.get(i), i
        assert got[i][0] == pytest.approx(want[i][0], abs=1e-8)
    assert licenses.own_licenses(files.limit(0)).count() == 0
    assert {r.license for r in licenses.own_licenses(files, {}).collect()} == {None}


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    rows = [("a/LICENSE", "MIT", 1.0, True), ("a/b/c/x", None, 0.0, False), ("a/b/LICENSE", None, 0.0, True), ("a/b/d/LICENSE", "GPL-3.0", 0.9, True), ("a/b/d/LICENSE2", "MIT", 0.8, True), ("a/b/d/e/y", None, 0.0, False), ("z/y", None, 0.0, False), (None, None, 0.0, False), ("top", None, 0.0, False), ("a/own", "MIT", 1.0, False), ("a/b/c/x", None, 0.0, False)]
    files = spark.createDataFrame(rows, "path string, license string, score double, is_license boolean")
    got = Counter((r.path, r.license_source, r.inherited_from, r.effective_license) for r in licenses.inherited(files).collect())
    assert got == Counter([("a/LICENSE", "own", None, "MIT"), ("a/b/c/x", "inherited", "a", "MIT"), ("a/b/c/x", "inherited", "a", "MIT"), ("a/b/LICENSE", "inherited", "a", "MIT"), ("a/b/d/LICENSE", "own", None, "GPL-3.0"), ("a/b/d/LICENSE2", "own", None, "MIT"), ("a/b/d/e/y", "inherited", "a/b/d", "GPL-3.0"), ("z/y", "none", None, None), (None, "none", None, None), ("top", "none", None, None), ("a/own", "own", None, "MIT")])


def plain_schedule(parts, period):
    done, out = [0] * len(parts), []
    for t in range(period):
        ready = [(math.ceil(Fraction((done[i] + 1) * period, a)), i) for i, a in enumerate(parts) if (done[i] * period) // a <= t]
        out.append(min(ready)[1])
        done[out[-1]] += 1
    return out


def test_the_schedule_is_that_of_earliest_deadlines_and_stays_within_a_block(spark):
    for weights in ([1, 1, 1], [0.5] + [0.01] * 50, [5, 3, 1, 1], [1]):
        parts = mixing.parts_of(weights, 256)
        got = spark.range(1).select(mixing.schedule(F.array(*map(F.lit, parts)), 256)).first()[0]
        assert got == plain_schedule(parts, 256) and sum(parts) == 256
        done = Counter()
        for t, i in enumerate(got, 1):
            done[i] += 1
            assert all(abs(done[k] - t * Fraction(a, 256)) < 1 for k, a in enumerate(parts))


def test_mix_keeps_every_document_and_the_weights(spark):
    rng = random.Random(8)
    rows = [(i, rng.choices(["hot", "b", "c", None], [6, 2, 1, 1])[0], "x") for i in range(4000)] + [(7, "hot", "x"), (None, "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    weights = {"hot": 2.0, "b": 1.0, "c": 1.0, None: 1.0}
    got = mixing.mix(docs, weights, block=4, period=64).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    assert Counter((str(r.doc_id), r.source) for r in got) == Counter((str(i), s) for i, s, _ in rows)
    share = dict(zip(sorted(weights, key=lambda s: (s is not None, s)), mixing.parts_of([weights[s] for s in sorted(weights, key=lambda s: (s is not None, s))], 64), strict=True))
    blocks = defaultdict(set)
    for r in got:
        blocks[r.source].add((r.source_block, r.slot))
    for s, seen in blocks.items():
        assert [b for b, _ in sorted(seen)] == list(range(len(seen)))
        for b, slot in seen:
            assert b * 64 // share[s] <= slot < -(-(b + 1) * 64 // share[s])
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="weights"):
        mixing.mix(docs, {"hot": 1.0})


def plain_slots(weights, blocks):
    """Earliest deadline first, slot by slot, in rational numbers."""
    done, out, t = [0] * len(weights), {}, 0
    share = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    while any(d < n for d, n in zip(done, blocks, strict=True)):
        ready = [(math.ceil((done[i] + 1) / w), i) for i, w in enumerate(share) if done[i] < blocks[i] and math.floor(done[i] / w) <= t]
        if ready:
            i = min(ready)[1]
            out[i, done[i]] = t
            done[i] += 1
        t += 1
    return out


@pytest.mark.parametrize("weights", [[1, 1, 1], [0.5] + [0.01] * 50, [5, 3, 1, 1], [1], [0.9999, 0.0001], [math.sqrt(n) for n in (3000, *[300] * 19)], [Fraction(1, 3), 2, 0.1]])
def test_exact_slots_stay_within_a_block_of_the_weights_given(weights):
    blocks = [300 if i == 0 else 7 + i for i in range(len(weights))]
    got = mixing.slots_of(mixing.exact_parts(weights), blocks)
    assert [t for t, _ in got] == sorted({t for t, _ in got})
    done, slots = [0] * len(weights), {}
    for t, i in got:
        slots[i, done[i]] = t
        done[i] += 1
    if max(slots.values()) < 10_000:
        assert slots == plain_slots(weights, blocks)
    total = sum(map(Fraction, weights))
    for (i, b), t in slots.items():
        w = Fraction(weights[i]) / total
        assert -1 < b - t * w < 1 and -1 < b + 1 - (t + 1) * w < 1


def test_blocks_grow_so_that_the_schedule_stays_bounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 50)
    rows = [(i, "abc"[min(2, i % 7)]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights={"a": 3, "b": 2, "c": 5}).collect()
    assert sorted(r.position for r in got) == list(range(3000)) and max(r.slot for r in got) < 500
    assert max(Counter((r.source, r.source_block) for r in got).values()) == 60
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(spark.range(60).selectExpr("id as doc_id", "cast(id as string) as source"))


def test_mix_with_clashing_columns_and_repeated_keys(spark):
    names = ["parts", "pattern", "_hash", "_chunk", "_n", "_source", "_slots", "_run", "_before", "ordinal", "_doc", "_key", "rows", "_salt"]
    rows = [(None if i % 3 else i, "a" if i % 4 else None, *[f"{n}{i}" for n in names]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    got = mixing.mix(df).collect()
    assert Counter(tuple(r)[: len(names) + 2] for r in got) == Counter(rows)
    assert sorted(r.position for r in got) == list(range(400))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_holds_the_weights_given_over_long_inputs_and_many_sources(spark):
    # 1,000 documents a block each; rounded to parts of 2,048 the rare source would lie five times too near.
    rows = [(i, "rare" if i % 100 == 0 else "hot") for i in range(3000)]
    weights = {"hot": 0.9999, "rare": 0.0001}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=1).collect()
    assert sorted(r.position for r in got) == list(range(3000))
    for r in got:
        w = Fraction(weights[r.source]) / sum(map(Fraction, weights.values()))
        assert math.floor(r.source_block / w) <= r.slot < math.ceil((r.source_block + 1) / w)
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2500).alias("source"))
    assert sorted(r.position for r in mixing.mix(many).collect()) == list(range(6000))


def test_warc_round_trip(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a/\r\n1", big), (5, "http://a/5", big), (3, None, big), (2, "http://a/2", "small"), (4, "u", "small"), (6, "u", None), (7, "u", other), (8, "u", "x\r\n\r\nWARC/1.1\r\n" * 200), (7, "u", other), (9, "u", other[:-1])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    manifest, folder = warc.deduplicated(pages)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(manifest, folder, payloads=True).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = (next(h for i, _, h in rows if i == r.page_id) or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 5) if r.page_id in (1, 3) else ("response", None))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
    manifest, folder = warc.deduplicated(pages.limit(0))
    assert warc.read_archives(manifest, folder).count() == 0


def test_lookup_table_is_filled_by_turns():
    table = sharding.lookup_table([f"s{i}" for i in range(7)], 1009)
    counts = Counter(table)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table([f"s{i}" for i in range(6)], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 0.2 * 1009
    # Brute force: each turn walks the shard's whole preference list.
    lists = [[(int.from_bytes(h[:8]) % 1009 + j * (int.from_bytes(h[8:16]) % 1008 + 1)) % 1009 for j in range(1009)] for h in (hashlib.sha256(f"s{i}".encode()).digest() for i in range(7))]
    slow = {}
    while len(slow) < 1009:
        for k in range(7):
            if len(slow) < 1009:
                slow[next(s for s in lists[k] if s not in slow)] = k
    assert [slow[i] for i in range(1009)] == table
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(["a"], 1000)
    with pytest.raises(ValueError, match="shard"):
        sharding.lookup_table([])


def test_placement(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(3000)] + [(None, "x"), (5, "x")], "k long, shard string")
    got = sharding.place(rows, "k", ["b", "a", "c", "a"], 1009).collect()
    assert len(got) == 3002 and len({r.shard for r in got if r.k == 5}) == 1
    assert [r.shard for r in got if r.k is None] == [None]
    table = sharding.lookup_table(["a", "b", "c"], 1009)
    assert all(r.shard == "abc"[table[r.slot]] for r in got if r.k is not None)
    assert max(Counter(r.shard for r in got).values()) < 1200


@pytest.mark.parametrize("clustered", [True, False])
def test_top_k_matches_brute_force(spark, clustered):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8)) * (1 if clustered else 0)
    x = [(i, (centres[i % 6] * 2 + rng.normal(size=8) * 0.3).astype(np.float32).tolist()) for i in range(900)]
    x += [(900 + i, x[3][1]) for i in range(60)] + [(2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [1.0])] + [x[10], (10, x[10][1])]
    df = spark.createDataFrame([(*r, "clash") for r in x], "vec_id long, embedding array<float>, id string")
    got = topk.top_k(topk.integers(df), F.col("id") % 50 == 0, k=5, pivots=8, block=128).collect()
    whole = {i: np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64) for i, v in x if i < 2000}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        best = heapq.nsmallest(5, ((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(topk.integers(df), F.col("id") % 50 == 0).collect()] == [(0, 1, 1, 128 * 256)]
    assert topk.top_k(topk.integers(df.limit(0)), F.col("id") % 50 == 0).count() == 0


def test_top_k_of_large_components_and_of_ids_with_several_vectors(spark):
    rng = np.random.default_rng(4)
    x = [(i, [float(c) for c in rng.integers(-(2**20), 2**20, 4)]) for i in range(200)] + [(200, [2.0**22, 1.0, -(2.0**22), 3.0]), (50, [5.0, 5.0, 5.0, 5.0]), (201, [0.1, 0.2, 0.3, 0.4])]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>").repartition(3)
    got = Counter(tuple(r) for r in topk.top_k(topk.integers(df), F.col("id") % 50 == 0, k=3, pivots=4, block=16).collect())
    rows = [(i, [math.floor(256 * c) for c in v]) for i, v in x]
    want = Counter()
    for a, (i, q) in enumerate(rows):
        if i % 50 == 0:
            best = heapq.nsmallest(3, ((-sum(m * n for m, n in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(rows) if b != a))
            want.update((i, rank, j, -s) for rank, (s, j) in enumerate(best, 1))
    assert got == want
    assert [int(s) for s in topk.products_of(np.array([[2**40, 1]]), np.array([2**40, 1]))] == [2**80 + 1]


def test_apexes_bound_distances_from_below():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12)) * 100
    anchors = topk.choose_pivots(x, 7)
    far = topk._distances(x, anchors)
    a = topk.Apexes(anchors).of(far)
    bound = np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=-1))
    true = topk._distances(x, x)
    assert (bound <= true + 1e-6 * (1 + true)).all()
    assert (bound + 1e-6 * (1 + true) >= np.abs(far[:, None] - far[None]).max(axis=-1)).all()


def test_pivot_bounds_save_products():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 6)) * 400
    v = np.floor(centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 6)) * 10).astype(np.int64)
    most = float((v * v).sum(axis=1).max())
    lifted = topk._lifted(v, most)
    anchors = topk.choose_pivots(lifted, 16)
    far, asked = topk._distances(lifted, anchors), topk._distances(topk._lifted(v[:10], None), anchors)
    ids = np.arange(2000)
    floor = np.full(10, np.iinfo(np.int64).min)
    found, products = topk.best_of(v[:10], ids[:10], asked, floor, v, ids, far, most, 5)
    assert products < 10 * 2000
    for q in range(10):
        best = heapq.nsmallest(5, ((-int(v[q] @ v[i]), i) for i in range(2000) if i != q))
        assert sorted((-s, i) for a, i, s in found if a == q) == sorted(best)

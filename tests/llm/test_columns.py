"""Media columns, quality rules and page texts."""

from __future__ import annotations

import hashlib
import html
import random
import re
import tarfile
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
from helpers import SF, words
from tessella.llm import _common, html_extract, media, quality
from tessella.llm._common import new_folder


def test_media_round_trip(spark, odd, none):
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        folder = new_folder(spark, "test-media")
        rows = media.media_index(df, folder).collect()
        texts = [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]
        want = []
        for doc, body in texts:
            p = body + bytes(-len(body) % 64) or bytes(64)
            want.append((str(doc), len(body), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
        fs, root = pafs.FileSystem.from_uri(folder)
        for r in rows[:20]:
            with fs.open_input_file(f"{root}/{r.shard}") as f:
                image = f.read_at(r.length, r.offset)
            assert hashlib.sha256(image).hexdigest() == r.digest == r.media_sha256 and len(image) == r.media_bytes
            assert media.read_header(image[: media.HEADER]) == (r.width, r.height, r.bit_depth)
        with fs.open_input_file(f"{root}/{rows[0].shard}") as f:
            names = tarfile.open(fileobj=f).getnames()
        assert len(names) == len(set(names)) and f"{rows[0].digest}.png" in names
        equal: dict = {}
        for r in rows:
            assert equal.setdefault(r.payload_sha256, (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)
        with_id = [r for r in rows if r.doc_id != 6]  # two rows share that id and text
        assert len({(r.digest, r.shard, r.offset) for r in with_id}) == len({r.digest for r in with_id})
    assert media.media_index(none).count() == 0


@pytest.mark.parametrize(("limit", "hot"), [(100_000, 1_000), (0, 1_000), (0, 2)])
def test_equal_payloads_are_stored_once_over_all_tasks(spark, monkeypatch, limit, hot):
    monkeypatch.setattr(media, "BROADCAST_COPIES", limit)
    monkeypatch.setattr(_common, "HOT_ROWS", hot)
    rows = [(i, "copy" if i % 3 else f"own {i}") for i in range(60)] + [(100, "a"), (101, "a\x00"), (None, "copy"), (None, "own 3")]
    folder = new_folder(spark, "test-media")
    got = media.media_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), folder).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(i), len(t)) for i, t in rows)
    fs, root = pafs.FileSystem.from_uri(folder)
    names = [m for f in fs.get_file_info(pafs.FileSelector(root)) for m in tarfile.open(fileobj=fs.open_input_file(f.path)).getnames()]
    assert len(names) == len(set(names)) == 22 and {n[:-4] for n in names} == {r.digest for r in got}
    assert len({(r.digest, r.shard, r.offset) for r in got}) == 22


def test_media_reads_again_the_same(spark):
    index = media.media_index(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"))
    assert index.collect() == index.collect()


def test_damaged_images_are_refused():
    image = media.encode_image(bytes(range(64)) * 3)
    assert media.decode_image(image) == bytes(range(64)) * 3
    for k in (3, 20, 50):
        with pytest.raises(Exception):
            media.decode_image(image[:k] + bytes([image[k] ^ 1]) + image[k + 1 :])


def statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    g = Counter(zip(w, w[1:], w[2:]))
    covered = np.zeros(n, bool)
    for i in range(n - 2):
        if g[tuple(w[i : i + 3])] > 1:
            covered[i : i + 3] = True
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), int(covered.sum())


def test_base_statistics(spark, odd, none):
    extra = spark.createDataFrame([(100, "a b c a b c x a b c", "en", "s", 1), (101, "a b a b a b a", "en", "s", 1), (102, "x\n\nx\n x\ny\n", "en", "s", 1), (103, "a\x1cb\x85c d e", "en", "s", 1), (104, "😀😀 𝒳", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (odd, extra, spark.read.parquet(f"{SF}/documents.parquet")):
        got = sorted(((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(df).collect()))
        want = []
        for r in df.select("doc_id", "text").collect():
            s = statistics(r.text)
            want.append((str(r.doc_id), *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
        assert got == sorted(want)
    assert quality.quality_rules(none).count() == 0


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randrange(60, 300)), "en", f"s{i % 3}", 1) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "###" for w in words(rng, 100).split()), "en", "s0", 1) for i in range(20)]
    rows += [(2000 + i, words(rng, 80), f"x{i}", None, 1) for i in range(5)]  # groups too small for an estimate
    kept = {r.doc_id for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).filter("kept").collect()}
    assert kept == {r[0] for r in rows if not 1000 <= r[0] < 2000}


def test_repeats_alone_reject(spark):
    """Within the base rules: many repeated words, or many repeated lines too short for a window of words."""
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(60, 300)), "en", "s", 1) for i in range(300)]
    for i in range(5):
        passage = words(rng, 22)
        rows.append((1000 + i, f"{passage} {words(rng, 56)} {passage}", "en", "s", 1))  # 44 of 100 words
        unique = [f"stones{k} {words(rng, 1)} cloud{k}" for k in range(20)]
        rows.append((2000 + i, "\n".join(f"{x}\nread more" for x in unique), "en", "s", 1))  # 19 of 40 lines
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(r.n_repeat_words == 0 and r.n_dup_lines == 19 for i, r in got.items() if i >= 2000)
    assert {i for i, r in got.items() if r.kept} == set(range(300))


def low(v, p):
    """The quantile of Spark's sketches while they are exact."""
    return np.sort(v, 0)[max(0, int(np.ceil(p * len(v))) - 1)]


def estimate(x):
    """Mean and covariance of one group by the module's rules, in numpy."""
    floor = np.diag(np.array(quality.FLOOR) ** 2)
    centre = low(x, 0.5)
    s = 1.4826 * low(np.abs(x - centre), 0.5)
    z = (x - centre) / np.maximum(s, quality.FLOOR)
    u = z / np.sqrt(np.maximum((z**2).sum(1, keepdims=True), 1e-12))
    found = []

    def step(mean, cov):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floor), x - mean)
        near = x[d <= low(d, quality.SHARE)]
        return near.mean(0), np.cov(near.T, bias=True).reshape(cov.shape)

    for corr in (np.eye(4), np.tanh(z).T @ np.tanh(z) / len(x) / quality.TANH_VAR, 4 * u.T @ u / len(x)):
        mean, cov = centre, np.outer(s, s) * corr
        for _ in range(quality.STEPS):
            mean, cov = step(mean, cov)
        found.append((np.linalg.slogdet(cov + floor)[1], mean, cov))
    _, mean, cov = min(found, key=lambda f: f[0])
    for _ in range(quality.STEPS):
        mean, cov = step(mean, cov)
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floor), x - mean)
    scale = max(1.0, low(d, 0.5) / quality.MEDIAN_CHI2)
    return len(x), mean, cov * scale + floor * (scale - 1)


def shrink(own, parent):
    n, mean, cov = own
    w, gap = n / (n + quality.PRIOR), mean - parent[1]
    return n, w * mean + (1 - w) * parent[1], w * cov + (1 - w) * parent[2] + w * (1 - w) * np.outer(gap, gap)


def test_verdicts_against_numpy(spark):
    """Distances and verdicts over groups of many sizes, 49 and 50 among them, and null names."""
    rng = random.Random(2)
    sizes = {("en", "a"): 150, ("en", "b"): 49, ("en", "c"): 50, ("de", "a"): 80, ("de", None): 3, (None, "a"): 1, ("x", "y"): 20}
    rows = []
    for (lang, source), n in sizes.items():
        for _ in range(n):
            extra = " #" * rng.randrange(3) + (f"\n{words(rng, 2)}" * 2 if rng.random() < 0.2 else "")
            rows.append((len(rows), words(rng, rng.randrange(60, 200)) + extra + " ### ***" * (30 if rng.random() < 0.04 else 0), lang, source, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    s = np.array([statistics(r[1]) for r in rows], float)
    x = np.stack([np.log(s[:, 1] / s[:, 0]), np.sqrt(s[:, 2] / s[:, 0]), np.sqrt(s[:, 3] / s[:, 0]), np.sqrt(s[:, 4] / s[:, 0])], 1)
    good = ~((s[:, 0] < 50) | (s[:, 4] * 2 > s[:, 0]))
    names = [(r[2], r[3]) for r in rows]
    at = lambda test: np.array([i for i, n in enumerate(names) if good[i] and test(n)])
    every = estimate(x[at(lambda n: True)])
    for own in sizes:
        here = at(lambda n: n == own)
        lang = shrink(estimate(x[at(lambda n: n[0] == own[0])]), every)
        _, mean, cov = shrink(estimate(x[here]), lang)
        y = x[here] - mean
        d = np.einsum("ij,jk,ik->i", y, np.linalg.inv(cov + np.diag(np.array(quality.FLOOR) ** 2)), y)
        assert np.allclose([got[i].squared_distance for i in here], d, rtol=0.02, atol=0.02)
        assert [got[i].kept for i in here] == (d <= quality.CUTOFF).tolist()
    assert not all(got[i].kept for i in at(lambda n: True))


def test_repeat_windows_are_compared_by_words(spark, monkeypatch):
    """With a hash that makes all windows collide, only equal words count."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    df = spark.createDataFrame([(1, "a b c a b c"), (2, "a b c d e f g")], "doc_id long, text string").selectExpr("*", "'l' as lang", "'s' as source")
    assert {r.doc_id: r.n_repeat_words for r in quality.text_statistics(df).collect()}[2] == 0


def page(body, head=""):
    return f'<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>'


CASES = [
    ("<nav><a>Menu</a></nav><article><h1>Head</h1><p>One <b>bo</b>ld &amp; x</p><p>Two<br>three</p></article><footer>Foot</footer>", "Head One bold & x Two three"),
    ("<article><p>a<p>b<ul><li>c<li>d</ul></article>", "a b c d"),
    ("<article><p>t</p><script>var s='</p><p>no</p>';</script><style>p{}</style><form><p>no</p></form><aside>no</aside><div class='ad-box ads'>no</div><section id=comments><p>no</p></section><p>u</p></article>", "t u"),
    ("<nav><article><p>open menu</p></article>", "open menu"),
    ("<div class=sidebar>no</div><div class='cookie-notice'>no</div><main><p>main text</p></main>", "main text"),
    ("<header>no</header><p>bare  text\n here</p><footer>no</footer>", "bare text here"),
    ("<article><header><h2>Title</h2><p>by line</p></header><p>x &lt;tag&gt; &#233;&nbsp;y</p></article>", "Title x <tag> é y"),
    ("<article><p>a<!-- no --> b</p><p>5 < 6 and 7 > 3</p></article>", "a b 5 < 6 and 7 > 3"),
    ("<article><p>kept</p><!-- never closed <p>no</p>", "kept"),
    ("<article class=teaser><p>short</p></article><article><p>much longer main article text</p></article>", "much longer main article text"),
    ("<article class='post share-on'><P>upper <BR/>case</P><div class=reader-comments><article class=comment><p>no such long comment here</p></article></div></article>", "upper case"),
    ("<div id=main><p title='a > b'>in main</p><div role=navigation>no</div><p class=notice>no</p></div><div>no</div>", "in main"),
    ("", ""),
]


def test_page_texts(spark):
    rows = [(i, f"https://h{i}.example/x", page(b)) for i, (b, _) in enumerate(CASES)]
    rows += [(100, None, None), (101, "odd url", ""), (102, "http://x.example", "<p>unclosed <b"), (103, "http://x.example", "<" * 2000), (104, "http://x.example", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as host", "'c' as rule", "'c' as text")
    for limit in (html_extract.BROADCAST_BYTES, 0):  # both ways to bring wrappers to pages
        got = {r.page_id: r for r in html_extract.extract_text(df, broadcast_bytes=limit).collect()}
        assert len(got) == len(rows)
        for i, (_, want) in enumerate(CASES):
            assert (got[i].text, got[i].n_chars) == (want, len(want)), CASES[i][0]
        assert got[100].text == got[101].text == "" and got[100].url is None
        assert got[104].text == "deep"
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_wrapper_of_a_host(spark):
    rng = random.Random(5)
    pages = []
    for i in range(30):
        paragraphs = "".join(f"<p>{words(rng, 12)}</p>" for _ in range(rng.randrange(1, 6)))
        promo = "<div class=box>Read our daily letter</div>"
        pages.append((i, f"http://one.example/{i}", page(f"<ul><li>m</ul><article><h1>{words(rng, 3)}</h1>{promo}{paragraphs}</article>{'<hr><em>x</em>' if i % 3 else ''}")))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    w = html_extract.infer_wrappers(df).collect()
    assert len(w) == 1 and w[0].pages == 30
    assert "<p>#</p>)+" in w[0].expression and "(<em>'</em>)?" in w[0].expression
    texts = [r.text for r in html_extract.extract_text(df).collect()]
    assert not any("daily letter" in t for t in texts) and all(len(t) > 20 for t in texts)


def by_hand(pages, wrapper=True):
    """Texts of one host's pages by the operator's plain functions; without a wrapper each page only has its own."""
    total = None
    for p in pages:
        one = html_extract.page_wrapper(p)
        total = one if total is None else html_extract._merge(total, one)
    if not wrapper:
        return [by_hand([p])[0] for p in pages] if len(pages) > 1 else []
    rule = html_extract.read_rule(html_extract._flat(html_extract.rule_of(html_extract.unpack(html_extract.pack(total)))))
    return [html_extract.extract(p, rule) for p in pages]


def plain_host(rng, n):
    """Pages without article or telling names: site line, menu, heading, paragraphs, links, copyright line."""
    out = []
    for _ in range(n):
        head, text = words(rng, 4), [words(rng, 12) for _ in range(rng.randrange(3, 7))]
        body = f"<div class=k>Example site</div><div class=w><div class=v><a>{words(rng, 1)}</a> <a>{words(rng, 1)}</a></div><h1>{head}</h1><div class=c>" + "".join(f"<p>{t}</p>" for t in text)
        out.append((page(body + "</div><div class=z>© 2020 Example Ltd. All rights reserved.</div></div>"), " ".join([head, *text])))
    return out


@pytest.mark.parametrize("n", [2, 7, 30])
def test_the_wrapper_decides(n):
    made = plain_host(random.Random(n), n)
    got = by_hand([p for p, _ in made])
    assert got == [t for _, t in made]
    assert html_extract.extract(made[0][0], html_extract.Rule()) != made[0][1]  # without a wrapper the text is another
    scrambled = [re.sub(r"class=(\w+)", lambda m: f"class=x{m[1][::-1]}q", p) for p, _ in made]
    assert by_hand(scrambled) == got


@pytest.mark.parametrize("n", [2, 7, 30])
def test_template_blocks_at_any_number_of_pages(n):
    rng = random.Random(n)
    made = [page(f"<article><h1>{words(rng, 3)}</h1><div class=box>Read our daily letter</div><h2>Summary</h2>" + "".join(f"<p>{words(rng, 12)}</p>" for _ in range(rng.randrange(1, 6))) + "</article>") for _ in range(n)]
    for t in by_hand(made):
        assert "daily letter" not in t and "Summary" in t
    assert all("daily letter" in t for t in by_hand(made, wrapper=False))


def test_copies_are_no_template():
    one = page("<article><h1>Head</h1><p>a long paragraph of the only article here</p><ul><li>point</li></ul><blockquote>quoted</blockquote></article>")
    rng = random.Random(3)
    others = [page(f"<article><h1>{words(rng, 3)}</h1><p>{words(rng, 20)}</p></article>") for _ in range(4)]
    got = by_hand([one] * 8 + others)
    assert got[:8] == ["Head a long paragraph of the only article here point quoted"] * 8
    assert by_hand([one] * 3) == got[:3]


def test_nothing_of_the_article_is_lost():
    inside = '<section id="related-work"><p>work</p></section><div class="notice-of-motion"><p>motion</p></div><p class="search-result">result</p><p>x <math><mi>a</mi><mo>=</mo></math> y</p>'
    assert by_hand([page(f"<article>{inside}</article>")]) == ["work motion result x a= y"]
    assert by_hand([page(f"<div class='entry-content no-sidebar'>{inside}</div>")]) == ["work motion result x a= y"]
    deep = [page("<div>" * 450 + f"<article><p>article {i}</p></article>" + "</div>" * 450 + "<div>Site line</div>") for i in "abc"]
    assert by_hand(deep) == ["article a", "article b", "article c"]
    assert by_hand([page("<div>" * 20_000 + "deep")]) == ["deep"]


def test_wrappers_pack_and_stay_bounded(monkeypatch):
    rng = random.Random(2)
    total = None
    for p, _ in plain_host(rng, 5):
        one = html_extract.page_wrapper(p)
        total = one if total is None else html_extract._merge(total, one)
    assert html_extract.pack(html_extract.unpack(html_extract.pack(total))) == html_extract.pack(total)
    monkeypatch.setattr(html_extract, "NODES", 40)
    for i in range(30):
        odd = html_extract.page_wrapper(page(f"<div class=w><div class=u{'abcdefghij'[i % 10]}{'klm'[i // 10]}><i>x</i></div></div>"))
        total = html_extract._bounded(html_extract._merge(total, odd))
    every = [total]
    for x in every:
        every += x.children
    assert len(every) < 40


def test_documented_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract_text(df).collect()}
    for r in df.collect():
        a = re.sub(r"</?(p|h1|br)[^>]*>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"</?b>", "", a)).split())


def test_no_element_of_a_host_is_forgotten(spark):
    """A line that two pages share is template, however many elements of single pages stand between them."""
    name = lambda i: "".join("abcdefghijklmnopqrstuvwxyz"[i // 26**k % 26] for k in range(4))
    line = '<div class="promo">The same line in two pages</div>'
    odd = "".join(f'<div class="x{name(i)}">{name(i)}</div>' for i in range(html_extract.NODES + 1_000))
    bodies = [f"<p>first page's text of its own</p>{line}", f"<p>a page of many kinds</p>{odd}", f"<p>last page, another text again</p>{line}"]
    df = spark.createDataFrame([(i, "http://h.org/", page(f"<article>{b}</article>")) for i, b in enumerate(bodies)], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in html_extract.extract_text(df).collect()}
    assert (got[0], got[2]) == ("first page's text of its own", "last page, another text again")
    assert got[1].split()[5:] == [name(i) for i in range(html_extract.NODES + 1_000)]


def test_large_wrappers_merge_without_loss():
    """With any limit all kinds, characters and repeated texts of the pages are in the wrapper."""
    pages = [page(f"<div class=w><div class=u{'abcdefghij'[i % 10]}{'klm'[i // 10 % 3]}><i>x</i></div><p>own {i}</p></div>") for i in range(45)]
    for limit in (1, 25, 1_000):
        merger = html_extract.Merger(limit)
        for p in pages:
            one = html_extract.page_wrapper(p)
            if merger.add(one, html_extract._count(one)):
                merger.begin()
        every = [merger.whole()]
        for x in every:
            every += x.children
        odd = [x for x in every if x.kind.startswith("div u")]
        assert sorted({x.kind for x in odd}) == sorted({f"div u{a}{b}" for a in "abcdefghij" for b in "klm"})
        assert sum(x.slot[1] for x in every if x.kind == "i") == 45
        assert sum(x.slot[1] for x in every if x.kind == "p") == sum(len(f"own {i}") for i in range(45))

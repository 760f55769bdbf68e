"""WARC archives and main-text extraction."""

import gzip
import io
import itertools
import os
import random
import re
import time
import zlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from ratiospark.llm import html_extract, warc
from ratiospark.llm.html_extract import main_text

PAGES = [(1, "http://a/1", "<p>x</p>"), (3, "http://a/3\r\nX: y%0D", "<p>é\r\n\r\nWARC/1.1</p>"), (2, "http://a/2", "<p>é\r\n\r\nWARC/1.1</p>"), (4, None, None), (5, "u", ""), (6, "u", "z" * 3_000_000), (None, "n", "<p>x</p>"), (7, "u", "only"), (7, "u", "only"), (8, "u", "only")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"first": F.lit(1), "n": F.lit("x"), "sha": F.lit(0)})


@pytest.mark.parametrize("roll", [warc.ROLL_BYTES, 100])
def test_round_trip(pages, tmp_path, roll):
    manifest = warc.archive(pages, f"file://{tmp_path}/w", roll_bytes=roll)
    got = warc.read_archives(manifest).collect()
    least = {}
    for i, _, h in PAGES:
        least[h or ""] = min(x for x in (least.get(h or ""), i) if x is not None) if i is not None or least.get(h or "") is not None else None
    want = []
    for i, u, h in PAGES:
        data, first = (h or "").encode(), least[h or ""]
        again = i != first
        want.append((i, u, "revisit" if again else "response", first if again else None, warc.digest32(data), len(data), None if again else data))
    row = lambda r: str(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r))
    assert sorted(map(row, got)) == sorted(map(str, want))
    for m in manifest.collect():
        data = open(m.path.removeprefix("file://"), "rb").read()
        entries = [line.split() for line in open(m["index"].removeprefix("file://"))]
        assert len(entries) == m.records and sum(int(e[1]) for e in entries) == len(data)
        for offset, length, name in entries:
            member = gzip.decompress(data[int(offset) : int(offset) + int(length)])
            assert member.startswith(b"WARC/1.1\r\n") and name.encode() in member and member.endswith(b"\r\n\r\n")


def test_small_payloads_stay_responses(pages, tmp_path):
    got = warc.read_archives(warc.archive(pages, f"file://{tmp_path}/w", least_bytes=10)).collect()
    assert {r.page_id for r in got if r.record_type == "revisit"} == {3}


def test_empty_table(pages, tmp_path):
    assert warc.read_archives(warc.archive(pages.limit(0), f"file://{tmp_path}/w")).count() == 0


def test_splitting_in_any_portions():
    records = [warc.record(i, f"u{i}", random.Random(i).randbytes(i * 7)) for i in range(20)]
    whole = b"".join(records)
    for size in (1, 3, 50, 10_000):
        assert list(warc.split_records(whole[i : i + size] for i in range(0, len(whole), size))) == records
    with pytest.raises(ValueError):
        list(warc.split_records([whole[:-5]]))
    assert b"".join(warc.inflate(io.BytesIO(gzip.compress(whole[:999]) + gzip.compress(whole[999:])))) == whole


def test_damaged_payload_is_found():
    data = bytearray(warc.record(1, "u", b"abcdef"))
    data[-8] ^= 1
    with pytest.raises(ValueError):
        warc.parse(bytes(data))


def test_local_files_are_reached_by_uri(tmp_path):
    assert fs.FileSystem.from_uri(f"file://{tmp_path}")[1] == str(tmp_path)


LONG = "This is a long paragraph of the article, with several words and a full stop."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""),
    (f"<nav><a href=1>Home</a></nav><article><h1>T</h1><p>{LONG}</p><p>Hi.</p></article><footer>&copy; 2020</footer>", f"T\n{LONG}\nHi."),
    (f"<div class=content><p>A &amp;amp; b&nbsp;&#x41;<br>c \n d<p>{LONG}</div><div class='sidebar'><p>{LONG}</p></div>", f"A &amp; b A c d\n{LONG}"),
    (f"<header><p>{LONG}</p></header><main><p>{LONG}<script>var a='</p>'</script></p><form><p>{LONG}</p></form></main><aside>{LONG}</aside>", LONG),
    (f"<article><p>{LONG}</p><div class='ad'>Buy now.</div><section id='comments'><p>{LONG}</p></section></article>", LONG),
    (f"<div role=alert>{LONG}</div><div id=cookie-notice>{LONG}</div><p>{LONG}</p><!-- {LONG} --><style>p{{}}</style><div hidden>{LONG}</div>", LONG),
    (f"<p>{LONG}<p>one<b>two</b>", f"{LONG}\nonetwo"), ("<p>unclosed <b", "unclosed"),
])
def test_main_text(page, want):
    assert main_text(page) == want


def test_long_and_hostile_pages():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(5000))
    assert main_text(f"<article>{body}</article>").count("\n") == 4999
    for page in ("<div>" * 20_000 + "x", '<a "' * 20_000, "<p>" * 20_000, "&" * 50_000, "<!--" * 20_000):
        main_text(page)


def made_pages(n, seed=5):
    """Pages with a menu, adverts, a sidebar, an article and a footer of one vocabulary, and their articles' texts."""
    r, out = random.Random(seed), []
    line = lambda a, b: " ".join(f"w{r.randrange(300)}" for _ in range(r.randint(a, b)))
    for _ in range(n):
        body = [line(2, 6)] + [line(20, 60).capitalize() + "." if r.random() < 0.7 else line(1, 3) for _ in range(r.randint(3, 9))]
        parts = "".join(f"<p>{x}</p>" if i else f"<h1>{x}</h1>" for i, x in enumerate(body))
        cut = r.randint(0, 1)
        nav = "".join(f"<li><a href=x>{line(1, 2)}</a></li>" for _ in range(r.randint(3, 6)))
        aside = f"<aside><p>{line(15, 30)}.</p></aside>" if r.random() < 0.5 else ""
        inner = f"<div class='ad'>{line(10, 20)}.</div>" if cut else ""
        out.append((f"<html><head><title>{line(2, 4)}</title></head><body><nav><ul>{nav}</ul></nav><div class=ad>{line(8, 25)}.</div><article>{parts}{inner}</article>{aside}<footer>&copy; {line(3, 9)}</footer></body></html>", "\n".join(body)))
    return out


def test_fitted_extraction_of_held_out_pages(spark):
    shown, unseen = made_pages(150), made_pages(60, 6)
    model = html_extract.fit_blocks([p for p, _ in shown])
    assert all(main_text(p, model) == want for p, want in unseen)
    rows = [(i, "u", p) for i, (p, _) in enumerate(shown + unseen)]
    got = {x.page_id: x.text for x in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == want for i, (_, want) in enumerate(shown + unseen))
    assert html_extract.fit_blocks([LONG, None, "<p>x</p>"]) is None and html_extract.fit_blocks([]) is None


def other_pages(n, seed=8):
    """Pages of another make than the fitted ones: all parts are full of sentences, and what isn't the article stands in it or beside it."""
    r, out = random.Random(seed), []
    sentence = lambda: " ".join(f"v{r.randrange(500)}" for _ in range(r.randint(9, 30))).capitalize() + "."
    for _ in range(n):
        p = r.choice(["<p>{}</p>", "<div>{}</div>"])
        many = lambda a, b, p=p: "".join(p.format(sentence()) for _ in range(r.randint(a, b)))
        away = [
            f"<section id=comments><h2>{sentence()}</h2>{many(2, 9)}</section>", "".join(f"<div class=comment>{many(1, 2)}</div>" for _ in range(3)), f"<ol class=commentlist><li>{many(1, 2)}<li>{many(1, 2)}</ol>",
            f"<div class=advert>{many(1, 3)}</div>", f"<div class='newsletter-signup'>{many(1, 2)}<form>{sentence()}<input></form></div>", f"<aside>{many(1, 3)}</aside>", f"<div role=alert>{many(1, 1)}</div>",
            f"<div id=cookie-notice>{many(1, 2)}</div>", f"<form>{many(1, 2)}</form>", f"<div class='related-posts'><ul><li>{sentence()}<li>{sentence()}</ul></div>", f"<footer>{many(1, 3)}</footer>", f"<nav><ul><li><a href=x>{sentence()}</a></ul></nav>",
        ]
        body = [sentence() for _ in range(r.randint(3, 12))]
        inner, want = [], []
        for k, x in enumerate(body):
            inner.append(p.format(x) if k else f"<h1>{x}</h1>")
            want.append(x)
            if r.random() < 0.15:
                inner.append(r.choice(away))
        start, end = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class=post-content>", "</div>"), ("<div>", "</div>"), ("<article><div class='entry'>", "</div></article>")])
        beside = [r.choice(away) for _ in range(r.randint(1, 6))]
        k = r.randint(0, len(beside))
        out.append(("<body>" + "".join(beside[:k]) + start + "".join(inner) + end + "".join(beside[k:]) + "</body>", "\n".join(want)))
    return out


def test_pages_of_another_make():
    """Comments, adverts, asides, notices, forms, menus and footers full of sentences, inside or beside articles that are marked, named or plain."""
    pages = other_pages(300)
    shown = [page for page, _ in other_pages(60, 1) if "<article>" in page or "<main>" in page]
    for model in (html_extract.fit_blocks(shown), None):  # and with the fixed values
        assert not [page for page, want in pages if main_text(page, model) != want]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_a_model_of_the_table_serves_pages_of_another_make(spark):
    model = html_extract.fit_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert model is not None and not [page for page, want in other_pages(300) if main_text(page, model) != want]


def test_long_pages_get_the_same_labels(monkeypatch):
    """Ties too, on both sides of SMALL: an equal cut may be another one, but which blocks are content does not depend on the page's length."""
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(2, 12)
        s = [float(r.randint(-4, 4)) for _ in range(n)]
        links = [(i - 1, i, 2.0) for i in range(1, n)]
        found = []
        for small in (0, 300):
            monkeypatch.setattr(html_extract, "SMALL", small)
            found.append(html_extract.minimum_cut(s, links))
        assert found[0] == found[1], (s, found)


def test_the_cut_changes_labels_for_the_better():
    """Held-out pages whose markup says nothing: no names, and every block of one kind."""
    model = html_extract.fit_blocks([p for p, _ in made_pages(150)])
    n = changed = right = right_without = 0
    for page, want in made_pages(60, 6):
        found, made = html_extract.blocks(page)
        truth = [b.element.article and not b.element.marked for b in found]
        assert "\n".join(b.text for b, t in zip(found, truth, strict=True) if t) == want
        with_, without = (html_extract.labels(*html_extract.blocks(page), model, markup=False, cut=cut) for cut in (True, False))
        n += len(truth)
        changed += sum(a != b for a, b in zip(with_, without, strict=True))
        right += sum(a == b for a, b in zip(with_, truth, strict=True))
        right_without += sum(a == b for a, b in zip(without, truth, strict=True))
    print(f"the cut changes {changed} of {n} blocks; right with it {right / n:.4f}, without {right_without / n:.4f}")
    assert changed > 0.01 * n and right > right_without


def test_labels_come_through_maximum_flow(monkeypatch):
    calls, flow = [], html_extract._max_flow
    monkeypatch.setattr(html_extract, "_max_flow", lambda *a: calls.append(1) or flow(*a))
    model = html_extract.fit_blocks([p for p, _ in made_pages(150)])
    for page, _ in made_pages(60, 6):
        html_extract.labels(*html_extract.blocks(page), model, markup=False)
    assert calls


@pytest.mark.parametrize("page", ["<b>x</i>" * 100_000, "<b>" * 50_000 + "<h1></h1>" * 50_000, "<i><b>" * 50_000 + "</i>" * 50_000])
def test_mismatched_tags_take_linear_time(page):
    start = time.process_time()
    html_extract.blocks(page)
    assert time.process_time() - start < 3


@pytest.mark.parametrize("inner, want", [
    ("<svg/><p>More.</p>", "More."), ("<p>a <math><mi>x</mi></math> b</p>", "a x b"), ("<p>one</p><object>two", "one\ntwo"), ("<noscript><p>text</p></noscript>", "text"),
    ("<p>one</p><select><option>two</select><p>three</p>", "one\nthree"), ("<p>one <select><option>two</select> three</p>", "one\nthree"), ("<p>one</p><script>two", "one"),
])
def test_embedded_elements(inner, want):
    assert main_text(f"<article><p>{LONG}</p>{inner}</article>") == f"{LONG}\n{want}"


@pytest.mark.parametrize("url", ["http://a/x%20y", "http://a/%0D%25", "http://a/x\ny%20", " http://a/é ", ""])
def test_urls_are_archived_as_they_are(url):
    data = warc.record(1, url, b"x")
    assert warc.parse(data)["url"] == url
    if "\n" not in url:
        assert f"WARC-Target-URI: {url}\r\n".encode() in data


def test_truncated_archives_are_found(spark, tmp_path):
    rows = [(i, f"u{i}", random.Random(i).randbytes(300).hex()) for i in range(200)]
    pages = warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    manifest = warc.write_monolithic(pages, f"file://{tmp_path}/m")
    path = manifest.first().path.removeprefix("file://")
    whole = open(path, "rb").read()
    plain = zlib.decompressobj(31).decompress(whole)
    at = [m.start() for m in re.finditer(rb"WARC/1\.1\r\n", plain)][100]
    for damaged in (whole[:-8], whole[:-1], whole[: len(whole) // 2], gzip.compress(plain[:at])):
        open(path, "wb").write(damaged)
        with pytest.raises(Exception, match="cut off|holds 100 records|ends within"):
            warc.normalise(manifest, f"file://{tmp_path}/n")


@pytest.mark.parametrize("small", [0, 300])
def test_minimum_cut(small, monkeypatch):
    monkeypatch.setattr(html_extract, "SMALL", small)
    r = random.Random(3)
    for _ in range(400):
        n = r.randint(1, 8)
        s = [r.choice([-1, 1]) * r.random() * 3 for _ in range(n)]
        links = [(i, j, r.random() * 2) for i in range(n) for j in range(i) if r.random() < 0.5]

        def cost(x, s=s, links=links):
            return sum(abs(v) for v, c in zip(s, x, strict=True) if c != (v > 0)) + sum(w for i, j, w in links if x[i] != x[j])

        assert cost(html_extract.minimum_cut(s, links)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_extract_pages(pages):
    got = html_extract.extract_pages(pages).collect()
    assert len(got) == len(PAGES) and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0

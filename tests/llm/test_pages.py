"""op4 and op9: page text and archives."""
import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimwise.llm import html_extract as hx
from claimwise.llm import warc
from claimwise.llm.common import scratch_path

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<!-- <p>gone</p> --><div class="ad">Buy now, it is cheap.</div><article><h1>Heading of it</h1><p><b>First &amp; last&nbsp;of
 all.<br><p>Second <a href=x>linked</a> paragraph, with words.</article><div class="comments"><p>I was here first, said a reader.</p></div>
<aside><p>Related things to read next time.</p></aside><form><label>Mail</label><button>Send</button></form><footer>&copy; 2020 us</footer>"""


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_html", F.lit("clash")).repartition(3)
    return make


def test_main_text(pages):
    df = pages([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>open <b>never closed"), (1, "u", PAGE), (None, "u", PAGE)])
    got = hx.extract(df, hx.train(df)).collect()
    text = "Heading of it\nFirst & last of all.\nSecond linked paragraph, with words."
    assert sorted((r["page_id"] or 0, r["text"]) for r in got if r["page_id"] not in (2, 3, 4)) == [(0, text), (1, text), (1, text)]
    assert [(r["text"], r["n_chars"]) for r in got if r["page_id"] in (2, 3)] == [("", 0)] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_empty_table(pages):
    df = pages([])
    assert hx.extract(df, hx.train(df)).collect() == []


def test_held_out_layouts():
    texts = [f"Some words number {i} that make up a sentence, of a size." for i in range(50)]
    rng = random.Random(99)
    pages = []
    for _ in range(700):
        page, label = hx.compose(rng, texts)
        found = hx.blocks(page)
        if len(found) == len(label):
            pages.append((hx.features(found), label))
    assert len(pages) > 500
    field = hx.fit(pages[:400])
    right = total = 0
    for named, label in pages[400:]:
        right += sum(a == b for a, b in zip(field.decode(named), label))
        total += len(label)
    assert right / total > 0.95


def test_viterbi_finds_the_best_labels():
    import itertools

    import numpy as np
    rng = np.random.default_rng(3)
    field = hx.Field({"a": 0, "b": 1, "c": 2}, rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    named = [["a"], ["b", "c"], ["c"], ["a", "b"], ["unknown"]]
    s = [field.weights[[field.index[f] for f in x if f in field.index]].sum(axis=0) for x in named]
    best = max(itertools.product((0, 1), repeat=5), key=lambda y: sum(s[i][y[i]] for i in range(5)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
    assert tuple(field.decode(named)) == best


def test_blocks_decode_references_once_and_skip_raw_text():
    assert [b[2] for b in hx.blocks("<p>a &lt;b&gt; &amp;amp;</p><script>if (a<b) '<p>no</p>'</script><li>x<li>y")] == ["a <b> &amp;", "x", "y"]


def archive_of(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        ids = [x for x in groups[h or ""] if x is not None]
        first = min(ids) if ids else None
        kind = "response" if first is None or i == first else "revisit"
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if kind == "response" else first))
    return sorted(out, key=repr)


ROWS = [(5, "http://x/a b", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "http://x/\r\nEvil: 1", None), (3, "u", ""), (None, "u", "<p>é</p>"), (None, "u", "alone"),
        (2, "again", "<p>é</p>"), (11, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" + "x" * 300_000)] + [(100 + i, f"http://h/{i}", f"page {i % 40}") for i in range(90)]


def test_archive_round_trip(pages):
    assert sorted((tuple(r) for r in warc.archive(pages(ROWS)).collect()), key=repr) == archive_of(ROWS)


def test_many_copies_by_shuffle_join(pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted((tuple(r) for r in warc.archive(pages(ROWS), file_bytes=2000).collect()), key=repr) == archive_of(ROWS)


def test_archive_of_nothing(pages):
    assert warc.archive(pages([])).collect() == []


def test_index_names_byte_ranges(spark, pages):
    folder = scratch_path(spark, "warc-test")
    index = warc.write(pages(ROWS), folder, file_bytes=3000)
    store, _ = warc._open(folder)
    for r in index.filter("url like 'http://h/%'").collect():
        with store.open_input_file(r["file"]) as f:
            headers, payload = warc.parse(gzip.decompress(f.read_at(r["length"], r["offset"])))
        assert headers["warc-target-uri"] == r["url"] and headers["warc-type"] == r["record_type"]
    some = warc.read(index.filter("page_id in ('100', '103', '188')"), folder, gap=0).collect()
    assert sorted(r["page_id"] for r in some) == ["100", "103", "188"]
    assert {r["page_id"]: r["payload"] for r in some if r["payload"] is not None} == {"100": b"page 0", "103": b"page 3"}


@pytest.fixture(scope="module")
def field():
    """Trained on the fixed page and pages composed of its texts."""
    return hx.fit(hx.labelled_pages([PAGE]))


@pytest.mark.parametrize("page,text", [
    ("<body><article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be the first of many numbers.</p></article></body>", "Let x=2 be the first of many numbers."),
    ("<body><article><p>A chart <object data='c.svg'>of the sales in 1999</object> follows here in the text.</p></article></body>", "A chart of the sales in 1999 follows here in the text."),
    ("<body><article><p>See <a href=\"x>the other page</a> for more of this long story.</p></article></body>", "See the other page for more of this long story."),
    ("<body><article><p>Words before and words after it.</p><script>var a = '<p>';</script><style>p {}</style><svg><text>drawn</text></svg></article></body>", "Words before and words after it."),
    ("<body><noscript>Please enable JavaScript to view the comments.</noscript><article><p>The story itself, which has a good number of words.</p></article></body>", "The story itself, which has a good number of words.")])
def test_what_is_text(field, page, text):
    assert hx.main_text(page, field) == text


def test_very_long_pages_and_their_ends(field):
    body = "".join(f"<p>Sentence number {i} of a very long article goes on here.</p>" for i in range(20_000))
    text = hx.main_text(f"<html><body><article>{body}</article></body></html>", field)
    assert text.count("\n") == 19_999 and text.endswith("Sentence number 19999 of a very long article goes on here.")


def test_sampled_pages_are_whole():
    late = "<body>" + "<nav><a href='/'>menu item</a></nav>" * 300 + "<article>" + "<p>Words of the article come late in this page.</p>" * 5 + "</article></body>"
    named, label = hx.labelled_pages([late], composed=0)[0]
    assert len(named) == len(label) == 305 and sum(label) == 5
    assert hx.labelled_pages(["<body><article>" + "<p>x</p>" * (hx.SAMPLE_BLOCKS + 1) + "</article></body>"], composed=0) == []

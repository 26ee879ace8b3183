"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between tags that start or end a block.
A block's features are the tags above it, the words of those tags' class, id and role
attributes, and its text (length, share of links, punctuation, place). The field
labels every block main or other, with weights for features and for label changes,
trained here on labelled pages and decoded by Viterbi. Main blocks are joined in page
order.

Labelled pages are of two kinds: a bounded sample (``SAMPLE_PAGES``, those with the
smallest hash of page_id) of the table's pages that hold an article or main element,
labelled by it; and pages composed of the sample's block texts in many layouts,
whose labels are known as they are composed. Sampled pages are taken whole; pages of more than
``SAMPLE_CHARS`` characters or ``SAMPLE_BLOCKS`` blocks are not sampled. Extraction itself runs
within each row, over whole pages.

Scripts, styles, templates, frames and drawings are not text. Formulas and the text within
objects are, and a noscript part is a block of its own, for the field to label.

Null and empty html give empty text. Markup that never closes is read to the end; an attribute
whose quote never closes ends with its tag. Repeated rows (also null ids) give a row each; other
columns than those kept are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import strings

SAMPLE_PAGES, COMPOSED_PAGES = 200, 400
SAMPLE_CHARS, SAMPLE_BLOCKS = 500_000, 2_000
STEPS, RATE, L2 = 120, 0.15, 1e-3

# Element names of the HTML standard.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td
    textarea tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template svg iframe".split())
#: A start tag of the key closes open elements of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^<>]*)>", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[A-Za-z]+")


def blocks(page: str | None) -> list[tuple[tuple[str, ...], tuple[str, ...], str, int]]:
    """(tags above, attribute words above, text, characters within links) per leaf block, in order."""
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out, run, linked, at = [], [], 0, 0

    def end_block():
        nonlocal run, linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append((tuple(t for t, _ in stack), tuple(w for _, ws in stack for w in ws), text, linked))
        run, linked = [], 0

    def close(upto: int):
        del stack[upto:]

    while True:
        m = _TAG.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            run.append(text)
            if any(t == "a" for t, _ in stack):
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        end, name, inner = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if end:
            if name in BLOCK:
                end_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(t in BLOCK for t, _ in stack[i + 1:]):
                        end_block()
                    close(i)
                    break
                if stack[i][0] in ("article", "body", "table", "td") and name not in BLOCK:
                    break
            continue
        if name in RAW:
            if not inner.endswith("/"):
                tail = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = tail.end() if tail else len(page)
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in BLOCK:
            end_block()
            shut = CLOSES.get(name, {"p"})
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    close(i)
                    break
                if stack[i][0] in BLOCK and stack[i][0] not in ("td", "th", "li", "p"):
                    break
        if name not in VOID and not inner.endswith("/"):
            words = tuple(w.lower() for x in _ATTR.findall(inner) for v in x for w in _TOKEN.findall(v)) if "=" in inner else ()
            stack.append((name, words))
    end_block()
    return out


def features(found: list) -> list[list[str]]:
    """Names of each block's features."""
    out, n, before = [], len(found), ()
    for i, (tags, words, text, linked) in enumerate(found):
        size, last = len(text.split()), text[-1]
        f = ["bias", f"size{min(6, size.bit_length())}", f"link{min(3, int(4 * linked / max(1, len(text))))}",
             "ends" + ("." if last in ".!?…\"”»" else "x"), f"own:{tags[-1] if tags else ''}", "same" if tags == before else "moved"]
        f += [f"tag:{t}" for t in set(tags)]
        f += [f"word:{w}" for w in set(words)]
        if "©" in text[:40]:
            f.append("copyright")
        if i < 2 or i >= n - 2:
            f.append("edge")
        before = tags
        out.append(f)
    return out


class Field:
    """Two labels: 0 other, 1 main."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def decode(self, named: list[list[str]]) -> list[int]:
        if not named:
            return []
        get = self.index.get
        scores = np.array([self.weights[[j for j in map(get, f) if j is not None]].sum(axis=0) for f in named])
        best, back = scores[0], []
        for s in scores[1:]:
            through = best[:, None] + self.moves
            step = through.argmax(axis=0)
            back.append(step)
            best = through[step, (0, 1)] + s
        label = int(best.argmax())
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]]) -> Field:
    """Maximum likelihood with an L2 penalty by Adam; forward and backward sums run over all pages at once."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for named, _ in pages for block in named for f in block})
    index = {f: i for i, f in enumerate(names)}
    lens = np.array([len(y) for _, y in pages] or [0])
    longest, n = int(lens.max()), len(pages)
    y = np.zeros((n, longest), np.int64)
    place, name = [], []           # of every feature that is there: its block, and which it is
    for i, (named, label) in enumerate(pages):
        y[i, :len(label)] = label
        for t, block in enumerate(named):
            name += [index[f] for f in block]
            place += [i * longest + t] * len(block)
    place, name = np.array(place, np.int64), np.array(name, np.int64)
    live = np.arange(longest)[None, :] < lens[:, None]
    w, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, moves)]
    for step in range(1, STEPS + 1 if n else 1):
        s = np.stack([np.bincount(place, w[name, k], n * longest) for k in (0, 1)], axis=1).reshape(n, longest, 2)
        ahead, behind = np.zeros_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(live[:, t, None], np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + s[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = np.logaddexp.reduce(moves[None] + (s[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(live[:, t + 1, None], nxt, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead + behind - total[:, None, None]) * live[..., None]
        hit = np.eye(2)[y] * live[..., None]
        missed = (hit - p).reshape(n * longest, 2)
        grad_w = np.stack([np.bincount(name, missed[place, k], len(names)) for k in (0, 1)], axis=1) / n - L2 * w
        grad_m = np.zeros((2, 2))
        for t in range(1, longest):
            pair = np.exp(ahead[:, t - 1, :, None] + moves + (s[:, t] + behind[:, t])[:, None, :] - total[:, None, None])
            grad_m += ((hit[:, t - 1, :, None] * hit[:, t, None, :] - pair) * live[:, t, None, None]).sum(axis=0)
        for param, grad, (m1, m2) in zip((w, moves), (grad_w, grad_m / n - L2 * moves), state):
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            param += RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    return Field(index, w, moves)


# Class words that page authors give to parts that are not the article, and to the article.
OTHER_WORDS = """ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header login
    masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup popular privacy promo recommended related reply replies
    respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget""".split()
MAIN_WORDS = "article body content entry main page post single story text wrapper container".split()
OTHER_TAGS = ("nav", "header", "footer", "aside", "form", "button", "select", "option", "textarea", "label", "dialog", "menu", "noscript")


def label_by_elements(found: list) -> list[int]:
    """Labels from a page's own elements: within article or main, and in no part of another kind there."""
    out = []
    for tags, words, _, _ in found:
        inside = [i for i, t in enumerate(tags) if t in ("article", "main")]
        after = tags[inside[0]:] if inside else ()
        out.append(int(bool(inside) and not any(t in OTHER_TAGS for t in after) and not set(words) & (set(OTHER_WORDS) - {"header"})))
    return out


def compose(rng: random.Random, texts: list[str]) -> tuple[str, list[int]]:
    """A page in a random layout, and the labels of its blocks."""
    labels: list[int] = []

    def text(main: bool, short: bool = False) -> str:
        words = rng.choice(texts).split() or ["text"]
        size = rng.randint(1, 6) if short or (not main and rng.random() < 0.6) else rng.randint(8, 80)
        return html.escape(" ".join(words[:size]))

    def block(tag: str, main: bool, short: bool = False) -> str:
        labels.append(int(main))
        body = text(main, short)
        if not main and rng.random() < 0.4:
            body = f'<a href="/x">{body}</a>'
        elif main and rng.random() < 0.2:
            body = f"{body} <a href='/y'>more</a> <em>{body[:9]}</em>"
        return f"<{tag}>{body}</{tag}>" if rng.random() < 0.9 or tag not in ("p", "li") else f"<{tag}>{body}"

    def other() -> str:
        kind = rng.random()
        named = f'{rng.choice(("class", "id"))}="{rng.choice(OTHER_WORDS)}{rng.choice(("", "-box", " x1", "_area"))}"'
        if kind < 0.15:
            return "<nav><ul>" + "".join(block("li", False, True) for _ in range(rng.randint(2, 7))) + "</ul></nav>"
        if kind < 0.3:
            tag = rng.choice(("header", "footer", "aside"))
            return f"<{tag}>" + "".join(block(rng.choice(("p", "div", "h2", "h3")), False) for _ in range(rng.randint(1, 3))) + f"</{tag}>"
        if kind < 0.4:
            return "<form>" + block("label", False, True) + "<input name=q>" + block("button", False, True) + "</form>" if rng.random() < 0.5 else f"<form {named}>" + block("p", False) + block("button", False, True) + "</form>"
        if kind < 0.44:
            return block("noscript", False)
        tag = rng.choice(("div", "section", "ul"))
        inner = "li" if tag == "ul" else rng.choice(("p", "div", "h3"))
        return f"<{tag} {named}>" + "".join(block(inner, False) for _ in range(rng.randint(1, 5))) + f"</{tag}>"

    def main_part() -> str:
        tag = rng.choice(("article", "article", "main", "div", "section"))
        named = "" if tag in ("article", "main") and rng.random() < 0.7 else f' {rng.choice(("class", "id"))}="{rng.choice(MAIN_WORDS)}"'
        parts = [block(rng.choice(("h1", "h1", "h2")), True, rng.random() < 0.5)] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.1:
                parts.append("<ul>" + "".join(block("li", True) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.16:
                parts.append("<table><tr>" + "".join(block("td", True, True) for _ in range(rng.randint(1, 4))) + "</tr></table>")
            elif kind < 0.26:
                parts.append(block(rng.choice(("h2", "h3", "blockquote", "pre", "figcaption")), True, rng.random() < 0.5))
            elif kind < 0.33:
                parts.append(other())
            else:
                parts.append(block("p", True))
        return f"<{tag}{named}>" + "".join(parts) + f"</{tag}>"

    labels.append(0)
    out = [f"<html><head><title>{text(False, True)}</title></head><body>"]
    out += [other() for _ in range(rng.randint(0, 4))]
    out.append(main_part())
    out += [other() for _ in range(rng.randint(0, 4))]
    return "".join(out) + "</body></html>", labels


def labelled_pages(sample: list[str], composed: int = COMPOSED_PAGES) -> list[tuple[list[list[str]], list[int]]]:
    out, texts = [], ["A page without any words of its own."]
    for page in sample:
        found = blocks(page)
        texts += [b[2] for b in found]
        label = label_by_elements(found)
        if any(label) and len(found) <= SAMPLE_BLOCKS:
            out.append((features(found), label))
    rng = random.Random(7)
    for _ in range(composed):
        page, label = compose(rng, texts)
        found = blocks(page)
        if len(found) == len(label):
            out.append((features(found), label))
    return out


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Field:
    rows = pages.filter(F.length(strings(pages, html_col)) <= SAMPLE_CHARS).select(F.md5(F.col(id_col).cast("string")).alias("h"), F.xxhash64(html_col).alias("x"), strings(pages, html_col).alias("html"))
    chosen = rows.select("h", "x").distinct().orderBy("h", "x").limit(sample)
    found = rows.join(F.broadcast(chosen), ["h", "x"], "left_semi").distinct().orderBy("h", "x").collect()   # bounded by sample
    return fit(labelled_pages([r["html"] for r in found]))


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page)
    return "\n".join(b[2] for b, y in zip(found, field.decode(features(found))) if y)


def extract(pages: DataFrame, field: Field, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), out_col: str = "text") -> DataFrame:
    """The ``keep`` columns with the main text and its number of code points."""
    source = pages.select(*keep, strings(pages, html_col).alias("_html"))

    def run(batches):
        for batch in batches:
            text = [main_text(x.as_py(), field) for x in batch.column("_html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
                                             names=[*keep, out_col, "n_chars"])

    return source.mapInArrow(run, T.StructType([*(source.schema[k] for k in keep), T.StructField(out_col, T.StringType()), T.StructField("n_chars", T.LongType())]))

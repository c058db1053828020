"""Main text of HTML pages by line-block distribution.

Markup is stripped so that every block of the page becomes one line. Lines of boilerplate (navigation, adverts, forms,
comments, link lists ...) keep their place but count no text. Text lengths are summed over windows of lines; where the
sum leaves zero the text surges, where it falls back to zero it dives, and lines between the two are kept.

Defined cases: null or blank html gives the empty text; a page without any tag is one block; unclosed elements end with
the page; repeated rows give repeated results; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import ship_by_value, table

ship_by_value(__name__)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
RAW = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
# Elements that start a new block.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul caption".split())
# Elements whose whole content is no main text.
SKIP = frozenset("script style head title nav footer header aside form noscript template iframe svg button select textarea menu object canvas audio video dialog xmp noembed noframes".split())
# Words in class, id or role of a container that mark boilerplate.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus footer form gdpr header legal masthead menu menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related respond share sharing sidebar signup skip sponsor sponsored subscribe toolbar topbar widget".split())
CONTAINER = frozenset("article div section ul ol table dl p span center details figure li".split())
SOCIAL = frozenset("media links link share sharing icons icon buttons bar list menu follow feed".split())  # words that make "social" boilerplate
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))


def is_marked(attrs: str) -> bool:
    for name, value in ATTR.findall(attrs):
        for word in value.strip("\"'").lower().split():
            parts = re.split(r"[_-]+", word)
            if MARKS.intersection(parts) or parts[0] == "social" and (len(parts) == 1 or SOCIAL.intersection(parts[1:])):
                return True
    return False


def strip_markup(html: str) -> tuple[list[str], list[bool], list[bool], list[bool]]:
    """Lines of the page, and for each whether it is boilerplate, mostly links, and inside an article."""
    lines, boiler, linky, inside = [], [], [], []
    parts: list[str] = []
    links, anchors = 0, 0
    stack: list[tuple[str, bool, bool]] = []  # open containers, with whether they opened a skipped region
    skips, mains, at, n = 0, 0, 0, len(html)

    def end_line() -> None:
        nonlocal parts, links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            lines.append(text)
            boiler.append(skips > 0)
            linky.append(2 * links > sum(map(len, parts)))
            inside.append(mains > 0)
        parts, links = [], 0

    while at < n:
        m = TOKEN.search(html, at)
        data = html[at : m.start()] if m else html[at:]
        if data:
            parts.append(data)
            if anchors:
                links += len(data)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag, closing = m[2].lower(), m[1]
        if tag == "br":
            parts.append(" ")
        if tag == "a":
            anchors = max(0, anchors - 1) if closing else anchors + 1
        opens_region = tag in SKIP and not (tag == "header" and mains)
        tracked = opens_region or tag in MAIN or tag in CONTAINER
        if tag in BLOCK or opens_region or tag == "td":
            end_line()
        if closing:
            if tracked and any(t == tag for t, _, _ in stack):
                while stack:
                    t, skip, main = stack.pop()
                    if skip or main:
                        end_line()
                    skips -= skip
                    mains -= main
                    if t == tag:
                        break
            continue
        if tag in VOID or m[3].endswith("/") and tag in ("path", "circle", "rect", "use"):
            continue
        if tag in RAW:  # its content holds no tags
            close = RAW[tag].search(html, at)
            at = close.end() if close else n
            continue
        if tag == "p" and stack and stack[-1][0] == "p":  # a paragraph ends the one before
            _, skip, main = stack.pop()
            skips -= skip
            mains -= main
        if tag == "li" and stack and stack[-1][0] == "li":
            _, skip, main = stack.pop()
            skips -= skip
            mains -= main
        if tracked:
            skip = opens_region or tag in CONTAINER and is_marked(m[3])
            if skip:
                end_line()
            stack.append((tag, skip, tag in MAIN))
            skips += skip
            mains += tag in MAIN
    end_line()
    return lines, boiler, linky, inside


def surges(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """Line ranges between a surge and a dive: the sum over ``window`` lines that start there leaves, or falls to, zero."""
    total = [0]
    for x in lengths:
        total.append(total[-1] + x)
    sums = [total[min(len(lengths), i + window)] - total[i] for i in range(len(lengths))]
    out, start = [], None
    for i, s in enumerate(sums):
        if start is None and s > 0 and lengths[i] > 0:
            start = i
        if start is not None and s == 0:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, len(lengths)))
    return out


def main_text(html: str | None, window: int = 3, min_peak: int = 40) -> str:
    """The blocks between surge and dive, joined by two line feeds.

    Inside an article every surge counts. A page without one has menus and notices that nothing names, so there link lists
    count no text and a surge must reach ``min_peak`` characters in some window, unless none does: then the largest stays.
    """
    if not html:
        return ""
    lines, boiler, linky, inside = strip_markup(html)
    named = any(i and not b for i, b in zip(inside, boiler, strict=True))
    if named:
        lengths = [len(x) if i and not b else 0 for x, i, b in zip(lines, inside, boiler, strict=True)]
    else:
        lengths = [0 if b or k else len(x) for x, b, k in zip(lines, boiler, linky, strict=True)]
        if not any(lengths):
            lengths = [0 if b else len(x) for x, b in zip(lines, boiler, strict=True)]
    found = surges(lengths, window)
    if not named and found:
        peak = [max(sum(lengths[k : k + window]) for k in range(i, j)) for i, j in found]
        least = min(min_peak, max(peak))
        found = [x for x, p in zip(found, peak, strict=True) if p >= least]
    return "\n\n".join(lines[k] for i, j in found for k in range(i, j) if lengths[k])


def extract(pages: DataFrame, html_col: str = "html", window: int = 3, min_peak: int = 40) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` instead of the html (columns of those names give way). No shuffle."""
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, window, min_peak) for h in batch.column(html_col).to_pylist()]
            cols = [batch.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html_col).mapInArrow(run, f"{fields}, text string, n_chars long" if keep else "text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))

"""The main text of a web page as the best-scoring contiguous region of its tokens.

Words score by where they stand, tags cost; the weights are counted on labelled pages.
One linear scan finds the contiguous region with the largest sum. What is no content
inside the region (forms, adverts, comments, ...) is left out of the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.keys import original, present

# Pages read to count the weights; a bound on the sample of labelled pages.
LABELLED_PAGES = 2_000

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section"
    " summary table tbody td tfoot th thead tr ul".split()
)
NOT_CONTENT = frozenset(
    "script style title head noscript template svg math canvas object iframe audio video map nav header footer aside"
    " menu form button select option textarea input label fieldset dialog".split()
)
LABELS = frozenset(["article", "main"])
# Words of class, id or role that mark what is no content.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side-?bar|widget|menu|nav\w*|breadcrumbs?|"
    r"foot(?:er)?|masthead|site-?header|page-?header|comments?|replies|disqus|respond|cookies?|consent|gdpr|notice|notification|alert|"
    r"popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|"
    r"complementary|contentinfo|navigation|search|hidden)(?=$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.S,
)
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
# Elements whose start ends an open element of these names.
_CLOSES = {name: frozenset([name]) for name in ("li", "option", "p")} | {
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
}
# Where the weights of tags not seen on labelled pages come from.
TAG_COST = 4.0


def events(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """``(kind, name, dropped, text)``: kind is ``text``, ``open`` or ``close``.

    ``name`` is the element the text stands in, or the tag's own; ``dropped`` tells
    whether it lies in an element that is no content. Comments, scripts and the like give
    nothing. Unclosed elements end with the element around them or with the page.
    """
    stack: list[tuple[str, bool]] = []
    at, n = 0, len(page)

    def inside() -> bool:
        return bool(stack) and stack[-1][1]

    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            yield "text", stack[-1][0] if stack else "", inside(), page[at:stop]
        if not m:
            return
        at = m.end()
        if m["name"] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", stack[-1][0] if stack else "", inside(), m[0][9:].removesuffix("]]>")
            continue
        name = m["name"].lower()
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is None:
                yield "close", name, inside(), ""
                continue
            dropped = stack[depth][1]
            del stack[depth:]
            yield "close", name, dropped, ""
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = n
            continue
        if stack and stack[-1][0] in _CLOSES.get(name, ()):
            stack.pop()
        attrs = m["attrs"]
        dropped = inside() or name in NOT_CONTENT
        if not dropped and attrs and name not in ("html", "body", *LABELS):
            dropped = any(MARKS.search(a or b or c) for a, b, c in _MARKED.findall(attrs)) or bool(_HIDDEN.search(attrs))
        yield "open", name, dropped, ""
        if name not in VOID and not attrs.endswith("/"):
            stack.append((name, dropped))


def label_of(page: str) -> str | None:
    """``article`` if the page has exactly one, or else ``main``, or None."""
    found = Counter(m["name"].lower() for m in _TOKEN.finditer(page) if m["name"] and not m["end"])
    return next((x for x in ("article", "main") if found[x] == 1), None)


def label_counts(page: str) -> Counter:
    """Words and tags of a page by feature and whether they lie inside its one labelled element.

    A page without exactly one ``article`` (or else ``main``) element is no labelled page.
    """
    label = label_of(page)
    counts: Counter = Counter()
    if label is None:
        return counts
    depth = 0
    for kind, name, dropped, text in events(page):
        if name == label and kind == "close":
            depth = 0
        key = _feature(kind, name, dropped)
        counts[key, bool(depth)] += len(text.split()) if kind == "text" else 1
        if name == label and kind == "open":
            depth = 1
    return counts


def _feature(kind: str, name: str, dropped: bool) -> str:
    if kind == "text":
        return "words in what is no content" if dropped else f"words in {name if name in BLOCK else 'text'}"
    return f"tag {name if name in BLOCK or name in VOID else 'other'}" + (" dropped" if dropped else "")


def weights_of(pages: DataFrame, n_pages: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most ``n_pages`` labelled pages, chosen by a hash of ``page_id`` among all labelled ones.

    With p the smoothed share of a feature inside the labelled element, a word scores p
    and a tag -TAG_COST * (1 - p). The table has one row per element name.
    """
    @F.pandas_udf("boolean")
    def labelled(html: pd.Series) -> pd.Series:
        return pd.Series([label_of(page) is not None for page in html], dtype=bool)

    with_label = pages.where(F.col("html").isNotNull()).select("page_id", "html").where(labelled("html"))
    ids = with_label.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(n_pages)
    sample = pages.select("page_id", "html").join(F.broadcast(ids), "page_id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch["html"]:
                counts.update(label_counts(page))
        yield pd.DataFrame(
            [(f, inside, n) for (f, inside), n in counts.items()], columns=["feature", "inside", "n"]
        )

    counted = sample.select("html").mapInPandas(run, "feature string, inside boolean, n long")
    rows = counted.groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    weights = {}
    for feature in {r["feature"] for r in rows}:
        n_in = sum(r["n"] for r in rows if r["feature"] == feature and r["inside"])
        n_out = sum(r["n"] for r in rows if r["feature"] == feature and not r["inside"])
        share = (n_in + 0.5) / (n_in + n_out + 1)
        weights[feature] = share if feature.startswith("words") else -TAG_COST * (1 - share)
    return weights


def _weight(weights: dict[str, float], kind: str, name: str, dropped: bool) -> float:
    feature = _feature(kind, name, dropped)
    if feature in weights:
        return weights[feature]
    if kind == "text":
        return 0.02 if dropped else 0.5
    return -TAG_COST if dropped else -0.5


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best region: blocks joined by a line feed, white space made single."""
    if not page:
        return ""
    tokens = list(events(page))
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for i, (kind, name, dropped, text) in enumerate(tokens):
        if total <= 0:
            total, start = 0.0, i
        weight = _weight(weights, kind, name, dropped)
        total += weight * len(text.split()) if kind == "text" else weight
        if total > best:
            best, best_from, best_to = total, start, i + 1
    blocks, block = [], []

    def close() -> None:
        joined = " ".join(html.unescape("".join(block)).split())
        if joined:
            blocks.append(joined)
        block.clear()

    for kind, name, dropped, text in tokens[best_from:best_to]:
        if kind != "text":
            if name in BLOCK:
                close()
            elif name == "br":
                block.append(" ")
        elif not dropped:
            block.append(text)
    close()
    return "\n".join(blocks)


def extract_main_text(pages: DataFrame, n_labelled: int = LABELLED_PAGES) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``.

    A null or empty ``html``, and a page without content, gives the empty text; null keys
    and URLs stay; repeated rows give a row each; further columns are not read. Among
    regions of equal score the first and shortest wins. The scan is linear in the page and a narrow
    step; only the counts of features leave the tasks.
    """
    weights = weights_of(pages, n_labelled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch["html"]]
            out = batch[["page_id", "url"]].copy()
            out["text"], out["n_chars"] = texts, [len(t) for t in texts]
            yield out

    found = pages.select(present("page_id"), "url", "html").mapInPandas(
        run, "page_id long, url string, text string, n_chars long"
    )
    return found.withColumn("page_id", original("page_id"))

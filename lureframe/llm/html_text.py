"""Main text of HTML pages: parser events to lines, text-to-tag ratio, Gaussian smoothing, threshold clustering.

A line is a block of the page as the parser streams by. Its ratio is its text length against the tags met since
the line before. Smoothed ratios over a threshold form content regions. A region is grown to the container that
holds most of the content, so short paragraphs between long ones stay, and what a page marks as furniture
by its elements and roles (navigation, forms, asides) never becomes text; class and id are a weight.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureframe.llm.store import back_id, sent_id

SIGMA = 1.5
SCHEMA = "page_id long, url string, text string, n_chars long"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content of these is never text of a page; the first ones may stand inside a line and don't end it.
INLINE = frozenset("script style noscript template svg math iframe object canvas audio video select option textarea button".split())
HIDDEN = INLINE | frozenset("head title nav header footer aside menu dialog".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that a new block of the same kind closes when their end tag was left out.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names of furniture. A token of a class, or a whole id, is one if each of its words is here or in BESIDE and one is here.
FURNITURE = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising nav navbar navigation topnav subnav footnav header masthead footer share sharing social related recommended recommendation recommendations"
    " comment comments reply replies respond disqus login signup search pager pagination skip copyright legal notice notices gdpr cookie cookies consent disclaimer sidebar sponsor sponsors sponsored"
    " newsletter subscribe subscription breadcrumb breadcrumbs menu banner banners promo promos promotion promotions popup modal widget widgets toolbar".split()
)
BESIDE = frozenset(
    "site page global top bottom left right primary secondary main sub mobile sticky box bar list item items link links wrap wrapper container inner outer area block section content row col column panel slot unit card"
    " group buttons button icons icon form input policy message overlay dialog media network posts post articles article stories thread count to text info google body div author meta".split()
)
OPENS = frozenset("page post posts article articles story stories section content text card item body".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Containers that are articles whatever their class says.
WHOLE = frozenset(("html", "body", "article", "main"))
#: Blocks of text, too small for a content region.
LEAF = frozenset("p li td th tr dd dt pre blockquote h1 h2 h3 h4 h5 h6".split())
#: What the text of a container named as furniture counts in the vote.
NAMED = 0.1


def furniture_name(name: str, number: bool = True) -> bool:
    """Whether a token names furniture: cookie-notice and sidebarLeft do, has-sidebar and social-effects don't."""
    words = [w for w in re.split(r"[-_]+", CAMEL.sub("-", name).lower()) if w]
    if "header" in words and (not OPENS.isdisjoint(words) or words[-1].isdigit()):
        return False  # the head of an article, with its title
    if number and words and words[-1].isdigit():
        words.pop()
    return any(w in FURNITURE for w in words) and all(w in FURNITURE or w in BESIDE for w in words)


class Lines(HTMLParser):
    """Collects (text, tags since the last line, container), and the containers that a class or id names as furniture."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, container number, furniture
        self.parent = [0]
        self.kinds = [""]
        self.named: set[int] = set()
        self.lines: list[tuple[str, int, int]] = []
        self.buffer: list[str] = []
        self.tags = 0
        self.open: Counter[str] = Counter()

    def cut(self, at: int) -> None:
        """Close the open elements from `at` on."""
        self.open.subtract(tag for tag, _, _ in self.stack[at:])
        del self.stack[at:]

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer = []
            if text:
                self.lines.append((text, self.tags, self.stack[-1][1]))
                self.tags = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
        if (tag in BLOCK or tag in HIDDEN) and tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        if tag == "body":  # also ends a head without an end tag
            self.cut(1)
        if tag in BLOCK:
            self.close_open("p")
        for open_tag in IMPLIED.get(tag, ()):
            self.close_open(open_tag, within=tag)
        _, container, furniture = self.stack[-1]
        plain = {k: v for k, v in attrs}
        if not furniture and tag not in WHOLE:
            furniture = tag in HIDDEN and not (tag == "header" and (self.open["article"] or self.open["main"])) or (plain.get("role") or "").lower() in ROLES or "hidden" in plain
        # A form is furniture as a name makes it: a small one is, one around the text of the page isn't.
        named = not furniture and (tag == "form" or self.names_furniture(tag, plain))
        if named and tag not in BLOCK:
            self.flush()  # an inline element of its own
        if tag in BLOCK or named or tag == "header" and not furniture:
            self.parent.append(container)
            self.kinds.append(tag)
            container = len(self.parent) - 1
            if named:
                self.named.add(container)
        self.stack.append((tag, container, furniture))
        self.open[tag] += 1

    def names_furniture(self, tag: str, attrs: dict) -> bool:
        """Paragraphs and headings, and what stands inside them, are text whatever their names. Ids of sections inside
        an article are slugs of their titles."""
        if tag in ("html", "body", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6"):
            return False
        if tag not in BLOCK and self.kinds[self.stack[-1][1]] in LEAF:
            return False
        if any(furniture_name(token) for token in (attrs.get("class") or "").split()):
            return True
        inside = tag == "section" and (self.open["article"] or self.open["main"])
        return bool(attrs.get("id")) and not inside and furniture_name(attrs["id"].strip(), number=tag != "section")

    def close_open(self, tag: str, within: str = "") -> None:
        """End the innermost open `tag` unless a container stands between."""
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name == tag:
                self.flush()
                self.cut(i)
                return
            if name in BLOCK and name != "p" or name in HIDDEN:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if (tag in BLOCK or tag in HIDDEN) and tag not in INLINE:
            self.flush()
        if tag in VOID or not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if self.stack[i][1] in self.named:
                    self.flush()
                self.cut(i)
                return
            if self.stack[i][0] in ("article", "body", "main", "nav", "aside", "footer", "header", "form", "table") and tag not in ("html", "body", "article", "main", "nav", "aside", "footer", "header", "form", "table", "div", "section"):
                return  # an end tag without its start doesn't leave the container

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.buffer.append(data)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def two_means(values: np.ndarray) -> float:
    """The value midway between the means of two clusters; the smallest one where all are equal."""
    cut = values.mean()
    for _ in range(20):
        high = values >= cut
        if high.all() or not high.any():
            return float(values.min())
        moved = (values[high].mean() + values[~high].mean()) / 2
        if moved == cut:
            break
        cut = moved
    return float(cut)


def furniture_lines(page: Lines, length: np.ndarray, paths: list[list[int]]) -> np.ndarray:
    """Which lines stand in a container that its name and its place both tell to be furniture.

    A name doesn't count on a container with an article in it, unless an article outside it holds more text; nor on one
    with most of the text, unless an article outside holds a quarter of all or the container is only a line or two.
    """
    first: dict[int, int] = {}
    last: dict[int, int] = {}  # lines of a container follow each other
    for i, path in enumerate(paths):
        for c in path:
            first.setdefault(c, i)
            last[c] = i + 1
    articles = {c for c in first if page.kinds[c] in ("article", "main") and c not in page.named}
    holders: set[int] = set()  # containers with an article in them
    free = np.zeros(len(length), bool)  # lines of an article in no named container
    for i, path in enumerate(paths):
        at = [n for n, c in enumerate(path) if c in articles]
        if at:
            holders.update(path[at[0] + 1 :])
            free[i] = page.named.isdisjoint(path[at[-1] :])
    total, upto, freed = length.sum(), np.append(0, length.cumsum()), np.append(0, (length * free).cumsum())
    marked = np.zeros(len(length), bool)
    for c in page.named & first.keys():
        lines = slice(first[c], last[c])
        inside = upto[last[c]] - upto[first[c]]
        outside = freed[-1] - freed[last[c]] + freed[first[c]]
        if c in holders and outside <= inside:
            continue
        if inside > 0.5 * total and (not outside or last[c] - first[c] >= 3 and outside < 0.25 * total):
            continue
        marked[lines] = True
    if not articles and length[~marked].sum() < 0.1 * total or marked.all():
        marked[:] = False
    return marked


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """Text of the main blocks in page order, one line each; empty for null, empty or text-free pages.

    Lines are the unmarked blocks. Those whose smoothed ratio passes the threshold (two clusters: the mean splits
    low from high) vote with their length for their containers, others with half of it. The outermost <article> and
    <main> elements with such lines are the content region if they hold most of the votes, else the deepest
    container with at least three quarters of them is. All lines of the region are returned, and lines outside it
    that belong to the higher of two clusters of ratios, and the page's title. Lines of a container that is named as
    furniture count a tenth in ratio and votes, nothing beside an article, and stay only where that is still enough.
    """
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    if page.rawdata.startswith(("<!", "<?")):  # a comment that never ends
        page.rawdata = ""
    page.close()
    page.flush()
    if not page.lines:
        return ""
    length = np.array([len(t) for t, _, _ in page.lines], float)
    paths: list[list[int]] = []
    for _, _, at in page.lines:
        path = [at]
        while path[-1]:
            path.append(page.parent[path[-1]])
        paths.append(path)
    marked = furniture_lines(page, length, paths)
    # Beside an article, place and name agree, and a long notice must not outweigh a short article.
    beside = any(page.kinds[c] in ("article", "main") for path, named in zip(paths, marked, strict=True) if not named for c in path)
    weight = np.where(marked, 0.0 if beside else NAMED, 1.0)
    raw = length / np.maximum(1, [n for _, n, _ in page.lines]) * weight
    ratio = raw.copy()
    ratio[~marked] = smoothed(raw[~marked], sigma)
    content = ratio >= min(ratio[~marked].mean(), np.median(ratio[~marked])) * (1 - 1e-9)  # equal lines are all content, whatever the last bits say
    votes: dict[int, float] = {}
    voted: set[int] = set()  # containers with a line of the content cluster
    for i, path in enumerate(paths):
        for c in path:
            votes[c] = votes.get(c, 0.0) + length[i] * (1.0 if content[i] else 0.5) * weight[i]
        if content[i]:
            voted.update(path)
    outermost = {c for path in paths for c in [next((c for c in reversed(path) if page.kinds[c] in ("article", "main")), 0)] if c} & voted
    if sum(votes[c] for c in outermost) > 0.5 * votes[0]:
        chosen = outermost
    else:
        depth: dict[int, int] = {}
        for path in paths:
            depth.update((c, len(path) - n) for n, c in enumerate(path))
        chosen = {max((c for c, v in votes.items() if v >= 0.75 * votes[0] and page.kinds[c] not in LEAF), key=depth.__getitem__, default=0)}
    # Outside, a line needs a high ratio of its own too, or a short line would ride on the text beside it; the only
    # first heading of a page is its title.
    cut = two_means(ratio[~marked])
    titles = np.array([page.kinds[at] == "h1" for _, _, at in page.lines]) & ~marked
    far = (raw >= cut) & (ratio >= cut / 2) | (titles if titles.sum() == 1 else False)
    keep = far | ~marked & np.array([not chosen.isdisjoint(path) for path in paths])
    return "\n".join(line[0] for line, kept in zip(page.lines, keep, strict=True) if kept)


def extract(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points). One row for every row, repeated rows too; null html
    gives empty text, null ids and urls stay null, an empty table gives no rows. Other columns are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(h, sigma) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    return back_id(pages.select(sent_id("page_id"), F.col("url").cast("string").alias("url"), "html").mapInPandas(run, SCHEMA), "page_id")

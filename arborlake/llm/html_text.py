"""Main text of web pages by consensus of a host's pages on where the article stands.

Every page scores its containers by the running text they hold outside menus, forms, notices and the like. The
page votes for the generalised path (tags and classes, digits taken out) of its best container, with the length of
the text as weight. Votes count among the pages of a host that are built alike: a page's template is the set of its
outer container paths. Spark sums the votes of a template; the winning path is then used to extract all its pages
again. A page without that path falls back to its own best container.

The best container is only the start. An ancestor below the body is taken in its place if it holds running text of
its own, so a title or lead beside the body of an article belongs to it, or if it adds running text and nothing that
is left out. Running text directly in the body belongs to an article that stands in no ``article`` or ``main``.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from arborlake.session import cut_lineage

# Element names of HTML by their role.
RAW = "script style noscript textarea title iframe template svg math xmp noembed noframes object select".split()
LEFT_OUT = "nav header footer aside form dialog menu button fieldset".split()
VOID = "area base col embed hr img input link meta param source track wbr".split()
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var audio video canvas picture map ruby rb rp rt output meter progress"
).split()
HEAD = ["head"]
# Words in a class, id or role that mark what is not the article.
MARKS = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "menu nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager "
    "header masthead footer sidebar aside rail complementary contentinfo search searchbox "
    "notice cookie cookies consent gdpr popup modal overlay alert disclaimer "
    "comment comments commentlist reply replies respond disqus discussion "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login form widget"
).split()
LAYOUT = "with has no without".split()
HEADINGS = "header masthead".split()  # of an article, if inside one or named with it
ARTICLE_MARKS = "article content entry main maincontent post story text".split()
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SHARE = 0.75  # part of the page's running text that an unnamed container of the article holds
NAMED_SHARE = 0.4  # the same for one that is named as an article
OUTER = 3  # depth of the containers that make a template

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PIECES = re.compile(r"[^\W\d_]+")
_CLOSERS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW + HEAD}


class Page:
    """Blocks of text of one page, each under its container."""

    def __init__(self, source: str | None) -> None:
        self.paths, self.parents, self.named, self.depth = [""], [-1], [False], [0]
        self.tags = [""]
        self.left_out = [0]  # elements of a container that are left out
        self._outer: set[str] = set()
        self.blocks: list[tuple[str, int, int]] = []  # text, container, characters outside links
        self._stack: list[tuple[str, int, bool]] = []  # tag, container, left out
        self._out = self._link = self._article = 0
        self._parts: list[str] = []
        self._linked = 0
        self._read(source or "")

    def _read(self, source: str) -> None:
        at = 0
        while found := _TOKEN.search(source, at):
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if tag in _CLOSERS and not found[1]:
                close = _CLOSERS[tag].search(source, at)
                at = close.end() if close else len(source) if tag != "head" else at
            elif tag in VOID or tag == "br":
                if tag in ("br", "hr"):
                    self._flush()
            elif tag == "a":
                self._link = 0 if found[1] else 1
            elif tag not in INLINE or self._marked(found):
                (self._close if found[1] else self._open)(tag, found[3])
        self._text(source[at:])
        self._flush()

    def _marked(self, found: re.Match) -> bool:
        """An inline element that is left out, or the end of one."""
        return any(t == found[2].lower() for t, _, _ in self._stack) if found[1] else self._attributes(found[3], False)[2]

    def _attributes(self, text: str, block: bool) -> tuple[str, bool, bool]:
        """Generalised class, whether it is named as an article, and whether the element is left out.

        One marking word is enough for a container; of a block, half of the words of a name have to mark.
        """
        if not text or text == "/":
            return "", False, False
        classes, pieces, out, names = "", set(), False, []
        for name, *values in _ATTRIBUTE.findall(text):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                out = True
            elif name != "aria-hidden":
                pieces.update(_PIECES.findall(value))
                names += value.split()
                if name == "class":
                    classes = ".".join(sorted(_PIECES.findall(value)))
        named = any(p in ARTICLE_MARKS for p in pieces)
        marks = _MARKS - _HEADINGS if named or self._article else _MARKS
        if block:
            marked = any(2 * sum(w in marks for w in own) >= len(own) for own in map(_PIECES.findall, names) if own)
        else:
            marked = any(p in marks for p in pieces)
        # with-sidebar, no-header: a layout that speaks of others
        return classes, named, out or marked and not any(p in LAYOUT for p in pieces)

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        closes = CLOSED_BY.get(tag, ())
        if self._stack and (self._stack[-1][0] == "p" or self._stack[-1][0] in closes):
            self._pop()
        block = tag in ("p", "html") or tag[0] == "h" and tag[1:].isdigit()
        classes, named, out = self._attributes(attributes, block)
        parent = self._stack[-1][1] if self._stack else 0
        out = (out or tag in LEFT_OUT and not (tag == "header" and self._article)) and tag not in ("body", "html")
        self._article += tag in ("article", "main")
        if block:
            self._stack.append((tag, parent, out))  # a block, not a container
            self.left_out[parent] += out
        else:
            self.left_out[parent] += out
            self.left_out.append(0)
            self.paths.append(f"{self.paths[parent]}/{tag}{'.' + classes if classes else ''}")
            self.parents.append(parent)
            self.tags.append(tag)
            self.named.append(named or tag in ("article", "main"))
            self.depth.append(self.depth[parent] + 1)
            if self.depth[-1] <= OUTER and not self._out and not out:
                self._outer.add(self.paths[-1])
            self._stack.append((tag, len(self.paths) - 1, out))
        self._out += out

    def _pop(self) -> None:
        tag, _, out = self._stack.pop()
        self._out -= out
        self._article -= tag in ("article", "main")

    def _close(self, tag: str, _: str) -> None:
        self._flush()
        if any(t == tag for t, _, _ in self._stack):
            while self._stack[-1][0] != tag:
                self._pop()
            self._pop()

    def _text(self, text: str) -> None:
        if text and not self._out:
            text = html.unescape(text) if "&" in text else text
            self._parts.append(text)
            if self._link:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((text, self._stack[-1][1] if self._stack else 0, max(0, len(text) - self._linked)))
        self._parts, self._linked, self._link = [], 0, 0

    def template(self) -> str:
        """Digest of the outer container paths, those that are left out aside."""
        return hashlib.md5("\n".join(sorted(self._outer)).encode()).hexdigest()

    def best(self) -> tuple[int, float]:
        """The container of the article and the length of its running text; -1 if the page has no text."""
        inside, size, without = [0.0] * len(self.paths), [0] * len(self.paths), list(self.left_out)
        for text, container, running in self.blocks:
            inside[container] += running + 0.01 * len(text)
            size[container] += len(text)
        own = [2 * x > n for x, n in zip(inside, size)]  # running text that is in no inner container
        for node in range(len(self.paths) - 1, 0, -1):  # children come after their parents
            for sums in (inside, size, without):
                sums[self.parents[node]] += sums[node]
        if not inside[0]:
            return -1, 0.0
        named = [i for i, x in enumerate(inside) if self.named[i] and x >= NAMED_SHARE * inside[0]]
        if named:  # the one with most text, the inner one of equals
            top = max(named, key=lambda i: (inside[i], i))
        else:  # the innermost that holds nearly all
            top = max((i for i, x in enumerate(inside) if x >= SHARE * inside[0]), key=lambda i: (self.depth[i], inside[i]))
        above, clean = self.parents[top], without[top]
        while above > 0 and self.tags[above] != "body":
            adds = inside[above] - inside[top] > 0.5 * (size[above] - size[top])  # not a list of links
            if own[above] or adds and without[above] == clean:
                top, clean = above, without[above]
            above = self.parents[above]
        return top, inside[top]

    def text(self, path: str | None) -> str:
        """Blocks below all containers of that path, or below the page's own best one."""
        wanted = {i for i, p in enumerate(self.paths) if p == path} if path is not None else set()
        below = self._below(wanted)
        if not below:
            below = self._below({self.best()[0]})
        return "\n".join(below)

    def _below(self, wanted: set[int]) -> list[str]:
        held = [False] * len(self.paths)
        for node in range(len(self.paths)):
            held[node] = node in wanted or node > 0 and held[self.parents[node]]
        found = [text for text, container, _ in self.blocks if held[container]]
        if not found or any(self.tags[i] in ("article", "main") for i in wanted):
            return found
        body = [tag == "body" or not node for node, tag in enumerate(self.tags)]
        return [text for text, container, running in self.blocks if held[container] or body[container] and 2 * running > len(text)]


_MARKS, _HEADINGS = set(MARKS), set(HEADINGS)


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sums: dict[tuple[str, str, str], list[float]] = defaultdict(lambda: [0.0, 0])
        for host, source in zip(batch["host"], batch["html"]):
            page = Page(source)
            node, length = page.best()
            if node >= 0:
                own = sums[host, page.template(), page.paths[node]]
                own[0] += length
                own[1] += 1
        yield pd.DataFrame([(*key, w, n) for key, (w, n) in sums.items()], columns=["host", "template", "path", "weight", "pages"])


def host_of(url):
    """Host of a url column in lower case, null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, template, path``: the path with most votes among the host's pages of a template; ties go to more pages,
    then the smaller path."""
    hosted = pages.select(host_of(F.col("url")).alias("host"), "html").filter("host is not null and html is not null")
    votes = hosted.mapInPandas(_votes, "host string, template string, path string, weight double, pages long")
    summed = votes.groupBy("host", "template", "path").agg(F.round(F.sum("weight"), 3).alias("weight"), F.sum("pages").alias("pages"))
    # the least of an aggregate, so a template with many paths is no window
    best = F.min(F.struct((-F.col("weight")).alias("w"), (-F.col("pages")).alias("n"), "path")).alias("best")
    return summed.groupBy("host", "template").agg(best).select("host", "template", "best.path")


@pandas_udf(StringType())
def _template(source: pd.Series) -> pd.Series:
    return pd.Series([Page(s).template() for s in source], dtype=object)


@pandas_udf(StringType())
def _extract(source: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([Page(s).text(p) for s, p in zip(source, path)], dtype=object)


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, path`` for every row.

    Null and empty html gives an empty text, as does a page without text outside what is left out. Pages
    without a host use their own best container. Repeated rows are all answered; an empty table gives an empty
    result. ``path`` is that of the page's host and template, null where there is none.
    """
    winners = cut_lineage(host_paths(pages))
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), _template("html").alias("template"))
    joined = hosted.join(winners, ["host", "template"], "left")
    texts = joined.select("page_id", "url", "path", F.coalesce(_extract("html", "path"), F.lit("")).alias("text"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")

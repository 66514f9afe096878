"""HTML by its element tree, where regular expressions cannot tell: main content, paragraphs, links with their text."""

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_NOISE = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "button"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"article", "main", "section", "div", "body"}


class _Node:
    __slots__ = ("attributes", "children", "tag", "text")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.text = tag, attributes, [], []

    def words(self) -> str:
        """The text below, in document order, noise left out, white space collapsed."""
        parts: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in _NOISE:
                stack.extend(reversed(x.children))
        return " ".join(" ".join(parts).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("body", {})
        self.open = [self.root]
        self.blocks = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs})
        if tag == "p" and self.open[-1].tag == "p":  # an open paragraph ends here
            self.open.pop()
        self.open[-1].children.append(node)
        if tag in _BLOCKS:
            self.blocks.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _tree(html: str) -> _Tree:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree


def _paragraphs(node: _Node) -> list[str]:
    found: list[str] = []
    stack = [node]
    while stack:
        x = stack.pop()
        for child in reversed([c for c in x.children if isinstance(c, _Node) and c.tag not in _NOISE]):
            stack.append(child)
        if x.tag == "p" and (text := x.words()):
            found.append(text)
    return found


def main_paragraphs(html: str, weight: int = 2, least: int = 300) -> list[str]:
    """Paragraphs of the main block: the smallest with at least nine tenths of the best score.

    A block scores ``weight`` times the characters of its paragraphs, plus those of its text; blocks of less than ``least``
    characters do not count.  Without any block the whole text is one paragraph.
    """
    tree = _tree(html)
    scored = []
    for block in tree.blocks:
        text = block.words()
        if len(text) >= least:
            scored.append((weight * sum(len(p) for p in _paragraphs(block)) + len(text), block))
    most = max((score for score, _ in scored), default=0)
    near = [(score, -k) for k, (score, _) in enumerate(scored) if score >= 0.9 * most]  # of equal blocks the innermost
    best = scored[-min(near)[1]][1] if near else None
    found = _paragraphs(best) if best is not None else []
    whole = tree.root.words()
    return found or ([whole] if whole else [])


def anchors(html: str) -> list[dict[str, str]]:
    """href and text of each link, in order."""
    tree, out, stack = _tree(html), [], []
    stack.append(tree.root)
    while stack:
        x = stack.pop()
        if x.tag == "a" and "href" in x.attributes:
            out.append({"href": x.attributes["href"], "label": x.words()})
        stack.extend(reversed([c for c in x.children if isinstance(c, _Node)]))
    return out


@F.pandas_udf(ArrayType(StringType()))
def content_paragraphs(pages: pd.Series) -> pd.Series:
    return pages.map(main_paragraphs, na_action="ignore")


@F.pandas_udf(ArrayType(StructType([StructField("href", StringType()), StructField("label", StringType())])))
def links(pages: pd.Series) -> pd.Series:
    return pages.map(anchors, na_action="ignore")

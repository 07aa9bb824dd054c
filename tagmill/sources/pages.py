"""Web pages as tagged documents: tag tokens, links, and structure nodes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML elements as structure types.
TYPES = {"html": "Document", "nav": "Sect", "article": "Sect", "footer": "Sect", "div": "Div", "h1": "H1", "h2": "H2", "h3": "H3", "h4": "H4", "h5": "H5", "h6": "H6", "p": "P", "ul": "L", "ol": "L", "li": "LI", "a": "Link", "b": "Span", "span": "Span", "img": "Figure", "table": "Table", "tr": "TR", "th": "TH", "td": "TD"}
_HIDDEN = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->"


def tags(pages: DataFrame) -> DataFrame:
    """page_id, tag: opening tags outside scripts, styles and comments."""
    return pages.select("page_id", F.explode(F.expr(rf"regexp_extract_all(regexp_replace(html, '{_HIDDEN}', ''), '<([a-z][a-z0-9]*)', 1)")).alias("tag"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, k, href, text of plain links."""
    both = [F.expr(f"""regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', {i})""") for i in (1, 2)]
    return pages.select("page_id", "url", F.posexplode(F.arrays_zip(both[0].alias("href"), both[1].alias("text"))).alias("k", "x")).select("page_id", "url", "k", "x.href", "x.text")


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag not in TYPES:
            return
        if tag in ("p", "li"):  # closed by the next of their kind
            for k in range(len(self.open) - 1, -1, -1):
                kind = self.rows[self.open[k]][2]
                if kind == TYPES[tag]:
                    del self.open[k:]
                    break
                if kind in ("Sect", "Div", "L", "Document"):
                    break
        self.rows.append([len(self.rows), self.open[-1] if self.open else None, TYPES[tag], [], dict(attrs).get("lang") or ""])
        if tag != "img":
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        kind = TYPES.get(tag)
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][2] == kind:
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.open and not self.hidden and data.strip():
            self.rows[self.open[-1]][3].append(data)


def parsed(pages: DataFrame) -> DataFrame:
    """doc_id, node_id (its place in the page), parent_id, type, text, lang, error.

    A page that can't be parsed gives the nodes before the fault and one row that has the
    error alone; no page keeps another from being read.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for page_id, html in zip(f["page_id"], f["html"], strict=True):
                tree, error = _Tree(), None
                try:
                    tree.feed(html or "")
                    tree.close()
                except Exception as fault:  # the parser asserts on some malformed declarations
                    error = f"{type(fault).__name__}: {fault}"
                out += [(page_id, k, up, kind, "".join(text), lang, None) for k, up, kind, text, lang in tree.rows]
                if error:
                    out.append((page_id, None, None, None, None, None, error))
            yield pd.DataFrame(out, columns=["doc_id", "node_id", "parent_id", "type", "text", "lang", "error"]).astype({"node_id": "Int64", "parent_id": "Int64"})

    return pages.select("page_id", "html").mapInPandas(parse, "doc_id long, node_id long, parent_id long, type string, text string, lang string, error string")


def nodes(pages: DataFrame) -> DataFrame:
    """doc_id, node_id, parent_id, type, text, lang of all pages, as far as they can be parsed."""
    return parsed(pages).where("error is null").drop("error")


def load_errors(pages: DataFrame) -> DataFrame:
    """doc_id, error of the pages that can't be parsed to their end."""
    return parsed(pages).where("error is not null").select("doc_id", "error")

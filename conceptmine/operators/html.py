"""HTML to plain text, one Arrow batch at a time."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text is not page text (fixed values).
HIDDEN = {"script", "style", "template", "rt", "rp"}


class _Text(HTMLParser):
    """Collects the text nodes between tags; entities arrive decoded."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.node = ""
        self.hidden: list[str] = []

    def end_node(self, *_args) -> None:
        if self.node.strip():
            self.nodes.append(self.node.strip())
        self.node = ""

    handle_comment = handle_decl = handle_pi = unknown_decl = handle_startendtag = end_node

    def handle_starttag(self, tag, attrs) -> None:
        self.end_node()
        if tag in HIDDEN:
            self.hidden.append(tag)

    def handle_endtag(self, tag) -> None:
        self.end_node()
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag):]

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.node += data


def plain_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    parser.end_node()
    return " ".join(parser.nodes)


@F.arrow_udf(T.StringType())
def _plain_text(html: pa.Array) -> pa.Array:
    return pa.array([plain_text(h) for h in html.to_pylist()], pa.string())


def html_text(c: Column) -> Column:
    """Tags stripped, text nodes trimmed and joined by one blank."""
    return _plain_text(c)

"""Anchor links as a document tree gives them: native for well-formed pages, an HTML tokenizer over Arrow for the others."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What holds no tags: comments, the document type, scripts and styles.
_HIDDEN = r"(?is)<!--.*?-->|<!doctype[^<>]*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
#: What a pattern can't judge: comments and raw text that end in unusual ways, other elements of raw text, odd bytes.
_ODD_BEFORE = r"(?is)<!-->|<!--->|--!>|<(?:script|style)\b[^>]*/>|\x00"
_ODD_AFTER = r"(?is)<!|<\?|<(?:script|style|xmp|iframe|noembed|noframes|noscript|plaintext)\b|<(?:title|textarea)\b[^>]*>[^<]*<(?!/(?:title|textarea)\s*>)"
_OPEN = r"<(?=[A-Za-z/])"
_TAG = r"""<[A-Za-z/][^<>"']*(?:"[^"<>]*"[^<>"']*|'[^'<>]*'[^<>"']*)*>"""
_ANCHOR = r"(?i)<a(?=[\s/>])"
_VALUE = r"""(?:"[^"<>&]*"|'[^'<>&]*')"""
_PLAIN_ANCHOR = rf"(?i)<a(?:\s+[a-z][a-z0-9-]*={_VALUE})*\s*>"
_HREF = rf"(?i)<a(?:\s+(?!href=)[a-z][a-z0-9-]*={_VALUE})*\s+href=({_VALUE})(?:\s+[a-z][a-z0-9-]*={_VALUE})*\s*>"


class _Anchors(HTMLParser):
    """The first href of each <a> start tag, in order; comments, declarations and raw text hold no tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            value = next((v for k, v in attrs if k == "href"), None)
            if value is not None:
                self.found.append(value)


def parsed_anchors(html: str | None) -> list[str] | None:
    if html is None:
        return None
    parser = _Anchors()
    parser.feed(html)
    parser.close()
    return parser.found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parsed(html: pd.Series) -> pd.Series:
    return html.map(parsed_anchors)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _native(html: Column) -> Column:
    """The href values of a page whose tags are all well-formed and whose anchors have quoted attributes alone, without a
    reference to a character; null for any other page."""

    def read(clean: Column) -> Column:
        n = lambda pattern: F.regexp_count(clean, F.lit(pattern))
        plain = ~html.rlike(_ODD_BEFORE) & ~clean.rlike(_ODD_AFTER) & (n(_OPEN) == n(_TAG)) & (n(_ANCHOR) == n(_PLAIN_ANCHOR))
        return F.when(plain, F.transform(F.regexp_extract_all(clean, F.lit(_HREF), F.lit(1)), lambda h: F.substr(h, F.lit(2), F.length(h) - 2)))

    return _let(F.regexp_replace(html, _HIDDEN, " "), read)


def all_anchors(html: Column) -> Column:
    """The href values of a page's <a> elements, decoded, in order; null for a null page. Python gets, in Arrow batches, the
    pages that patterns can't vouch for, and nulls in place of the others."""
    found = _native(html)
    return F.coalesce(found, _parsed(F.when(found.isNull(), html)))

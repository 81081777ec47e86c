"""Markdown zones: prose, headings, fences and protected tokens, as one scanner and as DataFrame operators.

Concatenating the zones of a text gives the text. Null text has null zones, empty text has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terseflow.semantics import PATH_TAIL, TICK, URL

_URL = re.compile(URL)
_PATH = re.compile(r"(^|[\t\n\f\r (])((?:\.?/|\../)" + PATH_TAIL + ")")
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_OPEN = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$", re.S)
_MARKER = re.compile(r"( {0,3})(?:[-+*]|\d{1,9}[.)])( {1,4}|$)")
_QUOTE = re.compile(r" {0,3}> ?")

#: What a heading, fence, quote or list item starts with, but for the digits of a numbered one.
_STARTS = "#>~-+*" + TICK


def closes(line: str, mark: str, size: int) -> bool:
    return line.strip()[:size] == mark * size


def special_regions(text: str) -> Iterator[tuple[int, int, str]]:
    """(first character, character after the last, kind) of headings and fences, in order.

    Lines are looked at within block quotes and list items. Indented code is no heading. A heading inside a container
    is skipped, as its line doesn't start with '#'; a fence inside one protects up to its closer, or its own line where
    the container's mark hides the opener.
    """
    at, item, after_blank, paragraph = 0, 0, True, False
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end + 1
        line = text[at:end].rstrip("\r\n")
        body, contained = line, False
        indent = len(body) - len(body.lstrip(" "))
        if item and body.strip() and indent < item and after_blank:
            item = 0
        if item and indent >= item:
            body = body[item:]
        mark = body.lstrip(" ")[:1]
        if not mark or (mark not in _STARTS and not mark.isdecimal()):
            paragraph, after_blank, at = bool(body.strip()), not line.strip(), end
            continue
        while True:
            if m := _QUOTE.match(body):
                body, contained = body[m.end() :], True
            elif m := _MARKER.match(body):
                if paragraph and not body[m.end() :].strip():
                    break
                body, contained, item = body[m.end() :], True, m.end() + (len(line) - len(line.lstrip(" ")) if not contained else 0)
            else:
                break
        opener = _OPEN.match(body)
        if opener and not (opener[1][0] == TICK and TICK in opener[2]):
            trimmed = line.strip()
            if trimmed[:3] in (TICK * 3, "~~~"):
                mark = trimmed[0]
                size = len(trimmed) - len(trimmed.lstrip(mark))
                stop = end
                while stop < len(text):
                    nxt = text.find("\n", stop)
                    nxt = len(text) if nxt < 0 else nxt + 1
                    done = closes(text[stop:nxt], mark, size)
                    stop = nxt
                    if done:
                        break
                end = stop
            yield at, end, "code_fence"
            paragraph = False
        elif _ATX.match(body):
            if not contained and line.lstrip(" ").startswith("#"):
                yield at, end, "heading"
            paragraph = False
        else:
            paragraph = bool(body.strip())
        after_blank = not line.strip()
        at = end


def protected(text: str) -> Iterator[tuple[str, str]]:
    """Zones of a text without headings and fences: inline code, URLs and paths, and prose between them.

    A token is placed where its text first occurs, and the earliest wins, inline code before URL before path.
    """
    at = 0
    while at < len(text):
        rest = text[at:]
        found = []
        opened = rest.find(TICK)
        if opened >= 0 and (closed := rest.find(TICK, opened + 1)) >= 0:
            found.append(("inline_code", rest[opened : closed + 1]))
        if m := _URL.search(rest):
            found.append(("url", m[0]))
        if m := _PATH.search(rest):
            found.append(("path", m[2]))
        if not found:
            yield "prose", rest
            return
        kind, token = min(found, key=lambda x: rest.index(x[1]))
        begin = rest.index(token)
        if begin:
            yield "prose", rest[:begin]
        yield kind, token
        at += begin + len(token)


def split(text: str) -> list[tuple[str, str]]:
    """(kind, text) of all zones in order."""
    out, at = [], 0
    for begin, end, kind in special_regions(text):
        if begin > at:
            out += protected(text[at:begin])
        out.append((kind, text[begin:end]))
        at = end
    return out + list(protected(text[at:]))


def structure(text: str) -> tuple[list[str], list[str]]:
    """(headings, fences) in one pass: heading texts after the first blank of lines that start with '#', and whole fences."""
    heads, blocks = [], []
    if "#" in text or TICK * 3 in text or "~~~" in text:
        for begin, end, kind in special_regions(text):
            if kind == "code_fence":
                blocks.append(text[begin:end])
            elif text[begin] == "#" and " " in (line := text[begin:end].rstrip("\r\n")):
                heads.append(line.split(" ", 1)[1])
    return heads, blocks


def headings(text: str) -> list[str]:
    """Heading texts after the first blank of lines that start with '#'."""
    return structure(text)[0]


def fences(text: str) -> list[str]:
    return structure(text)[1]


ZONES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(ZONES)
def _zones(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [{"kind": k, "text": z} for k, z in split(t)])


def zones(text: Column | str) -> Column:
    """The zones of a markdown text as array<struct<kind, text>>."""
    return _zones(F.col(text) if isinstance(text, str) else text)

"""Splitting Markdown bodies into blocks, and the links and anchors they hold. One Arrow call per batch of notes.

Everything works on places in the body: a block is a slice of it, so citations quote the note verbatim.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens a block holds at most, and anchors kept of a body.
BLOCK_TOKENS, MAX_ANCHORS = 512, 16
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|\r?$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_LOCATOR = re.compile(r" {0,3}<!-- *at: *(.+?) *-->\s*$")
_LINE = re.compile(r"[^\n]*\n|[^\n]+$")


@dataclass
class Block:
    text: str
    tokens: int
    locator: str | None
    oversized: str | None
    line: int


@dataclass
class Segment:
    """body[start:end]: a heading, fence, locator or paragraph, without the line end after it."""

    kind: str
    start: int
    end: int
    tokens: int = 0


@lru_cache(1 << 16)
def _word_tokens(word: str) -> int:
    runs = re.findall(r"[A-Za-z0-9]+", word)
    return sum(-(-len(r) // 4) for r in runs) + len(word) - sum(map(len, runs))


def count_tokens(text: str) -> int:
    """Quarter-length of every run of ASCII letters and digits, rounded up, plus one for each other visible character."""
    return sum(_word_tokens(w) if len(w) < 64 else _word_tokens.__wrapped__(w) for w in text.split())


def segments(body: str) -> list[Segment]:
    """The segments of a body in order; blank lines part paragraphs."""
    out: list[Segment] = []
    opened: tuple[str, int] | None = None  # the open fence and where it starts
    start, end = -1, -1  # of the open paragraph or fence

    def close(kind: str) -> None:
        nonlocal start
        if start >= 0:
            out.append(Segment(kind, start, end))
            start = -1

    for m in _LINE.finditer(body):
        line = m[0].rstrip("\n").removesuffix("\r")
        stop = m.start() + len(line)
        fence = _FENCE.match(line)
        if opened:
            end = stop
            mark = line.strip()
            if fence and mark[0] == opened[0] and len(fence[1]) >= opened[1] and not mark.strip(opened[0]):
                close("fence")
                opened = None
        elif fence:
            close("paragraph")
            opened, start, end = (fence[1][0], len(fence[1])), m.start(), stop
        elif _LOCATOR.match(line) or _HEADING.match(line):
            close("paragraph")
            out.append(Segment("locator" if _LOCATOR.match(line) else "heading", m.start(), stop))
        elif not line.strip():
            close("paragraph")
        else:
            start, end = (m.start() if start < 0 else start), stop
    close("fence" if opened else "paragraph")
    for s in out:
        s.tokens = count_tokens(body[s.start : s.end])
    return out


def _parts(body: str, whole: Segment, room: int, limit: int) -> Iterator[Segment]:
    """A paragraph in parts of at most the limit, the first of at most room: cut after the last whole line that fits, else after
    the last word; a word beyond the limit stays whole."""
    words = [(whole.start + m.start(), whole.start + m.end(), _word_tokens(m[0])) for m in re.finditer(r"\S+", body[whole.start : whole.end])]
    first = 0
    while first < len(words):
        used, last, at_line = 0, first, None
        while last < len(words) and (last == first or used + words[last][2] <= room):
            used += words[last][2]
            last += 1
            if last < len(words) and "\n" in body[words[last - 1][1] : words[last][0]]:
                at_line = last
        if last < len(words) and at_line is not None:
            last = at_line
        a, b = words[first][0], words[last - 1][1]
        yield Segment("paragraph", a, b, sum(w[2] for w in words[first:last]))
        first, room = last, limit


def split_body(body: str | None, limit: int = BLOCK_TOKENS) -> list[Block]:
    """Blocks of a body, each a slice of it: paragraphs packed greedily up to the limit, a heading opens a block and stays with the text
    after it, fences stay whole, a locator names the place of what follows and is no text itself."""
    body = body or ""
    out: list[Block] = []
    held: list[Segment] = []
    used, place = 0, None
    marks: list[Segment] = []  # locators between held headings and their text
    lines_before, counted_to = 0, 0

    def filled() -> bool:
        return any(s.kind != "heading" for s in held)

    def close() -> None:
        nonlocal used, lines_before, counted_to
        if held:
            at, pieces = held[0].start, []
            for m in [*marks, Segment("", held[-1].end, held[-1].end)]:
                if at <= m.start <= held[-1].end:
                    pieces.append(body[at : m.start])
                    at = m.end
            text = "".join(pieces).rstrip()
            lines_before += body.count("\n", counted_to, held[0].start)
            counted_to = held[0].start
            n = used
            reason = "fence" if any(s.kind == "fence" for s in held) else "word" if filled() else "headings"
            out.append(Block(text, n, place, f"{reason} over the limit" if n > limit else None, lines_before + 1))
        held.clear()
        marks.clear()
        used = 0

    def hold(s: Segment) -> None:
        nonlocal used
        held.append(s)
        used += s.tokens

    for s in segments(body):
        if s.kind == "locator":
            if filled():
                close()
            if held:
                marks.append(s)
            place = _LOCATOR.match(body[s.start : s.end])[1]
        elif s.kind == "heading":
            if filled():
                close()
            hold(s)
        elif s.kind == "fence":
            if filled() and used + s.tokens > limit:
                close()
            hold(s)
            if used > limit:
                close()
        else:
            if filled() and used + s.tokens > limit:
                close()
            if held and not filled() and used + _word_tokens(body[s.start : s.end].split(None, 1)[0]) > limit:
                close()
            for k, part in enumerate([s] if used + s.tokens <= limit else _parts(body, s, limit - used, limit)):
                if k:
                    close()
                hold(part)
    close()
    return out


def wiki_links(body: str | None) -> list[str]:
    """Targets of [[target]], [[target|alias]] and [[target#part]] outside fences and code spans, different ones in order."""
    seen: dict[str, None] = {}
    for s in segments(body or ""):
        if s.kind in ("paragraph", "heading"):
            plain = re.sub(r"(`+)(?!`).*?(?<!`)\1(?!`)", " ", body[s.start : s.end], flags=re.S)
            for m in re.finditer(r"\[\[([^\[\]\n]+)\]\]", plain):
                if target := re.split(r"[|#]", m[1])[0].strip():
                    seen[target] = None
    return list(seen)


def anchors(body: str | None) -> list[tuple[str, int, int]]:
    """(path, first, last) of places like dir/file.ext:12-30, none that is part of a URL; MAX_ANCHORS at most, as the notes keep no more."""
    out: list[tuple[str, int, int]] = []
    for m in re.finditer(r"(?<![\w/:.])((?:[\w.-]+/)*[\w-][\w.-]*\.[A-Za-z]\w*):(\d+)(?:-(\d+))?(?![\w/])", body or ""):
        first = int(m[2])
        spot = (m[1], first, int(m[3] or first))
        if first and spot[2] >= first and spot not in out:
            out.append(spot)
    return out[:MAX_ANCHORS]


def _blocks(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: [(i, x.text, x.tokens, x.locator, x.oversized, x.line) for i, x in enumerate(split_body(b))])


def _links(bodies: pd.Series) -> pd.Series:
    return bodies.map(wiki_links)


def _anchors(bodies: pd.Series) -> pd.Series:
    return bodies.map(anchors)


def blocks_of(body: Column) -> Column:
    return F.pandas_udf(_blocks, "array<struct<idx:int,text:string,token_count:int,locator:string,oversized:string,line:int>>")(body)


def links_of(body: Column) -> Column:
    return F.pandas_udf(_links, "array<string>")(F.when(F.contains(body, F.lit("[[")), body))


def anchors_of(body: Column) -> Column:
    return F.pandas_udf(_anchors, "array<struct<path:string,first:int,last:int>>")(body)


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode normal form C."""
    return F.pandas_udf(_nfc, "string")(text)


def _diff(pair: tuple[str | None, str | None], most: int = 2000) -> list[str] | None:
    a, b = ((x or "").split("\n") for x in pair)
    if len(a) > most or len(b) > most:
        return None
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    same, after = a[:head], a[len(a) - tail :]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    table = [array("H", [0]) * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = table[i], table[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [" " + x for x in same], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(" " + a[i])
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and table[i + 1][j] >= table[i][j + 1]):
            out.append("-" + a[i])
            i += 1
        else:
            out.append("+" + b[j])
            j += 1
    return out + [" " + x for x in after]


def _diffs(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([_diff(p) for p in zip(old, new)])


def line_diff(old: Column, new: Column) -> Column:
    """Lines of a longest-common-subsequence difference, marked with space, - and +; null over 2000 lines."""
    return F.pandas_udf(_diffs, "array<string>")(old, new)


def clean_page(text: Column) -> Column:
    """Page text as paragraphs: words broken at a line end joined, blank runs collapsed, a leading # escaped."""
    return F.pandas_udf(_clean_pages, "string")(text)


def _clean_pages(texts: pd.Series) -> pd.Series:
    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        t = re.sub(r"(?<=[^\W\d_])-\n(?=[a-zà-ÿ])", "", t)
        t = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", t))
        return re.sub(r"(?m)^#", r"\\#", t).strip()

    return texts.map(clean)

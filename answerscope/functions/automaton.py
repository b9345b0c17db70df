"""Dictionary matching by an Aho-Corasick automaton over folded text.

All aliases are found in one pass, however many there are. Letters are folded one by one, as a pattern without regard to
case compares them, so that places in the folded text are those of the text; aliases that mind case are compared again.
A hit begins after no word character or apostrophe and ends before no word character. Hits of one alias don't overlap
(the first from the left counts); hits that touch others are settled longest first, then leftmost, then in dictionary
order, by bisection.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import pyarrow as pa
import regex

WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍]")
APOSTROPHES = "'’"
HIT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("nth", pa.int32())])


class _Folded(dict):
    """Code point -> what a comparison without regard to case takes it for: one character, always."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        upper = c.upper() if len(c.upper()) == 1 else c
        self[code] = upper.lower() if len(upper.lower()) == 1 else upper
        return self[code]


_folded = _Folded()
#: Characters that lower() changes in another way.
ODD = regex.compile("[" + "".join(c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and _folded[ord(c)] != c.lower()) + "]")


def folded(text: str) -> str:
    return text.lower() if text.isascii() or not ODD.search(text) and len(text.lower()) == len(text) else text.translate(_folded)


class Matcher:
    def __init__(self, entries: Iterable[tuple[int, str, bool]]):
        """entries: (nth, alias, case-sensitive)."""
        import ahocorasick

        by: dict[str, list[tuple[int, str | None]]] = {}
        for nth, alias, minds in entries:
            if alias:
                by.setdefault(folded(alias), []).append((nth, alias if minds else None))
        self.trie = ahocorasick.Automaton()
        for key, found in by.items():
            self.trie.add_word(key, (len(key), found))
        self.some = bool(by)
        if by:
            self.trie.make_automaton()
        self.word: dict[str, bool] = {}

    def _is_word(self, c: str) -> bool:
        known = self.word.get(c)
        if known is None:
            known = self.word[c] = bool(WORD.match(c))
        return known

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, nth) of every alias, before overlaps between aliases are settled."""
        if not self.some or not text:
            return []
        out, ends, size, is_word = [], {}, len(text), self._is_word
        for last, (length, found) in self.trie.iter(folded(text)):
            end = last + 1
            start = end - length
            if end < size and is_word(text[end]) or start and (text[start - 1] in APOSTROPHES or is_word(text[start - 1])):
                continue
            for nth, exact in found:
                if ends.get(nth, 0) <= start and (exact is None or text.startswith(exact, start)):
                    ends[nth] = end
                    out.append((start, end, nth))
        return out

    def settled(self, text: str) -> list[tuple[int, int, int]]:
        return settled(self.hits(text))

    def any(self, text: str) -> bool:
        return bool(self.hits(text))


def settled(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Hits by start, those that overlap settled: longest first, then leftmost, then in dictionary order."""
    hits.sort()
    kept: list[tuple[int, int, int]] = []
    k = 0
    while k < len(hits):
        reach, j = hits[k][1], k + 1
        while j < len(hits) and hits[j][0] < reach:
            reach = max(reach, hits[j][1])
            j += 1
        if j == k + 1:
            kept.append(hits[k])
        else:
            mine: list[tuple[int, int, int]] = []  # apart from each other and in order, so only neighbours can clash
            for h in sorted(hits[k:j], key=lambda h: (h[0] - h[1], h[0], h[2])):
                at = bisect_left(mine, h)
                if (at == 0 or mine[at - 1][1] <= h[0]) and (at == len(mine) or h[1] <= mine[at][0]):
                    mine.insert(at, h)
            kept += mine
        k = j
    return kept


def listed(rows: list[list[tuple[int, int, int]]]) -> pa.ListArray:
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    columns = zip(*(h for r in rows for h in r), strict=True) if offsets[-1] else ([], [], [])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], fields=list(HIT)))


def pieces(text: str, lengths: frozenset[int], most: int) -> list[tuple[int, str]]:
    """(start, folded piece) for every piece of one of these lengths that begins and ends as a hit does: at most the ends of words in reach."""
    low, size = folded(text), len(text)
    word = [bool(WORD.match(c)) for c in text]
    ends = [e for e in range(1, size + 1) if e == size or not word[e]]
    out, k = [], 0
    for start in range(size):
        if start and (word[start - 1] or text[start - 1] in APOSTROPHES):
            continue
        while k < len(ends) and ends[k] <= start:
            k += 1
        for end in ends[k:]:
            if end - start > most:
                break
            if end - start in lengths:
                out.append((start, low[start:end]))
    return out

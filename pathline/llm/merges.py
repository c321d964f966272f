"""Byte-pair merges answered by prefix tables.

In a merge vocabulary every prefix of a string has one encoding, and the last token of
each prefix settles it: token t ends the prefix i if it matches there and the last token
of prefix i - len(t) stays a token of its own when t follows. An automaton gives the
matches, a remembered test of two tokens gives the second condition, and ids are
recovered from the end. One pass in text order; nothing is merged in the text itself.
"""

from __future__ import annotations

import ahocorasick


#: Tests of two tokens that a worker remembers (some 50 bytes each).
MOST_PAIRS = 400_000


class PrefixTable:
    """tokens: string of each id that may occur; rank(left, right): order of a merge, or None.

    close: a mark put on the last symbol of a word, if the vocabulary has one ("</w>").
    `closing` are then ids of tokens with that mark, by their string without it.
    """

    def __init__(self, tokens: dict[str, int], rank, closing: dict[str, int] | None = None, close: str = ""):
        self.rank, self.close = rank, close
        self.text: dict[int, str] = {}
        self.closing: dict[str, int] = {}
        self.shut: set[int] = set()
        self.known: dict[int, dict[int, bool]] = {}  # by the first token, then the second: no key of its own for a pair
        self.pairs = 0
        self.auto = ahocorasick.Automaton()
        for s, i in tokens.items():
            if self.merged(list(s)) == [s]:
                self.text[i] = s
                self.auto.add_word(s, (i, len(s)))
        self.auto.make_automaton()
        for s, i in (closing or {}).items():
            if self.merged([*s[:-1], s[-1] + close]) == [s + close]:
                self.text[i] = s
                self.closing[s] = i
                self.shut.add(i)
        self.longest = max(map(len, self.closing), default=0)

    def merged(self, parts: list[str]) -> list[str]:
        """The merges carried out one by one, lowest rank first and leftmost of equals; for short strings."""
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether a followed by b is encoded as these two tokens."""
        row = self.known.get(a)
        ok = row.get(b) if row is not None else None
        if ok is None:
            s, t = self.text[a], self.text[b]
            end = self.close if b in self.shut else ""
            whole = s + t
            ok = self.merged([*whole[:-1], whole[-1] + end]) == [s, t + end]
            if self.pairs == MOST_PAIRS:
                self.known.clear()
                self.pairs = 0
            self.known.setdefault(a, {})[b] = ok
            self.pairs += 1
        return ok

    def last_tokens(self, s: str) -> list[int]:
        """For each prefix length the id of its last token; -1 at 0 and after a character without one."""
        last = [-1] * (len(s) + 1)
        known, fits = self.known.get, self.fits
        for end, (tok, size) in self.auto.iter(s):
            if last[end + 1] < 0:
                before = last[end + 1 - size]
                if before < 0:
                    last[end + 1] = tok
                else:
                    row = known(before)
                    ok = row.get(tok) if row is not None else None
                    if ok or ok is None and fits(before, tok):
                        last[end + 1] = tok
        return last

    def ids(self, s: str, other) -> list[int]:
        """Ids of s, recovered backwards; other(c) gives the ids of a character without a token."""
        last, out, i = self.last_tokens(s), [], len(s)
        while i:
            t = last[i]
            if t < 0:
                out.extend(reversed(other(s[i - 1])))
                i -= 1
            else:
                out.append(t)
                i -= len(self.text[t])
        out.reverse()
        return out

    def open_counts(self, s: str, last: list[int]) -> list[int]:
        """Number of tokens of each prefix that goes on."""
        counts = [0] * len(last)
        for i in range(1, len(last)):
            t = last[i]
            counts[i] = counts[i - (1 if t < 0 else len(self.text[t]))] + 1
        return counts

    def closed_count(self, s: str, i: int, last: list[int], counts: list[int]) -> int:
        """Number of tokens of the prefix of length i as a word of its own."""
        for size in range(min(i, self.longest), 0, -1):
            t = self.closing.get(s[i - size : i])
            if t is not None and (i == size or self.fits(last[i - size], t)):
                return counts[i - size] + 1
        raise ValueError("a word without an encoding")

    def prefix_counts(self, s: str) -> list[int]:
        """Token count of every prefix of a word, each taken as a whole word; 0 for the empty one."""
        last = self.last_tokens(s)
        counts = self.open_counts(s, last)
        return [0, *(self.closed_count(s, i, last, counts) for i in range(1, len(s) + 1))]


class Memory(dict):
    """Results by word: two generations, so that it stays bounded and keeps what is frequent."""

    def __init__(self, make, most: int = 120_000, longest: int = 200):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, word):
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        if len(word) <= self.longest:
            self[word] = out
        return out

    def turn(self) -> None:
        """Between texts: the younger generation becomes the older one when it is full."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

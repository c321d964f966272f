"""Token counts by dynamic programming over prefixes.

The vocabulary is a BPE with word ends. A text falls into words; for a word the table
holds the exact count at every prefix, so a text's count, and the count of any cut of it,
is a sum of known numbers and nothing is encoded again.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import public_tokenizers
import regex
import tokenizers
from pyspark.sql import DataFrame

from pathline.llm.batches import map_texts
from pathline.llm.merges import Memory, PrefixTable

#: Words of the vocabulary's own pattern, after lower case. Text between them is dropped.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
SPACE = regex.compile(r"\p{White_Space}+")
LIMIT = 2048


def _settled() -> str:
    """A class of code points whose letters, cases and compositions all Unicode tables have alike: those of the
    oldest tables at hand in the first plane and in the ideographs of the second, and pictures, which are signs
    whether a table has them or not."""
    old = unicodedata.ucd_3_2_0
    at = [c for c in range(0x10000) if old.category(chr(c)) not in ("Cn", "Cs")]
    runs, first = [], 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] != at[k - 1] + 1:
            runs.append((at[first], at[k - 1]))
            first = k
    runs += [(0x1F000, 0x1FAFF), (0x20000, 0x2A6D6)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _byte_letters() -> dict[str, int]:
    """The usual byte alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordCounts:
    def __init__(self, path: str, end: str = "</w>"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_letters()

        def plain(token: str) -> str:
            return "".join(chr(of[c]) for c in token)

        def symbol(token: str) -> str:
            return plain(token[: -len(end)]) + end if token.endswith(end) else plain(token)

        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        order = {(symbol(a), symbol(b)): k for k, (a, b) in enumerate(pairs)}
        vocab = spec["model"]["vocab"]
        inner = {plain(t): i for t, i in vocab.items() if not t.endswith(end)}
        closing = {plain(t[: -len(end)]): i for t, i in vocab.items() if t.endswith(end) and t != end}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        library = tokenizers.Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.odd = re.compile(f"[^{_settled()}]")
        self.table = PrefixTable(inner, lambda a, b: order.get((a, b)), closing, end)
        self.words = Memory(self._word)

    def _word(self, word: str) -> int:
        s = word.encode().decode("latin-1")
        last = self.table.last_tokens(s)
        return self.table.closed_count(s, len(s), last, self.table.open_counts(s, last))

    def _parts(self, text: str) -> list[str]:
        """Words, composed and in lower case, letter by letter as the vocabulary's library has it.

        What this Python's tables and the library's can take for different things (newer or
        unassigned code points) is cut by the library's own normaliser and pattern.
        """
        if text.isascii() or not self.odd.search(text):
            return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        out = []
        for chunk in SPACE.split(text):
            if self.odd.search(chunk):
                chunk = self.normalizer.normalize_str(chunk)
                out += [chunk[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(chunk)]
            else:
                out += WORDS.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())
        return out

    def count(self, text: str) -> int:
        n = 0
        if self.special and "<" in text:
            pieces = self.special.split(text)
            n = len(pieces) - 1
        else:
            pieces = [text]
        for p in pieces:
            n += sum(map(self.words.__getitem__, self._parts(p)))
        self.words.turn()
        return n

    def prefix_counts(self, text: str) -> list[int]:
        """Exact count at every prefix of a normalised text without special strings (one entry for each byte
        of each word, words in order): what a text cut there costs."""
        out, before = [0], 0
        for w in self._parts(text):
            inside = self.table.prefix_counts(w.encode().decode("latin-1"))
            out += [before + k for k in inside[1:]]
            before += inside[-1]
        return out

    def fit(self, text: str, budget: int) -> int:
        """How many leading words of a text without special strings have at most budget tokens."""
        used, n = 0, 0
        for w in self._parts(text):
            used += self.words[w]
            if used > budget:
                break
            n += 1
        return n


@functools.lru_cache(1)
def word_counts(path: str) -> WordCounts:
    """One for each Python worker."""
    return WordCounts(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; null text counts as empty.

    Rows stay where they are: no shuffle.
    """

    def make():
        table = word_counts(vocabulary)

        def run(texts):
            n = [table.count(t) for t in texts]
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}

        return run

    return map_texts(docs, make, "n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """`count_tokens` of documents: doc_id, n_bytes, n_tokens, over_limit; a null or empty text has 0 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))

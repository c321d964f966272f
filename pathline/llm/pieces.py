"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

Spaces become the mark U+2581 and one mark goes first. No piece has the mark after
another character, some control characters are in no longer piece, and some signs are in
none after a letter, so the text falls into units that are encoded one by one, each by its
own prefix table (see `merges`).
Pieces of several marks come last in the order of merges, all with one rank, so a run of
marks that the rest of its unit leaves over is joined on its own, from the left.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from pathline.llm.batches import map_texts
from pathline.llm.merges import Memory, PrefixTable

MARK = "▁"


class Pieces:
    """Encoder and decoder of one model file of merge type with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.bytes = {i: int(self.pieces[i][1:-1], 16) for i in range(n) if model.is_byte(i)}
        self.of_byte = {b: i for i, b in self.bytes.items()}
        normal = {self.pieces[i]: i for i in range(n) if not special[i] and i not in self.bytes}
        if any(MARK in p.lstrip(MARK) for p in normal) or len(self.of_byte) < 256:
            raise ValueError("a model with marks inside pieces, or without bytes")
        joined = set("".join(p for p in normal if len(p) > 1))
        alone = "".join(c for c in map(chr, range(32)) if c not in joined)
        cut, letter = re.escape(alone), r"[^\W\d_]"
        # signs that no piece has after a letter: a word ends before them
        after = {b for p in normal for a, b in zip(p, p[1:], strict=False) if re.fullmatch(letter, a)}
        ends = re.escape("".join(c for c in map(chr, range(33, 127)) if not re.fullmatch(r"\w", c) and c not in after))
        word = f" *{letter}+(?=[{ends}])|" if ends else ""
        self.units_of = re.compile(f"{word} *[^ {cut}]+| +|[{cut}]")
        order = {p: -model.get_score(i) for p, i in normal.items()}
        self.mark = normal[MARK]
        runs = {p: i for p, i in normal.items() if not p.strip(MARK)}
        words = {p: i for p, i in normal.items() if len(p) == 1 or p not in runs}
        self.table = PrefixTable(words, lambda a, b: order.get(a + b) if a + b in words else None)
        self._learn_runs(runs)
        self.silent = {i for i in range(n) if special[i]}
        self.odd = self.silent | self.bytes.keys()
        self.units = Memory(self._unit)

    def _learn_runs(self, runs: dict[str, int]) -> None:
        """Ids of a run of marks by its length; longer runs begin with the longest piece."""
        size = {len(p): i for p, i in runs.items()}
        self.most = max(size)

        def left(n: int) -> list[int]:
            parts = [1] * n
            while (at := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in size), None)) is not None:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [size[k] for k in parts]

        self.runs = [left(n) for n in range(4 * self.most + 1)]
        for n in range(2 * self.most + 1, len(self.runs)):
            if self.runs[n] != [size[self.most], *self.runs[n - self.most]]:
                raise ValueError("runs of marks are not joined from the left")

    def _run(self, n: int) -> list[int]:
        whole = max(0, -(-(n - 3 * self.most) // self.most))
        return self.runs[self.most][:1] * whole + self.runs[n - whole * self.most]

    def _unit(self, unit: str) -> str | tuple[str, str]:
        """Ids of a unit (spaces for marks) as decimals joined by commas; with what they say where that is not the unit."""
        ids = self.table.ids(unit.replace(" ", MARK), lambda c: [self.of_byte[b] for b in c.encode()])
        if ids[:2] == [self.mark, self.mark]:
            n = next((k for k, i in enumerate(ids) if i != self.mark), len(ids))
            ids[:n] = self._run(n)
        joined, said = ",".join(map(str, ids)), self._said(ids)
        return joined if said == unit else (joined, said)

    def _said(self, ids) -> str:
        if self.odd.isdisjoint(ids):
            return "".join(map(self.pieces.__getitem__, ids)).replace(MARK, " ")
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.pieces[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def _split(self, text: str) -> list[str]:
        """Units with spaces for marks; a mark in the text counts as a space."""
        return self.units_of.findall(" " + text.replace(MARK, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.digest(text)[1].split(",")] if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that stands for the first mark is taken off."""
        said = self._said(ids)
        return said[1:] if said[:1] == " " else said

    def digest(self, text: str) -> tuple[int, str, str, str]:
        """Number of ids, the ids as decimals joined by commas, their digest, and the decoded text."""
        parts = self._split(text)
        got = [self.units[u] for u in parts]
        self.units.turn()
        try:
            ids, said = ",".join(got), " " * bool(text) + text.replace(MARK, " ")
        except TypeError:  # some units do not say what they were
            ids = ",".join([g if isinstance(g, str) else g[0] for g in got])
            said = "".join([u if isinstance(g, str) else g[1] for u, g in zip(parts, got, strict=True)])
        return ids.count(",") + bool(ids), ids, hashlib.sha256(ids.encode()).hexdigest(), said[1:] if said[:1] == " " else said


@functools.lru_cache(1)
def pieces(path: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(path)


def encode_decode(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).

    A row for each row; null text is an empty text with no ids. Rows stay where they are:
    no shuffle, and a text of any length takes time in proportion to it.
    """

    def make():
        table = pieces(model)

        def run(texts):
            rows = [table.digest(t) for t in texts]
            out = {
                "n_tokens": [r[0] for r in rows],
                "ids_sha256": [r[2] for r in rows],
                "decoded_sha256": [hashlib.sha256(r[3].encode()).hexdigest() for r in rows],
            }
            if with_ids:
                out["ids"] = pa.array([np.fromstring(r[1], dtype=np.int32, sep=",") for r in rows], type=pa.list_(pa.int32()))
            return out

        return run

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """`encode_decode` of documents: doc_id, n_tokens, ids_sha256, decoded_sha256; a null or empty text has no ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))

"""Secret scans by a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every
match must hold. A segment (some megabytes of documents in one task) has its own inverted
index of the trigrams that occur in queries; postings are intersected and joined into the
rule's candidates, and only those are searched. Rules without mandatory trigrams search
every text. Segments are independent: no shuffle, and no list longer than a segment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathline.llm.batches import map_texts, small_batches

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Rule:
    """kind, pattern; a match counts if its group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The kinds that every result must have, in their order.
BASE = (
    Rule("assign", r"""((?ia:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# Public formats of credentials that the method adds.
MORE = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

# --- from a pattern to a Boolean query -------------------------------------------------
# A query is True (no condition), a trigram, ("and", ...) or ("or", ...).


def _terms(query) -> frozenset:
    return frozenset(query[1:]) if isinstance(query, tuple) and query[0] == "and" else frozenset([query])


def _both(*parts):
    flat = dict.fromkeys(t for p in parts if p is not True for t in (p[1:] if isinstance(p, tuple) and p[0] == "and" else [p]))
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", *flat)


def _either(*parts):
    parts = list(dict.fromkeys(parts))
    if True in parts or not parts:
        return True
    # what asks for more than another alternative adds nothing
    parts = [p for p in parts if not any(q != p and _terms(q) < _terms(p) for q in parts)]
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _grams(s: bytes):
    return _both(*(s[i : i + 3] for i in range(len(s) - 2)))


def _of(strings) -> object:
    return _either(*map(_grams, strings))


#: Alternatives that are followed exactly; a node with more counts as unknown.
_MOST = 64


def _letter(c: int, flags: int) -> set[bytes] | None:
    """A character as the index has it (ASCII letters in lower case); None if a rule ignores case and it has forms
    beyond ASCII (of ASCII letters i, k and s do)."""
    char = chr(c)
    if flags & re.IGNORECASE and not (flags & re.ASCII and c < 128):
        if char in "iIkKsS" or c >= 128 and len({char, char.lower(), char.upper(), char.casefold()}) > 1:
            return None
    return {char.encode().lower()}


def _node(op, arg, flags):
    """(strings that the node can stand for, or None if unknown; the query of its inside)."""
    if op is K.LITERAL:
        return _letter(arg, flags), True
    if op is K.IN:
        chars = set()
        for o, a in arg:
            points = [a] if o is K.LITERAL else range(a[0], a[1] + 1) if o is K.RANGE and a[1] - a[0] < _MOST else None
            if points is None:
                return None, True
            for c in points:
                form = _letter(c, flags)
                if form is None:
                    return None, True
                chars |= form
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op is K.SUBPATTERN:
        return _sequence(arg[3], (flags | arg[1]) & ~arg[2])
    if op is K.BRANCH:
        both = [_sequence(b, flags) for b in arg[1]]
        query = _either(*(_both(q, True if s is None else _of(s)) for s, q in both))
        if all(s is not None for s, _ in both) and sum(len(s) for s, _ in both) <= _MOST:
            return set().union(*(s for s, _ in both)), True
        return None, query
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner, flags)
        if least == 0:
            return ({b"", *strings}, True) if most == 1 and strings is not None else (None, True)
        if strings is not None and len(strings) == 1 and least <= 32:
            return (strings and {next(iter(strings)) * least}, query) if least == most else (None, _both(query, _of({next(iter(strings)) * least})))
        return None, _both(query, True if strings is None else _of(strings))
    if op is K.AT:
        return {b""}, True
    return None, True


def _sequence(nodes, flags):
    """As `_node`, for nodes one after another: known strings are joined until one is unknown."""
    conditions, run, whole = [], {b""}, True
    for op, arg in nodes:
        strings, query = _node(op, arg, flags)
        conditions.append(query)
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a in run for b in strings}
            continue
        conditions.append(_of(run))
        whole = False
        run = strings if strings is not None else {b""}
    if whole:
        return run, _both(*conditions)
    return None, _both(*conditions, _of(run))


def trigram_query(pattern: str):
    """The Boolean query over trigrams (ASCII letters in lower case) that each text with a match fulfils."""
    parsed = _parser.parse(pattern)
    strings, query = _sequence(parsed, parsed.state.flags)
    return _both(query, True if strings is None else _of(strings))


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1:]))


# --- the index of a segment ---------------------------------------------------------------


def _code(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


#: A segment ends with the document that fills it.
SEGMENT_BYTES = 2 << 20


class Segment:
    """Inverted index of some documents: for each wanted trigram the sorted numbers of those that have it."""

    def __init__(self, texts: list[bytes], wanted: set[bytes]):
        self.n = len(texts)
        data = _LOWER[np.frombuffer(b"\n".join([*texts, b"\n\n"]), dtype=np.uint8)].astype(np.uint32)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        has = np.zeros(1 << 24, dtype=bool)
        has[[_code(g) for g in wanted]] = True
        codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        at = np.flatnonzero(has[codes])
        pairs = np.unique(codes[at].astype(np.int64) << 32 | (np.searchsorted(starts, at, "right") - 1))
        keys, self.docs = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.int64)
        grams, first = np.unique(keys, return_index=True)
        self.lists = dict(zip(grams.tolist(), np.split(self.docs, first[1:]), strict=True)) if len(grams) else {}

    def postings(self, gram: bytes) -> np.ndarray:
        return self.lists.get(_code(gram), np.zeros(0, dtype=np.int64))

    def candidates(self, query) -> np.ndarray:
        """Numbers of the documents that fulfil the query: shortest postings are intersected first."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings(query)
        lists = sorted(map(self.candidates, query[1:]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
            if query[0] == "and" and not len(out):
                break
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(k, r, re.compile(r.pattern), trigram_query(r.pattern)) for k, r in enumerate(rules)]
        self.grams = set().union(*(trigrams(q) for *_, q in self.rules))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, number of the rule, end) in order, in code points."""
        found: list[list] = [[] for _ in texts]
        first, size, raw = 0, 0, []
        for i, t in enumerate(texts):
            raw.append(t.encode())
            size += len(raw[-1])
            if size >= SEGMENT_BYTES or i == len(texts) - 1:
                self._scan(Segment(raw, self.grams), texts[first : i + 1], found[first : i + 1])
                first, size, raw = i + 1, 0, []
        for f in found:
            f.sort()
        return found

    def _scan(self, segment: Segment, texts: list[str], found: list[list]) -> None:
        for k, rule, pattern, query in self.rules:
            for i in segment.candidates(query).tolist():
                found[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found: kind, start, end of every span of each row's whole text (code points, end exclusive).

    Spans of one kind do not overlap; those of different kinds may. A null or empty text
    has none. Repeated rows are scanned one by one.
    """

    def make():
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def run(texts):
            rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in scanner.spans(texts)]
            return {"found": pa.array(rows, type=kind)}

        return run

    return map_texts(docs, make, "found array<struct<kind:string,start:long,end:long>>")


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index itself: segment (number of the task, its batch), trigram, ids of documents."""
    wanted = set().union(*(trigrams(trigram_query(r.pattern)) for r in rules))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            s = Segment([(t or "").encode() for t in batch.column("text").to_pylist()], wanted)
            ids = batch.column("doc_id").to_pylist()
            grams = sorted(s.lists)
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": [f"{part}-{k}"] * len(grams),
                    "gram": [bytes((g >> 16, g >> 8 & 255, g & 255)).decode("latin-1") for g in grams],
                    "doc_ids": pa.array([[ids[i] for i in s.lists[g]] for g in grams], type=pa.list_(pa.int64())),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, "segment string, gram string, doc_ids array<long>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with every span (overlapping ones joined) replaced by mark in text; n_chars follows if it is there.

    All rows stay, with all their columns; a null text stays null.
    """

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for text, spans in zip(texts, scanner.spans([t or "" for t in texts]), strict=True):
                parts, at = [], 0
                for a, _, b in spans:
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                out.append("".join([*parts, text[at:]]) if spans else text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, type=batch.schema.field("text").type))

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op2_secret_scans(spark, sf_dir: str) -> DataFrame:
    """`scan` of documents: doc_id, n_assign, n_access, n_hex, base_sha256, spans; a null or empty text has none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = len(BASE)
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in RULES[:n]]))
    return scan(docs).select(
        "doc_id",
        *[of(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )


def _sql_rule(k: int, rule: Rule) -> str:
    """Spans of one rule: pieces between matches give the starts."""
    pattern = rule.pattern.replace("(?ia:", "(?i:").replace(r"\x20", " ").replace("'", "''")
    size = f"len(regexp_extract(m[i], '{pattern}', {rule.group}))" if rule.group else "len(m[i])"
    return f"""
  SELECT rid, {k} AS k, '{rule.kind}' AS kind,
         CAST(list_sum([len(x) FOR x IN p[1:i]]) + coalesce(list_sum([len(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS a,
         len(m[i]) AS n
  FROM (SELECT rid, p, m, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT rid, regexp_split_to_array(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM t))
  WHERE {size} >= {max(rule.least, 1)}"""


OP2_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_sql_rule(k, r) for k, r in enumerate(RULES))}),
g AS (
  SELECT rid, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
         string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (WHERE k < {len(BASE)}) AS base,
         string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans
  FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (rid)
"""

"""Personal data by bootstrapped contextual extraction.

1. Regular forms (addresses of mail and network, card and phone numbers) are the seeds.
   The same pass notes every other identifier-like mention: the longest run of tokens, one blank
   apart, that each have two digits, an @, or a digit and no more letters, and touch no regular form. What stands inside a
   longer run and looks like a regular form counts by its shape alone, so that parts of a run
   do not stand beside it in a context.
2. Lexical patterns: the word before a run or entity, the two before, the word after, the
   words on both sides, and the shape of a mention (letters and digits as such). Digits
   within context words are one digit, so that numbers before it are a pattern too.
3. The graph has a row for each distinct pair of pattern and instance (what a mention says).
   In each round a pattern is scored for each kind by the worth of the accepted instances
   of that kind, set against all identifier-like instances that it introduces (the lower
   bound of the share, so that few instances do not make a high score). Patterns with
   enough support and a score above the bar are accepted; so are the instances that they
   introduce, worth more the more of them agree (1 - product of 1 - score); these induce
   further patterns in the next round. Seeds stay at 1. Rounds end when a round accepts the same instances.
4. Accepted patterns mark the mentions they introduce, by the kind of the seeds they share.

A text is cut into tokens once, and a context is looked up by the number of a token, so the
work is linear in a text, blanks or not. Mentions are not stored: texts are read once for
the pairs, which are made distinct before they are dealt, and once to be marked. Sums are taken
before the shuffle, and joins meet on one row for each pattern or instance, so a pattern of
very many mentions is split like any other large group.
"""

from __future__ import annotations

import re
import warnings
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathline.llm.batches import settle, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Kinds of what the method adds, by the seeds that its patterns share.
FOUND = tuple(f"like_{k}" for k in KINDS)
#: Sorts of patterns that hold the words before a mention.
INTRODUCING = ("left", "left2", "both")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a token of an identifier-like mention has; with a single digit it has no more letters than digits (B7, not room7).
_MARKED = re.compile(r"[0-9@]")


@dataclass(frozen=True)
class Bootstrap:
    """support: accepted instances of one kind that a pattern needs; bar: score of patterns with the words before that are
    accepted; weak_bar: of shapes and words after, which say less (a number that fails the check of a regular form has
    its shape too, and anything can be followed by the same word); rounds at most; block: patterns that go to all executors at once (24 bytes each)."""

    support: int = 5
    bar: float = 0.4
    weak_bar: float = 0.6
    rounds: int = 12
    block: int = 1_000_000


def emails(text: str):
    """Leftmost matches that do not overlap, found from their @; linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def regular_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every entity of a regular form, in order."""
    if not _MARKED.search(text):
        return []  # each has a digit or an @
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


#: Whether a code point is a blank, up to the last one that is.
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
#: What in a longer run looks like a regular form: a row of digits, or numbers with dots between them.
_ROW = re.compile(r"\+?[0-9(][\x20().0-9-]*[0-9]")
_ROW_START = re.compile(r"\+?[0-9(][\x20().0-9-]*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_ROW_DIGITS = range(9, 20)
#: Shapes of rows of digits that go to all tasks.
SHAPES = 100_000
_DIGIT = re.compile(r"[0-9]")
_ZERO = str.maketrans("123456789", "000000000")
_SHAPE = re.compile(r"[^\W\d_]")


def shape_of(said: str) -> str:
    return _SHAPE.sub("a", said).translate(_ZERO)


def tokens_of(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of all runs of what is no blank."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word = np.zeros(len(codes) + 2, dtype=np.int8)
    word[1:-1] = ~_BLANK[np.minimum(codes, len(_BLANK) - 1)]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


class Text:
    """A text cut into tokens (runs of what is no blank), with its entities."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]] | None = None):
        self.text = text
        self.spans = regular_spans(text) if spans is None else spans
        self.start, self.end = tokens_of(text) if self.spans or _MARKED.search(text) else ([], [])
        self._word: dict[int, str] = {}
        self._starts = [a for a, _, _ in self.spans]
        self._ends = sorted(b for _, _, b in self.spans)
        self._past: list[int] = []  # the last end of the entities up to each
        for _, _, b in self.spans:
            self._past.append(max(b, self._past[-1]) if self._past else b)

    def word(self, k: int) -> str:
        """Token k in lower case with one digit for all; none beyond the ends."""
        if not 0 <= k < len(self.start):
            return ""
        if k not in self._word:
            self._word[k] = self.text[self.start[k] : self.end[k]].lower().translate(_ZERO)
        return self._word[k]

    def _free(self, a: int, b: int) -> bool:
        k = bisect_left(self._starts, b)
        return k == 0 or self._past[k - 1] <= a

    def _bare(self, a: int, b: int) -> tuple[int, int]:
        """Without punctuation at the ends (a + before a digit stays)."""
        t = self.text
        while a < b and not (t[a].isalnum() or t[a] == "+" and t[a + 1 : a + 2].isdigit()):
            a += 1
        while b > a and not t[b - 1].isalnum():
            b -= 1
        return a, b

    def _like(self, a: int, b: int) -> bool:
        digits = _DIGIT.finditer(self.text, a, b)
        next(digits, None)
        return next(digits, None) is not None or self.text.find("@", a, b) >= 0 or sum(map(str.isalpha, self.text[a : min(b, a + 99)])) <= 1

    def runs(self) -> Iterator[list[int]]:
        """Numbers of the tokens of each longest run."""
        run, at = [], 0 if self.start else len(self.text)
        while m := _MARKED.search(self.text, at):
            k = bisect_right(self.start, m.start()) - 1
            at = self.end[k]
            free = self._free(self.start[k], at) and self._like(self.start[k], at)
            if run and not (free and run[-1] == k - 1 and self.text[self.end[k - 1] : self.start[k]] == " "):
                yield run
                run = []
            if free:
                run.append(k)
        if run:
            yield run

    def mentions(self, shapes: frozenset[str] | None = None) -> list[tuple[int, int, bool]]:
        """(start, end, whether it is a longest run) of identifier-like mentions, in order; of a run's parts that are rows of
        digits only those of the given shapes, if there are any."""
        out = []
        for run in self.runs():
            a, b = self._bare(self.start[run[0]], self.end[run[-1]])
            if _MARKED.search(self.text, a, b):
                out.append((a, b, True))
            if len(run) > 1:
                parts = (p for p in self._forms(run) if p != (a, b))
                out += [(x, y, False) for x, y in parts if shapes is None or "@" in self.text[x:y] or shape_of(self.text[x:y]) in shapes]
        return sorted(set(out))

    def _forms(self, run: list[int]) -> Iterator[tuple[int, int]]:
        """Parts of a run that look like a regular form; as such has few digits, a token begins few of them."""
        digits = [len(_DIGIT.findall(self.text, self.start[k], self.end[k])) for k in run]
        for i, k in enumerate(run):
            n = 0
            for j in range(i, len(run)):
                n += digits[j]
                if n >= _ROW_DIGITS.stop:
                    break
                a, b = self._bare(self.start[k], self.end[run[j]])
                if n in _ROW_DIGITS and _ROW.fullmatch(self.text, a, b) or i == j and _DOTTED.fullmatch(self.text, a, b):
                    yield a, b
                elif not digits[j] or not _ROW_START.fullmatch(self.text, a, b):
                    break  # nothing longer that begins here is a row of digits
            if "@" in self.word(k):
                yield self._bare(self.start[k], self.end[k])

    def context(self, a: int, b: int) -> tuple[str, str, str]:
        """The words before a, before those, and after b. What else a token holds is a word of its own, up to the next entity."""
        k = bisect_right(self.start, a) - 1
        e = bisect_right(self._ends, a)
        lo = max(self.start[k], self._ends[e - 1]) if e else self.start[k]
        first = lo == self.start[k]
        if lo < a:
            one, two = self.text[lo:a].lower().translate(_ZERO), self.word(k - 1) if first else ""
        else:
            one, two = (self.word(k - 1), self.word(k - 2)) if first else ("", "")
        k = bisect_right(self.start, b - 1) - 1
        e = bisect_left(self._starts, b)
        hi = min(self.end[k], self._starts[e]) if e < len(self._starts) else self.end[k]
        after = self.text[b:hi].lower().translate(_ZERO) if b < hi else self.word(k + 1) if hi == self.end[k] else ""
        return one, two, after

    def patterns(self, a: int, b: int, whole: bool = True) -> list[tuple[str, str]]:
        """Lexical patterns: (sort, words); of a part of a run the shape alone."""
        out = [("shape", shape_of(self.text[a:b]))]
        if not whole:
            return out
        one, two, after = self.context(a, b)
        if one:
            out.append(("left", one))
            if two:
                out.append(("left2", f"{two} {one}"))
        if after:
            out.append(("right", after))
            if one:
                out.append(("both", f"{one} {after}"))
        return out


def _hash(kind: str, said: str) -> int:
    """64 bits; the last one tells what has the words before (1) from shapes and words after (0)."""
    h = xxhash.xxh3_64_intdigest(f"{kind} {said}".encode())
    return (h & ~1 | (kind in INTRODUCING)) - (1 << 63)


def instance_of(text: str, a: int, b: int) -> int:
    return _hash("says", " ".join(text[a:b].lower().split()))


_MENTION = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]
_FOUND_SCHEMA = "doc_id long, found array<struct<kind:int,start:long,end:long,instance:long,patterns:array<long>>>"


def row_shapes(docs: DataFrame, support: int) -> frozenset[str] | None:
    """Shapes that at least `support` different seeds other than mail addresses have. They are few, as such seeds have at most 19
    digits; if they are more than SHAPES all the same, None: then any shape may be looked for."""

    def read(text: str) -> list[tuple[str, int]]:
        return [(shape_of(text[a:b]), instance_of(text, a, b)) for a, k, b in regular_spans(text) if k]

    def run(batches):
        for batch in batches:
            rows = list({x for t in batch.column("text").to_pylist() if t for x in read(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], type=pa.string()), pa.array([x[1] for x in rows], type=pa.int64())], ["shape", "instance"])

    each = texts_of(docs).mapInArrow(run, "shape string, instance long").distinct()
    shapes = each.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support).select("shape").limit(SHAPES + 1).collect()
    return frozenset(r["shape"] for r in shapes) if len(shapes) <= SHAPES else None


def candidates(docs: DataFrame, shapes: frozenset[str] | None = None) -> DataFrame:
    """doc_id and found: entities (kinds 0 to 3) and other mentions (kind -1) with hashes of what they say and of
    their patterns, in order, for each row of docs. A null text has none. shapes: see `Text.mentions`."""

    def read(said: str) -> list[dict]:
        text = Text(said)
        every = sorted([*((a, k, b, True) for a, k, b in text.spans), *((a, -1, b, whole) for a, b, whole in text.mentions(shapes))])
        return [{"kind": k, "start": a, "end": b, "instance": instance_of(said, a, b), "patterns": [_hash(*p) for p in text.patterns(a, b, whole)]} for a, k, b, whole in every]

    def run(batches):
        for batch in batches:
            rows = [read(t) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, type=pa.list_(pa.struct(_MENTION)))], ["doc_id", "found"])

    return texts_of(docs).mapInArrow(run, _FOUND_SCHEMA)


def lower_share(part: Column, n: Column) -> Column:
    """Lower bound (one deviation, Wilson's interval) of a share that shows as part of n."""
    p = part / n
    return (p + 1 / (2 * n) - F.sqrt(p * (1 - p) / n + 1 / (4 * n * n))) / (1 + 1 / n)


def learn(found: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """pattern, kind (number), score of the accepted patterns, from `candidates`."""
    each = found.select(F.explode("found").alias("f")).select("f.kind", "f.instance", F.explode("f.patterns").alias("pattern"))
    edges = settle(each.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    # a pattern of fewer instances can never have the support
    able = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= how.support)
    able = settle(able, "able")  # a table of its own, so that a pattern of very many instances can be split in the join
    seeds = settle(edges.filter("kind >= 0").groupBy("instance").agg(F.min("kind").alias("of"), F.lit(1.0).alias("worth")), "seeds")
    graph = settle(edges.join(able, "pattern").select("pattern", "instance", "total"), "graph")
    accepted, last = seeds, None
    best = None
    for _ in range(how.rounds):
        held = graph.join(accepted, "instance").groupBy("pattern", "total", "of").agg(F.count(F.lit(1)).alias("support"), F.sum("worth").alias("s"))
        scored = held.filter(F.col("support") >= how.support).withColumn("score", lower_share(F.col("s"), F.col("total").cast("double")))
        bar = F.when(F.col("pattern").bitwiseAND(F.lit(1)) == 0, how.weak_bar).otherwise(how.bar)
        top = scored.filter(F.col("score") >= bar).groupBy("pattern").agg(F.max(F.struct("score", -F.col("of"))).alias("x"))
        best = settle(top.select("pattern", (-F.col("x.col2")).cast("int").alias("of"), F.col("x.score").alias("score")), "accepted")
        agreed = graph.join(best, "pattern").groupBy("instance", "of").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("score"))
        new = agreed.groupBy("instance").agg(F.max(F.struct("score", -F.col("of"))).alias("x"))
        new = new.join(seeds.select("instance"), "instance", "left_anti").select("instance", (-F.col("x.col2")).cast("int").alias("of"), F.col("x.score").alias("worth"))
        new = settle(new, "instances")
        if last is not None and last.select("instance").exceptAll(new.select("instance")).isEmpty() and new.select("instance").exceptAll(last.select("instance")).isEmpty():
            break
        last, accepted = new, seeds.unionByName(new)
    else:
        warnings.warn(f"after {how.rounds} rounds other instances are still accepted", stacklevel=2)
    return best.select("pattern", F.col("of").alias("kind"), "score")


def _best_of(known):
    """Puts to each mention the best of the given patterns that it has: (score, kind), beside what it had."""

    def run(batches):
        keys, kinds, scores = known.value
        for batch in batches:
            rows, had = batch.column("found").to_pylist(), batch.column("best").to_pylist()
            for r, old in zip(rows, had, strict=True):
                for i, f in enumerate(r):
                    if f["kind"] >= 0:
                        continue
                    at = np.searchsorted(keys, f["patterns"])
                    at[at == len(keys)] = 0
                    hit = at[keys[at] == f["patterns"]]
                    if len(hit):
                        top = max(zip(scores[hit].tolist(), (-kinds[hit]).tolist(), strict=True))
                        old[i] = max(old[i], {"score": top[0], "kind": -top[1]}, key=lambda x: (x["score"], -x["kind"]))
            yield batch.set_column(2, "best", pa.array(had, type=batch.schema.field("best").type))

    return run


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _spans(batches):
    """Entities, and of the marked mentions those that no better one overlaps (of equals the longer, then the first)."""
    for batch in batches:
        out = []
        for r, best in zip(batch.column("found").to_pylist(), batch.column("best").to_pylist(), strict=True):
            rows = [(f["start"], f["kind"], f["end"], None) for f in r if f["kind"] >= 0]
            marked = sorted((-b["score"], f["start"] - f["end"], f["start"], b["kind"], f["end"]) for f, b in zip(r, best, strict=True) if f["kind"] < 0 and b["score"] > 0)
            starts, taken = [], []
            for score, _, a, k, b in marked:
                at = int(np.searchsorted(starts, a))
                if (at == len(starts) or starts[at] >= b) and (at == 0 or taken[at - 1] <= a):
                    starts.insert(at, a)
                    taken.insert(at, b)
                    rows.append((a, len(KINDS) + k, b, -score))
            names = KINDS + FOUND
            out.append([{"kind": names[k], "start": a, "end": b, "score": s} for a, k, b, s in sorted(rows, key=lambda x: x[:3])])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, type=pa.list_(_SPAN))], ["doc_id", "spans"])


def extract(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive; score) in order, for each row of docs.

    Entities of regular forms (score null), and what the learned patterns introduce, as
    kind like_email, like_ip, like_card or like_phone with the score of its best pattern.
    A null or empty text has none; repeated rows are read one by one.
    """
    found = candidates(docs, row_shapes(docs, how.support))
    learned = settle(learn(found, how), "learned")
    n = learned.count()
    blocks = max(1, -(-n // how.block))
    out = found.withColumn("best", F.transform("found", lambda f: F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("kind"))))
    for k in range(blocks if n else 0):
        part = learned.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).orderBy("pattern").toArrow()
        known = tuple(part.column(c).to_numpy() for c in ("pattern", "kind", "score"))
        if len(known[0]):
            out = out.mapInArrow(_best_of(docs.sparkSession.sparkContext.broadcast(known)), out.schema)
    return out.mapInArrow(_spans, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """`extract` of documents: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all) and n_found
    (those that the method adds). A null or empty text has none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["score"].isNull())
    return extract(docs).select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_found"),
    )

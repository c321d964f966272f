"""Filter interaction audit against plain simulation of every order."""

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pathline.llm import audit

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def plain_fails(rows):
    """Letters that each (doc_id, text, lang) fails."""
    import re

    out = []
    for i, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        out.append(f + "E" * any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in rows))
    return out


def plain_audit(rows, labels):
    fails, out = plain_fails(rows), {}
    said = lambda i, k: i is not None and any(r[0] == i and r[k] == 1 for r in labels)
    for part in {r[2] or "" for r in rows}:
        mine = [(f, said(r[0], 1), said(r[0], 2)) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            here = list(mine)
            for k, x in enumerate(order):
                gone = [m for m in here if x in m[0]]
                here = [m for m in here if x not in m[0]]
                total[x] += len(gone)
                all_x = sum(x in m[0] for m in mine)
                out[part, "".join(order), k + 1] = (len(here), len(gone), all_x - len(gone), sum(m[0] == x for m in mine), sum(m[1] for m in gone), sum(m[2] for m in gone))
        for key in [k for k in out if k[0] == part]:
            out[key] += (total[key[1][key[2] - 1]],)
    return out


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


WORDS = " ".join(f"w{i}" for i in range(120))
ODD = [
    (1, WORDS, "en"), (2, WORDS, "en"), (3, WORDS, "de"), (3, WORDS, "de"), (3, "other " * 120, None), (None, WORDS, "en"), (None, None, None),
    (4, None, "en"), (5, "", "en"), (5, "", "fr"), (0, "", ""), (6, WORDS.upper(), "en"), (7, WORDS + " 5%", "en"), (8, "ÄÖÜ ABC\x0bx y", "fr"), (9, "AB" + "é" * 18, "fr"), (10, "AB" + "é" * 17, "fr"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (5, None, 1), (None, 1, 1), (99, 1, 1), (7, 1, 1), (7, 1, 1)]


def test_audit_as_simulated(spark):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ODD], DOCS + ", mask string, n long").repartition(3)
    labels = spark.createDataFrame([(*r, 5) for r in MARKS], LABELS + ", part int")
    df = audit.audit(audit.failing(docs, labels))
    want = plain_audit(ODD, MARKS)
    assert len(want) == 600 * 4 and got(df) == want and df.count() == len(want)
    assert dict(df.dtypes)["step"] == "int" and {dict(df.dtypes)[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} == {"bigint"}


def test_no_documents_or_labels(spark):
    none = spark.createDataFrame([], DOCS)
    assert audit.audit(audit.failing(none, spark.createDataFrame(MARKS, LABELS))).count() == 0
    df = audit.audit(audit.failing(spark.createDataFrame(ODD[:4], DOCS), spark.createDataFrame([], LABELS)))
    assert got(df) == plain_audit(ODD[:4], [])


def test_kernel_solution_is_the_shapley_value():
    for m in (2, 3, 5):
        for i, row in enumerate(audit.kernel_values(m)):
            for s, x in enumerate(row):
                k = s.bit_count()
                want = 0
                if s >> i & 1:
                    want = Fraction(factorial(m), m * comb(m - 1, k - 1))
                elif k < m:
                    want = -Fraction(factorial(m), m * comb(m - 1, k))
                assert x == want or s == 0  # v(none) is 0


def test_words_of_long_texts(monkeypatch):
    text = ("a b\tc  d\x1ce " * 5000 + "x" * 300 + " end").encode()
    whole = text.split()
    for piece in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(audit, "_PIECE", piece)
        assert [w for ws in audit._words(text) for w in ws] == whole


def test_one_text_for_a_third_of_all_rows(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "en") for i in range(3000)]
    df = audit.failing(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS))
    n = {r["mask"]: r["n"] for r in df.collect()}
    assert n == {1: 2001, 17: 999}

"""SimHash near-dedup against plain loops over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from pathline.llm import simhash
from pathline.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = [x.translate(LOWER) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(nodes, edges):
    """The smallest node that each reaches."""
    lead = {n: n for n in nodes}

    def top(n):
        while lead[n] != n:
            n = lead[n]
        return n

    for a, b in edges:
        x, y = top(a), top(b)
        lead[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def plain_groups(rows):
    known = [(i, plain_fingerprint(t)) for i, t in rows if i is not None]
    edges = [(a, b) for a, x in known for b, y in known if a < b and (x ^ y).bit_count() <= 4]
    return reach({i for i, _ in known}, edges)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def cloud(seed, centres=12, each=60):
    r = random.Random(seed)
    out = set()
    for _ in range(centres):
        z = r.getrandbits(64)
        for _ in range(each):
            v = z
            for p in r.choices(range(64), k=r.randrange(9)):
                v ^= 1 << p
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize("most", [4096, 25, 2, 1])
def test_links_connect_what_all_pairs_do(spark, most):
    fps = cloud(3)
    a = np.array(fps, dtype=np.uint64)
    edges = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4) + i + 1]
    want = reach(range(len(fps)), edges)
    links = simhash.similar(spark.createDataFrame([(signed(v),) for v in fps], "fp long"), most=most)
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links.collect()]
    assert all((x ^ y).bit_count() <= 4 or most == 1 for x, y in pairs)
    at = {v: k for k, v in enumerate(fps)}
    assert reach(range(len(fps)), [(at[x], at[y]) for x, y in pairs]) == want
    label = {r.node: r.component for r in components(links).collect()}
    assert len({label.get(signed(v), signed(v)) for v in fps}) == len(set(want.values()))


def test_links_stay_few_in_a_cloud():
    fps = np.array(sorted({1 << a | 1 << b for a in range(64) for b in range(64)}), dtype=np.uint64)
    fps = fps[(fps >> np.uint64(32)) == 0]  # four bytes shared by all
    pairs = simhash.connect(fps, np.zeros(len(fps), dtype=np.int64), np.full(len(fps), 0b11110000, dtype=np.uint8), 4)
    assert len(pairs) <= len(fps) - 1


def test_tally_and_fingerprints():
    r = random.Random(1)
    pairs = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(300)]
    pairs += [(a, a ^ (b & 0xFF00FF0000FFFF00)) for a, b in pairs] + [(5, 5)]
    one, two = (np.array(x, dtype=np.uint64) for x in zip(*pairs, strict=True))
    want = [sum(1 << p for p in range(8) if (a ^ b) >> 8 * p & 255 == 0) for a, b in pairs]
    assert simhash.tally(one, two).tolist() == want
    texts = ["", " \t\n", "One", "one TWO", "a b c d", "A b C d e\x0bf", "ÄÖ É x y z   w", "same " * 50, " ".join(map(str, range(500)))]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_SHINGLES", 64)
    assert simhash.fingerprint(text) == whole


def test_query_on_odd_rows(spark, tmp_path):
    base = [f"w{i}" for i in range(300)]
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (5, 50, 290)]
    rows = [(9, None), (4, ""), (7, " \t"), (20, " ".join(base)), (12, near[0]), (15, near[1]), (15, "quite another text"), (30, "quite another TEXT"), (None, near[2]), (None, None), (40, near[2]), (40, near[2]), (41, "x"), (42, "x")]
    rows += [(100 + i, "copy of a text with a few words") for i in range(50)]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fp string, component_id int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op12_simhash_near_dedup(spark, str(tmp_path)).collect())
    want = plain_groups(rows)
    assert got == sorted((str(i), f"{plain_fingerprint(t):016x}", str(want.get(i))) for i, t in rows)


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain_groups(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op12_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{plain_fingerprint(t):016x}", want[i]) for i, t in rows}


def test_no_rows(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0

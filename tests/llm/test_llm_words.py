"""Words whose regularity cancels out in a polynomial, through the queries that compare hashes of words."""

import hashlib

import pyarrow as pa
import pytest

from pathline.llm import contamination, jaccard, substrings
from pathline.llm.words import hashes, words_of

OTHER = str.maketrans("ab", "ba")


def thue_morse(n):
    """The first n letters of the sequence, and the same with its letters swapped."""
    w = "a"
    while len(w) < n:
        w += w.translate(OTHER)
    return w[:n], w[:n].translate(OTHER)


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_swapped_words_are_apart(n):
    a, b = thue_morse(n)
    w = words_of(pa.array([f"{a} {b}", f"x {b} {a}"]))
    one, two = hashes(w), hashes(w, 1)
    assert one[0] == one[4] and one[1] == one[3] and two[0] == two[4] and two[1] == two[3]
    assert one[0] != one[1] and two[0] != two[1] and one[0] != two[0]


def test_places_and_lengths_count():
    texts = ["abcdefgh", "abcdefghabcdefgh", "abcdefgh" * 3, "aaaaaaaabbbbbbbb", "bbbbbbbbaaaaaaaa", "a", "a\0", "a\0\0\0\0\0\0\0\0"]
    for seed in (0, 1):
        assert len(set(hashes(words_of(pa.array(texts)), seed).tolist())) == len(texts)


def test_hash_is_the_same_wherever_a_word_stands():
    text = "long" * 40_000 + " b " + "é" * 70_000 + " c long"
    w = words_of(pa.array([text, "c", "é" * 70_000, "long"]))
    h = hashes(w).tolist()
    assert h[5] == h[3] and h[6] == h[2] and h[7] == h[4] and len(set(h)) == 5


def test_queries_keep_swapped_words_apart(spark, tmp_path):
    a, b = thue_morse(2048)
    lead = "one two three four five six seven eight nine ten eleven twelve".split()
    texts = [a, b, " ".join([*lead, a]), " ".join([*lead, b]), " ".join([*lead, a])]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, b), (2, a + "x")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    one = {r.doc_id: r.n_removed for r in substrings.op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert one == {1: 0, 2: 0, 3: 0, 4: 0, 5: 13}
    eight = {r.doc_id: r.component_id for r in jaccard.op8_ngram_jaccard_join(spark, str(tmp_path)).collect()}
    assert eight == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3}  # 3 and 4 share 8 of 10 shingles
    nine = {r.doc_id: (r.n_hit, r.items_sha256) for r in contamination.op9_benchmark_decontamination(spark, str(tmp_path)).collect()}
    hit, none = hashlib.sha256(b"1").hexdigest(), hashlib.sha256(b"").hexdigest()
    assert nine == {1: (0, none), 2: (1, hit), 3: (0, none), 4: (1, hit), 5: (0, none)}

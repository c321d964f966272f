"""Filters, the pipeline, long texts and both sides of each broadcast on odd input."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathline.llm import batches, contamination, counts, jaccard, pieces, pii, quality, secrets, substrings
from test_llm_groups import corpus, plain_groups
from test_llm_queries import DOC, clashing, odd_rows

BENCH = "item_id long, text string"


def bench_of(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (None, "x"), (3, ""), (1, "one two")], BENCH)


#: Steps that return rows of their input; the third searches for a block at a time.
STEPS = {
    "quality": lambda d: quality.keep_good(d),
    "jaccard": lambda d: jaccard.one_of_each(d),
    "contamination": lambda d: contamination.decontaminate(d, bench_of(d.sparkSession)),
    "contamination in passes": lambda d: contamination.decontaminate(d, bench_of(d.sparkSession), block_bytes=5),
    "secrets": lambda d: secrets.redact(d),
}
NAMES = ("spans_", "spans", "digest", "hits", "row", "doc", "task", "kept", "n", "key1", "c", "m", "word.s")


def told(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def odd(spark):
    more = [(50, "token = abcdefghijklmn and one two", "en", "s", 34), (51, "one two", None, None, None)]
    return spark.createDataFrame([*odd_rows(), *more], DOC)


@pytest.mark.parametrize("name", sorted(STEPS))
def test_steps_on_odd_rows(name, odd, monkeypatch):
    monkeypatch.setattr(contamination, "PASS_BLOCKS", 1)
    step = STEPS[name]
    out = step(odd)
    assert out.columns == odd.columns and step(odd.limit(0)).collect() == []
    more = odd.withColumns({c.replace(".", "_"): F.lit(c) for c in NAMES})
    clashed = step(more)
    assert clashed.columns == more.columns and told(clashed) == told(out)
    assert all(r.spans_ == "spans_" for r in clashed.select("spans_").collect())


def test_what_steps_do_with_odd_rows(odd, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    # no words, null texts: gone for their number of words
    assert {i for i, _ in texts(STEPS["quality"](odd))} <= {0, 1, 2, None} and all(t for _, t in texts(STEPS["quality"](odd)))
    # rows without a number all stay; of repeated ones and copies one
    kept = texts(STEPS["jaccard"](odd))
    assert [i for i, _ in kept].count(None) == 2 and len([i for i, _ in kept if i == 6]) == 1 and 1 not in [i for i, _ in kept] and 7 not in [i for i, _ in kept]
    assert {3, 4, 5} <= {i for i, _ in kept}
    for name in ("contamination", "contamination in passes"):
        want = [(i, t and t.replace("one two", "")) for i, t in rows]
        # the item "x" has no id and is none; the empty ones have no words
        assert texts(STEPS[name](odd)) == sorted(want, key=str)
    want = [(i, t and t.replace("token = abcdefghijklmn", "[secret]")) for i, t in rows]
    assert texts(STEPS["secrets"](odd)) == sorted(want, key=str)


@pytest.mark.parametrize("size", ["odd", "none"])
def test_pipeline_on_odd_rows(spark, odd, tmp_path, size):
    docs = odd if size == "odd" else odd.limit(0)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    bench_of(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if size == "none":
        assert rows == []
    else:  # the two copies and the text that differs by a word are one group; the row without a number is alone
        assert sorted((r.doc_id for r in rows), key=str) == [0, None] and all(r.n_tokens == len(r.ids) > 0 for r in rows)


@pytest.fixture(scope="module")
def long_texts():
    """Texts beyond a piece and a chunk, copies of one another but for some words, and parts of them."""
    base = [f"w{k % 99991}q{k // 7 % 997}" for k in range(1_000_000)]
    near = base.copy()
    near[500_000:500_010] = ["other"] * 10
    part = base[700_000:700_020]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(part)), (4, "z" * 9_000_000), (5, "just a short one")]
    assert len(rows[0][1]) > 8 << 20
    return rows, part


def test_long_texts_in_groups(spark, long_texts):
    rows, _ = long_texts
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df).collect()}
    want = {}
    for i, t in rows:
        w = t.split()
        want[i] = (len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}), 1 if i == 2 else i)
    assert got == want


def test_long_texts_in_repeats(spark, long_texts):
    rows, part = long_texts
    every, cut = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_words for r in every.collect()} == {i: len(t.split()) for i, t in rows}
    got = {r.doc_id: (r.n_removed, r.kept) for r in cut.collect()}
    assert got == {2: (1_000_000 - 10, " ".join(["other"] * 10)), 3: (len(part), "")}


def test_long_texts_elsewhere(spark, long_texts):
    rows, part = long_texts
    rows = [(i, t + f" token = abcdefghijkl{i}" if i < 3 else t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in secrets.scan(df).collect()}
    size = {i: len(t) for i, t in rows}
    assert all(("assign", size[i] - 21, size[i]) in found[i] for i in (1, 2)) and not found[4]
    items = spark.createDataFrame([(7, " ".join(part))], BENCH)
    hit = {r.doc_id: [tuple(s) for s in r.spans] for r in contamination.contamination(df, items).collect()}
    assert hit == {1: [(700_000, 700_020)], 2: [(700_000, 700_020)], 3: [(0, 20)], 4: [], 5: []}
    read = {r.doc_id: r.spans for r in pii.extract(df.withColumn("text", F.concat("text", F.lit(" me@x.org")))).collect()}
    assert all([(s.kind, s.end - s.start) for s in read[i]] == [("email", 8)] for i in read) and len(read) == 5
    short = df.filter("doc_id > 3")
    assert {r.doc_id for r in counts.count_tokens(short, public_tokenizers.path("word_bpe_49k.json")).collect()} == {4, 5}
    assert {r.doc_id for r in pieces.encode_decode(short, public_tokenizers.path("piece_bpe_32k.model")).collect()} == {4, 5}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_sent_or_shuffled(spark, sf_dir, monkeypatch, most):
    """The same rows whether ids and places are sent to all executors or joined by a shuffle."""
    for module in (batches, jaccard, substrings):
        monkeypatch.setattr(module, "BROADCAST_IDS", most)
    if not most:
        monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(contamination, "BROADCAST_TEXTS", 0)
    rows = corpus(3, groups=4)
    df = spark.createDataFrame(rows, DOC)
    label = plain_groups(rows)
    assert {r.doc_id: r.component_id for r in jaccard.similar_groups(df).collect()} == label
    assert sorted(r.doc_id for r in jaccard.one_of_each(df).collect()) == sorted(set(label.values()))
    every, cut = substrings.repeats(clashing(df))
    from test_llm_groups import plain_repeats

    want = plain_repeats(rows)
    cut = {r.doc_id: (r.n_removed, r.kept) for r in cut.collect()}
    for r in every.collect():
        n, gone, kept = want[r.doc_id]
        assert r.n_words == n and ((n, "") == (gone, kept) if r.copy else cut.get(r.doc_id, (0, " ".join(rows[r.doc_id][1].split()))) == (gone, kept))

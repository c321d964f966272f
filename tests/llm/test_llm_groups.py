"""Joins, repeats, contamination, shards and the pipeline against brute force on small tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pathline.llm import batches, components, contamination, exchange, fmindex, jaccard, shards, substrings, words

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def mutated(rnd, base, rate):
    return [f"m{rnd.randrange(10**9)}" if rnd.random() < rate else w for w in base]


def corpus(seed, groups=6, size=12, length=80):
    rnd, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rnd.randrange(400)}" for _ in range(length)]
        out += [" ".join(mutated(rnd, base, rnd.choice((0, 0.005, 0.02, 0.1)))) for _ in range(size)]
    rnd.shuffle(out)
    return [(k, t, "en", "s", len(t)) for k, t in enumerate(out)]


def plain_sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = [x for x in t.lower().split()]
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_groups(rows):
    sets = plain_sets(rows)
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


@pytest.mark.parametrize("block", [1000, 4])
def test_groups_as_brute_force(spark, monkeypatch, block):
    """Also with blocks so small that most groups are cut into several."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rows = corpus(3)
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(rows, DOC)).collect()}
    assert got == plain_groups(rows)


def test_a_chain_of_links_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(base[3 * k : 3 * k + 100]), "en", "s", 1) for k in range(40)]
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(rows, DOC)).collect()}
    assert got == plain_groups(rows)


def test_t_occurrence_as_all_pairs():
    rnd = np.random.default_rng(5)
    for _ in range(30):
        base = np.unique(rnd.integers(0, 2**60, 60).astype(np.uint64))
        sets = [np.unique(np.concatenate([rnd.choice(base, rnd.integers(30, 60), replace=False), rnd.integers(0, 2**60, rnd.integers(0, 6)).astype(np.uint64)])) for _ in range(25)]
        links = jaccard.t_occurrence(sets, list(range(25)))
        like = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert all(like(sets[a], sets[b]) for a, b in links)

        def label(pairs):
            g = np.arange(25)
            for a, b in pairs:
                g[g == g[a]] = g[b]
            return [min(np.flatnonzero(g == x)) for x in g]

        assert label(links) == label([(a, b) for a in range(25) for b in range(a) if like(sets[a], sets[b])])


def templates(seed, count, words=120, low=0, high=60):
    """Texts of one template, each with words of its own behind it, of several sizes; some drop a bit of the template."""
    rnd = random.Random(seed)
    base = [f"t{k}" for k in range(words)]
    rows = []
    for k in range(count):
        w = base + [f"own{k}.{j}" for j in range(rnd.randint(low, high))]
        if rnd.random() < 0.3:
            at = rnd.randrange(words)
            del w[at : at + rnd.randint(1, 12)]
        rows.append((k, " ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize(("low", "high", "block"), [(0, 60, 5), (8, 30, 5), (17, 60, 5), (8, 30, 256)])
def test_templates_as_brute_force(spark, monkeypatch, low, high, block):
    """Sets about as alike as asked for: some link, some do not, and all have most shingles in common."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rows = templates(low + high, 70, low=low, high=high)
    want = plain_groups(rows)
    assert 1 < len(set(want.values())) <= len(rows)
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(rows, DOC)).collect()}
    assert got == want


def test_sets_of_a_template_meet_nowhere(spark):
    """Where all share a template and nothing links, prefixes lead nowhere: no loose group, so no search."""
    rows = [(k, " ".join([f"t{j}" for j in range(200)] + [f"own{k}.{j}" for j in range(32)]), "en", "s", 1) for k in range(300)]
    sets = [(k, len(s), s.view(np.int64).tolist()) for k, s in enumerate(jaccard.shingle_sets(pa.array([r[1] for r in rows])))]
    prefix = jaccard._prefixes(spark.createDataFrame(sets, "class_id long, n long, tokens array<long>"), 80)
    assert jaccard._loose(prefix).isEmpty()
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {k: k for k in range(300)}


def test_t_occurrence_with_shingles_that_all_have():
    rnd = np.random.default_rng(9)
    for percent in (50, 80, 95):
        for _ in range(20):
            base = np.arange(1, 81, dtype=np.uint64)
            own = iter(range(1000, 10**6))
            sets = [np.array([*base[: rnd.integers(60, 81)], *(next(own) for _ in range(rnd.integers(0, 40)))], dtype=np.uint64) for _ in range(20)]
            links = jaccard.t_occurrence(sets, list(range(20)), percent)
            label = np.arange(20)
            for a, b in links:
                label[label == label[a]] = label[b]
            for a in range(20):
                for b in range(a):
                    like = 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))
                    assert not like or label[a] == label[b]
                    assert like or (a, b) not in links and (b, a) not in links


def test_unlike_texts_of_one_doc_id_are_one_document(spark):
    """Groups that only a repeated doc_id connects are one, also by a text of it that is like no other."""
    a, b, c, d = ([f"{x}{k}" for k in range(60)] for x in "abcd")
    like = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, a), (5, b), (7, a), (8, like(a)), (9, like(b)), (3, c), (6, like(c)), (6, d), (6, b), (4, d[:9]), (4, a[:9])]
    docs = spark.createDataFrame([(k, w if isinstance(w, str) else " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect())
    assert got == sorted((k, 5 if k == 4 else 56, 4 if k == 4 else 3) for k, _ in rows)


def test_one_of_each_group_stays(spark):
    rows = corpus(8, groups=3)
    df = spark.createDataFrame([*rows, rows[0], (None, "x", None, None, 1)], DOC)
    want = {i for i, m in plain_groups(rows).items() if i == m}
    got = [r.doc_id for r in jaccard.one_of_each(df).collect()]
    assert sorted(got, key=str) == sorted([*want, None], key=str)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 102: 100}


# --- repeats -----------------------------------------------------------------------------------


def plain_repeats(rows, n=13):
    first, out = {}, {}
    for i, t, *_ in rows:
        w = t.split()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    for i, t, *_ in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_repeats_as_brute_force(spark):
    rnd = random.Random(2)
    shared = [[f"p{rnd.randrange(50)}" for _ in range(rnd.randint(10, 40))] for _ in range(5)]
    rows = []
    for k in range(60):
        parts = [[f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 25))] for _ in range(3)]
        parts.insert(1, rnd.choice(shared)[rnd.randint(0, 3) :])
        rows.append((k, " ".join(w for p in parts for w in p), "en", "s", 1))
    rows += [(60, rows[0][1], "en", "s", 1), (61, " ".join(["same"] * 40), "en", "s", 1), (62, " ".join(["same"] * 20), "en", "s", 1)]
    every, cut = substrings.repeats(spark.createDataFrame(rows, DOC))
    cut = {r.doc_id: (r.n_removed, r.kept) for r in cut.collect()}
    want = plain_repeats(rows)
    for r in every.collect():
        n, gone, kept = want[r.doc_id]
        assert r.n_words == n
        text = " ".join(next(x[1] for x in rows if x[0] == r.doc_id).split())
        assert (n, "") == (gone, kept) if r.copy else cut.get(r.doc_id, (0, text)) == (gone, kept)


# --- contamination -----------------------------------------------------------------------------


def test_index_finds_every_place():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        s = rnd.integers(0, 4, rnd.integers(1, 200))
        index = fmindex.FMIndex(s)
        sizes = rnd.integers(1, 6, 12)
        phrases = np.zeros((12, 6), dtype=np.int64)
        for k, n in enumerate(sizes):
            phrases[k, :n] = rnd.integers(1, 5, n)
        lo, hi = index.search(phrases.ravel(), np.arange(12) * 6, sizes)
        for k, n in enumerate(sizes):
            want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == phrases[k, :n]).all()]
            assert sorted(index.locate(np.arange(lo[k], max(lo[k], hi[k]))).tolist()) == want


def test_a_shard_is_indexed_once_for_all_blocks(monkeypatch):
    rnd = np.random.default_rng(5)
    said = lambda n: " ".join(f"w{k}" for k in rnd.integers(0, 30, n))
    items = [(k, said(int(n))) for k, n in enumerate(rnd.integers(1, 40, 60))] + [(60, "never said")]
    texts = pa.array([said(400) + " " + items[k][1] for k in range(0, 60, 3)] + [None, "", "never"])
    made = []
    real = contamination.FMIndex
    monkeypatch.setattr(contamination, "FMIndex", lambda s: made.append(1) or real(s))
    one = list(contamination.search_texts(texts, contamination.Pass([contamination.phrases_of(items)])))
    assert len(made) == 1 and any(x[3] for x in one) and not any(60 in x[3] for x in one)
    many = list(contamination.search_texts(texts, contamination.Pass([contamination.phrases_of(items[k : k + 4]) for k in range(0, 61, 4)])))
    assert len(made) == 2 and many == one


@pytest.mark.parametrize("at_once", [12, 3])
def test_blocks_of_phrases_change_nothing(spark, sf_dir, monkeypatch, at_once):
    monkeypatch.setattr(contamination, "PASS_BLOCKS", at_once)
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one = contamination.contamination(docs, bench)
    many = contamination.contamination(docs, bench, block_bytes=2000)
    order = lambda df: sorted((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in df.collect())
    assert order(one) == order(many) and any(x[2] for x in order(one))


def test_passages_are_cut_out(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, item), (2, "Short, item!")], "item_id long, text string")
    rows = [(1, f"Start here. {item.upper()}, and on", "en", "s", 1), (2, "a short item b", "en", "s", 1), (3, "alpha beta gamma", "en", "s", 1), (4, None, "en", "s", None)]
    out = {r.doc_id: (r.text, r.n_chars) for r in contamination.decontaminate(spark.createDataFrame(rows, DOC), bench).collect()}
    assert out == {1: ("Start here. , and on", 20), 2: ("a  b", 4), 3: ("alpha beta gamma", 16), 4: (None, None)}


@pytest.mark.parametrize(("at_once", "most"), [(12, 10), (2, 10), (2, 0)])
def test_blocks_of_phrases_cut_as_one(spark, monkeypatch, at_once, most):
    """Items that overlap, meet or share a context lie in different blocks and passes, and are cut as from one."""
    monkeypatch.setattr(contamination, "PASS_BLOCKS", at_once)
    monkeypatch.setattr(contamination, "BROADCAST_TEXTS", most)
    rnd = random.Random(4)
    line = [f"c{k}" for k in range(60)]
    items = [" ".join(line[k : k + 14]) for k in range(0, 46, 3)] + ["who was it", "c55 c56", "left right"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [" ".join(["Before:", *line[rnd.randrange(20) :], "who was it, then?"]) for _ in range(20)]
    texts += ["so left " + items[0] + " right", "é " + ", ".join(line[:14]) + " ... " + items[8], "none", None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOC)
    out = lambda n: {r.doc_id: (r.text, r.n_chars) for r in contamination.decontaminate(docs, bench, block_bytes=n).collect()}
    one = out(1 << 20)
    assert one == out(40) == out(200)
    assert one[20] == ("so left  right", 14) and one[21] == ("é ", 2) and one[22][0] == "none" and one[23] == (None, None)


# --- shards ---------------------------------------------------------------------------------------


def test_store_keeps_rows_and_versions(spark):
    store = shards.ShardStore(spark, f"{batches.shared_dir(spark)}/store-test", shards.Tiers(target_bytes=1 << 20))
    assert store.manifest() is None and store.compact() == 0
    for k in range(4):
        rows = spark.range(100 * k, 100 * k + 100).selectExpr("id AS doc_id", "repeat('x', 50) AS text")
        assert store.append(rows.coalesce(1)) == k + 1
    before = store.manifest()
    assert before.count() == 4
    assert store.compact() == 5 and store.manifest().count() == 1
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(400))
    assert store.read(2).count() == 200  # old versions can be read until they are removed
    assert store.compact() == 5  # nothing to do
    assert store.vacuum() == 0 and store.versions() == [5]  # too young
    assert store.vacuum(grace_seconds=0) == 4 and store.read().count() == 400


def test_two_writers_lose_nothing(spark):
    """The slower of two writers commits after the faster one; of two that merge the same runs one gives way."""
    root = f"{batches.shared_dir(spark)}/store-two"
    one, two = shards.ShardStore(spark, root), shards.ShardStore(spark, root)
    rows = lambda k: spark.range(10 * k, 10 * k + 10).selectExpr("id AS doc_id").coalesce(1)
    for k in range(4):
        one.append(rows(k))
    publish = two._publish

    def late(manifest, version):
        two._publish = publish
        one.append(rows(4))  # takes the version that two is about to write
        return publish(manifest, version)

    two._publish = late
    assert two.append(rows(5)) == 6
    assert sorted(r.doc_id for r in one.read().collect()) == list(range(60))

    def merged_before(manifest, version):
        two._publish = publish
        one.compact()
        return publish(manifest, version)

    two._publish = merged_before
    two.compact()
    assert sorted(r.doc_id for r in two.read().collect()) == list(range(60)) and one.manifest().count() == 1


def test_store_of_no_rows_and_of_any_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    store, came = shards.compacted(none)
    assert came == 0 and store.read().collect() == [] and store.read().columns == ["doc_id", "text"]
    names = "doc_id long, text string, arrival string, Arrival_ string, run int"
    odd = spark.createDataFrame([(None, None, "a", "b", 1), (3, "x", None, "b", 2), (3, "x", None, "b", 2)], names)
    store, came = shards.compacted(odd)
    assert came == 2 and store.read().columns == odd.columns
    assert sorted(map(str, store.read().collect())) == sorted(map(str, odd.collect()))


def test_merged_files_have_the_target_size(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "sha2(cast(id AS string), 256) AS text").repartition(16)
    store, came = shards.compacted(docs, tiers=shards.Tiers(target_bytes=256 << 10))
    facts = store.manifest().collect()
    assert came == 16 and sum(r.rows for r in facts) == 40_000
    large = [r for r in facts if r.bytes > 1 << 20]
    assert large and all(128 << 10 < r.bytes / r.files < 512 << 10 for r in large)


# --- helpers ---------------------------------------------------------------------------------------


def test_places_are_packed():
    rnd = np.random.default_rng(1)
    for most in (1, 300, 5000):
        places = np.cumsum(rnd.integers(0, most, 500))
        assert (exchange.unpack_places(exchange.pack_places(places)) == places).all()
    assert len(exchange.unpack_places(exchange.pack_places(np.zeros(0, dtype=np.int64)))) == 0


def test_words_of_a_column():
    texts = [" a bb\tccc", None, "", "é中 x", "word", "word two", "\n"]
    column = pa.array(["skip", *texts]).slice(1)
    w = words.words_of(column)
    said = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert said == [x for t in texts for x in (t or "").split()]
    assert np.diff(w.first).tolist() == [3, 0, 0, 2, 1, 2, 0]
    h = words.hashes(w)
    assert h[said.index("word")] == h[len(said) - 2] and len(set(h.tolist())) == len(set(said))
    assert words.windows(h, 2).shape == (len(h) - 1,)


# --- the pipeline ------------------------------------------------------------------------------------


def test_pipeline_as_brute_force(spark, sf_dir):
    """run() against the stages in plain Python, one document after another."""
    import re

    import public_tokenizers
    import sentencepiece

    from pathline.llm import quality, secrets

    def good(t):
        w = t.split(" ") if False else re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen, gone = {}, set()
        for x in tri:
            seen[x] = seen.get(x, 0) + 1
        for k, x in enumerate(tri):
            if seen[x] > 1:
                gone |= {k, k + 1, k + 2}
        n = len(w)
        if not 50 <= n <= 100_000 or gone and len(gone) / n > 0.5 or not 2 <= sum(map(len, w)) / n <= 14:
            return False
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return sum(c in "#*$%&|<>" for c in t) / n <= 0.1 and sum(x in set(quality.STOP_WORDS) for x in w) / n >= 0.01 and (len(lines) - len(set(lines))) / len(lines) <= 0.5

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if good(r.text)]
    label = plain_groups([(i, t) for i, t in rows])
    rows = [(i, t) for i, t in rows if label[i] == i]
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = split.findall(r.text.translate(low))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in rows:
        at = list(split.finditer(t.translate(low)))
        hit = set()
        for n in {len(x) for x in windows}:
            for k in range(len(at) - n + 1):
                if tuple(m[0] for m in at[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        out, past = [], 0
        for k in range(len(at)):
            if k in hit and k - 1 not in hit:
                out.append(t[past : at[k].start()])
            if k in hit:
                past = at[k].end()
        t = "".join([*out, t[past:]])
        found = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, t) if m.end(r.group) - m.start(r.group) >= r.least)
        out, past = [], 0
        for a, b in found:
            if a >= past:
                out += [t[past:a], "[secret]"]
            past = max(past, b)
        want[i] = lib.encode("".join([*out, t[past:]]))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and len(got) > 50


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns

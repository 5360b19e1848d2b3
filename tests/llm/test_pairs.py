"""Near duplicates and cross-split overlaps against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import crosssplit, neardup
from corpusmill.llm import kernels as K
from corpusmill.operators.components import connected_components

SCHEMA = "row_seq long, article_text string, id string, text string, class string"


def corpus(n=160, seed=5):
    """Texts of a small vocabulary, with copies, edits, insertions and reorderings."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, k=r.randint(20, 60))) for _ in range(n // 2)]
    while len(texts) < n:
        w = r.choice(texts[: n // 2]).split()
        kind = r.randrange(4)
        if kind == 0:
            pass
        elif kind == 1:
            for _ in range(r.randint(1, 5)):
                w[r.randrange(len(w))] = r.choice(words)
        elif kind == 2:
            at = r.randrange(len(w))
            w[at:at] = r.choices(words, k=r.randint(1, 15))
        else:
            at = r.randrange(len(w))
            w = w[at:] + w[:at]
        texts.append(" ".join(w).upper() if r.random() < 0.2 else ", ".join(w))
    return texts


def brute(texts, t, width):
    s = [K.shingles(x, width) for x in texts]
    out = set()
    for a, b in combinations(range(len(texts)), 2):
        same = not s[a] and not s[b] and K.words(texts[a]) and K.words(texts[a]) == K.words(texts[b])
        if same or K.similarity(s[a], s[b]) >= t:
            out.add((a, b))
    return out


@pytest.mark.parametrize(("t", "width"), [(0.5, 3), (0.8, 5), (0.3, 2), (1.0, 3)])
def test_pairs_equal_brute_force(spark, t, width):
    texts = [*corpus(), None, "", " . ! ", "one two", "One, two!", "word", "x " * 3000, "x " * 3000 + "y"]
    rows = [(i, x, "clash", "clash", "clash") for i, x in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0], (None, texts[0], "a", "b", "c")], SCHEMA).repartition(5)
    got = {(r.a, r.b) for r in neardup.near_duplicate_pairs(df, "row_seq", "article_text", t, width).records().collect()}
    assert got == brute(texts, t, width)


def test_buckets_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_ENTRIES", 100)
    base = corpus(40)
    texts = base + [base[0]] * 60 + [base[0] + f" tail{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "row_seq long, article_text string").repartition(7)
    p = neardup.near_duplicate_pairs(df, "row_seq", "article_text", 0.5, 3)
    assert {(r.a, r.b) for r in p.records().collect()} == brute(texts, 0.5, 3)
    classes = {r.id: r for r in p.classes().collect()}
    assert len(classes) == len(texts)
    assert classes[40].class_id == 0 and classes[0].class_size >= 61
    groups = {r.node: r.component for r in connected_components(p.edges(), "a", "b").collect()}
    assert groups[classes[100].class_id] == 0


def test_hot_tokens_meet_in_a_grid(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 6)
    r = random.Random(7)
    hot = "one hot phrase of a few words that many texts begin with"
    texts = [f"{hot} {' '.join(r.choices('abcdefghij', k=r.randint(0, 14)))}" for _ in range(90)] + corpus(40)
    df = spark.createDataFrame(list(enumerate(texts)), "row_seq long, article_text string").repartition(4)
    for t in (0.5, 0.8):
        p = neardup.near_duplicate_pairs(df, "row_seq", "article_text", t, 3)
        assert {(r.a, r.b) for r in p.records().collect()} == brute(texts, t, 3)


def test_bytes_sent_do_not_grow_with_the_buckets():
    class Shared:
        value = np.zeros(1 << K.SKETCH_BITS, np.uint8)

    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array([" ".join(r.choices(words, k=160)) for _ in range(1500)])], ["id", "text"])
    sent = {}
    for buckets in (8, 1500):
        blobs = [x.as_py() for b in neardup._prefixes(Shared, buckets, 3, 0.5, neardup.HOT)(iter([batch])) for x in b.column(1)]
        sent[buckets] = sum(len(x) for x in blobs)
    assert sent[1500] < 1.2 * sent[8] < 1.2 * 1500 * 1600


def test_chance_pairs_are_not_shuffled():
    """Texts of few words share a rare shingle now and then; what is put out for that must stay far below one pair for each."""
    r = random.Random(4)
    texts = [" ".join(r.choices([f"w{i}" for i in range(40)], k=220)) for _ in range(3000)]
    flat, words = K.word_hashes(texts, K.WordHashes())
    key, _ = K.shingle_sets(flat, words, 3)

    class Shared:
        value = K.quantised(np.bincount(K.bucket_of(key), minlength=1 << K.SKETCH_BITS))

    def rows(f, blobs):
        blobs = sorted(blobs, key=lambda x: x[0])
        b = pa.RecordBatch.from_arrays([pa.array([x[0] for x in blobs], pa.int32()), pa.array([x[1] for x in blobs], pa.binary())], ["bucket", "data"])
        return [(k, x.as_py()) for b in f(iter([b])) for k, x in zip(b.column(0).to_pylist(), b.column(1))]

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    sent = [(k, x.as_py()) for b in neardup._prefixes(Shared, 32, 3, 0.5, neardup.HOT)(iter([batch])) for k, x in zip(b.column(0).to_pylist(), b.column(1))]
    met = rows(neardup._met(0.5, 8, 6), sent)
    assert sum(len(neardup.unpack(x, 3)[0]) for k, x in met if k >= 0) < 0.02 * len(texts) ** 2 / 2


@pytest.mark.parametrize("t", [0.5, 0.8])
def test_texts_of_all_sizes(spark, t):
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for n in (3, 8, 17, 18, 31, 33, 64, 130, 140, 257, 400, 900):
        base = r.choices(words, k=n)
        texts.append(base)
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, int(n * (1 - t) / 3))):
                w[r.randrange(n)] = r.choice(words)
            texts.append(w[: n - r.randint(0, int(n * (1 - t)))])
    texts = [" ".join(w) for w in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "row_seq long, article_text string").repartition(4)
    want = brute(texts, t, 3)
    assert len(want) > 60 and {(x.a, x.b) for x in neardup.near_duplicate_pairs(df, "row_seq", "article_text", t, 3).records().collect()} == want


def test_no_rows(spark):
    df = spark.createDataFrame([], "row_seq long, article_text string")
    p = neardup.near_duplicate_pairs(df, "row_seq", "article_text")
    assert p.records().count() == 0 and p.classes().count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=0, max_size=25), min_size=2, max_size=12), st.sampled_from([0.3, 0.5, 0.8]), st.integers(1, 6))
def test_prefix_filters_lose_nothing(sets, t, k):
    """Every pair at or above the threshold shares enough tokens within the prefixes."""
    sets = [sorted(set(s)) for s in sets if s]
    token = np.array([x for s in sets for x in s], np.uint64)
    n = np.array([len(s) for s in sets for _ in s])
    ids = np.array([i for i, s in enumerate(sets) for _ in s])
    place = np.array([p for s in sets for p in range(len(s))])
    if not len(token):
        return
    keep = place < K.probe_length(n, t, k)
    seen: dict = {}
    for a, b, c in K.prefix_pairs(token[keep], n[keep], ids[keep], place[keep], t, k, chunk=7):
        for x, y, z in zip(a, b, c):
            key = tuple(sorted((int(x), int(y))))
            seen[key] = seen.get(key, 0) + int(z)
    for a, b in combinations(range(len(sets)), 2):
        if K.similarity(set(sets[a]), set(sets[b])) >= t:
            need = min(k, int(K.least_common(np.array([len(sets[a]) + len(sets[b])]), t)[0]))
            assert seen.get((a, b), 0) >= need


def test_bitmap_bounds_the_overlap():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 400, r.integers(1, 300))).astype(np.uint64) for _ in range(2))
        key = np.concatenate([a, b | np.uint64(1 << K.TOKEN_BITS)])
        bits = neardup.bitmaps(key, 2)
        apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert (len(a) + len(b) - apart) // 2 >= len(np.intersect1d(a, b))


def test_cross_split_equals_brute_force(spark):
    texts = corpus(120, 9)
    ev = [(f"e{i}", [None, "", " nan", f" U{i} ", "shared"][i % 5], t, "x") for i, t in enumerate(texts[:30] + [None, "", "a b"])]
    tr = [(f"t{i}", ["<NA>", "none", f"u{i % 40}", "SHARED", None][i % 5], t, "x") for i, t in enumerate(texts[30:] + [None, "", "a b", texts[3]])]
    s = "{} string, uri string, article_text string, tid string"
    e, t = spark.createDataFrame([*ev, ev[0]], s.format("bid")), spark.createDataFrame([*tr, tr[-1]], s.format("sid"))
    got = {(r.eval_id, r.train_id): (r.same_uri, r.similarity) for r in crosssplit.overlap(e, t, "bid", "sid", threshold=0.5, width=3).collect()}
    none = {"", "nan", "none", "<na>"}
    want = {}
    for a in ev:
        for b in tr:
            u = a[1] is not None and b[1] is not None and a[1].strip().lower() == b[1].strip().lower() and a[1].strip().lower() not in none
            sim = K.similarity(K.shingles(a[2], 3), K.shingles(b[2], 3))
            if u or sim >= 0.5:
                want[a[0], b[0]] = (u, sim if sim >= 0.5 else None)
    assert got.keys() == want.keys()
    for k, (u, sim) in want.items():
        assert got[k][0] == u and got[k][1] == pytest.approx(sim)
    empty = t.limit(0)
    assert crosssplit.overlap(e.limit(0), t, "bid", "sid").count() == 0 == crosssplit.overlap(e, empty, "bid", "sid").where("not same_uri").count()

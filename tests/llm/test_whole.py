"""Operators that must do the whole job: lost bytes, passages in long texts, labels of a language, whole tables."""

import re

import numpy as np
import pyarrow as pa

from corpusmill.llm import counts, encoding, language, queries, reading
from corpusmill.session import table


def latin(t):
    return "".join(map(chr, t.encode()))


def test_lost_bytes_are_wildcards():
    words = ["схвалив", "сухих", "рада", "закон", "та", "їх", "хто", "право", "захист", "с", "ходи"]
    m = encoding.build([(w, 50 + i) for i, w in enumerate(words)])
    t = "закон та схвалив сухих їх хто Рада право закон"
    for bad in (latin(t), latin(latin(t))):
        # 0x85 and 0xA0 were white space and collapsed
        assert m.restore(re.sub(r"\s+", " ", bad)) == (t, 1, 0)
    # a byte replaced, and one dropped
    assert m.restore(latin("закон та право").replace("\xbf", "�")) == ("закон та право", 1, 0)
    assert m.restore(latin("закон та право").replace("\xbf", "")) == ("закон та право", 1, 0)
    m = encoding.build([("società", 80), ("una", 50), ("libertà", 60), ("perché", 70)])
    assert m.restore(re.sub(r"\s+", " ", latin(latin("perché libertà una società"))).strip()) == ("perché libertà una società", 1, 0)


def test_words_of_any_length():
    m = encoding.build([("été", 40), ("marché", 50), ("le", 90)])
    for w in ("é" * 600, "x" * 9999 + "é", "é" * 10000, "Ã©" * 5000, "\u0436" * 10000, "Ã" * 10000 + "\xa0 b"):
        t = f"le marché {w} été"
        assert np.isfinite(m.word(w)) and m.garbled(t) in (True, False)
        got, spans, lost = m.restore(t)
        assert got.startswith("le marché ") and got.endswith(" été")
        assert m.restore(f"le marchÃ© {w} le")[0].startswith("le marché ")
    model = language.build([("le", [10.0 if l == "fr" else 0.0 for l in language.LANGUAGES])])
    assert np.isfinite(model.scores(["é" * 10000, "ж" * 10000])).all()


def test_counts_of_any_vocabulary(spark, small, monkeypatch):
    words = [(f"w{i}é", 1 + 5000 // (i + 1), i % 3) for i in range(4000)]
    df = spark.createDataFrame([*words, (None, 3, 1)], "w string, a long, b long").repartition(3)
    everything, none = counts.head_and_tail(df, 4000)
    assert none is None and sorted(everything) == sorted(words)
    head, rest = counts.head_and_tail(df, 300)
    assert 200 < len(head) <= 300 and min(r[1] + r[2] for r in head) > max(r.a + r.b for r in rest.collect())
    tail = counts.sketch(rest, lambda w, n: w != "w3999é")
    held = {r[0] for r in head}
    for w, a, b in words:
        if w not in held and w != "w3999é":
            assert a <= 1.08 * tail.counts(w)[0] + 1e-9 and b <= tail.counts(w)[1] and tail.counts(w)[0] <= 1.08 * a + 2
    assert (tail.counts("w3999é") == 0).all() and tail.total[0] == sum(a for w, a, _ in words[:-1] if w not in held)
    # decisions with few words held are those with all of them held
    found = []
    for limit in (counts.HEAD, 400):
        monkeypatch.setattr(counts, "HEAD", limit)
        found.append([{tuple(r) for r in f(spark, small).collect()} for f in (queries.p2_found, queries.p4_found)])
    for a, b in zip(*found):
        assert len(a & b) >= 0.97 * len(a | b)


def test_every_word_counts_exactly(spark, small, monkeypatch):
    # words that are not held by a task are candidates like any other, with their own counts
    t = queries._texts(spark, small)
    text = t["raw_news"].union(t["cleaned_articles"]).select("text")
    rare = "Přibyslavská dvacetihaléřová"
    text = text.union(spark.createDataFrame([(rare,)] * 6, "text string"))
    bad = spark.createDataFrame([(1, latin(rare)), (2, rare.replace("ř", "\ufffd", 1)), (3, latin(rare).replace("\x99", "\ufffd"))], "row_seq long, text string")
    texts = t["raw_news"].union(bad)
    found = []
    for limit in (counts.HEAD, 400):
        monkeypatch.setattr(counts, "HEAD", limit)
        m = encoding.fit(text, "text")
        found.append((m, {tuple(r) for r in encoding.restored(texts, "row_seq", "text", m).collect()}, {r[0] for r in encoding.garbled_rows(texts, "row_seq", "text", m).collect()}))
    (a, *x), (b, *y) = found
    assert x == y and a.total == b.total
    assert a.words is None and len(b.counts) <= 400 < len(b.words) and a.longest == b.longest
    assert a.chars.keys() == b.chars.keys() and all(abs(a.chars[g] - b.chars[g]) < 1e-6 * a.chars[g] for g in a.chars)
    assert all((n or 0) == b.words.get(w) for w, n in a.counts.items()) and all(b.masked.get(m) == w for m, w in a.masked.items())
    assert (1, rare, 1, 0) in x[0] and b.masked.get("xyz\ufffd") is None


def test_both_models_from_one_scan(spark, small):
    t = queries._labelled(spark, small)
    model, channel = language.fit_both(list(t.values()))
    apart = language.fit(list(t.values()))
    assert model.words == apart.words and np.allclose(model.rows, apart.rows) and np.allclose(model.chars, apart.chars)
    text = t["cleaned_articles"].select("text").union(t["documents"].select("text"))
    other = encoding.fit(text, "text")
    assert channel.counts == other.counts and channel.total == other.total and channel.masked == other.masked
    none = [x.limit(0) for x in t.values()]
    model, channel = language.fit_both(none)
    assert language.unlabelled(none[0], "row_key", "text", "label", model, channel).count() == 0


def test_portions_of_texts():
    t = ["a" * 700_000, "b" * 700_000, None, "", "c" * 3_000_000, *["d"] * 1200]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(t)], ["d", "t"])
    got = list(reading._portions(b))
    assert [x for _, p in got for x in p] == t and [i for s, _ in got for i in s.column(0).to_pylist()] == list(range(len(t)))
    assert [len(p) for _, p in got] == [1, 3, 1, 512, 512, 176]
    n = np.array([3, 0, 5])
    m = reading.Letters(np.arange(8, dtype=np.uint64), np.ones((5, 8)))
    assert np.isfinite(reading._means(m.surprisals(np.arange(8, dtype=np.uint64) + np.uint64(4)), n)[[0, 2]]).all()


def test_all_labelled_documents_are_fitted(spark):
    # many more labels than any sample; two words in each level, so that one document says all
    n = 6000
    docs = [(i, " ".join(["ab" * (1 + 2 * (i % 5))] * (4 + i % 7)) + ".") for i in range(n)]
    d = spark.createDataFrame([*docs, (None, "ab."), (n, None)], "doc_id long, text string").repartition(6)
    l = spark.createDataFrame([(i, 1 + i % 5) for i in range(n)], "doc_id long, reading_level int")
    m = reading.fit_model(d, l)
    table, cache = reading._letter_table(), reading._Classes()
    tokens = sum(len(reading._TOKEN.findall(t)) for _, t in docs)
    counted = reading.triples([t for _, t in docs], table)[1].sum()
    assert tokens == reading.cells([t for _, t in docs], cache)[1].sum()
    assert np.isclose(m.models.letters.pairs.sum(), counted, rtol=1e-3)
    got = {r.doc_id: r.level for r in reading.levels(d, l).where("doc_id is not null").collect()}
    assert [got[i] for i in range(n)] == [1 + i % 5 for i in range(n)] and got[n] is None


def test_passages_are_found_in_texts_of_any_length():
    words = {k: [f"{l}{i}" for i in range(50)] for k, l in (("hu", "h"), ("fr", "f"))}
    counted = [(w, [100.0 if l == k else 0.0 for l in language.LANGUAGES]) for k, ws in words.items() for w in ws]
    shared = [(f"s{i}", [60.0 if l in words else 0.0 for l in language.LANGUAGES]) for i in range(50)]
    m = language.build(counted + shared)
    passage = [*words["fr"][:4], *[f"s{i}" for i in range(12)], *words["fr"][4:8]]
    for n in (90, 30000):
        text = words["hu"] * (n // 50) + passage + words["hu"] * (n // 50)
        score = m.scores(text)
        like = np.exp(score)
        chosen = language.languages(score, like, language.proportions(like, np.array([len(text)]))[0])
        assert {language.LANGUAGES[k] for k in chosen} == {"hu", "fr"}


def test_profile_is_by_language(spark, small):
    got = queries.p10_profile(spark, small).collect()
    assert {r.language for r in got} <= {*language.LANGUAGES, None}
    assert sum(r.documents for r in got) == table(spark, small, "documents").count()
    assert len({(r.source, r.language) for r in got}) == len(got)

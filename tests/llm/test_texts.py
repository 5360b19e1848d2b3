"""Leakage, templates, encodings, languages and reading levels."""

import random

import numpy as np
import pytest

from corpusmill.llm import encoding, language, leakage, reading, templates
from corpusmill.llm import kernels as K


def test_leaks_equal_brute_force(spark, monkeypatch):
    r = random.Random(2)
    words = [f"v{i}" for i in range(200)]
    items = [(f"i{k}", " ".join(r.choices(words, k=r.choice([5, 12, 13, 60])))) for k in range(40)]
    docs = []
    for k in range(80):
        w = r.choices(words, k=r.randint(0, 80))
        if k % 3 == 0:
            x = r.choice(items)[1].split()
            n = r.randint(8, len(x)) if len(x) > 8 else len(x)
            at = r.randrange(len(x) - n + 1)
            w[len(w) // 2 : len(w) // 2] = x[at : at + n]
        docs.append((k, " ; ".join(w) if k % 2 else " ".join(w).upper(), "clash"))
    # items that overlap in a document, and fall into different blocks
    items += [("o1", " ".join(f"q{j}" for j in range(20))), ("o2", " ".join(f"q{j}" for j in range(8, 30)))]
    docs += [(1003, " ".join(f"q{j}" for j in range(30)) + " tail", ""), (1000, None, ""), (1001, "", ""), (1002, items[5][1] + " z " * 5000, ""), (None, items[5][1], "")]
    d = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([*items, items[0], ("n", None), (None, "x")], "item_id string, item_text string")
    grams = {k: {tuple(w[j : j + 12]) for j in range(len(w) - 11)} for k, t in items if (w := t.split())}
    want = set()
    for k, t, _ in docs:
        w = K.words(t)
        mine = {tuple(w[j : j + 12]) for j in range(len(w) - 11)}
        want |= {(k, n) for n, g in grams.items() if mine & g and k is not None}
    texts = []
    for block in (leakage.BLOCK_GRAMS, 30, 1):
        monkeypatch.setattr(leakage, "BLOCK_GRAMS", block)
        got = leakage.leaks(d, i, "doc_id", "text").collect()
        assert {(x.doc_id, x.item_id) for x in got} == want
        clean = leakage.without_leaks(d, i, "doc_id", "text")
        assert clean.count() == len(docs) + 1
        assert leakage.leaks(clean.drop("removed_words"), i, "doc_id", "text").count() == 0
        texts.append(sorted((str(x.doc_id), str(x.text), x.removed_words) for x in clean.collect()))
    assert texts[0] == texts[1] == texts[2]
    kept = {x.doc_id: x for x in clean.collect()}
    hit = {k for k, _ in want}
    for k, t, _ in docs[:80]:
        assert (kept[k].removed_words > 0) == (k in hit) and (k in hit or kept[k].text == t)
    assert kept[1000].text is None
    assert leakage.leaks(d, i.limit(0), "doc_id", "text").count() == 0
    assert leakage.leaks(d.limit(0), i, "doc_id", "text").count() == 0


def test_repeated_lines(spark, monkeypatch):
    rows = []
    for k in range(40):
        host = ["a.example", "www.A.example:443", "b.example"][k % 3]
        rows.append((k, host, f"Title {k} {'x' * k}\nShare: {k} times!\n\nBody {chr(97 + k % 26) * (k + 1)}\nshare, 7 TIMES\n© 2020"))
    rows += [(100, "b.example", None), (101, None, "Share: 1 times"), (102, "unknown", "Share: 1 times"), (103, "c.example", "Only line\nOnly line"), (104, "c.example", "")]
    df = spark.createDataFrame([*rows, rows[0]], "row_seq long, source_uri string, article_text string").repartition(3)
    want = {(k, n) for k, *_ in rows[:40] for n in (2, 5)}

    def run():
        return {(x.row_seq, x.line_no) for x in templates.repeated_lines(df, "row_seq", "article_text", "source_uri").collect()}

    assert run() == want
    found = templates.repeated(df, "row_seq", "article_text", "source_uri").collect()
    assert {(x.outlet, x.documents, x.outlet_documents) for x in found} == {("a.example", 27, 27), ("b.example", 13, 14)}
    assert all("<*>" in x.template for x in found)
    clean = {x.row_seq: x for x in templates.without_repeated_lines(df, "row_seq", "article_text", "source_uri").collect()}
    assert clean[0].removed_lines == 2 and "Share" not in clean[0].article_text and clean[100].article_text is None
    assert clean[103].article_text == "Only line\nOnly line"
    monkeypatch.setattr(templates, "BROADCAST_TEMPLATES", 0)
    monkeypatch.setattr(templates, "TREE_LEAVES", 5)
    assert run() == want
    assert {x.row_seq: x.article_text for x in templates.without_repeated_lines(df, "row_seq", "article_text", "source_uri").collect()} == {k: x.article_text for k, x in clean.items()}
    assert templates.repeated_lines(df.limit(0), "row_seq", "article_text", "source_uri").count() == 0


def test_bylines_fall_under_one_template(spark):
    names = ["John Smith", "Anna Jones", "Mary Ann O'Neil", "Li Wei", "Eva Berg", "Tom Hall"]
    rows = [(k, "a.example", f"A title of article {'x' * k}\nBy {names[k % 6]}, {k} May\n{'y' * (k + 1)} is the body of it\nSHARE THIS") for k in range(30)]
    rows += [(k, "b.example", f"Council Finds {'X' * k} Guilty Of Many Things\nthe body {'z' * k}\nBy John Smith") for k in range(40, 52)]
    df = spark.createDataFrame(rows, "row_seq long, source_uri string, article_text string").repartition(4)
    found = {(x.outlet, x.template): x.documents for x in templates.repeated(df, "row_seq", "article_text", "source_uri").collect()}
    # a line that is always filled alike is a repeated line, but no template of names
    assert found[("a.example", "by <*>")] == 30 and found[("a.example", "SHARE THIS")] == 30 and found[("b.example", "By John Smith")] == 12 and ("b.example", "by <*>") not in found
    clean = {x.row_seq: x for x in templates.without_repeated_lines(df, "row_seq", "article_text", "source_uri").collect()}
    assert all(clean[k].removed_lines == 2 and "By " not in clean[k].article_text and "body of it" in clean[k].article_text for k in range(30))
    assert all(clean[k].removed_lines == 1 and clean[k].article_text.startswith("Council") for k in range(40, 52))
    plain = {(x.row_seq, x.line_no) for x in templates.repeated_lines(df, "row_seq", "article_text", "source_uri").collect()}
    # of the names themselves some recur often enough as they stand
    assert {(k, 4) for k in range(30)} <= plain and {(k, 3) for k in range(40, 52)} <= plain


SENTENCES = {
    "fr": "la société a présenté une requête à l'hôpital après l'élection où le député gênait déjà l'enquête du procès",
    "uk": "кожен міський суддя підписав договір після того як прокурор знайшов рахунок і захистив свідка від журналіста",
    "hu": "az elnök előtt a vezető megőrizte a szerződést és a jegyző később kifizette a költségvetést a kőhíd mellett",
}


def damage(t, kind):
    read, true, times = kind
    for _ in range(times):
        b = t.encode(true)
        t = "".join(bytes([x]).decode(read, "ignore") or chr(x) for x in b)
    return t


KINDS = {"fr": [("cp1252", "utf-8", 1), ("cp1252", "utf-8", 2)], "uk": [("cp1251", "utf-8", 1), ("cp1252", "cp1251", 1), ("cp1251", "koi8-u", 1), ("cp1252", "utf-8", 1)], "hu": [("cp1252", "cp1250", 1), ("cp1252", "utf-8", 1)]}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    out = []
    for l, s in SENTENCES.items():
        w = s.split()
        out += [(l, " ".join(r.sample(w, len(w)))) for _ in range(120)]
    return out


def test_round_trip_of_damage(spark, texts):
    bad, rows = {}, []
    r = random.Random(8)
    for k, (l, t) in enumerate(texts):
        if k % 12 == 0:
            kind = KINDS[l][(k // 12) % len(KINDS[l])]
            w = t.split()
            at = r.randrange(len(w) - 8)
            bad[k] = t
            t = " ".join([*w[:at], damage(" ".join(w[at : at + 8]), kind), *w[at + 8 :]])
        rows.append((k, t, "clash"))
    rows += [(900, None, ""), (901, "", ""), (902, "plain ascii text", ""), (903, "le march� reste", ""), (904, "été " * 20000, "")]
    df = spark.createDataFrame([*rows, rows[0]], "row_seq long, text string, t string")
    model = encoding.fit(df, "text")
    found = {x.row_seq for x in encoding.garbled_rows(df, "row_seq", "text", model).collect()}
    assert found == {k for k in bad if rows[k][1] != bad[k]} | {903}
    got = {x.row_seq: x for x in encoding.restored(df, "row_seq", "text", model).collect()}
    same = [k for k in bad if got[k].text == bad[k]]
    assert len(same) >= 0.9 * len(bad)
    assert all(got[k].text == t for k, t, _ in rows if k not in bad and k != 903) and got[903].lost == 1
    empty = encoding.fit(df.limit(0), "text")
    assert encoding.garbled_rows(df.limit(0), "row_seq", "text", empty).count() == 0


def test_wildcards_take_the_most_frequent_word():
    m = encoding.build([("marché", 50), ("marcha", 3), ("été", 9)])
    assert m.restore("Le march� est")[0] == "Le marché est"
    assert m.restore("x�y")[2] == 1
    # a byte that became white space
    m = encoding.build([("società", 80), ("una", 50), ("libertà", 60), ("perché", 70)])
    assert m.restore("perchÃ© libertÃ una societÃ\xa0")[0].split() == ["perché", "libertà", "una", "società"]


def test_languages(spark, texts):
    r = random.Random(3)
    rows = [(k, l if k % 10 else None if k % 20 else "fr", t) for k, (l, t) in enumerate(texts)]
    fr, hu = SENTENCES["fr"], SENTENCES["hu"]
    rows += [(1000, "hu", f"{hu}. {fr}. {hu}."), (1001, "hu", f"{hu}. la société a présenté. {hu}"), (1002, "uk", None), (1003, "uk", ""), (1004, None, fr), (1005, "fr", fr + ". 12 34 " * 3000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "row_key long, label string, text string")
    model = language.fit([df.select("label", "text")])
    got = {(x.row_key, x.lang) for x in language.unlabelled(df, "row_key", "text", "label", model).collect()}
    want = {(k, texts[k][0]) for k, l, t in rows if k < 1000 and l != texts[k][0]} | {(1000, "fr"), (1004, "fr")}
    assert got == want
    full = {x.row_key: x for x in language.infer(df, "row_key", "text", model).collect()}
    assert [p.lang for p in full[1000].passages] == ["hu", "fr", "hu"] and full[1002].passages == [] == full[1003].languages
    assert all(p.confidence > 0.9 for p in full[1000].passages)
    assert sum(x.share for x in full[1000].languages) == pytest.approx(1)
    none = language.fit([df.limit(0).select("label", "text")])
    assert language.unlabelled(df.limit(0), "row_key", "text", "label", none).count() == 0


def test_language_codes(spark):
    v = ["EN", "en-GB", "eng", " English", "nl_NL", "UK", "uk-UA", "und", "", None, "de", "srp"]
    df = spark.createDataFrame([(x,) for x in v], "l string")
    assert [r[0] for r in df.select(language.code("l")).collect()] == ["en", "en", "en", "en", "nl", "uk", "uk", None, None, None, None, "sr"]


def leveled(level, r):
    """Longer words and sentences at higher levels."""
    out = []
    for _ in range(8):
        out.append(" ".join("x" * max(1, int(r.gauss(3 + level, 1))) for _ in range(3 + 4 * level)) + ".")
    return " ".join(out)


def test_reading_levels_on_held_out_documents(spark):
    r = random.Random(6)
    truth = {k: r.randint(1, 5) for k in range(400)}
    docs = [(k, leveled(l, r), "x") for k, l in truth.items()] + [(900, None, ""), (901, " \n ", ""), (902, "y" * 50 + " z" * 20000, "")]
    labels = []
    for k in range(0, 400, 2):
        for rater in ("a", "b")[: 1 + k % 4 // 2]:
            off = r.choice([-1, 1]) if r.random() < 0.1 else 0
            labels.append((k, rater, min(5, max(1, truth[k] + off))))
    labels += [(5000, "a", 3), (None, "a", 2), (3, "a", 9), (5, "b", None)]
    d = spark.createDataFrame([*docs, docs[1]], "doc_id long, text string, level string")
    l = spark.createDataFrame([*labels, labels[0]], "doc_id long, rater string, reading_level int")
    got = {x.doc_id: x for x in reading.levels(d.drop("level"), l).collect()}
    held = [k for k in range(1, 400, 2)]
    assert np.mean([got[k].level == truth[k] for k in held]) > 0.9
    assert got[900].level is None and got[901].difficulty is None and got[902].level is not None
    assert reading.levels(d.drop("level"), l.limit(0)).where("level is not null").count() == 0
    assert reading.levels(d.drop("level").limit(0), l).count() == 0
    p = reading.profile(reading.levels(d.drop("level"), l), ["doc_id"])
    assert p.where("doc_id = 1").first().documents == 2


def test_isotonic_is_monotone_and_pools():
    x, y = reading.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]), np.ones(4))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [1, 2.5, 2.5, 4]
    assert (np.diff(y) >= 0).all()

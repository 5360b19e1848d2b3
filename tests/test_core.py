"""Core operators on small tables, with values worked out by hand."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import names as N
from corpusmill.functions import text as T
from corpusmill.functions.instants import readings
from corpusmill.functions.spans import find_spans
from corpusmill.functions.web import outlet
from corpusmill.operators import attention, corpus, labelling, metrics, records, sampling, screening, timestamps, topics
from corpusmill.operators.components import connected_components


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# text

def test_normal_forms_agree_with_python(spark):
    v = ["A B  c ", "Straße, groß!", "  ", None, "ς Σ", "x́ y", "don't_stop 3½", "\x1c tab\tend"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, t string")
    import re

    got = {r.i: r for r in df.select("i", T.collapse("t").alias("c"), T.plain("t").alias("p"), T.word_count("t").alias("n"), T.casefold("t").alias("f")).collect()}
    for i, x in enumerate(v):
        c = re.sub(r"\s+", " ", x or "").strip()
        assert got[i].c == c and got[i].n == len(c.split())
        if i != 4:  # the full folding rules are those of `casefold`
            assert got[i].p == re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", c.casefold())).strip()
        assert got[i].f == (x.casefold() if x else x)


def test_repair_of_marked_texts(spark):
    v = ["rédaction", "rÃ©daction", "Ñandorel", "Ð\x9aÐ¾Ð¶ÐµÐ½", None, ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "t string").select(T.repair_marked("t")).collect()]
    assert got == ["rédaction", "rédaction", "Ñandorel", "Кожен", None, ""]


def test_reading_again_agrees_with_python(spark):
    whole = ["été “à l’Île €", "Кожен суд", "naïve", "ça", "Ñandú", "plain", "\x85\x9d"]
    v = [*whole, *(x.encode().decode("latin1") for x in whole), *(x.encode().decode("cp1252") for x in whole[:1]), "Ã©\x85€", "Ã(", "É", "Ð ж", "ï¿½Ã©", None, ""]

    def best(x):
        readings = [x]
        for e in ("latin1", "cp1252"):
            try:
                readings.append(x.encode(e).decode())
            except UnicodeError:
                pass
        return min(readings, key=lambda y: sum(y.count(m) for m in T.MARKERS))

    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "t string").select(T.repair_marked("t")).collect()]
    assert got == [None if x is None else best(x) for x in v]


def test_identifiers_and_hashes(spark):
    df = spark.createDataFrame([(x,) for x in [" NaN ", "<NA>", None, " u1 ", "none"]], "u string")
    assert [r[0] for r in df.select(T.identifier("u")).collect()] == ["", "", "", "u1", ""]
    assert [r[0] for r in df.select(T.overlap_hash("u") == "").collect()] == [True, True, True, False, True]


def test_outlets():
    for v in ("https://WWW.Example.COM/news/1", "example.com/", "//example.com", "user:pw@example.com:8080/x", "example.com.", "feed@example.com"):
        assert outlet(v) == "example.com"
    assert outlet("xn--bcher-kva.example") == outlet("BÜCHER.example") == outlet("bücher.example") == outlet("b%C3%BCcher.example") == "bücher.example"
    for v in (None, "", " ", "nan", "Unknown", "N/A"):
        assert outlet(v) is None


def test_names(spark):
    df = spark.createDataFrame([("United Kingdom", "https://WWW.a.example:443/x?y"), (" the-Netherlands", "nan"), ("UK ", "b.example/"), (None, None), ("Atlantis", "xn--bcher-kva.example")], "c string, s string")
    got = df.select(N.country("c").alias("c"), N.source("s").alias("s"), N.source("s", decode=True).alias("d")).collect()
    assert [r.c for r in got] == ["United_Kingdom", "Netherlands", "United_Kingdom", "", "atlantis"]
    assert [r.s for r in got] == ["a.example", "unknown", "b.example", "unknown", "xn--bcher-kva.example"]
    assert [r.d for r in got] == ["a.example", "unknown", "b.example", "unknown", "bücher.example"]


def test_small_functions(spark):
    df = spark.createDataFrame([("First line\n\n second \nthird", 0.7), ("one", 70.0), (None, 150.0), ("", float("nan")), ("x", -1.0)], "t string, c double")
    title, body = T.title_body("t")
    got = df.select(title.alias("t"), body.alias("b"), T.confidence("c").alias("c"), T.excerpt("t", 8).alias("e"), T.first_number(F.lit("about -3.5 and 4")).alias("n")).collect()
    assert [r.t for r in got] == ["First line", "one", "", "", "x"]
    assert [r.b for r in got] == ["second\nthird", "one", "", "", "x"]
    assert [r.c for r in got] == [0.7, 0.7, 1.0, None, 0.0]
    assert got[0].e == "First l…" and got[0].n == -3.5
    assert T.latex("a_b & 50%") == r"a\_b \& 50\%"
    s = spark.createDataFrame([("```json\n{}\n```", "My Model/v1: x")], "f string, m string").select(T.strip_fence("f").alias("f"), T.slug("m").alias("m")).first()
    assert (s.f, s.m) == ("{}", "My__Model__v1__x")


def test_evidence(spark):
    df = spark.createDataFrame([("The MAYOR  paid the bill.", "“mayor paid”", "- the mayor\n• paid the bill"), ("text", "n/a", "text\ninvented"), (None, "x", None)], "t string, e string, p string")
    got = df.select(T.verbatim("t", "e").alias("v"), T.passages_verbatim(["t"], "p").alias("p")).collect()
    assert [(r.v, r.p) for r in got] == [(True, True), (False, False), (False, False)]
    assert [(s["start"], s["end"], s["label"]) for s in find_spans("aba ABA", [("x", "ab"), ("y", "aba")])] == [(0, 3, "y"), (4, 7, "y")]
    assert find_spans(None, [("x", "a")]) == [] == find_spans("abc", [("x", " ")])


# corpus

def test_deduplication_is_staged_and_order_free(spark):
    data = [
        (1, "A", "u1", "t1", ""), (2, "A", "u1", "t2", ""), (3, "A", "u2", "t2", ""), (4, "A", "u3", "t2", ""),
        (5, "B", "u1", "t1", ""), (6, "A", "", "t5", ""), (7, "A", "", "t6", ""), (8, "A", "u8", "t8", "n"), (9, "A", "u9", "t9", "n"),
    ]
    df = spark.createDataFrame(data, "row_seq long, country string, uri string, text_hash string, near_dup_hash string")
    # row 2 goes for its uri and does not count for its text, so row 3 stays
    want = [1, 3, 5, 6, 7, 8]
    for parts in (1, 3, 7):
        assert [r[0] for r in rows(corpus.deduplicate(df.repartition(parts)), "row_seq")] == want
    assert corpus.deduplicate(df.limit(0)).count() == 0


def test_clean(spark):
    long = " ".join(["word"] * 90)
    df = spark.createDataFrame(
        [(1, "u", "T", long, "S.example ", "2020-01-05T10:00:00Z", "True"), (2, None, None, long, None, "bad", "no"), (3, "u3", "T", "short", "s", None, None), (4, "u4", "T", None, "s", None, "")],
        "row_seq long, uri string, title string, body string, `source.uri` string, dateTime string, isDuplicate string",
    )
    got = corpus.clean(df).collect()
    assert [r.row_seq for r in got] == [2]
    assert (got[0].uri, got[0].source_uri, got[0].month, got[0].week, got[0].word_count) == ("", "", "NaT", None, 90)
    with pytest.raises(ValueError):
        corpus.clean(spark.createDataFrame([(1,)], "x int"))


def test_screening(spark):
    dec = spark.createDataFrame([("UK", "yes.example", "Yes"), ("UK", "no.example", " no "), ("UK", "both.example", "Yes"), ("United Kingdom", "www.both.example", "NO"), ("UK", "rev.example", None)], "country string, source_clean string, conventional_journalism string")
    art = spark.createDataFrame([(i, "United_Kingdom", s) for i, s in enumerate(["yes.example", "https://no.example/a", "both.example", "rev.example", "new.example", None])], "row_seq long, country string, source_uri string")
    s = screening.screen(art, screening.decisions(dec))
    assert rows(s, "row_seq", "source_include", "source_decision") == [(0, True, "YES"), (1, False, "NO"), (2, False, "NO;YES"), (3, True, ""), (4, True, "MISSING"), (5, True, "MISSING")]
    sm = screening.summary(s, ["country"], ["YES", "NO", "MISSING"]).first()
    assert (sm.rows_before, sm.rows_after, sm.share_excluded, sm.decision_missing) == (6, 4, 0.333333, 2)
    assert rows(screening.unreviewed(s), "source_key", "rank") == [("new.example", 1), ("unknown", 2)]


# attention

def test_attention_bins_by_the_month_of_the_week(spark):
    d = lambda s: dt.datetime.fromisoformat(s)
    cov = spark.createDataFrame([("A", d("2020-03-30"), 10), ("A", d("2020-03-30"), 10), ("A", d("2020-04-06"), 20), ("A", None, 5), ("B", d("2020-04-06"), None)], "country string, week timestamp, total_news_articles long")
    art = spark.createDataFrame([("A", d("2020-03-30")), ("A", d("2020-03-30")), ("C", d("2020-04-06")), ("A", None)], "country string, week timestamp")
    c, p = attention.coverage(cov), attention.weekly(art)
    assert rows(attention.relative(c, p, "week"), "positives", "total") == [(0, 20), (2, 10)]
    m = attention.relative(attention.roll_up(c, "month", "total"), attention.roll_up(p, "month", "positives"), "month")
    assert rows(m, "month", "positives", "attention") == [(d("2020-03-01"), 2, 0.2), (d("2020-04-01"), 0, 0.0)]
    s = attention.series(m, "month").orderBy("month").collect()
    assert [(r.rolling, r["index"]) for r in s] == [(0.2, 200.0), (0.1, 100.0)]
    assert rows(attention.by_country(m), "country", "total") == [("A", 30), ("ALL", 30)]


def test_lag_is_gap_safe(spark):
    y = spark.createDataFrame([("A", 2019, 1.0), ("A", 2020, 2.0), ("A", 2022, 3.0)], "country string, year int, v double")
    assert rows(attention.lagged(y, "v"), "year", "v_lag1") == [(2019, None), (2020, 1.0), (2022, None)]


# sampling

def test_even_quotas(spark):
    s = spark.createDataFrame([("a", 2), ("b", 50), ("c", 5), ("d", 50)], "k string, n long")
    for target, want in ((20, [2, 7, 5, 6]), (3, [1, 1, 1, 0]), (107, [2, 50, 5, 50]), (10, [2, 3, 3, 2])):
        got = dict(rows(sampling.even_quotas(s, target, ["k"]), "k", "quota"))
        assert [got[k] for k in "abcd"] == want and sum(want) == target


def test_splits(spark):
    df = spark.createDataFrame([(i, "AB"[i % 2], i // 2 % 2) for i in range(40)], "id long, country string, y int")
    got = sampling.calibration_split(df, ["country", "y"], 0.4, "id")
    assert rows(got.groupBy("country", "y", "part").count(), "part", "count") == [("calibration", 4)] * 4 + [("test", 6)] * 4
    assert {r.id: r.part for r in got.collect()} == {r.id: r.part for r in sampling.calibration_split(df.repartition(9), ["country", "y"], 0.4, "id").collect()}
    with pytest.raises(Exception, match="fewer than two"):
        sampling.calibration_split(df.where("id < 5"), ["country", "y"], 0.4, "id").collect()
    with pytest.raises(ValueError):
        sampling.calibration_split(df, ["y"], 0.9, "id")
    f = sampling.folds(df, ["y"], 5, "id")
    assert rows(f.groupBy("y", "fold").count(), "count") == [(4,)] * 10
    r = sampling.resamples(df, 3, 0.8, "id")
    assert rows(r.groupBy("repeat").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")), "n", "d") == [(32, 32)] * 3
    w = sampling.fixed(df, ["country"], 5, "id").agg(F.sum("design_weight")).first()[0]
    assert w == pytest.approx(40)


def test_overlap_by_uri_or_text(spark):
    s = "id int, uri string, h string"
    train = spark.createDataFrame([(1, "u1", "x"), (2, "", "h2"), (3, "u3", ""), (4, "", "")], s)
    held = spark.createDataFrame([(9, "u1", "y"), (8, "", "h2"), (7, "", "")], s)
    assert rows(sampling.overlap(train, held, "uri", "h"), "id", "by_uri", "by_text") == [(1, True, False), (2, False, True)]
    assert rows(sampling.without_overlap(train, held, "uri", "h"), "id") == [(3,), (4,)]


# metrics

def test_agreement_examples(spark):
    df = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 9.0)], "x string, y string, w double")
    assert metrics.agreement(metrics.confusion(df, "x", "y")).first().agreement == 0.5
    assert metrics.agreement(metrics.confusion(df, "x", "y", "w")).first().agreement == 0.1
    one = spark.createDataFrame([("a", "a"), ("a", "a")], "x string, y string")
    assert metrics.agreement(metrics.confusion(one, "x", "y")).first().kappa is None
    k = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15, "x string, y string")
    assert metrics.agreement(metrics.confusion(k, "x", "y")).first().kappa == pytest.approx(0.4)


def test_binary_and_sweep(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1), (None, 0.5)], "y int, p double")
    at = {r.threshold: r for r in metrics.sweep(df, "y", "p", [0.5, 0.05, 0.95]).collect()}
    for t, r in at.items():
        b = metrics.binary(df.withColumn("q", (F.col("p") >= t).cast("int")), "y", "q").first().asDict()
        assert {k: v for k, v in r.asDict().items() if k != "threshold"} == b
    assert at[0.95].yes_precision == 0.0 and at[0.05].yes_recall == 1.0
    ties = metrics.sweep(df, "y", "p", [0.7, 0.8])
    assert metrics.best_threshold(ties).first().threshold == 0.7
    assert metrics.binary(df.limit(0).withColumn("q", F.lit(1)), "y", "q", ["y"]).count() == 0


def test_cluster_agreement(spark):
    same = spark.createDataFrame([(i % 3, "abc"[i % 3]) for i in range(12)], "a int, b string")
    assert metrics.mutual_information(same, "a", "b").first().nmi == 1 == metrics.rand_index(same, "a", "b").first().ari
    apart = spark.createDataFrame([(i % 2, i // 2 % 2) for i in range(8)], "a int, b int")
    assert metrics.mutual_information(apart, "a", "b").first().nmi == 0


# topics and records

def test_topic_examples_go_round(spark):
    df = spark.createDataFrame([(1, c, i) for i, c in enumerate("AAABBC")], "topic int, country string, doc long")
    got = topics.round_robin(df, "topic", "country", 4, "doc").orderBy("place").collect()
    assert [r.country for r in got] == ["A", "B", "C", "A"]
    l = topics.leaders(topics.shares(df.withColumn("w8", F.lit(1.0)), ["country"], "topic", "w8"), "topic", "country").first().leaders
    assert l == "A (50.0%); B (33.3%); C (16.7%)"


def test_records(spark):
    old = spark.createDataFrame([("a", 1, "no", "timeout"), ("b", 1, "no", "")], "id string, n int, label string, error string")
    new = spark.createDataFrame([("a", 2, "yes", ""), ("c", 1, "yes", "x")], old.schema)
    both = records.upsert(old, new, "id", "n")
    assert rows(both, "id", "label") == [("a", "yes"), ("b", "no"), ("c", "yes")]
    assert rows(records.pending(both.select("id"), both, ["id"], "error"), "id") == [("c",)]
    assert rows(records.difference(old, new, "id"), "id", "only_in") == [("b", "first"), ("c", "second")]
    f = lambda d: records.fingerprint(d, d.columns).first()
    assert f(both) == f(both.repartition(5)) != f(both.union(old))
    assert records.fingerprint(both.limit(0), ["id"]).first().n_rows == 0
    with pytest.raises(Exception, match="stands twice"):
        records.one_to_one(old.union(new), "id", "labels").collect()
    assert records.standard(old, ["label", "absent"]).columns == ["label", "absent"]


def test_components(spark):
    e = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 100), (5, 5), (None, 7), (200, 100)]
    got = dict(rows(connected_components(spark.createDataFrame(e, "a long, b long"), "a", "b"), "node", "component"))
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 100, 101: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# timestamps

U = lambda *x: int(dt.datetime(*x, tzinfo=dt.UTC).timestamp())


@pytest.mark.parametrize(
    ("value", "country", "want"),
    [
        ("2019-01-07T17:03:17Z", "Serbia", U(2019, 1, 7, 17, 3, 17)),
        ("2020-01-08T14:48:28.991000Z", "Italy", U(2020, 1, 8, 14, 48, 28)),
        ("2019-07-14T13:10:41+03", None, U(2019, 7, 14, 10, 10, 41)),
        ("2021-04-02T17:55:43-0400", "Italy", U(2021, 4, 2, 21, 55, 43)),
        ("2019-01-16 17:16:06 EET", "Bulgaria", U(2019, 1, 16, 15, 16, 6)),
        ("2019-07-01 12:00:00 CET", "France", U(2019, 7, 1, 11)),
        ("2019-03-01T18:07:49+01:00[Europe/Amsterdam]", "Netherlands", U(2019, 3, 1, 17, 7, 49)),
        ("11.01.2019 22:33", "Ukraine", U(2019, 1, 11, 20, 33)),
        ("02/05/2019 17:31", "United_Kingdom", U(2019, 5, 2, 16, 31)),
        ("25 Oct 2020, 3:16 AM", "France", U(2020, 10, 25, 2, 16)),
        ("7 Jan 2019, 12:20 PM", "United_Kingdom", U(2019, 1, 7, 12, 20)),
        ("2019. 06. 01. 13:37", "Hungary", U(2019, 6, 1, 11, 37)),
        ("2020-07-09 kl. 04.58", "Sweden", U(2020, 7, 9, 2, 58)),
        ("Sun, 27 Oct 2019 02:18:29 +0200", "Italy", U(2019, 10, 27, 0, 18, 29)),
        ("20190125T083737Z", "Netherlands", U(2019, 1, 25, 8, 37, 37)),
        ("1549143575", "Sweden", 1549143575),
        ("1559317459916", "Hungary", 1559317459),
        # wall time that occurs twice, and that is skipped
        ("2021-10-31 02:30:00", "France", U(2021, 10, 31, 0, 30)),
        ("2021-03-28 02:30:00", "France", U(2021, 3, 28, 1, 30)),
        ("2021-03-28T01:15", "United_Kingdom", U(2021, 3, 28, 1, 15)),
    ],
)
def test_readings(value, country, want):
    got = [x for x in readings(value, country) if x[0] != "mdy"]
    assert [t for _, t, _ in got] == [want]


def test_no_readings():
    for v in (None, "", "n/a", "0000-00-00 00:00:00", "2020-13-45", "31.02.2020 10:00", "soon", "2020-01-01T25:00:00Z", "x" * 10000):
        assert readings(v, "Italy") == []


def test_mixture_of_formats(spark):
    monthfirst = [("us.example", f"{m:02d}/{d:02d}/2020 10:00") for m in (1, 2) for d in range(13, 28)] + [("us.example", "03/04/2020 10:00")]
    dayfirst = [("eu.example", f"{d:02d}/{m:02d}/2020 10:00") for m in (1, 2) for d in range(13, 28)] + [("eu.example", "03/04/2020 10:00")]
    none = [(None, "03/04/2020 10:00"), ("x.example", "none"), (None, None)]
    data = [(i, s, v, None, "United_Kingdom", "old") for i, (s, v) in enumerate(monthfirst + dayfirst + none)]
    df = spark.createDataFrame([*data, data[0]], "row_seq long, source_uri string, dateTime string, dateTimePub string, country string, ts_format string").repartition(3)
    got = {r.row_seq: r for r in timestamps.normalise(df, prior=timestamps.DAY_FIRST_PRIOR).collect()}
    us, eu = len(monthfirst) - 1, len(monthfirst) + len(dayfirst) - 1
    assert (got[us].ts_format, got[us].ts_ambiguous) == ("mdy", False) and (got[eu].ts_format, got[eu].ts_ambiguous) == ("dmy", False)
    assert got[us].ts_utc_s == U(2020, 3, 4, 10) and got[eu].ts_utc_s == U(2020, 4, 3, 9)
    assert got[eu + 1].ts_ambiguous and got[eu + 2].ts_utc_s is None and got[eu + 3].ts_ambiguous is None
    rule = timestamps.normalise(df)
    assert rule.where("ts_format = 'mdy'").count() == 0 and rule.count() == len(data) + 1
    assert {r.row_seq for r in rule.where("ts_utc_s is null").collect()} == {eu + 2, eu + 3} | set(range(us))
    assert timestamps.normalise(df.limit(0)).count() == 0


def test_impossible_day_first_dates_are_no_dates(spark):
    rows = [(1, "a.example", "01/25/2024 10:00", "2024-01-25T09:00:00Z", "France"), (2, "a.example", "25/01/2024 10:00", "2024-01-26T09:00:00Z", "France"), (3, None, "01/25/2024", "13.13.2024", "France")]
    df = spark.createDataFrame(rows, "row_seq long, source_uri string, dateTime string, dateTimePub string, country string")
    got = {r.row_seq: (r.ts_utc_s, r.ts_column) for r in timestamps.normalise(df).collect()}
    assert got == {1: (U(2024, 1, 25, 9), "dateTimePub"), 2: (U(2024, 1, 25, 9), "dateTime"), 3: (None, None)}
    open_order = {r.row_seq: r.ts_format for r in timestamps.normalise(df, prior=timestamps.DAY_FIRST_PRIOR).collect()}
    assert open_order == {1: "mdy", 2: "dmy", 3: "mdy"}


# labelling

def test_final_errors_of_a_client():
    final = labelling.Final()

    class AuthenticationError(Exception):
        pass

    class PermissionDeniedError(Exception):
        pass

    coded = RuntimeError("refused")
    coded.code = "model_not_found"
    for e in (
        RuntimeError("key not allowed to access model; code=key_model_access_denied"), RuntimeError("code=key_model_access_denied"), RuntimeError("Key not allowed to access model"),
        RuntimeError("invalid_api_key"), RuntimeError("The model does not exist or you do not have access to it"), RuntimeError("AuthenticationError: 401"), AuthenticationError(), PermissionDeniedError("x"), coded,
    ):
        assert final(e)
    assert not final(RuntimeError("temporary 503")) and not final(ValueError("no JSON object in the answer"))
    assert labelling.Final(classes=(), codes=("quota",), words=())(RuntimeError("quota")) and not labelling.Final((), (), ())(AuthenticationError())


def test_labelling_retries_and_records(spark):
    calls: dict = {}

    def client():
        def ask(p):
            calls[p] = calls.get(p, 0) + 1
            if "flaky" in p and calls[p] < 3:
                raise RuntimeError("temporary 503")
            if "locked" in p:
                raise RuntimeError("key not allowed to access model; code=401")
            return {"cut": '{"label": "ye', "raw": 'Sure:\n```json\n{"label": "line\nend"}\n```'}.get(p.split()[-1], '{"label": "yes"}')

        return ask

    df = spark.createDataFrame([(i, x) for i, x in enumerate(["ok", "a flaky", "a locked", "a cut", "a raw", None])], "id long, p string").coalesce(1)
    got = {r.id: r for r in labelling.label(df, "id", "p", client, lambda g: {"label": g["label"]}, ["label"], retries=3).collect()}
    assert (got[0].label, got[0].error, got[0].attempts) == ("yes", "", 1)
    assert (got[1].label, got[1].attempts) == ("yes", 3) and got[2].attempts == 1 and "not allowed" in got[2].error
    assert got[3].label is None and got[3].raw.startswith("{") and got[4].label == "line\nend" and got[5].error
    p = spark.createDataFrame([("a  b" * 10, "X")], "t string, c string").select(labelling.prompt("{c}: {text}", "t", 5, c="c").alias("p")).first().p
    assert p == "X: a ba "


# review

def test_review(spark):
    from corpusmill.operators import review

    df = spark.createDataFrame([(1, "The  GROSSE Straße", "x"), (2, None, "bill paid"), (3, "", "")], "id long, t string, u string")
    assert rows(review.search(df, ["t", "u"], "große STRASSE"), "id") == [(1,)] and rows(review.search(df, ["t", "u"], "strasse x"), "id") == [(1,)]
    assert review.search(df, ["t"], "  ").count() == 3
    assert rows(review.facets(df, {"u": ["x", ""], "t": []}), "id") == [(1,), (3,)]
    assert review.choose_key(df, df, ["t", "u", "id"]) == "id"
    with pytest.raises(ValueError):
        review.choose_key(df, df.union(df), ["id", "absent"])
    a, b = spark.createDataFrame([("A", 1), ("B", 2)], "k string, n int"), spark.createDataFrame([("A", 1), ("C", 2)], "k string, n int")
    assert rows(review.reconcile({"x": a, "y": b}, "k", "n"), "k", "agree") == [("A", True), ("B", False), ("C", False)]
    assert review.exactly_one(a.where("k = 'A'")).first().n == 1
    with pytest.raises(Exception, match="exactly one"):
        review.exactly_one(a).collect()
    e = spark.createDataFrame([("yes", "", "t"), ("yes", "invented", "the text"), ("yes", "THE text", "the text"), ("no", "", "t"), (None, None, None)], "l string, e string, t string")
    got = [r[0] for r in e.select(review.evidence_errors(e, "t", {"l": ("yes", "e")})).collect()]
    assert got == [["l: no evidence"], ["l: evidence is no quotation"], [], [], []]


def test_quotas_within_groups_and_models(spark):
    df = spark.createDataFrame([(i, "AB"[i % 2], i % 7) for i in range(70)], "id long, g string, s int")
    a = sampling.allocated(df, ["g", "s"], 10, "id", within=["g"])
    assert rows(a.groupBy("g").count(), "g", "count") == [("A", 10), ("B", 10)]
    assert sampling.total_even(df, ["g"], 5, "id").groupBy("g").count().orderBy("g").collect()[0]["count"] == 3
    with pytest.raises(Exception, match="too few"):
        sampling.total_even(df, ["g"], 100, "id").collect()
    labels = spark.createDataFrame([(0, "x"), (1, "y")], "topic int, label string")
    good = spark.createDataFrame([(0, "x", "X!"), (1, "y", " ")], "topic int, expected string, corrected string")
    assert rows(topics.override(labels, good, "topic"), "topic", "label") == [(0, "X!"), (1, "y")]
    for bad in (good.where("topic = 0"), good.withColumn("expected", F.lit("z"))):
        with pytest.raises(Exception, match="reviewed"):
            topics.override(labels, bad, "topic").collect()
    ex = spark.createDataFrame([("A", "u1", 9), ("A", "", 3)], "country string, uri string, id int")
    art = spark.createDataFrame([("A", "u1", 1), ("B", "u1", 2), ("A", "", 3), ("A", "", 4)], "country string, uri string, id int")
    assert rows(sampling.without(art, ex, "country", "uri", "id"), "id") == [(2,), (4,)]


def test_shared_tables(spark):
    import os

    from corpusmill.session import materialise, release, shared_dir

    folder = shared_dir(spark)
    assert shared_dir(spark) == folder == spark.conf.get("spark.checkpoint.dir")
    t = materialise(spark.range(3).toDF("n"), "numbers")
    path = t.inputFiles()[0].removeprefix("file://")
    assert rows(t, "n") == [(0,), (1,), (2,)] and os.path.exists(path) and path.startswith(folder.removeprefix("file://"))
    release(spark)
    assert not os.path.exists(path)


def test_places_of_a_whole_table(spark):
    df = spark.range(5000).toDF("doc_id").repartition(7)
    got = sampling.placed(df, "doc_id").collect()
    want = sorted(range(5000), key=lambda i: hashlib.sha256(f"s#{i}".encode()).hexdigest())
    assert [r.doc_id for r in sorted(got, key=lambda r: r.place)] == want and {r.place for r in got} == set(range(1, 5001))


def test_places_in_hot_and_null_groups(spark):
    rows = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, s int").repartition(5)
    want = {}
    for g in {r[1] for r in rows}:
        drawn = sorted((i for i, h, _ in rows if h == g), key=lambda i: hashlib.sha256(f"s#{i}".encode()).hexdigest())
        want |= {i: (g, k, len(drawn)) for k, i in enumerate(drawn, 1)}
    assert {r.id: (r.g, r["__place"], r["__size"]) for r in sampling.in_place(df, ["g"], "id").collect()} == want
    few = {r.id for r in sampling.fixed(df, ["g"], 4, "id").collect()}
    assert few == {i for i, (_, k, _) in want.items() if k <= 4}
    capped = sampling.source_capped(df, "g", "s", "s", 30, 10, "id").collect()
    assert len(capped) == sum(min(30, n) for n in {g: n for g, _, n in want.values()}.values()) and len({r.id for r in capped}) == len(capped)
    assert any(r.topped_up for r in capped)
    assert sampling.in_place(df.limit(0), ["g"], "id").count() == 0


def test_dense_periods_and_bounds(spark, tmp_path):
    df = spark.createDataFrame([("a", 2020, 1), ("a", 2022, 2), (None, 2021, 3)], "source string, year int, n long")
    got = {(r.source, r.year): r.n for r in attention.dense(df.where("source is not null"), "source", "year", "n").collect()}
    assert got == {("a", 2020): 1, ("a", 2022): 2}
    assert attention.dense(df.limit(0), "source", "year", "n").count() == 0
    with pytest.raises(Exception, match="more than 2 ids"):
        records.id_fingerprint(df, "n", [], 2).collect()
    assert records.id_fingerprint(df, "n").first().ids_sha256 == hashlib.sha256(b"1\n2\n3").hexdigest()
    assert records.id_fingerprint(df.limit(0), "n").first().n_ids == 0


# names and labels of count tables

def test_places(spark):
    v = ["United Kingdom [1]", "UK*", " Korea,  South (2)", "Czech_Republic 12", "– Türkiye:", "ab", "www.x.example", "Tel/fax", None, "Україна"]
    got = spark.createDataFrame([(x,) for x in v], "c string").select(N.place("c").alias("p"), N.is_place("c").alias("ok"), N.is_place("c", ["Czechia"]).alias("one")).collect()
    assert [r.p for r in got] == ["United Kingdom", "United Kingdom", "South Korea", "Czechia", "Turkey", "ab", "www.x.example", "Tel/fax", "", "Україна"]
    assert [r.ok for r in got] == [True] * 5 + [False] * 5 and [r.one for r in got] == [k == 3 for k in range(10)]


def test_labelled_numbers(spark):
    from corpusmill.sources import documents

    table = [["", "CPI", "CPI", ""], ["Country", "score 2019", "Score 2020", "Rank 2020"], ["7", "1", "2", "3"], ["Atlantis", "61", "1,5", "n/a 12"], ["Utopia", None, "", "4"]]
    df = spark.createDataFrame([("f.xlsx", "s", i, r) for i, r in enumerate(table, 1)], "path string, sheet string, row_no int, cells array<string>")
    x = documents.header_labels(df).cache()
    labels = {r.row_no: r.labels for r in x.collect()}
    assert labels[1] == ["", "", "", ""] and labels[4] == ["country", "cpi score 2019", "cpi score 2020", "rank 2020"]
    pick = lambda *a: {r[0]: r[1] for r in x.select("row_no", documents.labelled_number("cells", "labels", *a)).collect()}
    assert pick(["score"])[4] == 61 and pick(["score"], 2020)[4] == 15 and pick(["rank"])[4] == 12 and pick(["score"])[5] is None
    score, rank = documents.unlabelled_numbers("cells", F.lit(0))
    got = {r[0]: (r[1], r[2]) for r in df.select("row_no", score, rank).collect()}
    assert got[4] == (61, 15) and got[5] == (4, None) and got[3] == (1, 2) and got[1] == (None, None)


def test_totals_from_any_table(spark):
    from corpusmill.sources import tables

    month = spark.createDataFrame([("A", "2020-01", 2), ("A", "2020-02", 3), (None, "2020-01", 1)], "country string, month string, n long")
    year = spark.createDataFrame([("A", 2020, 9)], "country string, year int, total_articles long")
    assert rows(tables.country_totals({"summary": year, "week": month, "month": month}), "total_articles") == [(1,), (5,)]
    assert rows(tables.country_totals({"month": month, "year": year}), "total_articles") == [(9,)]
    assert rows(tables.country_totals({"summary": year.withColumnRenamed("total_articles", "input_rows"), "month": month}), "total_articles") == [(9,)]
    with pytest.raises(FileNotFoundError):
        tables.country_totals({"total": month})


def test_reviewed_rows_are_appended(spark):
    from corpusmill.operators import review

    old = spark.createDataFrame([("a", "u1", 1), ("b", "", 0)], "id string, uri string, y int")
    new = spark.createDataFrame([("c", "u1", "No political corruption", "T\nbody"), ("d", "u2", " mentioned but not central ", "T\n\nbody"), ("e", "", "unsure", "x"), ("f", None, "political corruption", "x")], "id string, uri string, y string, text string")
    got = {r.id: (r.y, r.title, r.body, r.country) for r in review.append_reviewed(old, new, "id", "uri", "y", N.LABELS, "text", {"country": "X"}).collect()}
    assert got == {"a": (1, None, None, None), "b": (0, None, None, None), "d": (0, "T", "body", "X"), "f": (1, "x", "x", "X")}


def test_runs_and_settings(spark, tmp_path, monkeypatch):
    from corpusmill.session import setting
    from corpusmill.sources import sinks

    path = str(tmp_path / "run" / "settings.json")
    sinks.same_run(path, {"k": [1, 2], "t": (1,)})
    sinks.same_run(path, {"t": [1], "k": [1, 2]})
    with pytest.raises(ValueError, match="other settings"):
        sinks.same_run(path, {"k": [1]})
    sinks.same_run(path, {"k": [1]}, overwrite=True)
    sinks.same_run(path, {"k": [1]})
    assert setting(spark, "no.such", "d") == "d"
    monkeypatch.setenv("CORPUSMILL_NO_SUCH", "e")
    assert setting(spark, "no.such", "d") == "e"
    spark.conf.set("spark.corpusmill.no.such", "s")
    assert setting(spark, "no.such", "d") == "s"
    spark.conf.unset("spark.corpusmill.no.such")


# clusterings

def test_grid_of_clusterings(spark):
    import numpy as np

    from corpusmill.operators import grid, metrics

    rng = np.random.default_rng(3)
    middle = rng.normal(size=(4, 12)) * 3
    of = rng.integers(0, 4, 600)
    data = [(i, f"c{of[i]}" if i % 5 else None, [float(v) for v in middle[of[i]] + rng.normal(size=12) * 0.2]) for i in range(600)]
    df = spark.createDataFrame([*data, (None, "x", [0.0] * 12), (900, "x", None)], "id long, country string, v array<double>").repartition(5)
    small = [(3, 4, 0.01, 1), (3, 4, 0.01, 2), (3, 4, 0.3, 1), (3, 2, 0.01, 1)]
    got = {(r.k, r.least, r.start): r for r in grid.stability_grid(df, "id", "v", "country", small, repeats=3).collect()}
    best = max((got[4, 0.01, 1], got[4, 0.01, 2]), key=lambda r: r.validity)
    assert best.topics == 4 and best.mean_ari > 0.99 and best.outlier_share == 0 and best.common_share == 1 and best.validity > 0.95
    assert got[2, 0.01, 1].topics == 2 and got[2, 0.01, 1].validity < best.validity
    assert got[4, 0.3, 1].topics < 4 and got[4, 0.3, 1].outlier_share > 0
    # the measures are those of the operators on rows
    a, b = rng.integers(0, 3, 200), rng.integers(0, 4, 200)
    table = np.bincount(a * 4 + b, minlength=12).reshape(3, 4).astype(float)
    pairs = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")
    assert grid._rand(table) == pytest.approx(metrics.rand_index(pairs, "a", "b").first().ari, abs=1e-7)
    assert grid._mutual(table) == pytest.approx(metrics.mutual_information(pairs, "a", "b").first().nmi, abs=1e-7)
    assert grid.stability_grid(df.limit(0), "id", "v", "country", small).count() == 0

"""Sources, sinks, streams and learning."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ml
from corpusmill.sources import documents, sinks, tables
from corpusmill.streaming import corpus as stream


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_country_files(spark, tmp_path):
    (tmp_path / "Italy_news.csv").write_text('title,body,source.uri\n"A ""q""","line 1\nline 2",X.example\nA,b,y.example\nA,b,y.example\n')
    with gzip.open(tmp_path / "France_news.csv.gz", "wt") as f:
        f.write("title,body,extra\nB,c,1\n")
    got = tables.country_csv(spark, str(tmp_path), combined=True)
    assert rows(got, "country", "combined_text") == [("France", "B\nc"), ("Italy", "A\nb"), ("Italy", "A\nb"), ("Italy", 'A "q"\nline 1\nline 2')]
    with pytest.raises(FileNotFoundError):
        tables.country_csv(spark, str(tmp_path), ["Spain"])
    (tmp_path / "it.txt").write_text(" Y.example\n\n")
    (tmp_path / "fr.txt").write_text("\n")
    got = tables.outlet_csv(spark, str(tmp_path), {"Italy": str(tmp_path / "it.txt"), "France": str(tmp_path / "fr.txt")})
    assert rows(got, "title", "country") == [("A", "Italy")]
    (tmp_path / "l1_news.csv").write_bytes("title,body\né,ü\n".encode("latin1"))
    assert rows(tables.country_csv(spark, str(tmp_path), ["l1"], encoding="ISO-8859-1"), "title") == [("é",)]


def test_count_files_of_any_layout(spark):
    a = spark.createDataFrame([("2020-01-06", "5", "x"), ("2020-01-07", "6", "y"), ("bad", "7", "z")], "some_week string, total string, note string")
    assert (tables.infer_period(a.where("total < 7")), tables.infer_count(a, ["some_week"])) == ("some_week", "total")
    b = spark.createDataFrame([("2020-01-06", 5.0, 1), ("2020-01-08", 6.0, 2), ("bad", 7.0, 3)], "week string, total_articles double, rank int")
    assert rows(tables.coverage_counts(b, "Italy"), "country", "total_news_articles") == [("Italy", 11)]
    with pytest.raises(ValueError):
        tables.coverage_counts(spark.createDataFrame([("a", "b")], "x string, y string"), "Italy")


def test_first_success(spark):
    errors: list = []
    ok = lambda: spark.range(2)
    assert tables.first_success([lambda: spark.read.parquet("/nowhere"), lambda: spark.range(0), ok], errors).count() == 2 and len(errors) == 1
    with pytest.raises(FileNotFoundError):
        tables.first_success([lambda: spark.range(0)])


def workbook() -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="one" r:id="r1"/><sheet name="two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Country</t></si><si><r><t>It</t></r><r><t>aly</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Score</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>42</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {main}><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_worksheets_and_archives(spark, tmp_path):
    assert documents.worksheet(workbook(), "two") == ("two", [["7"]]) and documents.worksheet(workbook(), "none")[0] == "one"
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("b.xlsx", workbook())
        z.writestr("c.csv", "x,y\n1,2\n")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.zip", inner.getvalue())
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    got = documents.sheets(spark, str(tmp_path)).collect()
    cells = {(r.path.rpartition("/")[2], r.row_no): r.cells for r in got}
    assert cells["a.zip!in.zip!b.xlsx", 1] == ["Country", "", "Score"] and cells["a.zip!in.zip!b.xlsx", 2] == ["Italy", "", "42"]
    assert cells["a.zip!in.zip!c.csv", 2] == ["1", "2"] and cells["bad.xlsx", 1] is None
    assert documents.column_number("AB12") == 27


def test_lines_links_and_names(spark):
    x = spark.createDataFrame([("New Zealand 2 88",), ("Italy 5253",), ("no numbers",), ("Korea, South* 45 59",)], "l string")
    n, r, s = documents.ranked_line(F.col("l"))
    assert [tuple(y) for y in x.select(n, r, s).collect()] == [("New Zealand", 2, 88), ("Italy", 52, 53), (None, None, None), ("Korea, South", 45, 59)]
    y = spark.createDataFrame([("cpi_2019_v2.xlsx",), ("x12019y2020.pdf",), ("none.csv",), ("1985-2001.csv",)], "f string")
    assert [z[0] for z in y.select(documents.year_of_name(F.col("f"))).collect()] == [2019, 2020, None, 1985]
    p = spark.createDataFrame([("u", "<a href='/data.xlsx'>x</a> <A HREF=\"/full_data.zip\">y</a> <a href='#top'>z</a>")], "url string, html string")
    assert rows(documents.links(p, "html", "url", {"data": 1, "full": 2}), "rank", "href", "score") == [(1, "/full_data.zip", 3), (2, "/data.xlsx", 1)]


def test_sinks(spark, tmp_path):
    df, path = spark.createDataFrame([(1, "a"), (2, "b_c")], "n int, s string"), str(tmp_path / "out")
    sinks.guarded(df, path)
    with pytest.raises(Exception, match="already exists"):
        sinks.guarded(df, path)
    sinks.atomic(spark.read.parquet(path).where("n = 1"), path)
    assert rows(spark.read.parquet(path), "n") == [(1,)]
    sinks.guarded(df, path, overwrite=True, partition_by=["s"])
    assert spark.read.parquet(path).count() == 2
    sinks.audit_log(df, str(tmp_path / "log"))
    sinks.audit_log(df, str(tmp_path / "log"))
    assert tables.json_lines(spark, str(tmp_path / "log"), "n int, s string").count() == 4
    f = tmp_path / "in.txt"
    f.write_text("x")
    m, m2 = str(tmp_path / "m.json"), str(tmp_path / "m2.json")
    sinks.write_manifest(m, [str(f)], {"t": df}, {"seed": 1})
    assert sinks.verify_manifest(m, {"t": df.repartition(3)}) == []
    sinks.write_manifest(m2, [m], {}, {})
    assert sinks.verify_chain([m, m2]) == []
    f.write_text("y")
    assert len(sinks.verify_manifest(m, {"t": df.limit(1)})) == 2
    sinks.archive([m], str(tmp_path / "arc"), "v1")
    assert sinks.restore(str(tmp_path / "arc"), str(tmp_path / "back"))
    (tmp_path / "arc/v1/m.json").write_text("{}")
    with pytest.raises(ValueError):
        sinks.restore(str(tmp_path / "arc"), str(tmp_path / "back"))
    t = sinks.latex_table(df, "A & B", "tab:x", "50%")
    assert r"b\_c" in t and r"A \& B" in t and r"50\%" in t
    assert sinks.latex_values({"rows": 12345}) == "\\providecommand{\\rows}{12,345}\n"
    assert rows(documents.file_records(spark, str(f)), "size") == [(1,)]


def test_streams_equal_batch(spark, tmp_path):
    data = [(i, "A", f"u{i % 4}" if i % 5 else "", f"text {i % 6}") for i in range(30)]
    df = spark.createDataFrame(data, "row_seq long, country string, uri string, article_text string").withColumn("at", F.timestamp_seconds(F.col("row_seq") * 86400))
    src = str(tmp_path / "src")
    for k in range(3):
        df.where(f"row_seq % 3 = {k}").coalesce(1).write.mode("append").parquet(src)

    def run(s, name, mode="append"):
        s.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).format("parquet").start(str(tmp_path / name)).awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    d = run(stream.deduplicated(stream.read(spark, src, df.schema), "at", "365 days"), "dedupe")
    assert d.count() == d.select("article_text").distinct().count() and d.where("uri <> ''").count() == d.where("uri <> ''").select("uri").distinct().count()
    w = run(stream.weekly_counts(stream.read(spark, src, df.schema), "at", ["country"]), "weeks")
    batch = {r[0]: r[1] for r in df.groupBy(F.date_trunc("week", "at")).count().collect()}
    assert w.count() > 1 and all(batch[r.week] == r.n for r in w.collect())
    path = str(tmp_path / "last")
    q = stream.read(spark, src, df.schema, 1).select("uri", "row_seq", "article_text")
    q.writeStream.foreachBatch(stream.keep_last_sink(spark, path, "uri", "row_seq")).option("checkpointLocation", str(tmp_path / "cl")).trigger(availableNow=True).start().awaitTermination()
    assert rows(stream.current(spark, path), "uri", "row_seq") == rows(df.groupBy("uri").agg(F.max("row_seq").alias("row_seq")), "uri", "row_seq")


def test_text_classifier(spark):
    data = [(i, ("the tender was corrupt bribe" if i % 3 == 0 else "sunny weather in the park") + f" {i}", int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame([*data, (100, None, 0)], "id long, t string, y int")
    s = ml.cross_validated(df, "id", "t", k=3)
    assert s.count() == 61 and s.where("(probability >= 0.5) <> (y = 1)").count() <= 1
    g = spark.createDataFrame([("ab x",)], "t string").select(ml.character_ngrams("t", 3, 4)).first()[0]
    assert g == [" ab", "ab ", " ab ", " x ", " x "]


def test_clusters(spark):
    pts = [(i, [1.0 + i * 1e-3, 0.0] if i % 2 else [0.0, 1.0 + i * 1e-3]) for i in range(40)]
    out, s = ml.clusters(spark.createDataFrame(pts, "id long, v array<double>"), "v", 2, 3)
    assert s > 0.9 and out.groupBy("cluster").count().count() == 2

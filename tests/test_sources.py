"""Files, mails and streams."""

import json

from pyspark.sql import functions as F

from ledgerloom.sources import files, mail
from ledgerloom.streaming.files import first_landings, landed_files, windowed_counts


def test_pdf_files_and_stream(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for n, c in (("a.pdf", b"1"), ("sub/B.PDF", b"1"), ("c.txt", b"2")):
        (tmp_path / "in" / n).write_bytes(c)
    df = files.pdf_files(spark, str(tmp_path / "in"))
    assert df.count() == 2 and df.select("file_hash").distinct().count() == 1
    q = first_landings(landed_files(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("landed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("landed").count() == 1


def test_windowed_stream(spark, tmp_path):
    e = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", "x") for i in range(30)], "id long, ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = windowed_counts(s, "ts", "k").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("win").collect()) == [10, 10, 10]


def test_dictionary_and_catalogue(spark, tmp_path):
    (tmp_path / "d.txt").write_text("# comment\nAcme Ltda|ACME|acme sa\n\nBeta|ACME\n", encoding="utf-8")
    d = {r["name"]: r["canonical"] for r in files.name_dictionary(spark, str(tmp_path / "d.txt")).collect()}
    assert d == {"ACME LTDA": "ACME LTDA", "ACME": "BETA", "ACME SA": "ACME LTDA", "BETA": "BETA"}
    (tmp_path / "p.json").write_text(json.dumps({"amount": {"NFE": [["(a+)", 0.9], ["(", 0.5]]}}))
    c = files.pattern_catalogue(spark, str(tmp_path / "p.json"))
    new = spark.createDataFrame([("amount", "NFE", 0, "(b+)", 0.7), ("amount", "NFE", 0, "(a+)", 0.1)], c.schema)
    assert sorted((r["ord"], r["pattern"]) for r in files.append_patterns(c, new).collect()) == [(0, "(a+)"), (1, "(b+)")]
    (tmp_path / "g.json").write_text(json.dumps({"documents": [{"file": "a", "error": None}, {"file": "b", "error": "x"}]}))
    assert [r["file"] for r in files.golden_documents(spark, str(tmp_path / "g.json")).collect()] == ["a"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, s string")
    files.write_csv(df, str(tmp_path / "c"), ";", "s = 'bad'")
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "c")).collect()[0]["id"] == "2"
    for n in (1, 2):
        files.replace_table(df.limit(n), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
    g = files.graph_json(spark.createDataFrame([(1, "NFE", 1)], "id long, kind string, c long"), spark.createDataFrame([(1, 2, 0.5, 1)], "src long, dst long, weight double, c long"), "c").collect()[0]["graph"]
    assert json.loads(g)["links"][0]["dst"] == 2


def test_mail(spark):
    m = spark.createDataFrame([(1, "<a href='https://x.example/nota.pdf'>Baixar <b>boleto</b></a><a href='https://facebook.com'>x</a>", "t", [("a.XML", "h1")]), (2, None, "text", []), (3, None, " ", [("b.pdf", "h1")]), (4, "<p>", None, [])], "id long, html_body string, text_body string, attachments array<struct<filename string, md5_hash string>>")
    assert [r["route"] for r in mail.route(m).orderBy("id").collect()] == ["xml", "text", "pdf", "link"]
    l = mail.html_links(m, "id", "html_body").collect()
    assert [(r["url"], r["label"]) for r in l] == [("https://x.example/nota.pdf", "Baixar boleto")]
    assert mail.new_attachments(m, spark.createDataFrame([("h9",)], "file_hash string")).count() == 1

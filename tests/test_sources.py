from __future__ import annotations

import csv
import glob
from email.message import EmailMessage

from pyspark.sql import functions as F

from sheafwork.sources import files, mail, sinks


def write(path, content: bytes):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def test_scan_hash_decode(spark, tmp_path):
    write(tmp_path / "a.TXT", "año".encode())
    write(tmp_path / "sub/b.csv", "año".encode("latin-1"))
    write(tmp_path / "sub/c.exe", b"x")
    write(tmp_path / ".hidden/d.txt", b"x")
    write(tmp_path / ".e.txt", b"x")
    write(tmp_path / "f.avif", b"y")
    scanned = files.scan_corpus(spark, str(tmp_path))
    decoded = files.decode_text_files(files.hash_files(scanned))
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["confidence"]) for r in decoded.collect()}
    assert got == {"a.TXT": ("año", 1.0), "b.csv": ("año", 1.0), "f.avif": ("y", 0.2)}
    plan = scanned.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_scan_below_a_hidden_folder_and_of_a_listing(spark, tmp_path):
    root = tmp_path / ".data/inbox"
    for name in ("a.txt", "_b.txt", ".c.txt", ".d/e.txt"):
        write(root / name, name.encode())
    found = files.scan_corpus(spark, str(root))
    assert [bytes(r["content"]) for r in found.collect()] == [b"a.txt"]
    listing = spark.createDataFrame([(f"file:{root}/{n}",) for n in ("a.txt", "_b.txt", ".c.txt", ".d/e.txt")], "path string")
    listing = listing.selectExpr("path", "timestamp'2024-01-01' as modificationTime", "cast(0 as bigint) as length")
    found = files.scan_corpus(spark, str(root), listing=listing)
    assert sorted(bytes(r["content"]) for r in found.collect()) == [b"_b.txt", b"a.txt"]


def test_html_text(spark):
    page = "<p>Hola <b>mundo</b></p><script>var t='</p>';</script><p>caf&eacute; &#65;</p><br>"
    got = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    rows = {r["id"]: r["text"] for r in mail.html_corpus_to_text(got).collect()}
    assert rows == {1: "Hola mundo var t='</p>'; café A", 2: None}


def message() -> bytes:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "Pedido: nº 7 / urgente y largo", "a@example.com", "b@example.com"
    m.set_content("Hola\n")
    m.add_alternative("<p>Hola <i>html</i></p>", subtype="html")
    m.add_attachment(b"%PDF", maintype="application", subtype="pdf", filename='in"voice?.PDF')
    m.add_attachment(b"MZ", maintype="application", subtype="octet-stream", filename="virus.exe")
    return m.as_bytes()


def test_mail(spark):
    mails = spark.createDataFrame([("m.eml", message())], "path string, content binary")
    text = mail.email_corpus_to_rows(mails).first()["text"]
    assert text == ("Subject: Pedido: nº 7 / urgente y largo\nFrom: a@example.com\nTo: b@example.com\nHola\nHola html")
    got = mail.email_attachments(mails, F.lit(123)).collect()
    assert [(r["name"], bytes(r["content"])) for r in got] == [("Email_123_Pedido nº 7  urgente_invoice.PDF", b"%PDF")]


def test_append_documents(spark, tmp_path):
    rows = spark.createDataFrame([(10, "a.pdf", "OK", "hola", "es", 0.5), (20, "b.pdf", "FAILED", "", None, None)],
                                 "seq bigint, filename string, status string, text string, language string, "
                                 "confidence double")
    store = str(tmp_path / "store")
    first = sinks.append_documents(spark, rows, store, "seq")
    assert sorted((r["doc_id"], r["seq"]) for r in first.collect()) == [(1, 10), (2, 20)]
    sinks.append_documents(spark, rows, store, "seq")
    docs = spark.read.parquet(f"{store}/documents")
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 2, 3, 4]
    assert sorted(r["id_doc"] for r in spark.read.parquet(f"{store}/texts").collect()) == [1, 3]


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a.pdf", "x", "extra")], "id bigint, filename string, path string, other string")
    sinks.export_documents_csv(docs.coalesce(1), str(tmp_path / "out"))
    [part] = glob.glob(str(tmp_path / "out/*.csv"))
    assert list(csv.reader(open(part))) == [list(sinks.EXPORT_COLUMNS), ["1", "a.pdf", "", "", "", "", "", "x"]]
    records = spark.createDataFrame([("a", "OK", 1.5, "Invoice", 9)], "filename string, status string, duration double, "
                                    "type string, doc_id int")
    sinks.batch_summary_report(records, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns == list(sinks.REPORT_COLUMNS)
    summaries = spark.createDataFrame([("/x/a.pdf", "es", "# A"), ("/x/b.pdf", "en", "")],
                                      "path string, language string, markdown string")
    sinks.export_side_outputs(summaries, str(tmp_path / "side"))
    assert spark.read.json(str(tmp_path / "side/json")).count() == 2
    assert {p.name: p.read_text() for p in (tmp_path / "side/markdown").iterdir()} == {"a.md": "# A"}


def test_postings_are_sorted_for_lookup(spark, tmp_path):
    postings = spark.createDataFrame([(t, d, "text", 1) for t in ("b", "a", "c") for d in range(5)],
                                     "term string, doc_id bigint, field string, tf bigint")
    sinks.write_postings(postings, str(tmp_path / "p"), 2)
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = stored.filter("term in ('a')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,a)]" in plan and stored.count() == 15


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, column in (("b_docs", "filename"), ("b_texts", "text")):
            df = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias(column))
            sinks.store_bucketed(df, name, "doc_id", 4, str(tmp_path / name))
        joined = spark.table("b_docs").join(spark.table("b_texts"), "doc_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("b_docs", "b_texts"):
            spark.sql(f"drop table if exists {name}")


def test_lineage_cut_reads_back_what_was_computed(spark, tmp_path):
    from sheafwork.session import cut_lineage

    kept = cut_lineage(spark.range(10).withColumn("v", F.array(F.col("id"))))
    assert sorted(r["id"] for r in kept.filter("id > 4").collect()) == [5, 6, 7, 8, 9]
    assert "FileScan parquet" in kept._jdf.queryExecution().executedPlan().toString()
    assert cut_lineage(kept.limit(0)).count() == 0

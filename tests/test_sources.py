"""Readers, sinks, streams and the command line."""

import json
import zipfile

from pyspark.sql import functions as F

from foliomark import cli
from foliomark.operators.detectors import Inputs
from foliomark.operators.store import Store
from foliomark.sources import readers, sinks
from foliomark.streaming import submissions


def make_files(folder):
    folder.mkdir()
    (folder / "a.txt").write_bytes("Grüße aus Köln.\r\nEnde".encode("latin-1"))
    (folder / "b.md").write_bytes("hello".encode("utf-16"))
    (folder / "c.html").write_text("<nav>x</nav><p>Seen &amp; read</p>")
    with zipfile.ZipFile(folder / "d.docx", "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (folder / "e.docx").write_bytes(b"not a zip")
    (folder / "f.xyz").write_bytes(b"ignored")


def test_read_documents(spark, tmp_path):
    make_files(tmp_path / "in")
    rows = {r.title: r for r in readers.read_documents(spark, str(tmp_path / "in")).collect()}
    assert set(rows) == {"a", "b", "c", "d", "e"}
    assert rows["a"].text == "Grüße aus Köln.\nEnde" and rows["b"].text == "hello" and rows["c"].text == "Seen & read" and rows["d"].text == "One\n\nTwo"
    assert rows["e"].text is None and rows["e"].error and rows["e"].document_id is None and len(rows["a"].document_id) == 16


def test_paragraph_rows(spark):
    df = spark.createDataFrame([(1, "a\n\n \n\nb c"), (2, None), (3, "")], "doc_id bigint, text string")
    assert [(r.doc_id, r.paragraph_index, r.text) for r in readers.paragraph_rows(df).orderBy("paragraph_index").collect()] == [(1, 0, "a"), (1, 2, "b c")]


def test_history(spark, tmp_path):
    folder = str(tmp_path / "runs")
    run = sinks.save_run({"x": 1}, folder, "first")
    (tmp_path / "runs" / "broken.json").write_text("{")
    got = readers.read_history(spark, folder).collect()
    assert [r.run_id for r in got] == [run] and json.loads(got[0].result) == {"x": 1}
    assert sinks.delete_run(folder, run) and not sinks.delete_run(folder, run)


def test_html_sinks():
    page = sinks.report_html({"doc_id": "<1>"}, [{"finding_type": "x", "severity": "low", "title": "<t>", "confidence": 0.5}])
    assert "&lt;1&gt;" in page and "&lt;t&gt;" in page
    assert sinks.marked("A <b> quote", "QUOTE") == "A &lt;b&gt; <mark>quote</mark>" and sinks.marked("a", "") == "a"
    assert "<mark>one two three</mark>" in sinks.marked_common("x one two three y", "one two three")


def test_stream_merges_findings(spark, tmp_path):
    text = "The weighted survey confirms the regional trend in the northern districts during the whole season."
    schema = "doc_id bigint, text string, author_key string, lang string, at timestamp"
    rows = spark.createDataFrame([(1, text, "a", "en"), (2, text, "b", "en")], "doc_id bigint, text string, author_key string, lang string").withColumn("at", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.createDataFrame([(10, text, "c", "en")], "doc_id bigint, text string, author_key string, lang string")
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second start finds nothing new
        q = submissions.detect(submissions.read_stream(spark, str(tmp_path / "in"), rows.schema), lambda batch: Inputs(batch, source), store, str(tmp_path / "cp"), ["exact_copy"])
        q.awaitTermination(120)
    found = store.read("findings").collect()
    assert {r.doc_id for r in found} == {1, 2} and len({r.finding_id for r in found}) == len(found)
    assert schema


def test_stream_windows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "2024-01-01 10:00:00"), (1, "x", "2024-01-01 10:00:01"), (2, "y", "2024-01-01 12:30:00")], "id int, k string, s string").select("id", "k", F.col("s").cast("timestamp").alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = submissions.read_stream(spark, str(tmp_path / "in"), rows.schema)
    counts = submissions.windowed_counts(stream, "at", ["k"])
    counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert {(r.k, r.n) for r in spark.table("counted").collect()} == {("x", 2), ("y", 1)}
    once = submissions.first_deliveries(stream, ["id"], "at")
    once.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("once").count() == 2


def test_command_line(spark, tmp_path, capsys):
    text = "The weighted survey confirms the regional trend in the northern districts during the whole season. It ends here."
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("Opening words. " + text)
    findings, report, runs = cli.analyze(spark, [str(tmp_path / "a.txt")], [str(tmp_path / "b.txt")])
    assert report.first().exact_overlap > 0.7 and all(r["status"] in ("ok", "skipped") for r in runs)

import io
import shutil
import zipfile

from pyspark.sql import functions as F

from fabula.sources import documents, tables
from fabula.streaming import events as S

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def container(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_formats_in_one_scan(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.txt").write_text("Capítulo 1\r\nHola.\n", "utf-8")
    (d / "b.md").write_text("# Título\ntexto", "utf-8")
    (d / "c.docx").write_bytes(container(**{"word__document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Uno</w:t></w:r></w:p><w:p><w:r><w:t>dos</w:t></w:r><w:ins w:author="x"><w:r><w:t> más</w:t></w:r></w:ins><w:del w:author="y"><w:r><w:delText>fuera</w:delText></w:r></w:del></w:p></w:body></w:document>'}))
    (d / "d.epub").write_bytes(container(**{"META-INF__container.xml": '<container><rootfile full-path="o.opf"/></container>', "o.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="i" href="c.html"/></manifest><spine><itemref idref="i"/></spine></package>', "c.html": "<html><head><title>no</title></head><body><h1>Cap</h1><p>Texto &amp; más</p></body></html>"}))
    (d / "e.pdf").write_bytes(b"%PDF-1.4")
    (d / "f.docx").write_bytes(b"broken")
    (d / "noext").write_bytes(b"plain")
    rows = documents.read_documents(spark, str(d)).orderBy("path", "para_idx").collect()
    got = {}
    for r in rows:
        got.setdefault(r.path.rpartition("/")[2], []).append((r.text, r.is_heading, r.start_char, bool(r.error)))
    assert got["a.txt"] == [("Capítulo 1", True, 0, False), ("Hola.", False, 11, False), ("", False, 17, False)]
    assert got["b.md"] == [("Título", True, 0, False), ("texto", False, 7, False)]
    assert got["c.docx"] == [("Uno", True, 0, False), ("dos más", False, 4, False)]
    assert got["d.epub"] == [("Cap", True, 0, False), ("Texto & más", False, 4, False)]
    assert got["e.pdf"][0][3] and got["f.docx"][0][3] and got["noext"] == [("plain", False, 0, False)]
    assert documents.docx_revisions((d / "c.docx").read_bytes()) == [(1, "insertion", "x", " más"), (1, "deletion", "y", "fuera")]


def test_export_and_import(spark, tmp_path):
    t = {"alerts": spark.createDataFrame([(1, "a"), (2, "b")], "project_id long, x string"), "terms": spark.createDataFrame([("t",)], "term string")}
    documents.export_project(t, 2, str(tmp_path / "p"))
    back = documents.import_project(spark, str(tmp_path / "p"), list(t), 77)
    assert [tuple(r) for r in back["alerts"].collect()] == [(77, "b")] and back["terms"].count() == 1


def test_paragraph_offsets(spark):
    df = spark.createDataFrame([(1, "ab\n\ncd"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in tables.paragraphs(df).filter("doc_id = 1").orderBy("para_idx").collect()] == [(1, 0, 0, 2, "ab"), (1, 1, 3, 3, ""), (1, 2, 4, 6, "cd")]


def test_streams_agree_with_batch(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", src / "events.parquet")
    batch = spark.read.parquet(str(src)).withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.run_to_memory(S.windowed_counts(S.stream(spark, str(src))), "windows", "complete", str(tmp_path / "c1"))
    want = batch.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert out.select("start", "event_type", "n").exceptAll(want).count() == 0 and out.count() == want.count()
    fed = S.stream(spark, str(src)).withColumn("dismissed", F.col("value") > 30)
    weights = S.run_to_memory(S.adaptive_weights(fed), "weights", "update", str(tmp_path / "c2"))
    from fabula.operators.alerts import adaptive_weights

    ref = adaptive_weights(batch.select(F.col("user_id").alias("project_id"), F.col("event_type").alias("alert_type"), "ts", F.col("event_id").alias("alert_id"), (F.col("value") > 30).alias("dismissed")))
    assert {(r.user_id, r.event_type): r.weight for r in weights.collect()} == {(r.project_id, r.alert_type): r.weight for r in ref.collect()}
    pairs = S.run_to_memory(S.continuity(S.stream(spark, str(src))), "pairs", "append", str(tmp_path / "c3"))
    assert pairs.count() > 0 and pairs.filter("closed <= opened").count() == 0
    few = S.run_to_memory(S.continuity(S.stream(spark, str(src)), most_open=1), "few", "append", str(tmp_path / "c4"))
    assert few.filter("closed is null").count() > 0 and few.filter("closed <= opened").count() == 0


def test_state_is_given_up_after_its_time(spark, tmp_path):
    src = tmp_path / "log"
    rows = [(1, "2024-01-01 00:00:00", 1, "purchase", 1.0), (2, "2024-01-01 00:10:00", 2, "purchase", 1.0), (3, "2024-06-01 00:00:00", 2, "error", 1.0), (4, "2024-06-01 01:00:00", 3, "error", 1.0), (5, "2024-06-02 00:00:00", 3, "error", 1.0)]
    for r in rows:  # a file, and so a batch, for each event
        df = spark.createDataFrame([r], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(src))
    pairs = S.run_to_memory(S.continuity(S.stream(spark, str(src)), keep_hours=24), "late_pairs", "append", str(tmp_path / "c5"))
    assert (1, 1, None) in {tuple(r) for r in pairs.collect()}
    whole = S.replayed_windows(spark, str(src))
    assert sorted((str(r.start), r.event_type, r.n) for r in whole.collect()) == [
        ("2024-01-01 00:00:00", "purchase", 2), ("2024-06-01 00:00:00", "error", 1), ("2024-06-01 01:00:00", "error", 1), ("2024-06-02 00:00:00", "error", 1)]

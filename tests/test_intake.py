"""File intake gate, binaryFile reads, text extraction, HTML text."""

import os
import tempfile

from pyspark.sql import functions as F

from quarry.operators import intake
from quarry.plans import checks


def test_gate(spark):
    mb10 = 10 * 1024 * 1024
    df = spark.createDataFrame([("a.pdf", 1), ("b.PDF", 1), ("c.Pdf", 1), ("d.txt", 1), ("e.pdf", mb10),
                                ("f.pdf", mb10 + 1)], "name string, length long")
    got = [r.accepted for r in intake.intake_gate(df).orderBy("name").collect()]
    assert got == [True, True, False, False, True, False]


def test_binary_file_reads_and_extracts(spark):
    d = tempfile.mkdtemp(prefix="quarry-intake-")
    for name, data in (("a.pdf", b"hello"), ("b.txt", b"no"), ("c.PDF", b"\xff\xfe")):
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    ok = intake.read_uploads(spark, d)
    plan = checks.plan_text(ok)
    assert "length" in plan.split("PushedFilters")[1].splitlines()[0]  # size cap reaches the scan
    out = {os.path.basename(r.path): (r.text, r.error) for r in
           intake.extract_text(ok, lambda b: b.decode("utf-8")).collect()}
    assert out["a.pdf"] == ("hello", None)
    assert out["c.PDF"][0] is None and "UnicodeDecodeError" in out["c.PDF"][1]
    rej = {os.path.basename(r.path): r.reason for r in intake.rejected_uploads(spark, d).collect()}
    assert rej == {"b.txt": intake.ERR_NOT_PDF}


def test_html_text(spark):
    html = "<html><head><style>p{}</style><script>var a='<p>';</script></head><body><p>Hi \n there</p></body></html>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(intake.html_text(F.col("h"))).first()[0] == "Hi there"


def test_html_extractor_as_the_expression(spark):
    pages = [(1, "<p>a <b>b</b></p>\n<script x>var a = '<p>';</script> c"), (2, ""), (3, None), (4, "<STYLE>x</STYLE>é\t \r\n😀<"), (5, "\x0b a \u00a0 ")]
    df = spark.createDataFrame(pages, "i long, html string")
    want = {r.i: r.t for r in df.select("i", intake.html_text(F.col("html")).alias("t")).collect()}
    files = df.select(F.col("i").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    got = {int(r.path): (r.text, r.error) for r in intake.extract_text(files, intake.html_extractor).collect()}
    assert got == {i: (t, None if t is not None else intake.ERR_NO_CONTENT) for i, t in want.items()}

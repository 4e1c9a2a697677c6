import hashlib
import re

from cellward.llm import warc

ROWS = [
    (1, "http://a.example/x", '<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><!-- c --><p>One<br>two &lt;3</p>\n\n <b>x</b>y<a href="/q">l</a></body></html>'),
    (2, None, None),
    (None, "http://b\r\nX: y", "plain é text"),
    (1, "http://a.example/x", ""),
]


def test_records_link_and_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, record string")
    made = warc.responses(pages)
    originals = [r.record for r in made.collect()]
    got = warc.derive(made, "page_id").collect()
    assert len(got) == 2 * len(ROWS)
    ids = {re.search(r"WARC-Record-ID: <(.*?)>", x)[1]: x for x in originals}
    for r in got:
        head, _, rest = r.record.partition("\r\n\r\n")
        assert f"WARC-Refers-To: <{r.refers_to}>" in head and r.refers_to in ids
        assert rest == r.block + "\r\n\r\n"
        assert f"Content-Length: {len(r.block.encode())}" in head
        assert f"WARC-Block-Digest: sha256:{hashlib.sha256(r.block.encode()).hexdigest()}" in head
        html = ids[r.refers_to].split("\r\n\r\n", 2)[2].removesuffix("\r\n\r\n")
        assert r.source_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    texts = {r.block for r in got if r.record_type == "conversion"}
    assert texts == {"One\ntwo <3\nxyl", "", "plain é text"}
    first = next(r for r in got if r.record_type == "metadata" and "title: A & B" in r.block)
    assert "lang: en\r\nlinks: 1\r\nsource-http: HTTP/1.1 200 OK | Content-Type" in first.block
    folder = f"file://{tmp_path}/warc"
    both = made.select("record").union(warc.derive(made).select("record"))
    assert sum(r.n_records for r in warc.write(both, folder).collect()) == 3 * len(ROWS)
    assert sorted(r.record for r in warc.read(spark, folder).collect()) == sorted(originals + [r.record for r in got])


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.responses(pages), "page_id").count() == 0


def test_responses_are_read_once(spark, tmp_path):
    """Both derived records come from one reading of a response: the table is scanned once."""
    spark.createDataFrame(ROWS, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    made = warc.op9_warc_derivatives(spark, str(tmp_path))
    assert made.count() == 2 * len(ROWS)
    assert len(made.inputFiles()) > 0 and made._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1

r"""WARC derivative builder: response records become linked metadata and plain-text conversion records.

``responses`` wraps pages as WARC/1.1 response records.  ``derive`` reads such records' own header lines and
block and builds for each a ``metadata`` record (application/warc-fields) and a ``conversion`` record
(text/plain).  Both name the response in WARC-Refers-To, keep its target URI and date, and carry the digests
of their own block; the source's payload digest and its HTTP header lines stand in the metadata record.
Everything is a column expression, so nothing leaves the JVM.  ``write`` and ``read`` keep records as WARC
files with a gzip member for each record.

Nulls: a null url is an empty one, a null html an empty page, a null page_id an empty identifier.  Line breaks
in a url become blanks, as a header can't hold them.  Repeated pages give records with equal identifiers.
Pages without any html still give both records, with an empty text.
"""

from __future__ import annotations

import gzip
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm.sparkops import cut, table

DATE = "2024-01-01T00:00:00Z"
SOFTWARE = "derivative-builder/1.0"
#: Removed with their content; line breaks; other tags go without trace.
_DROP = r"(?is)<!--.*?-->|<script[ \t\n\f\r>].*?</script[ \t\n\f\r]*>|<style[ \t\n\f\r>].*?</style[ \t\n\f\r]*>|<title[ \t\n\f\r>].*?</title[ \t\n\f\r]*>"
_BREAK = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|article|nav|table|tr|section|header|footer|body|html|head)([ \t\n\f\r/][^>]*)?>"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


#: Patterns that Spark runs in a faster form with the same matches, or without those that change nothing (a lone blank, a lone line break).
_FASTER = (
    (_DROP, "(?is)<(?:" + _DROP.removeprefix("(?is)<").replace("|<", "|") + ")"),
    (r"[ \t\f\r]+", r"[ \t\f\r]{2,}|[\t\f\r]"),
    (r" ?\n[ \n]*", r" \n[ \n]*|\n[ \n]+"),
)


def _sql(name: str) -> str:
    return name.replace("'", "''")


def _clean(x: str) -> str:
    """SQL that drops markup and entities from x and squeezes white space; the same text in Spark and DuckDB but for ``all``."""
    for pattern, by in ((_DROP, " "), (_BREAK, "\n"), (r"<[^>]*>", "")):
        x = f"regexp_replace({x}, {{r}}'{_sql(pattern)}', {{n}}'{by}'{{g}})" if by != "\n" else f"regexp_replace({x}, {{r}}'{_sql(pattern)}', chr(10){{g}})"
    for name, by in _ENTITIES:
        x = f"replace({x}, '{name}', '{_sql(by)}')"
    x = f"regexp_replace({x}, {{r}}'[ \\t\\f\\r]+', ' '{{g}})"
    x = f"regexp_replace({x}, {{r}}' ?\\n[ \\n]*', chr(10){{g}})"
    return f"{{ends}}{x}{{of}}"


def _dialect(sql: str, duck: bool) -> str:
    if duck:
        sql = sql.replace("{ends}", "regexp_replace(").replace("{of}", r", '^[ \n]+|[ \n]+$', '', 'g')")
    else:
        sql = sql.replace("{ends}", "btrim(").replace("{of}", ", concat(' ', chr(10)))")
        for pattern, faster in _FASTER:
            sql = sql.replace(f"'{_sql(pattern)}'", f"'{_sql(faster)}'")
    return sql.replace("{r}", "" if duck else "r").replace("{n}", "").replace("{g}", ", 'g'" if duck else "")


def _urn(seed: str) -> str:
    m = f"md5({seed})"
    return f"concat('urn:uuid:', substr({m}, 1, 8), '-', substr({m}, 9, 4), '-', substr({m}, 13, 4), '-', substr({m}, 17, 4), '-', substr({m}, 21, 12))"


def _record(kind: str, record_id: str, fields: list[tuple[str, str]], content_type: str, block: str, sha: str, size: str) -> str:
    """SQL for a whole record."""
    lines = [("WARC-Type", f"'{kind}'"), ("WARC-Record-ID", f"concat('<', {record_id}, '>')"), *fields, ("WARC-Block-Digest", f"concat('sha256:', {sha})"), ("Content-Type", f"'{content_type}'"), ("Content-Length", f"cast({size} as varchar(20))")]
    parts = ["'WARC/1.1'", *(f"CRLF, '{name}: ', {value}" for name, value in lines), "CRLF, CRLF", block, "CRLF, CRLF"]
    return f"concat({', '.join(parts)})".replace("CRLF", "chr(13), chr(10)")


#: Column by column: (new column, SQL over the ones before).  sha() and octets() differ by dialect.
_RESPONSE = [
    ("page_key", "coalesce(cast(page_id as varchar(20)), '')"),
    ("uri", "translate(coalesce(url, ''), concat(chr(13), chr(10)), '  ')"),
    ("page", "coalesce(html, '')"),
    ("payload", "sha(page)"),
    ("http", "concat('HTTP/1.1 200 OK', CRLF, 'Content-Type: text/html; charset=UTF-8', CRLF, 'X-Page: ', page_key, CRLF, 'Content-Length: ', cast(octets(page) as varchar(20)), CRLF, CRLF)"),
    ("block", "concat(http, page)"),
    ("record_id", _urn("concat('response|', page_key, '|', uri, '|', payload)")),
    ("record", _record("response", "record_id", [("WARC-Target-URI", "uri"), ("WARC-Date", f"'{DATE}'"), ("WARC-Payload-Digest", "concat('sha256:', payload)")], "application/http; msgtype=response", "block", "sha(block)", "octets(block)")),
]


def _field(name: str) -> str:
    return f"regexp_extract(head, {{r}}'\\n{name}: ([^\\r\\n]*)', 1)"


_DERIVED = [
    ("head", "concat(chr(10), substr(record, 1, instr(record, concat(CRLF, CRLF)) + 1))"),
    ("rest", "substr(record, instr(record, concat(CRLF, CRLF)) + 4)"),
    ("source", "substr(rest, 1, length(rest) - 4)"),
    ("http", "substr(source, 1, instr(source, concat(CRLF, CRLF)) - 1)"),
    ("page", "substr(source, instr(source, concat(CRLF, CRLF)) + 4)"),
    ("refers_to", "regexp_replace(" + _field("WARC-Record-ID") + ", '[<>]', ''{g})"),
    ("target_uri", _field("WARC-Target-URI")),
    ("source_date", _field("WARC-Date")),
    ("source_digest", _field("WARC-Payload-Digest")),
    ("plain", _clean("page")),
    ("title", "regexp_replace(" + _clean("regexp_extract(page, {r}'(?is)<title[^>]*>(.*?)</title', 1)") + ", chr(10), ' '{g})"),
    ("page_lang", "regexp_extract(page, {r}'(?i)<html[^>]* lang=\"([A-Za-z-]*)\"', 1)"),
    ("n_links", "cast(length(regexp_replace(page, {r}'(?i)<a[ \\t\\n\\f\\r][^>]*href', concat('<a href', chr(1)){g})) - length(replace(regexp_replace(page, {r}'(?i)<a[ \\t\\n\\f\\r][^>]*href', concat('<a href', chr(1)){g}), chr(1), '')) as bigint)"),
]
_LINK = [("WARC-Target-URI", "target_uri"), ("WARC-Date", f"'{DATE}'"), ("WARC-Refers-To", "concat('<', refers_to, '>')"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "source_date")]
_KINDS = {
    "metadata": [
        ("block", f"concat('software: {SOFTWARE}', CRLF, 'source-payload-digest: ', source_digest, CRLF, 'title: ', title, CRLF, 'lang: ', page_lang, CRLF, 'links: ', cast(n_links as varchar(20)), CRLF, 'source-http: ', replace(http, concat(CRLF), ' | '), CRLF)"),
        ("record_id", _urn("concat('metadata|', refers_to)")),
        ("derived", _record("metadata", "record_id", _LINK, "application/warc-fields", "block", "sha(block)", "octets(block)")),
    ],
    "conversion": [
        ("block", "plain"),
        ("record_id", _urn("concat('conversion|', refers_to)")),
        ("derived", _record("conversion", "record_id", _LINK, "text/plain; charset=UTF-8", "block", "sha(block)", "octets(block)")),
    ],
}
_OUT = ["record_id", "refers_to", "target_uri", "source_digest"]


def _spell(sql: str, duck: bool) -> str:
    sql = _dialect(sql, duck).replace("CRLF", "chr(13), chr(10)")
    sql = re.sub(r"\bsha\(", "sha256(" if duck else "SHA2_(", sql)
    if duck:
        return sql.replace("octets(", "strlen(")
    return re.sub(r"SHA2_\((\w+)\)", r"sha2(\1, 256)", sql).replace("octets(", "octet_length(").replace("varchar(20)", "string")


def _add(df: DataFrame, steps) -> DataFrame:
    for name, sql in steps:
        if name == "n_links":  # the SQL counts marks, put in for the links, and the page's own ones
            sql = f"if(contains(page, chr(1)), {sql}, cast(regexp_count(page, {{r}}'(?i)<a[ \\t\\n\\f\\r][^>]*href') as bigint))"
        df = df.withColumn(name, F.expr(_spell(sql, False)))
    return df


def responses(pages: DataFrame) -> DataFrame:
    """page_id and record: a WARC/1.1 response record for each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return _add(rows, _RESPONSE).select("page_id", "record")


def derive(records: DataFrame, *keys: str) -> DataFrame:
    """Two rows for each response record: record_type, record_id, refers_to, target_uri, source_digest, the
    text of the block and of the whole record, and the key columns."""
    made, parts = _add(records.select(*keys, "record"), _DERIVED), []
    for kind, steps in _KINDS.items():
        made = _add(made, steps).withColumn(kind, F.struct(F.lit(kind).alias("record_type"), *_OUT, "block", F.col("derived").alias("record")))
        parts.append(kind)
    # both from one row: a union would read, wrap and parse every response twice
    return made.select(*keys, F.inline(F.array(*parts)))


def _write(folder: str):
    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, part, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", f"{root}/_{uuid.uuid4().hex}", 0
        with store.open_output_stream(part) as f:
            for batch in batches:
                for record in batch.column(0).to_pylist():
                    f.write(gzip.compress(record.encode(), 6, mtime=0))
                    n += 1
        store.move(part, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_records"])

    return run


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes the ``record`` column as WARC files, one for each partition; returns (file, n_records)."""
    return cut(records.select("record").mapInArrow(_write(folder), "file string, n_records long"))


def _split(batches):
    for batch in batches:
        for body in batch.column(0).to_pylist():
            data, at, out = gzip.decompress(body), 0, []
            while at < len(data):
                head = data.index(b"\r\n\r\n", at) + 4
                end = head + int(re.search(rb"\nContent-Length: (\d+)", data[at:head])[1]) + 4
                out.append(data[at:end].decode())
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["record"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the WARC files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content").mapInArrow(_split, "record string")


def _hash(c: Column) -> Column:
    return F.sha2(c, 256)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(table(spark, sf_dir, "pages")), "page_id")
    return made.select("page_id", "record_type", *_OUT, F.octet_length("block").cast("long").alias("n_bytes"), _hash(F.col("block")).alias("block_sha256"), _hash(F.col("record")).alias("record_sha256"))


def _oracle() -> str:
    def nest(inner: str, steps) -> str:
        for name, sql in steps:
            inner = f"SELECT *, {_spell(sql, True)} AS {name} FROM ({inner})"
        return inner

    base = nest(f"SELECT page_id, record FROM ({nest('SELECT page_id, url, html FROM pages', _RESPONSE)})", _DERIVED)
    kinds = [
        f"SELECT page_id, '{kind}' AS record_type, {', '.join(_OUT)}, CAST(strlen(block) AS BIGINT) AS n_bytes, sha256(block) AS block_sha256, sha256(derived) AS record_sha256 FROM ({nest('SELECT * FROM base', steps)})"
        for kind, steps in _KINDS.items()
    ]
    return f"WITH base AS ({base}) {' UNION ALL '.join(kinds)}"


OP9_SQL = _oracle()

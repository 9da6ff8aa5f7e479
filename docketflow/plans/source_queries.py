"""Round trips through the sources, the stream, and the enricher."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.functions import text
from docketflow.functions.taxonomy import WORD
from docketflow.operators import enrich
from docketflow.plans.pipeline_queries import MATCHES, REGISTER
from docketflow.sources import archive, html, mail
from docketflow.sources.tables import load
from docketflow.streaming import incremental


def _escape(c):
    out = F.coalesce(c, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def s9_register_html(spark, sf_dir):
    """Each register row as a page with a register table, read back from the HTML."""
    head = "<html><script>var x = '<td>';</script><table class='subtle'><tr><th>Doc Number</th><th>Subject</th><th>Source</th><th>Date</th></tr><tr><td><a href='"
    page = F.concat(F.lit(head), _escape(F.col("doc_url")), F.lit("'>"), _escape(F.col("doc_num")), *(x for c in ("subject", "source", "date") for x in (F.lit("</a></td><td>"), _escape(F.col(c)))), F.lit("</td></tr></table></html>"))
    pages = load(spark, sf_dir, REGISTER).select("reg_id", page.alias("page"))
    line = lambda c: text.one_line(F.col(c)).alias(c)
    return pages.select("reg_id", F.inline(html.register_rows(F.col("page")))).select("reg_id", "doc_num", "doc_url", line("subject"), line("source"), line("date"))


def _base64(raw):
    return F.regexp_replace(F.base64(raw), r"\s", "")


def s14_mailbox(spark, sf_dir):
    """Each mail as a mailbox of its own, parsed back: encoded headers, two character sets, attachments in every second."""
    word = lambda c: F.concat(F.lit("=?utf-8?B?"), _base64(F.encode(F.coalesce(c, F.lit("")), "utf-8")), F.lit("?="))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\n"))
    wide = F.col("match_id") % 3 == 0
    body = F.coalesce("summary", F.lit(""))
    raw = _base64(F.when(wide, F.encode(body, "UTF-16LE")).otherwise(F.encode(body, "UTF-8")))
    part = F.concat(F.lit("Content-Type: text/plain; charset="), F.when(wide, "utf-16le").otherwise("utf-8"), F.lit("\nContent-Transfer-Encoding: base64\n\n"), raw, F.lit("\n"))
    attached = F.concat(F.lit("Content-Type: multipart/mixed; boundary=xyz\n\n--xyz\n"), part, F.lit("--xyz\nContent-Type: text/csv\nContent-Disposition: attachment; filename=a.csv\n\na,b\n--xyz--\n"))
    content = F.concat(
        F.lit("From list\n"), line("Message-ID", F.col("match_id").cast("string")), line("From", word(F.col("from_email"))), line("Date", word(F.col("date"))), line("Subject", word(F.col("subject"))),
        F.when(F.col("match_id") % 2 == 0, attached).otherwise(part),
    )
    boxes = load(spark, sf_dir, MATCHES).select(F.col("match_id").cast("string").alias("mbox_file"), content.alias("content"))
    return mail.parse_mailboxes(boxes).select(
        F.col("message_id").cast("bigint").alias("match_id"), F.col("from_field").alias("sender"), F.col("date_field").alias("date"), "subject", F.col("body").alias("summary"), "has_attachments", (F.col("size_bytes") > 0).alias("sized"), "error"
    )


def s12_urls(spark, sf_dir):
    return load(spark, sf_dir, REGISTER).select("reg_id", archive.document_url("http://docs.example", F.col("doc_num"), F.col("doc_url")).alias("url"))


def s16_archive_index(spark, sf_dir):
    """Each mail as a one-line index page, in the layout of its month, read back."""
    item = F.concat(F.lit('<ul><li><strong><a href="m'), F.col("match_id").cast("string"), F.lit('.html">'), _escape(F.col("subject")), F.lit("</a></strong>&nbsp;<em>"), _escape(F.col("from_name")), F.lit("</em></li></ul>"))
    row = F.concat(F.lit('<table><tr><td><a name="x" href="m'), F.col("match_id").cast("string"), F.lit('.html">'), _escape(F.col("subject")), F.lit("</a></td><td>"), _escape(F.col("from_name")), F.lit("</td></tr></table>"))
    mails = load(spark, sf_dir, MATCHES).filter("year IS NOT NULL AND month IS NOT NULL")
    new = mail.uses_new_layout(F.col("year"), F.col("month"))
    pages = mails.select("match_id", "year", "month", F.when(new, item).otherwise(row).alias("page"))
    return pages.select("match_id", F.inline(archive.index_rows(F.col("page"), F.col("year"), F.col("month"))))


def s18_message_pages(spark, sf_dir):
    """Each mail as a page of an archive with headers in comments, read back."""
    note = lambda name, c: F.concat(F.lit(f'<!-- {name}="'), _escape(c), F.lit('" -->\n'))
    page = F.concat(
        F.lit("<html><head><title>t</title></head>\n"), note("ID", F.lit("old")), note("id", F.col("match_id").cast("string")), note("name", F.col("from_name")), note("email", F.col("from_email")), note("subject", F.col("subject")),
        F.lit('<!-- body="start" --><p>'), _escape(F.col("summary")), F.lit("<br></p>\n&gt; quoted<!-- body=\"end\" --></html>"),
    )
    read = load(spark, sf_dir, MATCHES).filter("summary IS NOT NULL").select(page.alias("page")).select(archive.message(F.col("page")).alias("m"))
    return read.select(F.col("m.message_id").cast("bigint").alias("match_id"), "m.name", "m.email", "m.subject", "m.body", "m.in_reply_to")


def _proposal_table(spark, sf_dir, cells: int) -> DataFrame:
    """Rows of proposals as pages with a table of as many cells, between rows of other sizes, under a spanning header."""
    columns = ["doc_num", "proposal_title", "proposer", "count", "proposal_for_1"][:cells]
    tds = F.concat(*(x for c in columns for x in (F.lit("<td>"), _escape(F.col(c)), F.lit("</td>"))))
    page = F.concat(F.lit(f"<table><tr><th colspan='{cells}'>"), _escape(F.substring("doc_num", 1, 5)), F.lit("</th></tr><tr><td>x</td><td>y</td></tr><tr>"), tds, F.lit("</tr></table>"))
    return load(spark, sf_dir, "proposals").select("doc_num", page.alias("page"))


def s20_proposal_table(spark, sf_dir):
    """Rows of exactly five cells."""
    first = F.get(html.tables(F.col("page")), F.lit(0))
    rows = _proposal_table(spark, sf_dir, 5).select("doc_num", F.explode(html.table_rows(first, 5)).alias("r"))
    return rows.select("doc_num", *(F.col("r")[i].alias(c) for i, c in enumerate(("number", "title", "proposer", "total"))))


def s24_four_cells(spark, sf_dir):
    first = F.get(html.tables(F.col("page")), F.lit(0))
    return _proposal_table(spark, sf_dir, 4).select("doc_num", F.explode(html.table_rows(first, 4)).alias("r")).select("doc_num", F.col("r")[3].alias("total"))


def s21_categories(spark, sf_dir):
    """Spanning headers fill the rows below them."""
    rows = _proposal_table(spark, sf_dir, 4).select("doc_num", F.explode(html.category_rows(4)(F.col("page"))).alias("r"))
    return rows.select("doc_num", "r.category", F.size("r.cells").alias("n_cells"), F.col("r.cells")[0].alias("first"))


def s22_titled_images(spark, sf_dir):
    """One row per titled image."""
    page = F.concat(F.lit("<table><tr><td>"), _escape(F.col("doc_num")), F.lit("</td><td><img title='"), _escape(F.coalesce("proposal_for_1", F.lit("-"))), F.lit("'><img alt='none'><img title='second'></td></tr></table>"))
    rows = load(spark, sf_dir, "proposals").select("doc_num", F.explode(html.image_rows(page)).alias("r"))
    return rows.select("doc_num", F.col("r.cells")[0].alias("cell"), "r.title")


def s23_spans(spark, sf_dir):
    """A cell over several rows belongs to each of them."""
    page = F.concat(F.lit("<table><tr><td rowspan='2'>"), _escape(F.col("doc_num")), F.lit("</td><td>a</td></tr><tr><td>b</td></tr><tr><td colspan='2'>c</td></tr></table>"))
    table = F.get(html.spread_tables(F.col("page")), F.lit(0))
    rows = load(spark, sf_dir, "proposals").select("doc_num", page.alias("page")).select("doc_num", F.posexplode(html.table_rows(table)).alias("at", "r"))
    return rows.select("doc_num", "at", F.array_join("r", "|").alias("cells"))


def _pages(url: str) -> tuple[int, str]:
    """A provider without network: refuses some addresses, fails for others."""
    number = int(url.rpartition("/")[2])
    if number % 5 == 0:
        raise TimeoutError("timed out")
    return (404, "") if number % 3 == 0 else (200, "403 Forbidden" if number % 2 == 0 else f"page {number}")


def s26_fetched(spark, sf_dir):
    urls = load(spark, sf_dir, REGISTER).select(F.concat(F.lit("http://docs.example/"), F.col("reg_id").cast("string")).alias("url"))
    return archive.fetch(urls, _pages)


def s27_months(spark, sf_dir):
    """Addresses of each month's index, none in the future."""
    from datetime import date

    return archive.months(spark, date(2010, 11, 5), date(2031, 1, 1), date(2012, 2, 9)).select("year", "month", mail.archive_url("http://lists.example", F.col("year"), F.col("month"), F.lit("index")).alias("url"))


def f22_html_text(spark, sf_dir):
    """Visible text of a page around each document number."""
    page = F.concat(F.lit("<html><style>p {x}</style><p>"), _escape(F.col("doc_num")), F.lit("</p>\n<p>  one  two</p><script>no()</script></html>"))
    return load(spark, sf_dir, REGISTER).select("reg_id", text.html_text(page).alias("visible"))


def f17_composed(spark, sf_dir):
    """Texts in composed normal form."""
    return load(spark, sf_dir, "documents").select("doc_id", text.nfc(F.col("text")).alias("composed"))


def f15_pictographs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(text.pictographs(F.col("text")), " ").alias("pictographs"))


def s_stream_daily(spark, sf_dir):
    """Events per day and type by a stream that runs until nothing is left."""
    return incremental.daily_counts(spark, sf_dir, "events", "ts", "event_type")


def ud6_enriched(spark, sf_dir):
    """Register rows through the enricher with the provider that needs no network."""
    prompt = text.fill_template("Subject: {subject}\nText: {summary}", subject=F.col("subject"), summary=F.col("summary"))
    done = enrich.enrich(load(spark, sf_dir, REGISTER), "reg_id", prompt, enrich.DOCUMENT_REPLY)
    return done.select("reg_id", "reply.relevant", F.array_join("reply.references", ",").alias("refs"), "error")


_LIST = (
    s9_register_html, s12_urls, s14_mailbox, s16_archive_index, s18_message_pages, s20_proposal_table, s21_categories, s22_titled_images, s23_spans, s24_four_cells, s26_fetched, s27_months,
    f22_html_text, f17_composed, f15_pictographs, s_stream_daily, ud6_enriched,
)
QUERIES = {f.__name__: f for f in _LIST}


#: White space of all scripts, where DuckDB's class has that of ASCII only.
_SPACE = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _line(c: str) -> str:
    return rf"trim(regexp_replace(replace(coalesce({c}, ''), '|', '\|'), '{_SPACE}', ' ', 'g'), ' ')"


def _cell(c: str) -> str:
    """What the table parser makes of a cell: blanks but line breaks collapsed."""
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), '[ \\t\\r\\f\\v]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


_PICTURES = text.pictograph_sql()
SQL = {
    "s9_register_html": f"SELECT reg_id, {_cell('doc_num')} AS doc_num, coalesce(doc_url, '') AS doc_url, {_line('subject')} AS subject, {_line('source')} AS source, {_line('date')} AS date FROM utc_doc_reg_df",
    "s12_urls": "SELECT reg_id, CASE WHEN regexp_matches(coalesce(doc_num, ''), '^[Ll]2/\\d{2}') THEN 'http://docs.example/L20' || substr(doc_num, 4, 2) || '/' || coalesce(doc_url, '') ELSE '' END AS url FROM utc_doc_reg_df",
    "s14_mailbox": "SELECT match_id, coalesce(from_email, '') AS sender, coalesce(date, '') AS date, coalesce(subject, '') AS subject, rtrim(coalesce(summary, ''), chr(10)) AS summary, match_id % 2 = 0 AS has_attachments, true AS sized, NULL::VARCHAR AS error FROM email_match_df",
    "s16_archive_index": "SELECT match_id, 'm' || match_id || '.html' AS link, trim(coalesce(subject, ''), ' ') AS subject, trim(coalesce(from_name, ''), ' ') AS author FROM email_match_df WHERE year IS NOT NULL AND month IS NOT NULL",
    "s18_message_pages": "SELECT match_id, coalesce(from_name, '') AS name, replace(trim(coalesce(from_email, ''), ' '), '_at_', '@') AS email, coalesce(subject, '') AS subject, "
    "regexp_replace(summary || chr(10), '^\\s+', '') || chr(10) || '[quote 1]' || chr(10) || 'quoted' || chr(10) || '[/quote 1]' AS body, NULL::VARCHAR AS in_reply_to FROM email_match_df WHERE summary IS NOT NULL",
    "s20_proposal_table": f"SELECT doc_num, {_cell('doc_num')} AS number, {_cell('proposal_title')} AS title, {_cell('proposer')} AS proposer, {_cell(chr(34) + 'count' + chr(34))} AS total FROM proposals",
    "s24_four_cells": f"SELECT doc_num, {_cell(chr(34) + 'count' + chr(34))} AS total FROM proposals",
    "s21_categories": f"SELECT doc_num, substr(doc_num, 1, 5) AS category, 2 AS n_cells, 'x' AS first FROM proposals UNION ALL SELECT doc_num, substr(doc_num, 1, 5), 4, {_cell('doc_num')} FROM proposals",
    "s22_titled_images": f"SELECT doc_num, {_cell('doc_num')} AS cell, coalesce(proposal_for_1, '-') AS title FROM proposals UNION ALL SELECT doc_num, {_cell('doc_num')}, 'second' FROM proposals",
    "s23_spans": "SELECT doc_num, unnest([0, 1, 2])::INT AS at, unnest([doc_num || '|a', doc_num || '|b', 'c|c']) AS cells FROM proposals",
    "s26_fetched": "SELECT 'http://docs.example/' || reg_id AS url, CASE WHEN reg_id % 5 = 0 THEN NULL WHEN reg_id % 3 = 0 THEN 404 ELSE 200 END::INT AS status, CASE WHEN reg_id % 5 <> 0 AND reg_id % 3 <> 0 AND reg_id % 2 <> 0 THEN 'page ' || reg_id END AS body, "
    "CASE WHEN reg_id % 5 = 0 THEN 'timed out' WHEN reg_id % 3 = 0 THEN 'status 404' WHEN reg_id % 2 = 0 THEN 'refused' END AS error FROM utc_doc_reg_df",
    "s27_months": "SELECT year(m)::INT AS year, month(m)::INT AS month, 'http://lists.example/' || strftime(m, '%Y-m%m') || '/index.html' AS url FROM (SELECT unnest(range(TIMESTAMP '2010-11-01', TIMESTAMP '2012-02-02', INTERVAL 1 MONTH)) AS m)",
    "f22_html_text": "SELECT reg_id, CASE WHEN coalesce(doc_num, '') = '' THEN '' ELSE doc_num || chr(10) END || 'one' || chr(10) || 'two' AS visible FROM utc_doc_reg_df",
    "f17_composed": "SELECT doc_id, nfc_normalize(text) AS composed FROM documents",
    "f15_pictographs": f"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(coalesce(text, ''), '{_PICTURES}')), lambda x: unicode(x) >= 126976 OR contains(x, chr(65039)) OR (unicode(x) BETWEEN 9728 AND 10175))), ' ') AS pictographs FROM documents",
    "s_stream_daily": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "ud6_enriched": "SELECT reg_id, contains(lower('Subject: ' || coalesce(subject, '') || chr(10) || 'Text: ' || coalesce(summary, '')), '" + WORD + "') AS relevant, "
    "array_to_string(list_sort(list_distinct(regexp_extract_all('Subject: ' || coalesce(subject, '') || chr(10) || 'Text: ' || coalesce(summary, ''), 'L2/\\d{2}-\\d{3,}'))), ',') AS refs, NULL::VARCHAR AS error FROM utc_doc_reg_df",
}

"""Mail archives and other pages behind addresses: lists of months, fetching by a provider, index and message pages.

A provider is a picklable callable from an address to (status, body). It is
called on the executors; what fails keeps its row, with an error and empty
fields. Index and message pages are read by column expressions.

Cases: null pages have no rows and null fields; headers that are absent are null;
a page without body marks is read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.functions.text import mail_address, quote_blocks, strip_tags
from docketflow.sources.html import comment_headers
from docketflow.sources.mail import uses_new_layout

FETCHED = "url string, status int, body string, error string"
_BLOCKED = r"(?i)403 forbidden|access denied"


def months(spark: SparkSession, first: date, last: date, today: date | None = None) -> DataFrame:
    """(year, month) of each month from first to last that is not in the future."""
    last = min(last, today or date.today())
    span = F.explode(F.sequence(F.lit(first.replace(day=1)), F.lit(last.replace(day=1)), F.expr("interval 1 month"))).alias("m")
    none = spark.createDataFrame([], "year int, month int")
    return none if first.replace(day=1) > last else spark.range(1).select(span).select(F.year("m").alias("year"), F.month("m").alias("month"))


def document_url(base: str, doc_num: Column, doc_url: Column) -> Column:
    """Address of a document below the folder of its number's year; '' where the number has none."""
    year = F.regexp_extract(F.coalesce(doc_num, F.lit("")), r"^[Ll]2/(\d{2})", 1)
    return F.when(year == "", "").otherwise(F.concat(F.lit(base.rstrip("/") + "/L20"), year, F.lit("/"), F.coalesce(doc_url, F.lit(""))))


def fetch(urls: DataFrame, provider: Callable[[str], tuple[int, str]], partitions: int | None = None) -> DataFrame:
    """(url, status, body, error) of ``urls`` (url). A refusal, by status or in the text, and any failure become errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url in b["url"]:
                try:
                    status, body = (None, None) if url is None else provider(url)
                    error = "no address" if url is None else None if status == 200 else f"status {status}"
                except Exception as e:  # noqa: BLE001
                    status, body, error = None, None, str(e) or type(e).__name__
                rows.append((url, status, body if error is None else None, error))
            yield pd.DataFrame(rows, columns=["url", "status", "body", "error"]).astype({"status": "Int32"})

    spread = urls.select("url").repartition(partitions) if partitions else urls.select("url")
    done = spread.mapInPandas(run, FETCHED)
    refused = F.coalesce(F.col("body").rlike(_BLOCKED), F.lit(False))
    return done.select("url", "status", F.when(~refused, F.col("body")).alias("body"), F.when(refused, "refused").otherwise(F.col("error")).alias("error"))


def index_rows(page: Column, year: Column, month: Column) -> Column:
    """ARRAY of (link, subject, author) of a month's index: list items from June 2011 on, table cells before."""
    entry = r'(?is)<a\s+(?:name="[^"]*"\s+)?href="([^"#]+)"[^>]*>(.*?)</a>\s*(?:</strong>)?\s*(?:</td>)?\s*<(?:em|i|td)>(.*?)</(?:em|i|td)>'
    items = r'(?is)<li>.*?<a\s+href="([^"#]+)"[^>]*>(.*?)</a>.*?<em>(.*?)</em>'

    def read(pattern: str) -> Column:
        links, subjects, authors = (F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(pattern), F.lit(k)) for k in (1, 2, 3))
        zipped = F.arrays_zip(links.alias("link"), subjects.alias("subject"), authors.alias("author"))
        return F.transform(zipped, lambda x: F.struct(x["link"].alias("link"), F.trim(strip_tags(x["subject"])).alias("subject"), F.trim(strip_tags(x["author"])).alias("author")))

    return F.when(uses_new_layout(year, month), read(items)).otherwise(read(entry))


def message(page: Column) -> Column:
    """STRUCT (message_id, in_reply_to, name, email, sent, subject, body) of a message page: headers from its comments, the body between its marks, quotations grouped."""
    headers = comment_headers(page)
    body = F.regexp_extract(page, r'(?s)<!--\s*body="start"\s*-->(.*?)<!--\s*body="end"\s*-->', 1)
    text = F.regexp_replace(strip_tags(F.when(page.contains('body="start"'), body).otherwise(page)), r"^\s+|\s+$", "")
    of = lambda name: strip_tags(headers[name])
    return F.struct(
        of("id").alias("message_id"), of("inreplyto").alias("in_reply_to"), of("name").alias("name"), mail_address(of("email")).alias("email"), of("sent").alias("sent"), of("subject").alias("subject"), quote_blocks(text).alias("body"),
    )

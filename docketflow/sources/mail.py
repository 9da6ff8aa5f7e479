"""Mailboxes as rows: one message each, parsed by the standard library."""

from __future__ import annotations

import email
import re
from collections.abc import Iterator
from email import policy

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = (
    "mbox_file string, number int, message_id string, in_reply_to string, from_field string, date_field string, subject string, body string, has_attachments boolean, size_bytes bigint, error string"
)
_START = re.compile(r"^From .*$", re.M)


def body_of(message) -> tuple[str, bool]:
    """First text part that is no attachment, undecodable bytes replaced; and whether there are attachments."""
    text, attached = None, False
    for part in message.walk():
        if part.get_content_disposition() == "attachment":
            attached = True
        elif part.get_content_type() == "text/plain" and text is None:
            payload = part.get_payload(decode=True)
            charset = part.get_content_charset() or "utf-8"
            try:
                text = (payload or b"").decode(charset, "replace")
            except LookupError:
                text = (payload or b"").decode("utf-8", "replace")
    return text or "", attached


def split_mailbox(content: str) -> list[str]:
    """Messages of a mailbox; text before the first separator is none."""
    starts = [m.end() for m in _START.finditer(content)]
    ends = [m.start() for m in _START.finditer(content)][1:] + [len(content)]
    return [content[a:b].lstrip("\n") for a, b in zip(starts, ends)]


def parse_mailboxes(boxes: DataFrame) -> DataFrame:
    """Messages of ``boxes`` (mbox_file, content). A message that can't be parsed keeps its row, with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["mbox_file"], b["content"]):
                for k, raw in enumerate(split_mailbox(content or "")):
                    size = len(raw.encode("utf-8", "surrogatepass"))
                    try:
                        m = email.message_from_bytes(raw.encode("utf-8", "surrogatepass"), policy=policy.compat32)
                        header = lambda h, m=m: None if m[h] is None else str(email.header.make_header(email.header.decode_header(m[h])))
                        body, attached = body_of(m)
                        rows.append((name, k, header("Message-ID"), header("In-Reply-To"), header("From"), header("Date"), header("Subject"), body.replace("\r\n", "\n").rstrip("\n"), attached, size, None))
                    except Exception as e:  # noqa: BLE001
                        rows.append((name, k, None, None, None, None, None, "", False, size, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MESSAGE.split(", ")])

    return boxes.select("mbox_file", "content").mapInPandas(run, MESSAGE)


def read_mailboxes(spark: SparkSession, path: str, pattern: str = "*.mbox") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return parse_mailboxes(files.select(F.col("path").alias("mbox_file"), F.decode("content", "UTF-8").alias("content")))


def archive_url(base: str, year: Column, month: Column, thread: Column) -> Column:
    """Address of one message in an archive by year and month."""
    return F.concat(F.lit(base.rstrip("/") + "/"), year.cast("string"), F.lit("-m"), F.lpad(month.cast("string"), 2, "0"), F.lit("/"), thread, F.lit(".html"))


def uses_new_layout(year: Column, month: Column) -> Column:
    """Whether an archive page is of the layout used from June 2011 on."""
    return (year > 2011) | ((year == 2011) & (month >= 6))

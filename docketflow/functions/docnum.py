"""Document numbers of the form ``L2/yy-n``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hyphens and dashes that occur in typed document numbers.
DASHES = "\\-\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d"

NUMBER = rf"(?iU)(?<![\p{{L}}\p{{N}}])L2\s*/\s*(\d{{2}})\s*[{DASHES}]\s*(\d{{3,}})"


def doc_numbers(text: Column) -> Column:
    """All numbers in a string as ``L2/yy-n``, in order; empty for null or text without one."""
    return F.coalesce(
        F.zip_with(
            F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)),
            F.regexp_extract_all(text, F.lit(NUMBER), F.lit(2)),
            lambda year, number: F.concat(F.lit("L2/"), year, F.lit("-"), number),
        ),
        F.array().cast("array<string>"),
    )


def doc_number(text: Column) -> Column:
    """The first number in a string, or null."""
    year, number = (F.regexp_extract(text, NUMBER, k) for k in (1, 2))
    return F.when(number != "", F.concat(F.lit("L2/"), year, F.lit("-"), number))


def doc_numbers_of_array(texts: Column) -> Column:
    """Distinct numbers in an array of strings; null elements and null arrays hold none."""
    return F.array_distinct(F.flatten(F.transform(F.coalesce(texts, F.array().cast("array<string>")), doc_numbers)))

"""Text functions as column expressions; Arrow functions only where Spark has no built-in."""

from __future__ import annotations

import html as html_entities
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docketflow.functions.taxonomy import DOCUMENT_TYPES, IRRELEVANT, OTHERS, RELEVANT, SUBJECT_KEYWORDS, TEXT_KEYWORDS, WORD

NO_STRINGS = "array<string>"


def keyword_pattern(keywords: list[str]) -> str:
    """One alternation that finds any keyword as whole words, ignoring case."""
    return r"(?iU)(?<!\w)(?:" + "|".join(re.escape(k) for k in keywords) + r")(?!\w)"


def classify(subject: Column, rules: dict[str, dict[str, list[str]]] = DOCUMENT_TYPES) -> Column:
    """MAP of category to the subcategories with a keyword in the subject, in rule order."""
    entries = F.array(
        *(
            F.struct(
                F.lit(category).alias("key"),
                F.filter(F.array(*(F.when(subject.rlike(keyword_pattern(words)), F.lit(sub)) for sub, words in subs.items())), lambda x: x.isNotNull()).alias("value"),
            )
            for category, subs in rules.items()
        )
    )
    kept = F.filter(entries, lambda e: F.size(e["value"]) > 0)
    none = F.create_map(F.lit(OTHERS), F.array().cast(NO_STRINGS))
    return F.when(F.size(kept) > 0, F.map_from_entries(kept)).otherwise(none)


def relevance(subject: Column) -> Column:
    return F.when(F.coalesce(subject, F.lit("")).rlike(keyword_pattern(SUBJECT_KEYWORDS)), RELEVANT).otherwise(IRRELEVANT)


def keyword_hits(text: Column, keywords: list[str] = TEXT_KEYWORDS) -> Column:
    """The keywords that occur in a text, in list order."""
    tests = (F.when(text.rlike(r"(?iU)\b" + re.escape(k) + r"\b"), F.lit(k)) for k in keywords)
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def plain_dashes(text: Column) -> Column:
    """U+2010, 2013, 2014 and 2212 as hyphens, white space as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x{2010}\x{2013}\x{2014}\x{2212}]", "-"), r"(?U)\s+", " "))


def wide_dashes(text: Column) -> Column:
    """All dashes, also misread ones, as hyphens."""
    return F.regexp_replace(text, r"[\x{2010}\x{2011}\x{2013}\x{2014}\x{2212}]|\x{e2}\x{20ac}[\x{201c}\x{201d}\x{2018}\x{2019}]?", "-")


def mined_refs(text: Column, digits: str = "{3,}") -> Column:
    """Distinct document numbers L2/yy-n in a text, sorted. ``digits="{3}"`` reads no more than three digits."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(L2/\d{{2}}[-\x{{2010}}\x{{2013}}\x{{2014}}\x{{2212}}]\d{digits})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[\x{2010}\x{2013}\x{2014}\x{2212}]", "-"))))


def normal_id(doc_num: Column, digits: str = "{3,}") -> Column:
    """L2/yy-n where the text holds such a number, the text itself elsewhere, '' for null. ``digits="{3}"`` reads no more than three digits."""
    pattern = rf"(?i)L2/(\d{{2}})[-\x{{2013}}\x{{2014}}](\d{digits})"
    return F.when(doc_num.rlike(pattern), F.concat(F.lit("L2/"), F.regexp_extract(doc_num, pattern, 1), F.lit("-"), F.regexp_extract(doc_num, pattern, 2))).otherwise(
        F.coalesce(doc_num, F.lit(""))
    )


def id_year(doc_num: Column) -> Column:
    """Year of a number by its characters four and five; below 50 is 20yy; null if they are no digits."""
    yy = F.substring(doc_num, 4, 2)
    return F.when((F.length(doc_num) >= 6) & yy.rlike(r"^\d{2}$"), F.when(yy.cast("int") < 50, yy.cast("int") + 2000).otherwise(yy.cast("int") + 1900))


def id_parts(doc_num: Column) -> dict[str, Column]:
    """Other readings of a number: its year as 20yy, its first four and first nine characters."""
    return {"short_year": F.concat(F.lit("20"), F.substring(doc_num, 4, 2)), "head": F.substring(doc_num, 1, 4), "id": F.substring(doc_num, 1, 9)}


def id_in_range(doc_num: Column, first: int, last: int) -> Column:
    """Whether characters four and five are digits from first to last; false for null."""
    yy = F.substring(doc_num, 4, 2)
    return F.coalesce(yy.rlike(r"^\d{2}$") & yy.try_cast("int").between(first, last), F.lit(False))


def code_points(text: Column) -> Column:
    """Hexadecimal code points in any of five notations, sorted."""
    # Notations of a code point.
    patterns = (r"[Uu]\+([0-9A-F]{4,6})", r"\\u([0-9A-F]{4,6})", r"&#x([0-9A-F]{4,6});", r"\\x\{([0-9A-F]{4,6})\}", r"code[\s-]?point[\s:]+([0-9A-F]{4,6})")
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))))


def canonical_code_points(title: Column) -> Column:
    """Sorted upper-case code points of a title in one string."""
    return F.array_join(F.array_sort(F.transform(F.regexp_extract_all(title, F.lit(r"(?i)U\+([0-9A-F]{4,6})"), F.lit(1)), F.upper)), " ")


def shortcodes(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r":([a-z0-9_\-+]+):"), F.lit(1))))


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]", "")


def sender(field: Column) -> Column:
    """STRUCT (email, name) of ``user at domain (Name)``; '' where a part is missing."""
    address = F.regexp_replace(F.trim(F.regexp_replace(field, r"\(.*?\)", "")), r"\s+at\s+", "@")
    return F.struct(
        F.when(address.contains("@"), address).otherwise("").alias("email"), F.trim(F.regexp_extract(F.coalesce(field, F.lit("")), r"\((.*?)\)", 1)).alias("name")
    )


def mail_address(text: Column) -> Column:
    """Address of a mailto link or of text with ``_at_``."""
    link = F.regexp_extract(text, r"(?i)mailto:([^\"'?>\s]+)", 1)
    return F.replace(F.when(link != "", link).otherwise(F.trim(text)), F.lit("_at_"), F.lit("@"))


def strip_tags(text: Column) -> Column:
    """Text without tags, common entities resolved."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"\.([^./]+)$", 1))


#: Which reader a file of an extension goes to.
READERS = {"txt": "text", "htm": "html", "html": "html", "pdf": "pdf"}


def reader_of(url: Column) -> Column:
    """The reader for an address by its extension; '' where there is none, so that its text is empty."""
    ext, out = extension(url), F.lit("")
    for e, reader in READERS.items():
        out = F.when(ext == e, reader).otherwise(out)
    return out


def word_grams(phrase: Column, least: int = 2, most: int = 3) -> Column:
    """All n-grams of a phrase's words with repetitions, after the whole phrase itself."""
    words = F.filter(F.split(F.trim(phrase), r"(?U)\s+"), lambda w: w != "")
    empty = F.array().cast(NO_STRINGS)

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    grams = [F.when(F.size(words) >= n, of(n)).otherwise(empty) for n in range(least, most + 1)]
    return F.when(F.trim(phrase) != "", F.concat(F.array(F.trim(phrase)), *grams)).otherwise(empty)


def proposed_subject(title: Column) -> Column:
    """What a proposal is for: its title without the words that say it is one, before or after.

    A plain lead-in is only left out where trailing words were, as it may be part of a title.
    """
    bare = F.regexp_replace(title, rf"(?i)(\s*\[{WORD} proposal\]|(\s+unicode)?\s+{WORD}( proposal)?)$", "")
    named = rf"(?i)^proposal for {WORD}[:\s-]\s*"
    return F.trim(F.when(bare.rlike(named + "."), F.regexp_replace(bare, named, "")).when(bare != title, F.regexp_replace(bare, r"(?i)^proposal for\s+", "")).otherwise(title))


def sorted_list(text: Column) -> Column:
    """A comma-separated list with trimmed, sorted members."""
    return F.array_join(F.array_sort(F.transform(F.split(text, ","), lambda x: F.trim(x))), ", ")


def one_line(text: Column) -> Column:
    """White space collapsed; pipes escaped for a Markdown cell."""
    return F.replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|"))


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_")


def cut_text(text: Column, most: int, marker: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(marker))).otherwise(text)


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def fill_template(template: str, **fields: Column) -> Column:
    """``{name}`` replaced by columns in one pass, ``{{`` and ``}}`` by braces; nulls become ''."""
    parts = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        name = piece[1:-1] if re.fullmatch(r"\{\w+\}", piece) else None
        parts.append(F.coalesce(fields[name].cast("string"), F.lit("")) if name else F.lit({"{{": "{", "}}": "}"}.get(piece, piece)))
    return F.concat(*parts)


def digits_or_zero(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{1,18}$"), text.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def display_sender(name: Column, email: Column) -> Column:
    name, email = (F.when(F.trim(c) != "", F.trim(c)) for c in (name, email))
    return F.coalesce(F.concat(name, F.lit(" <"), email, F.lit(">")), name, email, F.lit(""))


def literal_list(text: Column) -> Column:
    """ARRAY<STRING> from a list as a scripting language prints it; null where it can't be read."""
    return F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})


def label_text(labels: Column) -> Column:
    """``category: a, b; category: c`` of a label map, categories sorted."""
    entries = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(entries, lambda e: F.when(F.size(e["value"]) > 0, F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", "))).otherwise(e["key"])), "; ")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


_PICTOGRAPHS = (
    "(?:[\U0001f1e6-\U0001f1ff]{2}|[#*0-9]\ufe0f?\u20e3|[\u00a9\u00ae\u203c-\u3299\U0001f000-\U0001faff]\ufe0f?[\U0001f3fb-\U0001f3ff]?"
    "(?:\u200d[\u2190-\u2bff\U0001f000-\U0001faff]\ufe0f?[\U0001f3fb-\U0001f3ff]?)*)"
)
_PICTOGRAPH = re.compile(_PICTOGRAPHS)


def pictograph_sql() -> str:
    """The pattern of ``pictographs`` as a DuckDB literal's content."""
    return _PICTOGRAPHS


@F.pandas_udf(ArrayType(StringType()))
def pictographs(texts: pd.Series) -> pd.Series:
    """Distinct pictographs and sequences of a text, sorted."""

    def find(text: str | None) -> list[str]:
        found = {m for m in _PICTOGRAPH.findall(text or "") if ord(m[0]) >= 0x1F000 or "\ufe0f" in m or 0x2600 <= ord(m[0]) <= 0x27BF}
        return sorted(found)

    return texts.map(find)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """Visible text: lines stripped, split at double blanks, blank ones dropped."""

    def read(page: str | None) -> str | None:
        if page is None:
            return None
        parser = _Text()
        parser.feed(page)
        parser.close()
        chunks = (c.strip() for line in "".join(parser.out).splitlines() for c in line.strip().split("  "))
        return "\n".join(c for c in chunks if c)

    return pages.map(read)


@F.pandas_udf(StringType())
def quote_blocks(bodies: pd.Series) -> pd.Series:
    """Mail text with runs of equally deep quotation between markers."""

    def group(body: str | None) -> str | None:
        if body is None:
            return None
        out, depth = [], 0
        for line in body.splitlines():
            mark = re.match(r"[>\s]*", line)[0]
            now = mark.count(">")
            if now != depth:
                out += [f"[/quote {depth}]"] * (depth > 0) + [f"[quote {now}]"] * (now > 0)
                depth = now
            out.append(line[len(mark) :] if now else line)
        return "\n".join(out + [f"[/quote {depth}]"] * (depth > 0))

    return bodies.map(group)


def unescape(text: str) -> str:
    return html_entities.unescape(text)

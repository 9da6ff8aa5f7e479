"""Visually identical text with different characters (problem 10).

Each Arrow batch goes through DuckDB inside the Python worker: embedded SQL maps
width forms, blanks, invisible characters and look-alikes by ``translate`` and
regular expressions around ``nfc_normalize``. Only digests leave the worker, so
no text is shuffled.

What the form keeps apart: other letters (also other Latin ones, such as the
script g), accents, case, raised and joined forms, dashes of different length,
pictograph sequences (their joiners, selectors and tags stay). What it unites:
full and half width, the kind of blank and of line break, composed and decomposed
accents, invisible characters, variation selectors after letters, hyphens, and
letters of other scripts that look like Latin ones: for Greek and Cyrillic, whose
texts occur, those of one and the same shape; for Armenian, Cherokee, Coptic,
Lisu and single Roman numerals, what the public confusables data that comes with
Spark (ICU) has, as far as the case is the same and no two letters of a script
fall together.

Cases: null texts and texts of nothing but blanks and line breaks have no form;
equal texts are no pair; empty input gives empty results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.operators.skew import heavy_keys, salted_join
from docketflow.runtime import cut

# Letters of Greek and Cyrillic by the Latin letter that they look like.
LOOK_ALIKES = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "H": "ΗН", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚК", "M": "ΜМ", "N": "Ν", "O": "ΟО", "P": "ΡР", "Q": "Ԛ",
    "S": "Ѕ", "T": "ΤТ", "W": "Ԝ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "o": "оο", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ν", "w": "ԝ", "x": "х", "y": "у",
    "Ë": "Ё", "È": "Ѐ", "Ï": "Ї", "Ă": "Ӑ", "Ä": "Ӓ", "Ĕ": "Ӗ", "Ö": "Ӧ", "ë": "ё", "è": "ѐ", "ï": "ї", "ă": "ӑ", "ä": "ӓ", "ĕ": "ӗ", "ö": "ӧ", "ó": "ό",
}
# Other signs by the one that looks the same; those that composition unites need no entry.
SAME_SIGNS = {"-": "\u2010\u2011", "\u03bc": "\u00b5"}
# Blanks, as code point ranges.
BLANKS = r"\x{9}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{2800}\x{3000}\x{3164}\x{FFA0}"
# Characters that show nothing, as code point ranges; the joiner only outside of pictographs.
INVISIBLE = r"\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}\x{200C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}"
# What a joiner may stand beside in a pictograph.
PICTURES = r"\x{2190}-\x{2BFF}\x{FE0F}\x{1F000}-\x{1FAFF}"
# Scripts, as code point ranges, whose look-alikes come from the confusables data.
SCRIPTS = {"Armenian": (0x530, 0x58F), "Cherokee": (0x13A0, 0x13FF), "Coptic": (0x2C80, 0x2CFF), "Lisu": (0xA4D0, 0xA4FF), "Roman capitals": (0x2160, 0x216F), "Roman small": (0x2170, 0x217F)}
# Line breaks besides the line feed; letters after which a variation selector shows nothing.
BREAKS = "\r\x0b\x0c\x85\u2028\u2029"
LETTERS = r"\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{Hebrew}\p{Arabic}\p{Cherokee}\p{P}"


def width_forms() -> dict[str, str]:
    """Full and half-width characters by their ordinary form, as the character database has it."""
    out = {}
    for code in (0x3000, *range(0xFF00, 0xFFF0)):
        kind, _, form = unicodedata.decomposition(chr(code)).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            out[chr(code)] = chr(int(form, 16))
    return out


def public_look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters of SCRIPTS by the Latin letter of the same case that the confusables data gives for them alone in their script."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    out: dict[str, str] = {}
    for script, (first, last) in SCRIPTS.items():
        chars = [chr(c) for c in range(first, last + 1) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo", "Nl")]
        found: dict[str, list[str]] = {}
        for char, shape in zip(chars, checker.getSkeleton("\x01".join(chars)).split("\x01")):
            small = unicodedata.category(char) == "Ll" or script == "Roman small"
            shape = "I" if shape == "l" and not small else shape  # the data has one shape for both
            if len(shape) == 1 and shape.isascii() and shape.isalpha() and shape.islower() == small:
                found.setdefault(shape, []).append(char)
        out |= {own[0]: shape for shape, own in found.items() if len(own) == 1}
    return out


def _translation(look_alikes: dict[str, str]) -> tuple[str, str]:
    pairs = width_forms() | look_alikes | dict.fromkeys(BREAKS, "\n")
    for table in (LOOK_ALIKES, SAME_SIGNS):
        for one, several in table.items():
            pairs |= dict.fromkeys(several, one)
    return "".join(pairs), "".join(pairs.values())


def form_sql(look_alikes: dict[str, str], table: str = "batch") -> str:
    """The embedded query: (doc_id, form, text) of ``table`` (doc_id, text); ``look_alikes`` are those of the public data."""
    source, target = _translation(look_alikes)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    visible = f"regexp_replace(text, '[{INVISIBLE}]+', '', 'g')"
    # tags belong to a flag or show nothing; selectors belong to a keycap or another pictograph, or show nothing
    visible = f"regexp_replace({visible}, '(\\x{{1F3F4}}[\\x{{E0020}}-\\x{{E007F}}]+)|[\\x{{E0001}}\\x{{E0020}}-\\x{{E007F}}]+', '\\1', 'g')"
    visible = f"regexp_replace({visible}, '([0-9#*]\\x{{FE0F}}\\x{{20E3}})|([0-9#*{LETTERS}])[\\x{{FE00}}-\\x{{FE0F}}]+', '\\1\\2', 'g')"
    joined = visible
    for _ in range(2):  # matches don't overlap, so every second joiner of a sequence is left to the second pass
        joined = f"regexp_replace({joined}, '([{PICTURES}])\\x{{200D}}([{PICTURES}])', '\\1' || chr(57344) || '\\2', 'g')"
    single = f"replace(replace(replace({joined}, chr(8205), ''), chr(57344), chr(8205)), chr(13) || chr(10), chr(10))"
    # composed before and after, as a look-alike may carry the accent
    form = f"nfc_normalize(translate(nfc_normalize({single}), {quote(source)}, {quote(target)}))"
    blank = f"regexp_replace({form}, '[{BLANKS}]', ' ', 'g')"
    return f"""
        SELECT doc_id, CASE WHEN NOT regexp_full_match(form, '\\s*') THEN form END AS form, text
        FROM (SELECT doc_id, text, CASE WHEN text IS NOT NULL THEN {blank} END AS form FROM {table})
    """


def _run(query: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB"}) as db:
            for b in batches:
                db.register("batch", pa.table({"doc_id": b.column(0), "text": b.column(1)}))
                out = db.sql(query).to_arrow_table().select(names)
                db.unregister("batch")
                yield from out.to_batches()

    return run


def consistent_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, form): every text in its consistent form; null where there is nothing to read."""
    query = form_sql(public_look_alikes(documents.sparkSession))
    return documents.select("doc_id", "text").mapInArrow(_run(query, ["doc_id", "form"]), "doc_id bigint, form string")


def digest_sql(look_alikes: dict[str, str], table: str = "batch") -> str:
    return f"SELECT doc_id, md5(form) AS form, md5(text) AS raw FROM ({form_sql(look_alikes, table)}) WHERE form IS NOT NULL"


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, form, raw): 128-bit digests of the consistent form and of the text itself."""
    return documents.select("doc_id", "text").mapInArrow(_run(digest_sql(public_look_alikes(documents.sparkSession)), ["doc_id", "form", "raw"]), "doc_id bigint, form string, raw string")


def comparable_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): documents whose texts differ and have the same form.

    Texts are represented by their digests, with the number of their documents;
    forms with one spelling, however many documents share it, are left out before
    anything is joined. Pairs are formed between spellings. Only then do both get
    their documents, the rarer spelling of a pair first; those of a frequent
    spelling, such as boilerplate, are spread over many tasks.
    """
    known = cut(digests(documents), "text-digests")
    spellings = cut(known.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n")), "spellings")
    several = spellings.groupBy("form").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("form")
    texts = cut(spellings.join(several, "form", "left_semi"), "comparable-texts")
    heavy = cut(heavy_keys(spellings.select("raw", "n"), "raw"), "frequent-texts")
    members = cut(salted_join(known.select("raw", "doc_id"), texts.select("raw"), heavy, "raw", ["doc_id"]), "comparable-documents")
    size = lambda p: F.struct(F.col(f"{p}.n"), F.col(f"{p}.raw"))
    pairs = texts.alias("a").join(texts.alias("b"), "form").filter(size("a") < size("b")).select(F.col("a.raw").alias("raw"), F.col("b.raw").alias("other"))
    rarer = salted_join(members, pairs, heavy, "raw", ["doc_id"]).select(F.col("other").alias("raw"), F.col("doc_id").alias("a"))
    both = salted_join(members.withColumnRenamed("doc_id", "b"), rarer, heavy, "raw", ["b"])
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))


def membership(documents: DataFrame) -> DataFrame:
    """(doc_id, form_class, n_spellings): the class of each text that can be read, and how many spellings it has."""
    known = cut(digests(documents), "text-digests")
    per = cut(known.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n")).groupBy("form").agg(F.count(F.lit(1)).alias("n_spellings"), F.sum("n").alias("n")), "forms")
    joined = salted_join(known.select("doc_id", "form"), per.drop("n"), heavy_keys(per.select("form", "n"), "form"), "form", ["doc_id"])
    return joined.select("doc_id", F.col("form").alias("form_class"), "n_spellings")

"""Several values packed in one field, one row each (problem 7).

A string is split on its quote characters: odd pieces are literals, even pieces
are split on delimiters. Array folds put the pieces together again, so that a
value may mix quoted and unquoted parts, and number the values. Delimiters are
``;``, ``|``, tabs and line breaks, ``、``, and, outside of names that contain
them, ``,``, ``/``, ``+``, ``&`` and ``and``. What belongs to a name is kept:

* delimiters in parentheses, and those within a listed name such as
  "Games, Flags & Sports Panel", also with typing errors in its words;
* the comma of "Surname, Given" and the one before "Inc." or "Jr.";
* ``and``, ``&``, ``/``, ``+`` after a lone word that is no listed short name.

Everything is ordinary expressions; no shuffle and no Python is needed.

Cases: null and blank strings, and strings of nothing but delimiters, give no
row; empty values are not counted; equal values in one string are rows of their
own; an unclosed quote is an ordinary character.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Private-use characters as marks: a place to cut, one after a delimiter that doesn't cut, an unclosed quote. Where a text holds
#: these itself, they are written as ESCAPE with a letter from the same block, and read back in the values.
CUT, KEEP, QUOTE, ESCAPE = "\ue001", "\ue000", "\ue002", "\ue003"
ESCAPED = {ESCAPE: ESCAPE + "\ue013", KEEP: ESCAPE + "\ue010", CUT: ESCAPE + "\ue011", QUOTE: ESCAPE + "\ue012"}

#: What may follow a name after a comma.
SUFFIXES = "inc ltd limited incorporated gmbh llc llp corp corporation co company plc ag sa bv kg oy ab jr sr ii iii iv phd md esq".split()
#: Words that belong to the surname after them.
PARTICLES = "von van de der den del della di da dos la le el al bin ter ten zu zur".split()
#: Words that a body's acronym leaves out.
SMALL_WORDS = "and of for the in on to de".split()

_WORD = r"[\p{L}\p{M}'’.\-]+"


def _typed(word: str) -> str:
    """Pattern of a word with at most one letter added, left out or replaced, or two exchanged."""
    ways = {re.escape(word)}
    if len(word) > 3:
        letters = r"[\p{L}\p{M}]"
        for k in range(len(word)):
            ways.add(re.escape(word[:k]) + letters + "{0,2}" + re.escape(word[k + 1 :]))
            ways.add(re.escape(word[:k]) + letters + "{2}" + re.escape(word[k + 2 :]))
    return f"(?:{'|'.join(sorted(ways))})"


def protected_pattern(names: list[str]) -> str:
    """One pattern for all delimiters within listed names, found by the words on either side."""
    found = {}
    for name in names:
        for m in re.finditer(r"([^\W\d_]+)(\s*[,/&+;|]\s*|\s+and\s+)(?=([^\W\d_]+))", name):
            left, delimiter, right = m[1], m[2].strip(), m[3]
            for way in ("&", "and") if delimiter in ("&", "and") else (delimiter,):
                sign = r"\s+and(?=\s+" if way == "and" else rf"\s*{re.escape(way)}(?=\s*"
                found[left.lower(), way, right.lower()] = rf"{_typed(left)}{sign}{_typed(right)}(?![\p{{L}}\p{{M}}]))"
    # the words before a delimiter are few; the others are passed over before any name is tried
    return rf"(?iU)(?<![\p{{L}}\p{{M}}])(?=[\p{{L}}\p{{M}}]+(?:\s*[,/&+;|]|\s+and\s))({'|'.join(found[k] for k in sorted(found)) or '(?!)'})"


def short_names(names: list[str]) -> list[str]:
    """Acronyms and first words by which the listed bodies may be named alone."""
    out = set()
    for name in names:
        words = [w for w in re.findall(r"[^\W\d_]+", name) if w.lower() not in SMALL_WORDS]
        if len(words) > 2:
            out.add("".join(w[0] for w in words).upper())
        if len(words) > 1 and not re.search(r"[,/&]| and ", name):
            out.add(words[0])
    return sorted(out)


def _kept_inside(after: Column) -> Column:
    """Text after an opening parenthesis, with the delimiters before the closing one marked as kept."""
    inside = F.when(after.contains(")"), F.substring_index(after, ")", 1)).otherwise(F.lit(""))
    marked = F.regexp_replace(inside, r"(?iU)([,;|/&+]|(?<=\s)and(?=\s))", "$1" + KEEP)
    return F.concat(marked, after.substr(F.length(inside) + 1, F.length(after)))


def _cuts(piece: Column, protect: str, shorts: str) -> Column:
    """An unquoted piece with CUT in place of every delimiter that separates values; all else stays as it was."""
    p = piece
    keep, free = "$1" + KEEP, rf"(?!{KEEP})"
    p = F.array_join(F.transform(F.split(p, r"\("), lambda x, k: F.when(k > 0, _kept_inside(x)).otherwise(x)), "(")
    p = F.regexp_replace(p, protect, keep)
    p = F.regexp_replace(p, rf"(?U)\s*[;|\n\r\t\x{{3001}}\x{{ff1b}}\x{{ff5c}}]{free}\s*", CUT)
    end = rf"\s*(?:$|[{CUT},/&+(]|\sand\s)"
    p = F.regexp_replace(p, rf"(?iU)(,)(?=\s*(?:{'|'.join(SUFFIXES)})\b\.?{end})", keep)
    edge = rf"(?:^|(?<=[{CUT},/&+])|(?<=\sand\s))"
    surname = rf"(?:(?:{'|'.join(PARTICLES)})\s+)*(?!(?:{shorts})\s*,)[\p{{L}}\p{{M}}'\x{{2019}}\-]+"
    given = r"(?:\p{L}\.(?:\s*\p{L}\.)*|[\p{L}\p{M}'\x{2019}\-]+(?:\s+\p{L}\.)*)"
    p = F.regexp_replace(p, rf"(?iU)({edge}\s*{surname}\s*,)(\s*(?!and\s){given})(?={end})", keep + "$2")
    p = F.regexp_replace(p, rf"(?iU)\s*,{free}\s*(?:(?:and\s|&)\s*)?", CUT)
    lone = rf"{edge}\s*(?!(?:{shorts})\s)[\p{{L}}\p{{M}}'\x{{2019}}\-]+"
    p = F.regexp_replace(p, rf"(?iU)({lone}(?:\s*[/&+]|\s+and(?=\s)))(?=\s*\S)", keep)
    p = F.regexp_replace(p, rf"(?U)\s*[/&+]{free}\s*", CUT)
    p = F.regexp_replace(p, rf"(?iU)(?:^|(?<={CUT})|\s+)and{free}(?:\s+|$)", CUT)
    return F.replace(p, F.lit(KEEP), F.lit(""))


def _bare(value: Column) -> Column:
    """A trimmed value without enclosing quotes, doubled quotes inside reduced to one."""
    trim = r"(?U)^\s+|\s+$"
    v = F.regexp_replace(value, trim, "")
    enclosed = v.rlike(r'(?s)^"(?:[^"]|"")*"$')
    inner = F.regexp_replace(v.substr(F.lit(2), F.greatest(F.length(v) - 2, F.lit(0))), trim, "")
    return F.replace(F.replace(F.when(enclosed, inner).otherwise(v), F.lit('""'), F.lit('"')), F.lit(QUOTE), F.lit('"'))


def _escaped(text: Column) -> Column:
    out = text
    for mark, written in ESCAPED.items():
        out = F.replace(out, F.lit(mark), F.lit(written))
    return F.when(text.rlike(f"[{KEEP}-{ESCAPE}]"), out).otherwise(text)


def _read_back(value: Column) -> Column:
    out = value
    for mark, written in reversed(ESCAPED.items()):
        out = F.replace(out, F.lit(written), F.lit(mark))
    return F.when(value.contains(ESCAPE), out).otherwise(value)


def split_values(text: Column, names: list[str]) -> Column:
    """Array of the values of ``text``, in order. ``names``: the bounded list of known bodies."""
    text = _escaped(text)
    protect, shorts = protected_pattern(names), "|".join(map(re.escape, short_names(names))) or "(?!)"
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"')))
    closed = F.when(quotes % 2 == 0, text).otherwise(F.regexp_replace(text, r'"(?=[^"]*$)', QUOTE))
    pieces = F.transform(
        F.split(closed, '"'),
        # a piece after a quote keeps the quote in front, so that its start isn't taken for the start of a value
        lambda piece, k: F.when(k % 2 == 1, F.concat(F.lit('"'), piece)).otherwise(
            _cuts(F.concat(F.when(k > 0, F.lit('"')).otherwise(F.lit("")), piece), protect, shorts)
        ),
    )
    whole = F.aggregate(pieces, F.lit(""), lambda done, piece: F.concat(done, piece))
    return F.filter(F.transform(F.split(whole, CUT), lambda v: _read_back(_bare(v))), lambda v: v != "")


def explode_values(df: DataFrame, id_col: str, text_col: str, names: list[str]) -> DataFrame:
    """(row_id, pos, n_values, item): one row per value of ``text_col``; pos counts from 1."""
    # the array is bound once, and the count travels with each value, so that no filter on it repeats the split
    each = F.flatten(
        F.transform(
            F.array(split_values(F.col(text_col), names)),
            lambda values: F.transform(values, lambda v, k: F.struct((k + 1).alias("pos"), F.size(values).alias("n_values"), v.alias("item"))),
        )
    )
    return df.select(F.col(id_col).alias("row_id"), F.explode(each).alias("v")).select("row_id", "v.pos", "v.n_values", "v.item")

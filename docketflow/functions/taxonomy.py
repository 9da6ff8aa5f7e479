"""Keyword rules for register documents, read from ``keywords.toml``, where they are kept as data."""

import pkgutil
import tomllib

_RULES = tomllib.loads(pkgutil.get_data(__package__, "keywords.toml").decode())
DOCUMENT_TYPES: dict[str, dict[str, list[str]]] = _RULES["types"]
SUBJECT_KEYWORDS: list[str] = _RULES["subject"]
TEXT_KEYWORDS: list[str] = _RULES["text"]
RELEVANT, IRRELEVANT, OTHERS = _RULES["labels"]
#: The word for a pictograph, which is also part of column names.
WORD = SUBJECT_KEYWORDS[0]

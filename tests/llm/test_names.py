import pytest

from docketflow.llm import names
from docketflow.llm.spelling import edits

PEOPLE = "contributor_id bigint, full_name string, kind string, affiliation string"
DIRECTORY = [
    (1, "Elizabeth Marden", "person", "Glyph Board"), (2, "Edward von Trask", "person", None), (3, "Søren O'Dell-Reyes", "person", None), (4, "Edgar Marsh", "person", None),
    (5, "Emil Marsh", "person", None), (6, "Games, Flags & Sports Panel", "org", None), (7, "Zizund Systems Inc.", "org", None), (8, "National Committee for Sets", "org", None), (9, " ", "org", None),
]
MENTION = "tab string, fld string, row_id bigint, pos int, text string, hint string, contributor_id bigint, spelling string"
CASES = {
    "Elizabeth Marden": 1, " Elizabeth  Marden ": 1, "ELIZABETH MARDEN": 1, "Marden, Elizabeth": 1, "Marden Elizabeth": 1, "E. Marden": 1, "Marden, E.": 1, "Dr. Marden": 1, "Liz Marden": 1,
    'Elizabeth "Liz" Marden': 1, "Elizabeht Marden": 1, "Elizabeth Mrdenn": 1, "emarden": 1, "elizabeth.marden": 1, "marden_elizabeth": 1, "Elizabeth Q. Marden": 1,
    'Edward "Ted" von Trask': 2,
    "Elizabeth Marden (Glyph Board)": 1, "Elizabeth Marden via list": 1, "Edward von Trask": 2, "von Trask, Ted": 2, "evontrask": 2, "Soren O'Dell-Reyes": 3, "sodell-reyes": 3,
    "E. Marsh": None, "Marsh, E.": None, "Ms. Marsh": None, "Edgar Marsh": 4, "Emil Mrash": 5, "Walter Marden": None, "Marden": None, "GFSP": 6, "Games, Flags and Sports Panel": 6, "Zizund": 7,
    "Zizund Systems": 7, "Zizund Systems Ltd.": 7, "ZIZUND SYTSEMS": 7, "Natl. Cttee for Sets": 8, "Nonsense Body": None, "": None, "   ": None, None: None, "x" * 5000: None,
}


def _link(spark, mentions, directory=DIRECTORY):
    return names.link(spark.createDataFrame(mentions, MENTION), spark.createDataFrame(directory, PEOPLE))


def test_cases(spark):
    mentions = [("t", "f", k, 1, text, None, 99, "clash") for k, text in enumerate(CASES)]
    got = {r["row_id"]: r["contributor_id"] for r in _link(spark, mentions).collect()}
    assert {text: got.get(k) for k, text in enumerate(CASES)} == CASES


def test_richer_profiles_match_again(spark):
    """The middle initial learned from one spelling, and a nickname from another, link spellings that were open."""
    mentions = [("t", "f", k, 1, x, None, None, None) for k, x in enumerate(["Edgar K. Marsh", "Emil P. Marsh", "E. K. Marsh", 'Edgar "Bix" Marsh', "Bix Marsh", "Marsh, Bix"])]
    got = {r["row_id"]: r["contributor_id"] for r in _link(spark, mentions).collect()}
    assert got == {0: 4, 1: 5, 2: 4, 3: 4, 4: 4, 5: 4}


def test_spellings_are_united(spark):
    """A nickname is known from the address, and a spelling too far from the entry is one letter from a united one."""
    mentions = [("t", "f", 1, 1, "Betsy Marden", "elizabeth.marden", None, None), ("t", "f", 2, 1, "Betzy Marden", None, None, None), ("t", "f", 3, 1, "Zoe Marden", None, None, None)]
    mentions += [("t", "f", 4, 1, "Edgar Marsh", "emil.marsh", None, None), ("t", "f", 5, 1, "Emil Marsh", None, None, None)]
    assert {r["row_id"]: r["contributor_id"] for r in _link(spark, mentions).collect()} == {1: 1, 2: 1, 4: 4, 5: 5}


def test_names_outside_the_directory(spark):
    """Full names that are no entry form profiles, named after the most frequent spelling."""
    texts = ["Wanda Kestrel", "Kestrel, Wanda", "Wanda Kestrel", "Wanda Kestrell", "Wanda Kestrl", "Otto Brandis", "W. Kestrel", "Emil Marsh"]
    mentions = spark.createDataFrame([("t", "f", k, 1, x, None, None, None) for k, x in enumerate(texts)], MENTION)
    rows = names.link_all(mentions, spark.createDataFrame(DIRECTORY, PEOPLE)).collect()
    assert {r["row_id"]: r["profile"] or r["contributor_id"] for r in rows} == {**dict.fromkeys(range(5), "kestrel wanda"), 5: "brandis otto", 7: 5}


def test_many_facts_of_one_entry(spark):
    """No number of nicknames is too large."""
    nicks = [f"{a}{b}x" for a in "bcdfghjklm" for b in ("aab", "eeb", "iib", "oob", "uub", "aad", "eed", "iid")]
    mentions = [("t", "f", k, 1, text, None, None, None) for k, n in enumerate(nicks) for text in (f'Elizabeth "{n}" Marden', f"Marden, {n}")]
    assert _link(spark, mentions).count() == 2 * len(nicks)


def test_hint_hot_spelling_and_empty(spark):
    mentions = [("t", "f", k, 1, "emarsh", "emil.marsh" if k % 2 else "edgar.marsh", None, None) for k in range(600)]
    assert {(r["row_id"] % 2, r["contributor_id"]) for r in _link(spark, mentions).collect()} == {(0, 4), (1, 5)}
    assert _link(spark, []).count() == 0
    assert _link(spark, mentions, []).count() == 0


@pytest.mark.parametrize(("a", "b", "n"), [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "abxc", 1), ("abcd", "badc", 2), ("abc", "xyz", 3), ("", "ab", 2), ("kitten", "sitting", 3)])
def test_edits(a, b, n):
    assert min(edits(a, b, 2), 3) == min(n, 3)

import pytest

from docketflow.operators import packed_values

BODIES = ["Games, Flags & Sports Panel", "Colour, Skin and Hair Task Force", "Text/Layout Working Group", "Northern Orthography Council", "Zizund Systems", "Groskil Media Inc."]
CASES = {
    "Ann Lee, Bo Ray": ["Ann Lee", "Bo Ray"],
    "Ann Lee,Bo Ray and Cy Fox": ["Ann Lee", "Bo Ray", "Cy Fox"],
    "Ann Lee, Bo Ray, and Cy Fox": ["Ann Lee", "Bo Ray", "Cy Fox"],
    "Lee, Ann; Bo Ray": ["Lee, Ann", "Bo Ray"],
    "Lee, Ann, Ray, Bo": ["Lee, Ann", "Ray, Bo"],
    "de la Cruz, A. B. | Bo Ray": ["de la Cruz, A. B.", "Bo Ray"],
    '"Lee, Ann",Bo Ray': ["Lee, Ann", "Bo Ray"],
    '"Elizabeth ""Liz"" Lee","Ray, Bo"': ['Elizabeth "Liz" Lee', "Ray, Bo"],
    'Thomas "Tom" Lee and The Northern Orthography Council': ['Thomas "Tom" Lee', "The Northern Orthography Council"],
    "; Ann Lee;; Bo Ray ; ": ["Ann Lee", "Bo Ray"],
    "Ann Lee\nBo Ray\tCy Fox": ["Ann Lee", "Bo Ray", "Cy Fox"],
    "Ann Lee、Bo Ray": ["Ann Lee", "Bo Ray"],
    "Ann Lee / Bo Ray + Cy Fox & Di Orr": ["Ann Lee", "Bo Ray", "Cy Fox", "Di Orr"],
    "Games, Flags & Sports Panel, Ann Lee": ["Games, Flags & Sports Panel", "Ann Lee"],
    "Games, Flgas and Sports Panel & Ann Lee": ["Games, Flgas and Sports Panel", "Ann Lee"],
    "COLOUR, SKIN AND HAIR TASK FORCE; Text/Layuot WG": ["COLOUR, SKIN AND HAIR TASK FORCE", "Text/Layuot WG"],
    "Northern Orthography Council, Quentin Marsh": ["Northern Orthography Council", "Quentin Marsh"],
    "Zizund, Ann Lee": ["Zizund", "Ann Lee"],
    "NOC and Ann Lee": ["NOC", "Ann Lee"],
    "Groskil Media, Inc., Ann Lee": ["Groskil Media, Inc.", "Ann Lee"],
    "Ann Lee (Games, Flags & Sports Panel), Bo Ray": ["Ann Lee (Games, Flags & Sports Panel)", "Bo Ray"],
    "Ann Lee; Ann Lee": ["Ann Lee", "Ann Lee"],
    'Ann Lee; Bo "Ray': ["Ann Lee", 'Bo "Ray'],
    "Ann Lee": ["Ann Lee"],
    "Lee, Ann": ["Lee, Ann"],
    "Ann\ue000Lee; B\ue001o\ue003\ue010, C\ue002y Fox": ["Ann\ue000Lee", "B\ue001o\ue003\ue010", "C\ue002y Fox"],
    " ;; ": [],
    "": [],
}


@pytest.mark.parametrize("names", [BODIES])
def test_cases(spark, names):
    df = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(CASES)], "id bigint, source string, item string")
    got = {k: [] for k in range(len(CASES))}
    for r in packed_values.explode_values(df, "id", "source", names).orderBy("row_id", "pos").collect():
        got[r["row_id"]].append(r["item"])
        assert r["pos"] == len(got[r["row_id"]])
    assert {x: got[k] for k, x in enumerate(CASES)} == CASES


def test_null_long_and_no_directory(spark):
    long = "; ".join(f"Ann Lee{chr(97 + k % 26)}" for k in range(20_000))
    df = spark.createDataFrame([(1, None), (2, long)], "id bigint, source string")
    assert packed_values.explode_values(df, "id", "source", []).count() == 20_000

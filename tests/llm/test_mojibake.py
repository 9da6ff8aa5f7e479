import random

from docketflow.llm import mojibake

VALUES = "tab string, fld string, row_id bigint, text string, restored string, n bigint"


def _misread(text, right, wrong):
    raw = text.encode(right)
    return "".join(bytes([b]).decode(wrong) if not (wrong == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) else chr(b) for b in raw)


def _corpus():
    rng = random.Random(3)
    frames = ["Café notation in {} texts", "{} – editorial marks", "Response to “{}” (draft)", "вопрос о знаках {}", "О порядке сортировки {}", "naïve letters of {}", "{}文字の追加提案", "Über die {} – 😀"]
    places = [f"Place{k}" for k in range(60)]
    clean = [rng.choice(frames).format(rng.choice(places)) for _ in range(900)]
    right = ["Use of © and ® beside {}", "Encoding of Ã and Õ in {}", "Display of � (REPLACEMENT CHARACTER) in {}", "The signs √ and ∞ in {}", "L’été “Übersicht” {}", "½-height bar in {}"]
    return frames, places, clean + [x.format(p) for x in right for p in places[:10]], rng


def test_round_trip(spark):
    frames, places, clean, rng = _corpus()
    bad = []
    for k in range(120):
        text = frames[k % len(frames)].format(rng.choice(places))
        wrong = ("cp1252", "mac_roman", "cp437")[k % 3]
        bad.append((_misread(text, "utf-8", wrong), text))
    for k in range(30):
        text = frames[3 + k % 2].format(rng.choice(places))
        bad.append((_misread(text, "cp1251", "cp1252"), text))
        bad.append((_misread(text, "koi8_r", "cp1251"), text))
    bad += [(_misread(_misread(t, "utf-8", "cp1252"), "utf-8", "cp1252"), t) for t in (frames[0].format("Place1"), frames[1].format("Place2"))]
    bad = [(g, t) for g, t in bad if g != t]
    rows = [("t", "f", k, x, "clash", 1) for k, x in enumerate(clean)] + [("t", "f", 10_000 + k, g, "clash", 1) for k, (g, _) in enumerate(bad)]
    rows += [("t", "f", -1, None, None, None), ("t", "f", -2, "", None, None), ("t", "f", -3, "plain", None, None), ("t", "f", -4, "é" * 200_000, None, None)]
    out = {r["row_id"]: r for r in mojibake.repair(spark.createDataFrame(rows, VALUES)).collect()}
    assert set(out) == {10_000 + k for k in range(len(bad))}
    assert {k: out[k]["restored"] for k in out} == {10_000 + k: t for k, (_, t) in enumerate(bad)}


def test_lost_characters(spark):
    frames, _, clean, _ = _corpus()
    rows = [("t", "f", k, x, None, None) for k, x in enumerate(clean)]
    rows += [("t", "f", -1, "Caf� notation in Place1 texts", None, None), ("t", "f", -2, "qx�qx", None, None)]
    out = {r["row_id"]: (r["restored"], r["whole"]) for r in mojibake.repair(spark.createDataFrame(rows, VALUES)).collect()}
    assert out == {-1: ("Café notation in Place1 texts", True), -2: ("qx�qx", False)}


def test_decodings_of_no_codec(spark):
    """Tables that no codec has are inferred from aligned characters: UTF-8 read by one, and letters taken for others."""
    strange = lambda text: "".join(c if c < "\x80" else "".join(chr(0x16A0 + (b * 37) % 0x80) for b in c.encode()) for c in text)
    shifted = lambda text: "".join(c if c < "\x80" else chr(0x10D0 + (ord(c) - 0x430) * 5 % 32) if "а" <= c <= "я" else c for c in text)
    accents = ["Café of {}", "naïve {} müde", "señor {} São", "Ångström {}", "{} œuvre à où", "Łódź {}", "€ {} – £"]
    letters = ["вопрос о знаках {}", "порядок букв {}", "список шрифтов {}", "новые буквы {}"]
    places = [f"Place{k}" for k in range(40)]
    clean = [x.format(p) for x in accents + letters for p in places]
    bad = [(strange(x.format(p)), x.format(p)) for x in accents for p in places[:6]] + [(shifted(x.format(p)), x.format(p)) for x in letters for p in places[:6]]
    # one of them has no near-twin
    bad.append((strange("Café señor nowhere else"), "Café señor nowhere else"))
    rows = [("t", "f", k, x, None, None) for k, x in enumerate(clean)] + [("t", "f", 10_000 + k, g, None, None) for k, (g, _) in enumerate(bad)]
    out = {r["row_id"]: r["restored"] for r in mojibake.repair(spark.createDataFrame(rows, VALUES)).collect()}
    assert out == {10_000 + k: t for k, (_, t) in enumerate(bad)}


def test_empty(spark):
    assert mojibake.repair(spark.createDataFrame([], VALUES)).count() == 0


def test_copies_have_no_vote(spark):
    """A garbled text that is repeated more often than all clean ones is still found."""
    _, _, clean, _ = _corpus()
    bad = [_misread(f"вопрос о знаках Place{k}", "cp1251", "cp1252") for k in range(3)]
    rows = [("t", "f", k, x, None, None) for k, x in enumerate(clean)] + [("t", "f", -1 - k, bad[0] if k > 1 else bad[k + 1], None, None) for k in range(2000)]
    out = {r["row_id"]: r["restored"] for r in mojibake.repair(spark.createDataFrame(rows, VALUES)).collect()}
    assert set(out) == {-1 - k for k in range(2000)}
    assert {out[-1], out[-2], out[-3]} == {f"вопрос о знаках Place{k}" for k in range(3)}

"""Files, workbooks, sinks, resumed runs and streams, over small tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from docketflow.functions import text
from docketflow.operators import enrich, phrases, prefix
from docketflow.sources import archive, files, mail
from docketflow.streaming import incremental


def _table(spark):
    return spark.createDataFrame([("L2/11-001", "a, \"b\"", ["x", "y"]), ("L2/11-002", None, []), ("L2/11-003", "line\nbreak\x01", None)], "doc_num string, subject string, refs array<string>")


@pytest.mark.parametrize("quote_all", [False, True])
def test_csv_and_back(spark, tmp_path, quote_all):
    path = str(tmp_path / "out")
    files.write_csv(_table(spark), path, quote_all)
    back = files.read_csv(spark, path, "doc_num string, subject string, refs string").orderBy("doc_num").collect()
    assert [r["subject"] for r in back] == ['a, "b"', None, "line\nbreak"] and back[0]["refs"] == '["x","y"]'


def test_file_names(spark, tmp_path):
    for name in ("one_llm", "two_llm", "other"):
        _table(spark).coalesce(1).write.parquet(str(tmp_path / name))
        (part,) = (tmp_path / name).glob("*.parquet")
        part.rename(tmp_path / f"{name}.parquet")
    assert files.read_parquet(spark, str(tmp_path / "*.parquet"), "*llm*").select("file_name").distinct().count() == 2
    assert files.read_parquet(spark, str(tmp_path / "*.parquet")).count() == 9


def test_texts_by_key(spark, tmp_path):
    (tmp_path / "L2_11-001.txt").write_text("whole\ntext")
    got = {r["doc_num"]: r["text"] for r in files.with_texts(_table(spark), spark, str(tmp_path)).collect()}
    assert got == {"L2/11-001": "whole\ntext", "L2/11-002": "", "L2/11-003": ""}


def test_lines_json_reports_sheets(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "id string")
    files.write_lines(df, "id", str(tmp_path / "lines"))
    assert [line for f in sorted((tmp_path / "lines").glob("part*")) for line in f.read_text().splitlines()] == ["a", "b"]
    files.write_json(_table(spark), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    files.write_reports(_table(spark), F.col("doc_num"), F.lit("# text"), str(tmp_path / "reports"))
    assert {p.name for p in (tmp_path / "reports").glob("report=*")} == {"report=L2_11-001", "report=L2_11-002", "report=L2_11-003"}
    files.write_sheets({"one": df, "two": _table(spark)}, str(tmp_path / "book"))
    assert files.read_csv(spark, str(tmp_path / "book" / "two"), "doc_num string, subject string, refs string").count() == 3


def test_replace_keeps_the_old_table_on_failure(spark, tmp_path):
    path = str(tmp_path / "table")
    files.replace_table(spark.range(3), path)
    files.replace_table(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        files.replace_table(spark.range(1).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert spark.read.parquet(path).count() == 2


def test_batches_resume(spark, tmp_path):
    path = str(tmp_path / "batches")
    assert files.last_batch(spark, path) is None
    for batch in (0, 1, 1):
        files.append_batch(spark.range(5), path, batch)
    assert files.last_batch(spark, path) == 1 and spark.read.parquet(path).count() == 10
    done = spark.range(3)
    assert files.unprocessed(spark.range(5), done, "id").count() == 2


def test_workbook(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(pd, "read_excel", lambda path, sheet_name, usecols, dtype: pd.DataFrame({"b": ["2", None], "a": ["1", "x"]}) if sheet_name == "s" else None)
    assert files.read_workbook(spark, "x.xlsx", "a string, b string", "s").collect() == [("1", "2"), ("x", None)]


def test_mailbox_files(spark, tmp_path):
    (tmp_path / "a.mbox").write_text("From x\nSubject: one\nFrom: =?utf-8?q?J=C3=BCrg?= <j@x>\n\nbody\n\nFrom y\nSubject: two\n\n> quoted\n")
    (tmp_path / "b.txt").write_text("From z\nSubject: three\n\n")
    rows = mail.read_mailboxes(spark, str(tmp_path)).orderBy("number").collect()
    assert [(r["subject"], r["from_field"], r["body"]) for r in rows] == [("one", "J\u00fcrg <j@x>", "body"), ("two", None, "> quoted")]
    assert mail.read_mailboxes(spark, str(tmp_path), "*.txt").count() == 1
    boxes = spark.createDataFrame([("c", None), ("d", "no separator")], "mbox_file string, content string")
    assert mail.parse_mailboxes(boxes).count() == 0


def test_streams(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(3).write.parquet(source)
    stream = lambda: spark.readStream.schema("id bigint").parquet(source)
    incremental.run_available(stream(), out, mark)
    spark.range(3, 5).write.mode("append").parquet(source)
    incremental.run_available(stream(), out, mark)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_sessions(spark, tmp_path):
    at = lambda h, m: datetime(2020, 1, 1, h, m)
    source = str(tmp_path / "events")
    spark.createDataFrame([("a", at(1, 0)), ("a", at(1, 20)), ("a", at(3, 0)), ("b", at(1, 0))], "k string, ts timestamp_ntz").write.parquet(source)
    stream = spark.readStream.schema("k string, ts timestamp_ntz").parquet(source)
    incremental.run_complete(incremental.sessions(stream, "ts", "k"), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert sorted((r["k"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_months_and_empty_spans(spark):
    assert archive.months(spark, date(2020, 12, 3), date(2021, 2, 1), date(2030, 1, 1)).count() == 3
    assert archive.months(spark, date(2021, 3, 1), date(2021, 2, 1)).count() == 0


def test_enrichment_tries_again(spark):
    def failing(prompts):
        raise RuntimeError("busy")

    df = spark.createDataFrame([(1, "p"), (2, None)], "id bigint, p string")
    assert enrich.enrich(df, "id", F.col("p"), enrich.KEYWORD_REPLY, failing, tries=2).orderBy("id").collect()[0]["error"] == "busy"
    assert enrich.enrich(df, "id", F.col("p"), enrich.KEYWORD_REPLY, lambda ps: ["no json"]).filter("id = 1").first()["error"] == "reply is no JSON"


def test_forward_fill_over_partitions(spark):
    rows = [(g, k, v) for g, n in (("a", 50), ("b", 1), (None, 20), ("c", 30)) for k in range(n) for v in [k if k % 13 == 3 else None]]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    expected, last = {}, {}
    for g, k, v in rows:
        last[g] = v if v is not None else last.get(g)
        expected[g, k] = last[g]
    for partitions in (1, 7):
        got = prefix.forward_fill(df, "g", ["k"], "v", "f", partitions).collect()
        assert {(r["g"], r["k"]): r["f"] for r in got} == expected


def test_phrases_and_summaries(spark):
    df = spark.createDataFrame([(1, "Deep sorting of glyph tables and glyph tables. Fast."), (2, None), (3, "")], "id bigint, t string")
    best = phrases.key_phrases(df, "id", "t").collect()
    assert [(r["id"], r["phrase"]) for r in best] == [(1, "glyph tables")] or best[0]["id"] == 1
    long = " ".join(f"Sentence {k} is about glyph tables." for k in range(9))
    out = spark.createDataFrame([(1, long), (2, None), (3, " ")], "id bigint, t string").select("id", phrases.summaries(3)(F.col("t")).alias("s")).orderBy("id").collect()
    assert out[0]["s"].count("Sentence") == 3 and out[1]["s"] is None and out[2]["s"] is None


def test_unescape():
    assert text.unescape("a &amp; b&#39;s") == "a & b's"

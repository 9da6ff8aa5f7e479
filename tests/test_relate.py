import __spark_entry__ as entry
from docketflow.functions.taxonomy import WORD
from tests.oracle import canonical, connect


def _shuffled(node) -> int:
    """Rows that the exchanges of a plan that has run wrote."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(node.children().apply(k)) for k in range(node.children().size()))


def test_scored_matches_shuffle_no_product(spark, tmp_path):
    """200 proposals meet 1,400 mails of the same phrase: 280,000 rows, of which none crosses the network."""
    proposals = [(f"L2/16-{k:03}", "Hand Fan" if k % 4 else "hand fan", "paper boat" if k % 50 == 0 else " ") for k in range(200)]
    proposals += [("L2/09-001", "hand fan", None), ("L2/16-500", None, None), ("L2/16-007R2", "loom", "loom"), ("none", "hand fan", None)]
    mails = [(k, "a hand fan, and a hand fan", "HAND FAN" if k % 3 else None, [":hand fan:"] if k % 5 == 0 else [], 2014 + k % 5, None) for k in range(1_400)]
    mails += [(2_000, "hand fan", None, None, 2016, ["L2/16-007", "L2/16–007", None, ""]), (2_001, None, None, None, 2017, ["l2/16-500", "L2/09-001"])]
    mails += [(2_002, "paper boat and hand fan", None, None, None, ["L2/16-001"]), (2_003, "handfan", "a hand fans", None, 2016, None), (2_004, "loom paper boat", None, None, 2018, ["L2/16-050"])]
    spark.createDataFrame(proposals, "doc_num string, proposal_for_1 string, proposal_for_2 string").write.parquet(str(tmp_path / "proposals.parquet"))
    columns = f"match_id bigint, subject string, summary string, {WORD}_shortcodes array<string>, year int, extracted_doc_refs array<string>"
    spark.createDataFrame(mails, columns).write.parquet(str(tmp_path / "email_match_df.parquet"))
    df = entry.queries()["j8_scored_matches"](spark, str(tmp_path))
    got = df.toPandas()
    assert len(got) > 280_000
    assert canonical(got) == canonical(connect(str(tmp_path)).execute(entry.oracle_sql()["j8_scored_matches"]).df())
    assert 0 < _shuffled(df._jdf.queryExecution().executedPlan()) < len(got) / 10


def _data_size(node) -> int:
    """Bytes that the exchanges of a plan that has run wrote."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _data_size(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _data_size(node.plan())
    own = node.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_data_size(node.children().apply(k)) for k in range(node.children().size()))


def test_scored_matches_shuffle_no_pairs_of_classes(spark, tmp_path):
    """600 proposals meet 512 mails that all have other hits: the proposals do not cross the network once for each kind of mail, whatever is too large to broadcast."""
    words = ["loom", "moss", "stilts", "beehive", "sundial", "pinwheel", "lighthouse", "anvil", "kiln"]
    proposals = [(f"L2/16-{k:04}", "Hand Fan" if k % 2 else "hand fan", None) for k in range(600)]
    proposals += [(f"L2/17-{k:04}", w, ["HAND FAN", w.upper(), w, None][k % 4]) for k in range(8) for w in words]
    proposals += [("L2/17-0001", "hand fan", "Loom"), ("L2/19-0001", "kiln", "Kiln")]
    mails = [(k, "hand fan " + " ".join(w for i, w in enumerate(words) if k >> i & 1), "kiln" if k % 7 == 0 else None, [], 2015 + k % 3, ["L2/16-0003"] if k % 9 == 0 else None) for k in range(512)]
    spark.createDataFrame(proposals, "doc_num string, proposal_for_1 string, proposal_for_2 string").write.parquet(str(tmp_path / "proposals.parquet"))
    columns = f"match_id bigint, subject string, summary string, {WORD}_shortcodes array<string>, year int, extracted_doc_refs array<string>"
    spark.createDataFrame(mails, columns).write.parquet(str(tmp_path / "email_match_df.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()["j8_scored_matches"](spark, str(tmp_path))
        got = df.toPandas()
        size = _data_size(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert canonical(got) == canonical(connect(str(tmp_path)).execute(entry.oracle_sql()["j8_scored_matches"]).df())
    assert 0 < size < 4 * len(got)

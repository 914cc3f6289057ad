from postmill.operators import metrics

TRUTH = "item_id int, keyword_match boolean, visa_sponsorship boolean, requires_phd boolean, job_level string"


def scores(spark, truth, pred):
    t = spark.createDataFrame(truth, TRUTH)
    p = spark.createDataFrame(pred, TRUTH + ", error boolean")
    paired = metrics.pair_labels(t, p)
    table = metrics.field_scores(metrics.label_pairs(paired), ["keyword_match", "job_level", "requires_phd"])
    return {r["field"]: r for r in table.collect()}, paired, table


def test_scores(spark):
    truth = [(1, True, True, None, "mid"), (2, True, False, False, "mid"), (3, False, True, False, "entry"), (4, True, True, True, "mid")]
    pred = [(1, True, False, True, "mid", False), (2, False, False, False, "entry", False), (3, True, True, False, "entry", None), (4, True, True, True, "mid", True)]
    got, paired, table = scores(spark, truth, pred)
    k = got["keyword_match"]
    assert (k["n"], k["tp"], k["fp"], k["fn"], k["tn"]) == (3, 1, 1, 1, 0)
    assert (k["accuracy"], k["precision"], k["recall"], k["f1"]) == (1 / 3, 0.5, 0.5, 0.5)
    assert got["job_level"]["accuracy"] == 2 / 3 and got["job_level"]["precision"] == 0.0
    assert got["requires_phd"]["n"] == 2 and got["requires_phd"]["precision"] == 0.0 and got["requires_phd"]["accuracy"] == 1.0
    assert got["overall"]["n"] == 8 and got["overall"]["accuracy"] == 5 / 8
    misses = {r["item_id"]: r["misses"] for r in metrics.mismatches(paired).collect()}
    assert misses == {
        1: "visa_sponsorship: got=false expected=true",
        2: "keyword_match: got=false expected=true; job_level: got=entry expected=mid",
        3: "keyword_match: got=true expected=false",
    }
    assert metrics.gate(table).first()["passed"] is False and metrics.gate(table, 0.6).first()["passed"] is True


def test_empty_and_all_correct(spark):
    got, _, _ = scores(spark, [], [])
    assert got["keyword_match"]["n"] == 0 and got["keyword_match"]["f1"] == 0.0 and got["overall"]["accuracy"] == 0.0
    got, _, _ = scores(spark, [(1, True, True, True, "mid")], [(1, True, True, True, "mid", False)])
    assert got["overall"]["f1"] == 1.0


def test_split(spark):
    df = spark.createDataFrame([(1, "t", (True, "mid"))], "item_id int, title string, evaluation struct<keyword_match: boolean, job_level: string>")
    inputs, truth = metrics.split_labelled(df)
    assert inputs.columns == ["item_id", "title"] and truth.first()[:] == (1, True, "mid")

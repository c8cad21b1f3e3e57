from pyspark.sql import functions as F

from cellarium.functions import text as t


def column(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, s string").orderBy("i").select(fn(F.col("s"))).collect()]


def test_cleaners(spark):
    assert column(spark, t.normalize_text, ["  Quote # : ; - ", "Customer P/N:\u00a0", None]) == ["quote #", "customer p/n", ""]
    assert column(spark, t.clean_part_number, ["3042605C (DWG 4022-A)", "858007801000\n(P0900612)", "A", "Strategic Fit for MPC?", "a b c d", None]) == ["3042605C", "858007801000", None, None, None, None]
    assert column(spark, t.bracketed_drawing, ["858007801000 (P0900612)", "(DWG 4022-A)"]) == ["P0900612", "4022-A"]
    assert column(spark, t.clean_cycle_time, [" 26.5 sec ", "35 seconds", "0", "-5s", "abc 12.5", "#N/A"]) == [26.5, 35.0, None, None, 12.5, None]
    assert column(spark, t.clean_currency, ["$1,250.50", "-5"]) == [1250.5, 5.0]
    assert column(spark, t.clean_ops, ["0.5 ops", "0", "-1"]) == [0.5, 0.0, -1.0]
    assert column(spark, t.clean_volume, ["25,000 EAU", "2.5", "0", "abc 3.7"]) == [25000, 2, None, 3]
    assert column(spark, t.clean_cycle_time, ["7.675", "2.675", "0.125", "1,250", "12 sec/shot", "-"]) == [7.67, 2.67, 0.12, 1.0, 12.0, None]
    assert column(spark, t.clean_text, ["Clip:", " - a  b ;", "--", "#N/A"]) == ["Clip", "a  b", None, None]


def test_rounding_is_that_of_the_exact_double(spark):
    import random

    rnd = random.Random(1)
    values = [rnd.randint(0, 10**6) / 1000 for _ in range(3000)] + [(2 * rnd.randint(0, 10**6) + 1) * 5 / 1000 for _ in range(3000)] + [rnd.uniform(-9, 9) for _ in range(500)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(t.round2(F.col("v"))).collect()
    assert [r[0] for r in got] == [round(v, 2) for v in values]


def test_typed_numbers(spark):
    df = spark.createDataFrame([("-5.5", -5.5), ("3.0", 3.0)], "s string, n double")
    got = df.select(t.clean_currency(F.col("s"), F.col("n")), t.clean_weight(F.col("s"), F.col("n")), t.clean_volume(F.col("s"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(-5.5, None, None), (3.0, 3.0, 3)]
    assert column(spark, t.normalize_part_number, ["2202046213000-01", "40601-BBA001 (LW)", "DWG_9901_REV_A"]) == ["2202046213000", "40601bba001", "dwg9901"]
    assert column(spark, t.matching_tokens, ["858007801000 (P0900612)"]) == [["858007801000", "p0900612"]]
    assert column(spark, t.has_item_suffix, ["Q3428", "3428", "Q3428-R3", "Q3428-Rev3", "Q3428-01", "Q4378-4 (2140)", "Q4231-R15-7"]) == [False] * 4 + [True] * 3


def test_item_numbers(spark):
    rows = [("Q3428", "1", "Q3428-1"), ("Q3428-1", "1", "Q3428-1"), ("Q3428-R3", "2", "Q3428-2"), ("Q4378-4 (2140)", "3", "Q4378-4"), ("Q4231-R15-7", "5", "Q4231-R15-7")]
    df = spark.createDataFrame(rows, "q string, i string, want string")
    got = df.select(t.resolve_item_number(F.col("q"), F.col("i"), F.lit(None).cast("string"), F.lit(1))["number"].alias("n"), "want").collect()
    assert [r.n for r in got] == [r.want for r in got]


def test_number_cleaners_read_a_text_once(spark):
    """Each step over a text stands in the plan once, not once for each use of its result."""
    df = spark.createDataFrame([("7.675 sec",)], "s string")
    for fn in (t.clean_cycle_time, t.clean_ops, t.clean_currency, t.clean_weight, t.clean_volume):
        plan = df.select(fn(F.col("s")).alias("v"))._jdf.queryExecution().analyzed().toString().lower()
        assert plan.count("regexp_replace(") < 10 and plan.count("regexp_extract(") < 3, fn.__name__
    assert column(spark, t.clean_weight, ["\u00a0 2.675 G ", " \u00a0", None, "-4g", "1,200.5 g"]) == [2.67, None, None, None, 1.0]
    assert column(spark, t.clean_volume, ["\u00a01,234.5 pcs", ",", "-3", None, "0.0", "2.5 eau"]) == [1234, None, None, None, None, 2]
    assert column(spark, t.clean_currency, ["$ ", "$\u00a07.675", "CAD 1,250.125", "#1"]) == [None, 7.67, 1250.12, None]

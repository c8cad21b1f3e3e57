import random

import pytest

from cellarium.operators import display, link

RND = random.Random(5)


def plain(jobs, quotes, keys, best):
    """Jobs in order, each taking the first free candidate of its key, else the first."""
    cands, used, got = {}, set(), {}
    for kind, key, q in sorted(keys):
        cands.setdefault((kind, key), []).append(q)
    number = {q[0]: q[3] or f"#{q[0]}" for q in quotes}
    for job, *_ in sorted(jobs):
        if job in best:
            own = cands[best[job]]
            pick = next((q for q in own if number[q] not in used), own[0])
            used.add(number[pick])
            got[job] = pick
    return got


def test_quotes_are_used_over_all_keys(spark):
    parts = ["ABC", "ABC-01", "abc (X9)", "X9", "ABC X9", "DEF", "DEF-02", "def g", "zz"]
    quotes = [(i, RND.choice(parts), RND.choice(["", "", "X9", "DEF"]), RND.choice([None, "", "Q1", "Q2"])) for i in range(24)]
    jobs = [(i, RND.choice(["J1", "J X9", "no"]), RND.choice([*parts, "", "none"])) for i in range(60)]
    j = spark.createDataFrame(jobs, "job_ord long, job_number string, part_number string")
    for columns in (["quote_ord", "part_number", "drawing_number", "quote_item_number"], ["quote_ord", "part_number", "drawing_number"]):
        q = spark.createDataFrame(quotes, "quote_ord long, part_number string, drawing_number string, quote_item_number string").select(*columns)
        known = quotes if len(columns) == 4 else [(*x[:3], None) for x in quotes]
        keys = [tuple(r) for r in link.quote_keys(q).select("kind", "key", "quote_ord").collect()]
        best = {r.job_ord: (r.kind, r.key) for r in link.match_tiers(j, q).collect()}
        got = {r.job_ord: r.quote_ord for r in link.link(j, q).collect()}
        want = plain(jobs, known, keys, best)
        assert got == {x[0]: want.get(x[0]) for x in jobs}


def test_exact_and_normalized_share_their_quotes(spark):
    q = spark.createDataFrame([(1, "ABC-01", ""), (2, "ABC-01", "")], "quote_ord long, part_number string, drawing_number string")
    j = spark.createDataFrame([(1, "A", "ABC-01"), (2, "B", "ABC"), (3, "C", "nothing")], "job_ord long, job_number string, part_number string")
    got = [(r.quote_ord, r.confidence) for r in link.link(j, q).orderBy("job_ord").collect()]
    assert got == [(1, "exact"), (2, "normalized"), (None, "none")]
    assert link.link(j.limit(0), q).count() == 0 and link.link(j, q.limit(0)).filter("quote_ord is null").count() == 3


@pytest.fixture
def small_batches(spark):
    """Batches of two rows: some hold candidates and no jobs. Jobs are known by text."""
    quotes = [(i, "ABC-01", "ABC X9") for i in range(6)] + [(9, "other", "")]
    jobs = [(f"{i:02d}", "J", ["ABC-01", "X9"][i % 2]) for i in range(8)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    j = spark.createDataFrame(jobs, "job_ord string, job_number string, part_number string")
    q = spark.createDataFrame(quotes, "quote_ord long, part_number string, drawing_number string")
    yield link.link(j, q), q
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_batches_of_candidates_alone(small_batches):
    linked, _ = small_batches
    assert {r.job_ord: r.quote_ord for r in linked.collect()} == {f"{i:02d}": i if i < 6 else 0 for i in range(8)}


def test_summary_of_small_batches(small_batches):
    assert [tuple(r) for r in link.summary(*small_batches).collect()] == [(8, 8, 0, 1)]


def test_linked_rows_of_small_batches(small_batches):
    linked, q = small_batches
    numbers = ("cycle_time_sec", "ops_labour", "labour_rate", "weight_g", "annual_volume")
    q = q.selectExpr("quote_ord", "part_number", "concat('Q', quote_ord) AS quote_item_number", "'Clip' AS description", "'' AS material", *(f"0D AS {n}" for n in numbers))
    got = {r["job_ord"]: r["Quote Item"] for r in display.linked_rows(linked, q).collect()}
    assert got == {f"{i:02d}": f"Q{i if i < 6 else 0}" for i in range(8)}


def test_unlinked_of_small_batches(small_batches):
    linked, q = small_batches
    assert [r.quote_ord for r in link.unlinked(q, linked).collect()] == [9]

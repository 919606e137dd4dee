"""Terms are counted where the texts of their key are: no shuffle by key and term."""

from tidemark.operators import terms


def test_no_shuffle_by_key_and_term(spark):
    rows = [(1, "aa bb aa"), (1, "bb cc"), (2, "aa bb"), (3, None), (4, "")]
    out = terms.tfidf(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", "text", min_df=1, max_share=1.0)
    got = {r.id: {x["term"] for x in r.terms} for r in out.collect()}
    # Rows of one key are one document, and no pair reaches from one text to the next.
    assert got == {1: {"aa", "bb", "cc", "aa bb", "bb aa", "bb cc"}, 2: {"aa", "bb", "aa bb"}}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(_k" in line and "term#" in line.split("hashpartitioning")[1] for line in plan.splitlines() if "hashpartitioning" in line)

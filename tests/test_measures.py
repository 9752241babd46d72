"""Counts and times of a run come from the passes that write its tables."""

from pyspark.sql import functions as F

from lumenfold.operators import catalog as cat
from lumenfold.operators import evaluation as ev
from lumenfold.operators.measures import Run
from lumenfold.plans import evaluate as plan


def test_steps_count_and_time(spark):
    run = Run(spark)
    rows = spark.range(1000).withColumn("even", F.col("id") % 2 == 0)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one pass", "one pass")
    try:
        out = run.step("numbers", rows, n_even=F.count_if("even"))
        jobs = len(tracker.getJobIdsForGroup("one pass"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1 and out.count() == 1000
    run.step("numbers", rows.filter("id < 10"), n_even=F.count_if("even"))
    run.step("none", rows.filter("id < 0"), n_even=F.count_if("even"))
    run.step("empty", spark.createDataFrame([], "id long"))
    got = {(r.component, r.call, r.measure): r.value for r in run.counts().collect()}
    assert got == {("numbers", 1, "rows"): 1000, ("numbers", 1, "n_even"): 500, ("numbers", 2, "rows"): 10, ("numbers", 2, "n_even"): 5, ("none", 1, "rows"): 0, ("none", 1, "n_even"): 0, ("empty", 1, "rows"): 0}
    means = {r.component: r for r in ev.component_means(run.times(), "ms", "component").collect()}
    assert means["numbers"].n == 2 and all(m.mean_ms > 0 for m in means.values())


def test_totals_of_an_evaluation(spark):
    entries = cat.build(spark.createDataFrame([(0, "Risk Taking"), (1, "Calm mind"), (2, "Iron level"), (3, "Honesty"), (4, "")], "pos long, raw_facet string"))
    talk = spark.createDataFrame([(1, "I went skydiving solo, a risk"), (2, "my mind is calm"), (3, "  "), (4, "x" * 10_001)], "conv_id long, text string")
    run = Run(spark)
    results, rejected = plan.measured(run, talk, entries, top_k=3)
    got = {(r.component, r.measure): r.value for r in run.counts().collect()}
    totals = ev.response_metadata(results).agg(F.sum("n_retrieved"), F.sum("n_scored"), F.sum("n_abstained")).first()
    assert (got["results", "rows"], got["results", "n_scored"], got["results", "n_abstained"]) == tuple(totals) and totals[1] > 0
    assert got["accepted", "rows"] == 2 and got["rejected", "rows"] == 2 == rejected.count()

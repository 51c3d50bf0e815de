"""Failures as values, lazy variables and results of steps."""

import pytest
from pyspark.sql import functions as F

from docspark.plans.steps import Context, Flatten, ForEach, Lazy, Pipeline, Script, SetVariable, Step, SubPipeline, Template, attempt_cast, attempt_if


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(0, "4", ("a", [1, 2])), (1, "x", ("b", [])), (2, None, ("c", [3])), (3, "-2", ("d", [4]))], "_pos long, t string, d struct<k:string,ns:array<int>>").repartition(3)


def body(df):
    return attempt_cast(F.col("t"), "int").then(lambda v: attempt_if(v * 10, v > 0, F.concat(F.lit("not positive: "), v.cast("string"))))


def test_failures_as_values(rows):
    kept = Pipeline((Step("e", ForEach(body, policy="null", errors="why")),)).run(rows).orderBy("_pos").collect()
    assert [(r["result"], r["why"]) for r in kept] == [(40, None), (None, "can't read x as int"), (None, "failed"), (None, "not positive: -2")]
    skipped = Pipeline((Step("e", ForEach(body, policy="skip")),)).run(rows)
    assert [r["result"] for r in skipped.collect()] == [40]
    failing = Pipeline((Step("e", ForEach(body)),)).run(rows)  # builds without a job
    with pytest.raises(Exception, match="item 1 failed: can't read x as int"):
        failing.collect()
    fine = Pipeline((Step("e", ForEach(body)),)).run(rows.filter("_pos = 0"))
    assert [r["result"] for r in fine.collect()] == [40]
    merged = ForEach(lambda df: F.struct((F.col("_pos") + 1).alias("_pos"), F.lit(1).alias("one")), merge=True).apply(rows, Context(rows))
    assert sorted(r["_pos"] for r in merged.collect()) == [1, 2, 3, 4] and "one" in merged.columns


def test_null_has_a_defined_end(rows):
    """A null that is cast is no error; a condition on it is not met, which is one."""
    got = {r["_pos"]: r["why"] for r in Pipeline((Step("e", ForEach(lambda df: attempt_cast(F.col("t"), "int"), policy="null", errors="why")),)).run(rows).collect()}
    assert got == {0: None, 1: "can't read x as int", 2: None, 3: None}
    got = {r["_pos"]: r["why"] for r in Pipeline((Step("e", ForEach(lambda df: attempt_if(F.col("t"), F.col("t") != "x", "bad"), policy="null", errors="why")),)).run(rows).collect()}
    assert got == {0: None, 1: "bad", 2: "bad", 3: None}


def test_variables_are_subqueries(spark, rows):
    p = Pipeline((
        Step("n", SetVariable("n", aggregate=F.struct(F.count("*").alias("rows"), F.max("t").alias("top")))), Step("k", SetVariable("k", path=("d", "$.ns[-1]"))), Step("t", SetVariable("t", template=("d", "<{{ k }}>"), save=True)),
        Step("each", ForEach(body, policy="null", saves={"last": lambda df: F.col("d.k")})), Step("out", Template("{{ vars.n.rows }}/{{ vars.n.top }}/{{ vars.n.zz }}/{{ vars.k }}/{{ vars.t }}/{{ vars.last }}/{{ loop.count }}/{{ vars.none }}", "d", "label")),
    ))
    context = Context(rows)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = p.run(rows, context)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert isinstance(context.variables["n"], Lazy) and set(context.saved) == {"t", "last"}
    assert "Subquery" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["label"] for r in out.collect()} == {"4/x//2/<a>/a/4/"}


def test_variables_of_a_sub_pipeline_flow_out(rows):
    inner = Pipeline((Step("v", SetVariable("v", aggregate=F.min("t"), save=True)),))
    context = Context(rows, library={"p": inner})
    out = Pipeline((Step("p", SubPipeline("p")), Step("s", Template("{{ vars.v }}", "d", "s")))).run(rows, context)
    assert {r["s"] for r in out.collect()} == {"-2"} and set(context.saved) == {"v"}


def test_results_of_steps(rows):
    p = Pipeline((Step("each", ForEach(body, policy="null", errors="why")), Step("off", Flatten("zz"), enabled=False), Step("few", Script(lambda df, c: df.filter("why IS NULL")))))
    run = p.watched(rows)
    assert run.failed is None
    left = run.output.count()
    assert run.step("each").observed == {"rows": 4, "failures": 4 - left} and run.step(2).observed["rows"] == left
    assert run.step("off").skipped and run.step("off").observed == {} and all(s.seconds >= 0 for s in run.steps)


def test_a_failing_step_stops_the_run(rows):
    p = Pipeline((Step("a", Script(lambda df, c: df)), Step("bad", SetVariable("1x", 1)), Step("worse", Script(lambda df, c: df.select("nothing"))), Step("last", Flatten("t"))))
    run = p.watched(rows)
    assert run.output is None and run.failed == "bad" and "1x" in run.step("bad").error
    assert [s.skipped for s in run.steps] == [False, False, True, True] and run.step("worse").error is None
    worse = Pipeline(p.steps[2:]).watched(rows)
    assert worse.failed == "worse" and worse.output is None

"""Jobs whose steps are cut, so that no task holds the memory of all of them and no step is done again for each reader."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def nodes(df, name):
    return sum(name in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_replug_protocol_ends_in_a_few_joins(spark):
    df = entry.queries()["c9_replug_protocol"](spark, SF)
    assert nodes(df, "Join ") <= 6


def test_a_report_that_a_run_names_is_looked_up_by_few_columns(spark):
    """Only names go to the paths; all columns of all runs were dealt by path before."""
    df = entry.queries()["j5_requirement_x_report"](spark, SF)
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert any("LeftSemi" in x for x in joins) and sum("_spread" in x for x in joins) == 1


def test_a_verdict_of_reports_does_not_spread_their_checks(spark):
    assert nodes(entry.queries()["a10_acceptance_verdict"](spark, SF), "inline") == 0


def test_facts_of_plans_are_not_shuffled_a_run_at_a_time(spark):
    plan = entry.queries()["c5_plan_checks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in plan.splitlines() if "HashAggregate" in x and "run_id" in x.split("functions=")[0] and x.count("bool_or") > 5]
    assert not wide

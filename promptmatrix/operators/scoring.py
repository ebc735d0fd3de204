"""From scores to aggregates, gates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmatrix.functions.scorers import Inputs, bind, entry


def scorecard(cells: DataFrame, criteria: list[dict], base_dir: str = ".") -> DataFrame:
    """Cells with ``scores``: one element for each criterion, in the order of the scorecard.

    ``criteria`` are mappings with criterion, weight and scorer; all scorers
    are bound before the plan is made, so a bad parameter fails first.
    """
    scorers = [(c["criterion"], c.get("weight", 1.0), bind(c["scorer"]["type"], {k: v for k, v in c["scorer"].items() if k != "type"}, base_dir)) for c in criteria]
    have = set(cells.columns)
    col = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    inputs = Inputs(F.col("output"), col("expected"), col("human_label"), col("case_json"))
    return once(cells, "scores", F.array(*(entry(name, weight, scorer(inputs)) for name, weight, scorer in scorers)))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a dear column that filters and later expressions read but never work out again.

    A filter above a plain projection takes the column's whole expression into
    its condition, where common parts are not shared; a generator of one
    element is passed by no filter that reads its output.
    """
    return rows.withColumn("_value", value).withColumn(name, F.explode(F.array("_value"))).drop("_value")


def cell_score(scores: Column, error: Column) -> Column:
    """The weighted mean of a cell's scores to six places; 0 for an errored or unscored cell."""
    weight = lambda e: F.coalesce(e["weight"], F.lit(1.0))
    total = F.aggregate(scores, F.lit(0.0), lambda a, e: a + weight(e))
    points = F.aggregate(scores, F.lit(0.0), lambda a, e: a + F.coalesce(e["score"], F.lit(0.0)) * weight(e))
    return F.when(error.isNull() & (F.size(scores) > 0) & (total > 0), F.round(points / total, 6)).otherwise(0.0)


def cell_passed(scores: Column, error: Column) -> Column:
    """Whether a cell has scores, no error, and every criterion passed."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, e: a + F.coalesce(e["weight"], F.lit(1.0)))
    return F.coalesce(error.isNull() & (F.size(scores) > 0) & (total > 0) & F.forall(scores, lambda e: e["passed"].eqNullSafe(True)), F.lit(False))


def judged(results: DataFrame) -> DataFrame:
    """Results with ``cell_score`` and ``passed``."""
    scores, error = F.col("scores"), F.col("error")
    return results.withColumns({"cell_score": cell_score(scores, error), "passed": cell_passed(scores, error)})


#: What is kept of a wave for each variant and model: sums, from which every figure of the run follows.
PARTIAL = "variant string, model string, cases long, score_sum decimal(38,10), n_passed long, errors long, cached long, input_tokens long, output_tokens long, cost decimal(38,10), unpriced long"


def partial(results: DataFrame) -> DataFrame:
    """The sums of a part of the results by variant and model: mergeable, and as exact as decimals."""
    failed = F.col("error").isNotNull()
    zero = F.lit(0).cast("decimal(38,10)")
    return results.groupBy("variant", "model").agg(
        F.count("*").alias("cases"), F.coalesce(F.sum(F.col("cell_score").cast("decimal(28,10)")), zero).cast("decimal(38,10)").alias("score_sum"), F.count_if("passed").alias("n_passed"), F.count_if(failed).alias("errors"), F.count_if("cached").alias("cached"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
        F.coalesce(F.sum(F.when(~F.col("cached"), F.col("cost_usd").cast("decimal(28,10)"))), zero).cast("decimal(38,10)").alias("cost"), F.count_if(~failed & F.col("cost_usd").isNull()).alias("unpriced"),
    )


def _figures(cases: Column, score_sum: Column, passed: Column, errors: Column) -> list[Column]:
    n = F.coalesce(cases, F.lit(0))
    return [
        n.cast("long").alias("cases"),
        F.coalesce(F.round(score_sum.cast("double") / F.when(n > 0, n), 6), F.lit(0.0)).alias("score"),
        F.coalesce(F.round(passed / F.when(n > 0, n), 6), F.lit(0.0)).alias("pass_rate"),
        F.coalesce(errors, F.lit(0)).cast("long").alias("errors"),
    ]


def _stats() -> list[Column]:
    return _figures(F.count("*"), F.sum(F.col("cell_score").cast("decimal(38,10)")), F.count_if("passed"), F.count_if(F.col("error").isNotNull()))


def _merged() -> list[Column]:
    return _figures(F.sum("cases"), F.sum("score_sum"), F.sum("n_passed"), F.sum("errors"))


def matrix(results: DataFrame) -> DataFrame:
    """One row for each variant and model, in order: cases, score, pass rate, errors."""
    return results.groupBy("variant", "model").agg(*_stats()).orderBy("variant", "model")


def matrix_of(partials: DataFrame) -> DataFrame:
    """``matrix`` from partial sums."""
    return partials.groupBy("variant", "model").agg(*_merged()).orderBy("variant", "model")


def overall(results: DataFrame) -> DataFrame:
    """One row over everything; no cells give zeros, not nulls."""
    return results.agg(*_stats())


def overall_of(partials: DataFrame) -> DataFrame:
    """``overall`` from partial sums."""
    return partials.agg(*_merged())


def _sums(total: Column, failed: Column, cached: Column, tokens_in: Column, tokens_out: Column, cost: Column) -> list[Column]:
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return [
        whole(total).alias("total"), (whole(total) - whole(failed)).alias("succeeded"), whole(failed).alias("failed"), whole(cached).alias("cached"), whole(tokens_in).alias("input_tokens"), whole(tokens_out).alias("output_tokens"),
        F.coalesce(F.round(cost.cast("double"), 10), F.lit(0.0)).alias("cost_usd"),
    ]


def totals(results: DataFrame) -> DataFrame:
    """Counts, tokens and cost of a run; a cached cell's cost was paid before and is left out."""
    cost = F.sum(F.when(~F.col("cached"), F.col("cost_usd").cast("decimal(38,10)")))
    return results.agg(*_sums(F.count("*"), F.count_if(F.col("error").isNotNull()), F.count_if("cached"), F.sum("input_tokens"), F.sum("output_tokens"), cost))


def totals_of(partials: DataFrame) -> DataFrame:
    """``totals`` from partial sums."""
    return partials.agg(*_sums(F.sum("cases"), F.sum("errors"), F.sum("cached"), F.sum("input_tokens"), F.sum("output_tokens"), F.sum("cost")))


def gate(overall_row: DataFrame, min_pass_rate: float | None = None, min_score: float | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """A row for each check that applies: name, passed, detail.  No rows means no verdict: nothing to check, or no cell ran."""
    percent = lambda c: F.concat(F.format_number(c * 100, 2), F.lit("%"))
    three = lambda c: F.format_number(c, 3)
    row, checks = overall_row, []
    if min_pass_rate is not None:
        checks.append(("min_pass_rate", F.col("pass_rate") >= min_pass_rate, F.concat(F.lit("pass rate "), percent(F.col("pass_rate")), F.lit(" vs required "), percent(F.lit(min_pass_rate)))))
    if min_score is not None:
        checks.append(("min_score", F.col("score") >= min_score, F.concat(F.lit("score "), three(F.col("score")), F.lit(" vs required "), three(F.lit(min_score)))))
    if baseline is not None:  # one row against one row
        row = row.join(F.broadcast(baseline.select(F.col("score").alias("base_score"), F.col("pass_rate").alias("base_rate")).limit(1)), how="cross")
        said = F.concat(F.lit("score "), three(F.col("score")), F.lit(" vs baseline "), three(F.col("base_score")), F.lit("; pass rate "), percent(F.col("pass_rate")), F.lit(" vs baseline "), percent(F.col("base_rate")))
        checks.append(("baseline", (F.col("score") >= F.col("base_score")) & (F.col("pass_rate") >= F.col("base_rate")), said))
    structs = F.array(*(F.struct(F.lit(n).alias("name"), p.alias("passed"), d.alias("detail")) for n, p, d in checks)) if checks else F.array().cast("array<struct<name:string,passed:boolean,detail:string>>")
    return row.where("cases > 0").select(F.inline(structs))


def criteria(results: DataFrame) -> DataFrame:
    """The names of all criteria, in order."""
    return results.select(F.explode("scores.criterion").alias("criterion")).distinct().orderBy("criterion")


def case_passed(results: DataFrame) -> DataFrame:
    """A case passes if all its cells pass."""
    return results.groupBy("case_id").agg(F.bool_and("passed").alias("passed"), F.count("*").cast("long").alias("cells"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two matrices side by side: one row for each group of either, ``side`` both, only_a or only_b, with deltas from a to b."""
    left = a.select("variant", "model", F.col("score").alias("score_a"), F.col("pass_rate").alias("pass_rate_a"))
    right = b.select("variant", "model", F.col("score").alias("score_b"), F.col("pass_rate").alias("pass_rate_b"))
    return (
        left.join(right, ["variant", "model"], "full_outer")
        .withColumn("side", F.when(F.col("score_a").isNull(), "only_b").when(F.col("score_b").isNull(), "only_a").otherwise("both"))
        .withColumn("score_delta", F.round(F.col("score_b") - F.col("score_a"), 6))
        .withColumn("pass_rate_delta", F.round(F.col("pass_rate_b") - F.col("pass_rate_a"), 6))
        .orderBy("variant", "model")
    )


def in_both(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """The groups of both runs."""
    return a.select(*key).intersect(b.select(*key))


def only_in(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """The groups of the first run that the second has not."""
    return a.select(*key).subtract(b.select(*key))


def of_both(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """The records of two runs one after another, each with its ``run``."""
    return a.withColumn("run", F.lit(name_a)).unionByName(b.withColumn("run", F.lit(name_b)))

"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document of a source, in a shuffled order fixed by a hash of its id (of
its text where that is null), has
a virtual finish time: the source's words up to and with it, divided by the
source's target.  A second round of the same order follows the first, so a
source can be taken twice at most.  All finish times are put in one global
order and cut where the words taken reach the budget; since a source reaches
time 1 exactly at its target, all sources stop near their targets together.

No step needs a whole source, or all rows, in one task: the running sum of a
source is made of sums over hash buckets (a small table) and a window inside
each bucket, and the cut is found by counting finish times in 4096 ranges,
then again inside the one range that holds the cut.

Defined results: a null text has size 0; a document of size 0 is never taken;
a null source is a source of its own, last in order; repeated rows count each;
with no words at all every target and every ``taken`` is 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmatrix.llm.session import checkpointed

#: Weights of the sources in order, repeating; the budget and a source's limit as multiples of the words there are.
WEIGHTS, BUDGET, LIMIT = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
_LEVELS, _BITS = 3, 12


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as a struct ``_doc``, with what the mix needs: _size, _source (never null), _null, _key."""
    source = F.col(source_col).cast("string")
    return docs.select(
        F.struct("*").alias("_doc"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.coalesce(source, F.lit("")).alias("_source"),
        source.isNull().alias("_null"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))).cast("binary")).alias("_key"),
    )


@dataclass
class Plan:
    """``ledger``: for each source and bucket the words before it, and the source's size, target and place.  The cut: finish time and place of the last document taken."""

    ledger: DataFrame
    digits: int
    finish: float
    place: int


def _targets(sizes: DataFrame) -> DataFrame:
    """Each source's target: its weight times the one level at which all targets, held at their limits, add up to the budget."""
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    everyone = Window.partitionBy()
    in_order = Window.orderBy("_null", "_source")
    by_fullness = Window.orderBy("_ratio", "_place")
    return (
        sizes.withColumn("_place", F.row_number().over(in_order))
        .withColumn("_weight", F.element_at(weights, (F.col("_place") - 1) % len(WEIGHTS) + 1))
        .withColumn("_most", LIMIT * F.col("source_size"))
        .withColumn("_ratio", F.col("_most").cast("double") / F.col("_weight"))
        .withColumn("_full", F.coalesce(F.sum("_most").over(by_fullness.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("_weight").over(by_fullness.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.lit(BUDGET) * F.sum("source_size").over(everyone) - F.col("_full")) / F.col("_rest"))
        .withColumn("_open", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_place", "_level"))).over(everyone)["_level"])
        .withColumn("target", F.least(F.coalesce(F.col("_open") * F.col("_weight"), F.col("_most").cast("double")), F.col("_most").cast("double")))
        .select("_source", "_null", "_place", "source_size", "target")
    )


def _bucket(digits: int) -> Column:
    return F.substring("_key", 1, digits)


def _placed(rows: DataFrame, ledger: DataFrame, digits: int) -> DataFrame:
    """``rows`` with the words of their source up to and with them, as ``_upto``."""
    inside = Window.partitionBy("_source", "_null", "_bucket").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_bucket", _bucket(digits)).join(ledger, ["_source", "_null", "_bucket"]).withColumn("_upto", F.col("_before") + F.sum("_size").over(inside))


def _finish(again: int) -> Column:
    return (F.col("_upto") + again * F.col("source_size")).cast("double") / F.col("target")


def plan(slim: DataFrame) -> Plan:
    """Plans the mix of ``keyed`` rows; reads them several times, so hand in a checkpointed table without the texts."""
    rows = slim.count()
    digits = max(2, math.ceil(math.log(max(rows, 1), 16) / 2))
    sums = slim.groupBy("_source", "_null", _bucket(digits).alias("_bucket")).agg(F.sum("_size").alias("_sum"))
    targets = _targets(sums.groupBy("_source", "_null").agg(F.sum("_sum").alias("source_size")))
    earlier = Window.partitionBy("_source", "_null").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ledger = checkpointed(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum").join(targets, ["_source", "_null"]))
    of_sources = ledger.groupBy("_place").agg(F.max("source_size").alias("n"), F.max("target").alias("t")).where("t > 0")
    total, top = of_sources.agg(F.sum("n"), F.max(2 * F.col("n") / F.col("t"))).first()
    if not total:
        return Plan(ledger, digits, -1.0, 0)
    budget = math.floor(BUDGET * total)
    placed = _placed(slim.where("_size > 0"), ledger, digits)
    events = checkpointed(placed.select("_size", "_place", F.explode(F.array(_finish(0), _finish(1))).alias("finish")).withColumn("_step", F.least(F.floor(F.col("finish") / top * 2 ** (_LEVELS * _BITS)), F.lit(2 ** (_LEVELS * _BITS) - 1))))
    before, chosen = 0, events
    for level in range(1, _LEVELS + 1):
        at = F.shiftright("_step", _BITS * (_LEVELS - level))
        counted = chosen.groupBy(at.alias("at")).agg(F.sum("_size").alias("words"), F.count("*").alias("n"))
        upto = counted.withColumn("upto", F.sum("words").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        found = upto.where(F.col("upto") + before > budget).orderBy("at").limit(1).collect()
        if not found:
            return Plan(ledger, digits, math.inf, 0)
        before += found[0]["upto"] - found[0]["words"]
        chosen = chosen.where(at == found[0]["at"])
        if found[0]["n"] <= 4096:
            break
    running = chosen.withColumn("upto", F.sum("_size").over(Window.orderBy("finish", "_place").rowsBetween(Window.unboundedPreceding, 0)))
    last = running.agg(F.max(F.when(F.col("upto") + before <= budget, F.struct("finish", "_place"))), F.min("finish")).first()
    if last[0] is None:
        return Plan(ledger, digits, last[1], 0)  # all before this time, and nothing at it
    return Plan(ledger, digits, last[0]["finish"], last[0]["_place"])


def apply(rows: DataFrame, plan: Plan) -> DataFrame:
    """``keyed`` rows (with any other columns) with size, source_size, target and taken."""
    cut = F.lit(plan.finish)
    within = lambda again: F.when((F.col("_size") > 0) & ((_finish(again) < cut) | ((_finish(again) == cut) & (F.col("_place") <= plan.place))), F.col("_size")).otherwise(F.lit(0))
    placed = _placed(rows, plan.ledger, plan.digits)
    out = placed.withColumn("target", F.when(F.col("target") > 0, F.col("target"))).withColumns({"size": F.col("_size"), "taken": within(0) + within(1)})
    return out.withColumn("target", F.coalesce("target", F.lit(0.0))).drop("_size", "_source", "_null", "_key", "_bucket", "_before", "_place", "_upto")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    slim = checkpointed(keyed(docs.select(F.col(id_col), F.col(text_col), F.col(source_col)), id_col, text_col, source_col).select(F.col("_doc").getField(id_col).alias("_id"), "_size", "_source", "_null", "_key"))
    return apply(slim, plan(slim)).select(F.col("_id").alias(id_col), "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it."""
    full = keyed(docs, id_col, text_col, source_col)
    slim = checkpointed(full.select("_size", "_source", "_null", "_key"))
    taken = apply(full, plan(slim)).where("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    return taken.select("_doc.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS z,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT s, z, sum(size)::BIGINT AS n FROM d GROUP BY s, z),
p AS (SELECT *, row_number() OVER (ORDER BY z, s) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM p),
r AS (SELECT *, (2 * n)::DOUBLE / weight AS ratio FROM w),
f AS (SELECT *, coalesce(sum(2 * n) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
             sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest,
             sum(n) OVER ()::BIGINT AS total FROM r),
l AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - filled::DOUBLE) / rest::DOUBLE AS level FROM f),
o AS (SELECT level AS top FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
t AS (SELECT s, z, place, n, total, least(coalesce((SELECT top FROM o) * weight, (2 * n)::DOUBLE), (2 * n)::DOUBLE) AS target FROM l),
u AS (SELECT d.*, t.n AS source_size, t.target, t.place, t.total,
             sum(size) OVER (PARTITION BY d.s, d.z ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto,
             row_number() OVER () AS line
      FROM d JOIN t ON d.s = t.s AND d.z = t.z),
e AS (SELECT line, size, place, total, upto::DOUBLE / target AS finish FROM u WHERE size > 0
      UNION ALL SELECT line, size, place, total, (upto + source_size)::DOUBLE / target FROM u WHERE size > 0),
q AS (SELECT line, size, total, sum(size) OVER (ORDER BY finish, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS words FROM e),
g AS (SELECT line, sum(size)::BIGINT AS taken FROM q WHERE words <= floor(1.5 * total) GROUP BY line)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM u LEFT JOIN g USING (line)
"""

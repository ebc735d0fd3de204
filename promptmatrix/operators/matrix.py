"""Building the cells: filters, samples, the product, and what is left to do."""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptmatrix.errors import ConfigError

KEY = ("variant", "model", "case_id")


def pick(names: list[str], wanted: Iterable[str] | None, what: str) -> list[str]:
    """The wanted names in declared order; an unknown one is an error that lists what there is."""
    if not wanted:
        return names
    chosen = set(wanted)
    if unknown := sorted(chosen - set(names)):
        raise ConfigError(f"unknown {what}: {', '.join(unknown)} (available: {', '.join(names)})")
    return [n for n in names if n in chosen]


def candidates(models: DataFrame) -> DataFrame:
    """Models that get cells: those with role candidate or both."""
    return models.where(F.col("role").isin("candidate", "both"))


def only_cases(cases: DataFrame, ids: DataFrame) -> DataFrame:
    return cases.join(ids.select("case_id").distinct(), "case_id", "left_semi")


def unknown_names(wanted: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Wanted names that are not known, in order."""
    return wanted.select(column).distinct().join(known.select(column), column, "left_anti")


def draw(total: int, n: int, seed: int) -> list[int]:
    """Positions of a uniform sample without replacement, in order: the same for the same total, size and seed."""
    if n < 1:
        raise ConfigError("sample size must be at least 1")
    return list(range(total)) if n >= total else sorted(random.Random(seed).sample(range(total), n))


def sampled(cases: DataFrame, positions: list[int], position: str = "case_pos") -> DataFrame:
    """The cases whose places in the order of their positions are these.

    The places are a sample that the user sized, so that side is bounded by it.
    Places are numbered by counts of ranges of positions and a window inside
    each range, so no task sorts all cases and none come to the driver.
    """
    spark = cases.sparkSession
    drawn = spark.createDataFrame([(p,) for p in positions], "_place long")
    bounds = cases.agg(F.min(position), F.max(position)).first()
    if bounds[0] is None:
        return cases
    width = (bounds[1] - bounds[0]) // 1024 + 1
    placed = cases.withColumn("_range", F.floor((F.col(position) - bounds[0]) / width))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(before), "_range").withColumn("_place", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(position)) - 1)
    return numbered.join(drawn, "_place", "left_semi").select(cases.columns)


def _listed(rows: DataFrame, order: str) -> list[Column]:
    """The few rows of a configuration table, in order, as literals."""
    fields = rows.schema.fields
    return [F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in fields)) for r in sorted(rows.collect(), key=lambda r: r[order])]


def border(rows: DataFrame, n: int, position: str = "cell_ord", ranges: int = 1 << 14) -> int:
    """The least position up to which there are ``n`` rows (of at least so many): counts of ranges, then of ranges inside the one that holds it."""
    low, high = rows.agg(F.min(position), F.max(position)).first()
    while low < high:
        width = (high - low) // ranges + 1
        inside = rows.where(F.col(position).between(low, high))
        counts = inside.groupBy(F.floor((F.col(position) - low) / width).cast("long").alias("r")).agg(F.count("*").alias("n"))
        for r, held in sorted(tuple(x) for x in counts.collect()):
            if held >= n:
                break
            n -= held
        low, high = low + r * width, min(high, low + (r + 1) * width - 1)
    return low


def product(variants: DataFrame, models: DataFrame, cases: DataFrame, case_major: bool = False) -> DataFrame:
    """Every variant with every model on every case, with ``cell_ord``, the order of the run and the key of a cell.

    Variants and models are the few rows of a configuration, numbered by
    ``v_ord`` and ``m_ord``; they are literals that each case is exploded by,
    so there is no join, and filters above the product stay plain filters.
    Positions of cases may have gaps; the order leaves room for the highest.
    """
    listed_v, listed_m = _listed(variants, "v_ord"), _listed(models, "m_ord")
    n_models, n_variants = len(listed_m), len(listed_v)
    if not n_models or not n_variants:
        listed = cases.sparkSession.createDataFrame([], T.StructType([*variants.schema.fields, *models.schema.fields]))
        return cases.join(listed, how="cross").withColumn("cell_ord", F.lit(0).cast("long"))
    cells = cases.withColumn("_v", F.explode(F.array(*listed_v))).withColumn("_m", F.explode(F.array(*listed_m))).select(*cases.columns, "_v.*", "_m.*")
    if case_major:
        order: Column = (F.col("case_pos") * n_variants + F.col("v_ord")) * n_models + F.col("m_ord")
    else:
        width = cases.agg(F.coalesce(F.max("case_pos") + 1, F.lit(0))).first()[0]
        order = (F.col("v_ord") * n_models + F.col("m_ord")) * width + F.col("case_pos")
    return cells.withColumn("cell_ord", order.cast("long"))


def remaining(cells: DataFrame, done: DataFrame) -> DataFrame:
    """Cells without a record; an errored record counts as done."""
    return cells.join(done.select(*KEY), list(KEY), "left_anti")


def ids_digest(cases: DataFrame, id_col: str = "case_id", position: str = "case_pos", block: int = 1 << 16) -> DataFrame:
    """One row: the SHA-256 of the digests of blocks of positions, each the SHA-256 of the block's ids followed by a line feed each, in order.

    No task holds more than a block of ids; the digests are 64 bytes a block.
    """
    at = F.floor(F.col(position) / block)
    inside = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(id_col).cast("string").alias("i"))))
    joined = F.array_join(F.transform(inside, lambda x: F.concat(x["i"], F.lit("\n"))), "")
    blocks = cases.groupBy(at.alias("b")).agg(F.sha2(joined.cast("binary"), 256).alias("d"))
    ordered = F.array_sort(F.collect_list(F.struct("b", "d")))
    return blocks.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["d"]), "\n").cast("binary"), 256).alias("digest"))


def names(spark: SparkSession, column: str, values: list[str], order: str) -> DataFrame:
    """Names of a configuration with their order, as a local table that needs no job to be read."""
    if not values:
        return spark.createDataFrame([], f"{column} string, {order} long")
    rows = ", ".join(f"(:n{i}, {i}L)" for i in range(len(values)))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS named(`{column}`, `{order}`)", {f"n{i}": v for i, v in enumerate(values)})

"""Reading results: failures, pages, lookups, report order, the wide export and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptmatrix.errors import ConfigError
from promptmatrix.functions.text import guard_formula, hash_case_id, is_blank


def failures(results: DataFrame, first: int | None = None) -> DataFrame:
    """Cells that did not pass, in the order of the run; the first few for a report."""
    out = results.where("not passed")
    return out.orderBy("cell_ord").limit(first) if first else out


def page(results: DataFrame, number: int, size: int = 20) -> DataFrame:
    """A page of results, from 1."""
    return results.orderBy("cell_ord").offset((max(1, number) - 1) * size).limit(size)


def one(results: DataFrame, variant: str, model: str, case_id: str) -> DataFrame:
    """The first record of a cell."""
    return results.where((F.col("variant") == variant) & (F.col("model") == model) & (F.col("case_id") == case_id)).orderBy("cell_ord").limit(1)


def drill_down(results: DataFrame, case_id: str) -> DataFrame:
    return results.where(F.col("case_id") == case_id).orderBy("variant", "model")


def for_report(results: DataFrame) -> DataFrame:
    """All cells, cases with a failing cell first, then by id; within a case failing cells first.

    Whether a case passes is aggregated and joined back, so a case with many
    cells is not one window.
    """
    cases = results.groupBy("case_id").agg(F.bool_and("passed").alias("case_passed"))
    return results.join(cases, "case_id").orderBy("case_passed", "case_id", "passed", "variant", "model")


def wide(results: DataFrame, names: list[str]) -> DataFrame:
    """One row a cell with columns score:<criterion> and passed:<criterion>, as a spreadsheet wants it.

    Each criterion is picked out of the cell's own array, so the pivot needs
    neither an explode nor a shuffle, and unscored cells keep their row.
    """
    pick = lambda name, part: F.try_element_at(F.filter("scores", lambda e: e["criterion"] == name), F.lit(1))[part]
    columns = [guard_formula(F.col(c)).alias(c) for c in ("variant", "model", "case_id")] + [F.col("cell_score"), F.col("passed").alias("cell_passed")]
    for name in sorted(names):
        columns.append(pick(name, "score").alias(f"score:{name}"))
    for name in sorted(names):
        columns.append(pick(name, "passed").alias(f"passed:{name}"))
    have = set(results.columns)
    columns += [F.col(c) for c in ("cached", "latency_ms", "input_tokens", "output_tokens", "cost_usd") if c in have]
    columns += [guard_formula(F.col(c)).alias(c) for c in ("error", "output") if c in have]
    return results.select(columns)


def latest_labels(labels: DataFrame, position: str = "pos") -> DataFrame:
    """One label a case: of several rows the last."""
    return labels.where(~is_blank(F.col("case_id"))).groupBy("case_id").agg(F.max_by("human_label", position).alias("human_label"))


def calibration(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Outputs with the human label of their case: one row a case, the first record that has an output, in order of id."""
    usable = results.where(F.col("error").isNull() & F.col("output").isNotNull() & (F.col("output") != ""))
    first = usable.groupBy("case_id").agg(F.min_by(F.struct("variant", "model", "output"), "cell_ord").alias("r"))
    return first.join(labels, "case_id").select("case_id", "r.variant", "r.model", "r.output", "human_label").orderBy("case_id")


def one_system(results: DataFrame) -> None:
    """Refuses results of several variants or models, of which a case could have several outputs."""
    row = results.agg(F.sort_array(F.collect_set("variant")), F.sort_array(F.collect_set("model"))).first()
    for what, found in zip(("variant", "model"), row, strict=True):
        if len(found) > 1:
            raise ConfigError(f"the run has several {what}s ({', '.join(found)}); choose one")


def redacted(results: DataFrame, keep_ids: bool = False, keep_detail: tuple[str, ...] = ()) -> DataFrame:
    """The one projection before anything of a private run is written: no messages, outputs, details or error texts, ids hashed."""
    clean = F.transform(
        "scores",
        lambda e: F.struct(
            e["criterion"].alias("criterion"), e["weight"].alias("weight"), e["score"].alias("score"), e["passed"].alias("passed"),
            F.when(e["criterion"].isin(*keep_detail), e["detail"]).alias("detail") if keep_detail else F.lit(None).cast("string").alias("detail"),
            F.when(e["error"].isNotNull(), F.lit("scorer error (details withheld)")).alias("error"),
        ),
    )
    out = {"scores": clean}
    if "messages" in results.columns:
        out["messages"] = F.array().cast(results.schema["messages"].dataType)
    if "output" in results.columns:
        out["output"] = F.lit(None).cast("string")
    if not keep_ids:
        out["case_id"] = hash_case_id(F.col("case_id"))
    out["error"] = F.when(F.col("error").isNotNull(), F.concat_ws(" ", F.regexp_extract("error", r"^(\w+(?:Error|Exception))", 1), F.regexp_extract("error", r"(HTTP \d{3})", 1)))
    return results.withColumns(out)


def artifacts(media: DataFrame) -> DataFrame:
    """Each content once, under its digest."""
    return media.groupBy("sha256").agg(F.min("media_type").alias("media_type"), F.min("path").alias("path"), F.count("*").cast("long").alias("uses"))


def latest_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs first."""
    return runs.orderBy(F.desc(F.coalesce("created_ns", F.lit(0))), F.desc("id")).limit(max(1, limit))


def by_label(runs: DataFrame, label: str) -> DataFrame:
    """The last run created under a label."""
    return runs.where(F.col("label") == label).agg(F.max_by("id", F.struct(F.coalesce("created_ns", F.lit(0)), "id")).alias("id"))


def retrieved(questions: DataFrame, passages: DataFrame, k: int, stop: list[str]) -> DataFrame:
    """The k best passages of each question by shared words: the larger of overlap and half the coverage, to four places.

    Questions and passages meet on their words only, so a passage that shares
    no word is never paired.
    """
    words = lambda c: F.array_distinct(F.array_except(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)")), F.array(*(F.lit(w) for w in stop)))) if stop else F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)")))
    q = questions.withColumn("w", words(F.col("question"))).withColumn("nq", F.size("w"))
    p = passages.withColumn("w", words(F.col("text"))).withColumn("np", F.size("w"))
    shared = q.select("q_id", "nq", F.explode("w").alias("word")).join(p.select("p_id", "np", F.explode("w").alias("word")), "word").groupBy("q_id", "p_id", "nq", "np").agg(F.count("*").alias("n"))
    score = F.round(F.greatest(F.col("n") / (F.col("nq") + F.col("np") - F.col("n")), 0.5 * F.col("n") / F.col("nq")), 4)
    best = Window.partitionBy("q_id").orderBy(F.desc("score"), "p_id")
    return shared.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q_id", F.col("rank").cast("int").alias("rank"), "p_id", "score")


def first_keyword(text: Column, rules: dict[str, str], otherwise: str) -> Column:
    """The class of the first keyword that a text holds."""
    out = F.lit(None).cast("string")
    for word, name in reversed(rules.items()):
        out = F.when(text.contains(word), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(otherwise))


def best_sentence(texts: DataFrame, key: str, text: str, question: list[str]) -> DataFrame:
    """Of each text the sentence that shares most words with a question; the shortest of equals, then the first."""
    parts = texts.select(key, F.posexplode(F.split(F.col(text), r"\.", -1)).alias("_i", "_s"))
    hits = F.size(F.array_intersect(F.array_distinct(F.split(F.lower("_s"), " ", -1)), F.array(*(F.lit(w) for w in question))))
    return parts.groupBy(key).agg(F.max_by("_s", F.struct(hits, -F.length("_s"), -F.col("_i"))).alias("_s")).select(key, F.trim("_s").alias("sentence"))

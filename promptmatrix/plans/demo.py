"""A run over the driver's tables: documents as cases, two prompts, two mock models, four criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmatrix.functions import template
from promptmatrix.operators import matrix, requests, scoring

VARIANTS = {"plain": "{{ text }}", "tagged": "Lang {{ lang }}: {{ text }}"}
MODELS = {"echo": (0.5, 1.5), "fixed": (1.0, 2.0)}
ANSWER = "the answer is en"
#: Shorter texts stand for calls that fail.
LEAST_CHARS = 40
CRITERIA = [
    {"criterion": "answer", "weight": 1.0, "scorer": {"type": "exact", "value": ANSWER}},
    {"criterion": "lang", "weight": 3.0, "scorer": {"type": "contains"}},
    {"criterion": "clean", "weight": 1.0, "scorer": {"type": "not-contains", "value": "MORON", "case_sensitive": False}},
    {"criterion": "digits", "weight": 2.0, "scorer": {"type": "regex", "pattern": "[0-9]+"}},
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("case_id"), F.col("doc_id").alias("case_pos"), "text", "lang", "n_chars")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.product(matrix.names(spark, "variant", list(VARIANTS), "v_ord"), matrix.names(spark, "model", list(MODELS), "m_ord"), cases(spark, sf_dir))


def rendered(all_cells: DataFrame) -> DataFrame:
    columns = {"text": F.col("text"), "lang": F.col("lang")}
    prompt = None
    for name, source in VARIANTS.items():
        text = template.column(source, columns)["text"]
        prompt = F.when(F.col("variant") == name, text) if prompt is None else prompt.when(F.col("variant") == name, text)
    return all_cells.withColumn("prompt", prompt)


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with output, usage, cost and error."""
    short = F.col("n_chars") < LEAST_CHARS
    output = F.when(short, None).when(F.col("model") == "echo", F.col("prompt")).otherwise(ANSWER)
    called = rendered(cells(spark, sf_dir)).withColumns({"output": output, "error": F.when(short, "ProviderError: HTTP 400 too short")})
    counted = called.withColumns({"input_tokens": requests.quarter(F.length("prompt")), "output_tokens": requests.quarter(F.length("output"))})
    prices = spark.createDataFrame([(m, *p) for m, p in MODELS.items()], "model string, input double, output double")
    priced = requests.with_price(counted, prices)
    usd = F.when(~short, requests.cost(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out")))
    return priced.withColumns({"cost_usd": usd, "cached": F.col("case_pos") % 10 == 0, "expected": F.concat(F.lit('"'), F.col("lang"), F.lit('"'))})


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.judged(scoring.scorecard(completed(spark, sf_dir), CRITERIA))


#: The same run in SQL, up to the table ``results``.
SQL = """
WITH cases AS (SELECT doc_id::VARCHAR AS case_id, doc_id AS case_pos, text, lang, n_chars FROM documents),
cells AS (
  SELECT v.variant, m.model, c.*, ((v.v_ord * 2 + m.m_ord) * (SELECT max(case_pos) + 1 FROM cases) + c.case_pos)::BIGINT AS cell_ord, m.pin, m.pout
  FROM cases c, (VALUES ('plain', 0), ('tagged', 1)) v(variant, v_ord), (VALUES ('echo', 0, 0.5::DOUBLE, 1.5::DOUBLE), ('fixed', 1, 1.0::DOUBLE, 2.0::DOUBLE)) m(model, m_ord, pin, pout)),
rendered AS (SELECT *, CASE variant WHEN 'plain' THEN text ELSE 'Lang ' || lang || ': ' || text END AS prompt FROM cells),
called AS (
  SELECT *, CASE WHEN n_chars < 40 THEN NULL WHEN model = 'echo' THEN prompt ELSE 'the answer is en' END AS output,
         CASE WHEN n_chars < 40 THEN 'ProviderError: HTTP 400 too short' END AS error, case_pos % 10 = 0 AS cached FROM rendered),
counted AS (SELECT *, (length(prompt) // 4)::BIGINT AS input_tokens, (length(output) // 4)::BIGINT AS output_tokens FROM called),
completed AS (
  SELECT *, CASE WHEN n_chars >= 40 THEN round((coalesce(input_tokens, 0) * pin + coalesce(output_tokens, 0) * pout) / 1000000, 8) END AS cost_usd FROM counted),
graded AS (
  SELECT *, coalesce(trim(output, E' \\t\\n\\r') = 'the answer is en', false) AS p1, coalesce(contains(output, lang), false) AS p2,
         coalesce(NOT contains(lower(output), 'moron'), false) AS p3, coalesce(regexp_matches(output, '[0-9]+'), false) AS p4 FROM completed),
results AS (
  SELECT *, CASE WHEN error IS NULL THEN round((p1::INT * 1.0::DOUBLE + p2::INT * 3.0::DOUBLE + p3::INT * 1.0::DOUBLE + p4::INT * 2.0::DOUBLE) / 7.0::DOUBLE, 6) ELSE 0.0::DOUBLE END AS cell_score,
         error IS NULL AND p1 AND p2 AND p3 AND p4 AS passed FROM graded)
"""

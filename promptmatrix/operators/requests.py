"""Requests: their key, the responses already there, one call for equal requests, and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bumped when the key changes, so that old responses are missed and not served for another request.
KEY_VERSION = 1


def request_key(spec_json: Column, messages: Column) -> Column:
    """SHA-256 of what can change a response: the model's provider, endpoint and parameters, and the messages without file paths."""
    return F.sha2(F.concat_ws("\n", F.lit(str(KEY_VERSION)), spec_json, F.to_json(bare(messages))).cast("binary"), 256)


def bare(messages: Column) -> Column:
    """Messages with media known by content only."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.transform(m["parts"], lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), p["media_type"].alias("media_type"), p["sha256"].alias("sha256"))).alias("parts")))


def message_text(messages: Column) -> Column:
    """The text parts of all messages, joined without a separator."""
    return F.array_join(F.transform(messages, lambda m: F.array_join(F.transform(m["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), "")), "")


def echo_last_user(messages: Column) -> Column:
    """What an echoing model says: the parts of the last user message joined by a space, media as kind and digest."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    last = F.try_element_at(users, F.lit(-1))
    said = F.transform(last["parts"], lambda p: F.when(p["type"] == "text", p["text"]).otherwise(F.concat(F.lit("["), p["type"], F.lit(":"), F.substring(p["sha256"], 1, 8), F.lit("]"))))
    return F.when(F.size(users) > 0, F.array_join(F.filter(said, lambda t: t.isNotNull() & (t != "")), " ")).otherwise("mock response")


def quarter(chars: Column) -> Column:
    """A token count from a count of characters."""
    return F.floor(chars / 4).cast("long")


def with_cache(requests: DataFrame, responses: DataFrame, key: str = "request_key") -> DataFrame:
    """Requests with the stored response of their key, if there is one; ``cached`` says so."""
    return requests.join(responses.withColumn("_hit", F.lit(True)), key, "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def to_call(requests: DataFrame, key: str = "request_key", order: str = "cell_ord") -> DataFrame:
    """Of the requests without a response, the first of each key: the calls to make.

    The first is a partial aggregate on the key, so a key that many cells
    share is one row before the shuffle.
    """
    columns = [c for c in requests.columns if c not in (key, order)]
    first = F.min_by(F.struct(*columns), F.col(order)) if columns else F.lit(None)
    out = requests.where("not cached").groupBy(key).agg(F.min(order).alias(order), first.alias("_first"))
    return out.select(key, order, *(F.col(f"_first.{c}").alias(c) for c in columns))


def single_flight(cells: DataFrame, key: str = "request_key", order: str = "cell_ord") -> DataFrame:
    """Marks the cells that are served by an earlier cell's call: ``called`` for the first of a key, ``cached`` for the rest."""
    first = cells.groupBy(key).agg(F.min(order).alias("_first"))
    return cells.join(first, key).withColumn("called", F.col(order) == F.col("_first")).withColumn("cached", ~F.col("called")).drop("_first")


def usage(c: Column) -> Column:
    """A token count as the provider gave it (any text), or null unless it is a whole number, finite and not negative."""
    n = c.cast("string").try_cast("double")
    return F.when((n >= 0) & (n == F.floor(n)) & (n < 9.2e18), n.cast("long"))


def with_price(calls: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Calls with ``price_in`` and ``price_out`` (USD a million tokens): an override of the model first, then the table.

    The table is a fixed list, so it is broadcast.
    """
    return calls.join(F.broadcast(prices.select(F.col("model").alias(model), F.col("input").alias("_in"), F.col("output").alias("_out"))), model, "left").withColumns(
        {"price_in": F.coalesce("override_in", "_in"), "price_out": F.coalesce("override_out", "_out")} if "override_in" in calls.columns else {"price_in": F.col("_in"), "price_out": F.col("_out")}
    ).drop("_in", "_out")


def cost(input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """USD of a call; null if the price or both counts are unknown."""
    known = price_in.isNotNull() & price_out.isNotNull() & (input_tokens.isNotNull() | output_tokens.isNotNull())
    return F.when(known, F.round((F.coalesce(input_tokens, F.lit(0)) * price_in + F.coalesce(output_tokens, F.lit(0)) * price_out) / 1_000_000, 8))


def estimate(groups: DataFrame, assumed_output: int = 500) -> DataFrame:
    """One row: the estimated ``usd`` of groups (model, input_tokens, max_tokens, cells, price_in, price_out) and the unpriced models; null if nothing has a price."""
    out = F.coalesce(F.when(F.col("max_tokens") > 0, F.col("max_tokens")), F.lit(assumed_output))
    each = cost(F.col("input_tokens") * F.col("cells"), out * F.col("cells"), F.col("price_in"), F.col("price_out"))
    priced = groups.withColumn("usd", each)
    return priced.agg(F.round(F.sum("usd"), 4).alias("usd"), F.sort_array(F.collect_set(F.when(F.col("usd").isNull(), F.col("model")))).alias("unpriced"))


def within_budget(calls: DataFrame, limit: float, spent: float = 0.0, order: str = "cell_ord", cost_col: str = "cost_usd", buckets: int = 1024) -> DataFrame:
    """The calls that are made one after another while what was spent before stays under the limit.

    The running sum is made of sums over ranges of the order (a small table)
    and a window inside each range, so no task holds all calls.  A call
    without a cost counts as nothing.
    """
    bounds = calls.agg(F.min(order), F.max(order)).first()
    if bounds[0] is None:
        return calls
    width = (bounds[1] - bounds[0]) // buckets + 1
    placed = calls.withColumn("_b", F.floor((F.col(order) - bounds[0]) / width)).withColumn("_c", F.coalesce(F.col(cost_col).cast("decimal(38,10)"), F.lit(0)))
    sums = placed.groupBy("_b").agg(F.sum("_c").alias("_s"))
    earlier = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_e"))
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(earlier, "_b").withColumn("_before", F.col("_e") + inside).where(F.col("_before") + spent < limit).drop("_b", "_c", "_e", "_before")


def until_failure(cells: DataFrame, order: str = "cell_ord") -> DataFrame:
    """Cells up to and with the first that did not pass."""
    first = cells.where("not passed").agg(F.min(order).alias("_stop"))
    return cells.join(F.broadcast(first), (F.col("_stop").isNull()) | (F.col(order) <= F.col("_stop"))).drop("_stop")


def in_window(calls: DataFrame, time: str, seconds: int = 60, by: str | None = None) -> DataFrame:
    """How many calls fell in the trailing window that ends with each call."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    window = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return calls.withColumn("_at", at).withColumn("in_window", F.count("*").over(window)).drop("_at")

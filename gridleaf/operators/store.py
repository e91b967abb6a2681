"""Presets, result cache and usage. No table format with MERGE is needed: each change is a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .layout import tile_grid
from .scan import null_safe_join

# --- fixed values ---------------------------------------------------------
MAX_NAME = 40
MAX_ENTRIES, MAX_VALUE = 5_000, 4_000_000
PRICE_IN, PRICE_OUT = 0.30, 1.20  # per million tokens
IMAGE_TOKENS = 1024
LONG_ANSWER, SHORT_ANSWER = 12_000, 2_500
# --------------------------------------------------------------------------


def preset_error(name: Column) -> Column:
    clean = strip(F.coalesce(name, F.lit("")))
    return F.when(F.length(clean) == 0, "empty name").when(F.length(clean) > MAX_NAME, "name too long")


def save_presets(changes: DataFrame) -> DataFrame:
    """``action, name, id, params, created, updated``: the last save of a name wins, the first gives id and date."""
    good = changes.withColumn("name", strip(F.col("name"))).where(preset_error(F.col("name")).isNull())
    return good.groupBy("action", "name").agg(
        F.min_by("new_id", "updated").alias("id"), F.max_by("params", "updated").alias("params"),
        F.min("updated").alias("created"), F.max("updated").alias("updated"),
    )


def refused_presets(changes: DataFrame) -> DataFrame:
    """The saves that ``save_presets`` doesn't take, all columns, with their ``error``."""
    return changes.withColumn("error", preset_error(F.col("name"))).where(F.col("error").isNotNull())


def list_presets(presets: DataFrame, action: str | None = None) -> DataFrame:
    chosen = presets if action is None else presets.where(F.col("action") == action)
    return chosen.orderBy("action", F.lower("name"), "name")


def delete_presets(presets: DataFrame, ids: DataFrame) -> DataFrame:
    return presets.join(ids.select("id"), "id", "left_anti").select(*presets.columns)


def merge_params(preset: Column, overrides: Column) -> Column:
    """String maps, the overrides win."""
    left = F.map_filter(preset, lambda k, _: ~F.map_contains_key(overrides, k))
    return F.map_concat(left, overrides)


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds ``hit`` and ``value`` to every request."""
    stored = cache.select("key", F.col("value").alias("value"), F.lit(True).alias("__hit"))
    joined = null_safe_join(requests, stored, ["key"], "left", grown=False)
    return joined.withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys to compute, once each."""
    return requests.join(cache.select("key"), "key", "left_anti").select("key").distinct()


def cache_touch(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """The cache after serving the requests: hits counted, last hit noted. Requests are counted before the join."""
    asked = requests.groupBy("key").agg(F.count(F.lit(1)).alias("__n"), F.max("at").alias("__at"))
    joined = null_safe_join(cache, asked, ["key"], "left", grown=False)
    return joined.withColumns(
        {"hits": F.col("hits") + F.coalesce("__n", F.lit(0)), "last_hit": F.coalesce("__at", "last_hit")}
    ).select(*cache.columns)


def cache_put(cache: DataFrame, rows: DataFrame, max_value: int = MAX_VALUE) -> DataFrame:
    """Store ``key, value, created``: a known key changes its value only; ``cache_refused`` has what is not stored."""
    fit = rows.where(F.length("value") <= max_value).groupBy("key").agg(
        F.max_by("value", "created").alias("__value"), F.min("created").alias("__created")
    )
    both = cache.withColumn("__known", F.lit(True)).join(fit, "key", "full_outer")
    return both.select(
        "key", F.coalesce("__value", "value").alias("value"),
        F.when(F.col("__known"), F.col("created")).otherwise(F.col("__created")).alias("created"),
        F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), "last_hit",
    )


def cache_refused(rows: DataFrame, max_value: int = MAX_VALUE) -> DataFrame:
    """``key, created, reason``: the rows that ``cache_put`` doesn't store."""
    reason = F.when(F.col("value").isNull(), "no value").when(F.length("value") > max_value, "value too long")
    return rows.select("key", "created", reason.alias("reason")).where(F.col("reason").isNotNull())


def cache_evict(cache: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The entries used last; a top-k, so no global sort."""
    return cache.orderBy(F.desc(F.coalesce("last_hit", "created")), "key").limit(max_entries)


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).cast("bigint").alias("hits"))


def token_cost(prompt: Column, completion: Column) -> Column:
    return F.round(prompt / 1_000_000 * PRICE_IN + completion / 1_000_000 * PRICE_OUT, 6)


def usage_rollup(calls: DataFrame, keys: list[str]) -> DataFrame:
    prompt, completion = F.sum("prompt_tokens").cast("bigint"), F.sum("completion_tokens").cast("bigint")
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
        token_cost(prompt, completion).alias("cost"),
    )


def estimate_cost(images: DataFrame, prompt_chars: int, structured: bool, mode: str = "auto") -> DataFrame:
    """Tiles, tokens and cost per image before anything runs; the line height is a guess from the height."""
    grid = tile_grid(F.col("width"), F.col("height"), F.lit(0.0), F.lit(mode), F.lit("grid"))
    calls = (grid["cols"] * grid["rows"]).cast("bigint")
    tokens_in = calls * (IMAGE_TOKENS + prompt_chars // 2)
    tokens_out = calls * (LONG_ANSWER if structured else SHORT_ANSWER)
    return images.select(
        "image_id", calls.alias("tiles"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"),
        token_cost(tokens_in, tokens_out).alias("cost"),
    )

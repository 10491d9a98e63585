"""Price catalogs and contract rates that have already landed as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The catalog's field names, per token category.
RATE_FIELDS = {
    "input": "input_cost_per_token",
    "output": "output_cost_per_token",
    "cache_read": "cache_read_input_token_cost",
    "cache_write": "cache_creation_input_token_cost",
}
_DOLLARS_TO_RATE = 1e12  # dollars per token -> micro-dollars per million tokens


class PricingError(ValueError):
    """Contract rates that cannot be used."""


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Landed catalog snapshots: one JSON file per revision, named by its sha."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([0-9a-f]{40})[^/]*$", 1).alias("sha"),
        F.col("value").alias("body"),
    )


def _rate(v: Column, field: str) -> Column:
    number = F.try_variant_get(v, f"$.{field}", "double")
    return F.when(number >= 0, F.round(number * _DOLLARS_TO_RATE).cast("bigint"))


def _tiers(raw: Column, field: str) -> Column:
    """``[(threshold, rate)]`` from ``<field>_above_<N>[k]_tokens`` members."""
    entries = F.from_json(raw, "map<string,string>")
    pattern = rf"^{field}_above_([0-9]+)(k?)_tokens$"
    found = F.filter(F.map_entries(entries), lambda e: e["key"].rlike(pattern))
    return F.transform(
        found,
        lambda e: F.struct(
            (
                F.regexp_extract(e["key"], pattern, 1).cast("bigint")
                * F.when(F.regexp_extract(e["key"], pattern, 2) == "k", 1000).otherwise(1)
            ).alias("threshold"),
            F.round(e["value"].cast("double") * _DOLLARS_TO_RATE).cast("bigint").alias("rate"),
        ),
    )


def price_catalog(snapshots: DataFrame, revisions: DataFrame) -> DataFrame:
    """Rates per revision and model.

    ``snapshots`` = (sha, body), ``revisions`` = (sha, recorded_at).  A snapshot
    counts only when some model has both an input and an output price.
    """
    models = snapshots.select("sha", F.try_parse_json("body").alias("v")).where(F.col("v").isNotNull())
    models = models.lateralJoin(
        models.sparkSession.tvf.variant_explode(F.col("v").outer())
    ).select("sha", F.lower("key").alias("model"), F.col("value").alias("m"))
    rates = models.where(F.col("model") != "sample_spec").select(
        "sha",
        "model",
        F.try_variant_get("m", "$.mode", "string").alias("mode"),
        *[_rate(F.col("m"), f).alias(f"{c}_rate") for c, f in RATE_FIELDS.items()],
        *[_tiers(F.to_json("m"), f).alias(f"{c}_tiers") for c, f in RATE_FIELDS.items()],
    )
    usable = (
        rates.where(F.col("input_rate").isNotNull() & F.col("output_rate").isNotNull()).select("sha").distinct()
    )
    return rates.join(usable, "sha", "left_semi").join(revisions, "sha")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Contract rates from one JSON file; raises when the file is incomplete."""
    schema = (
        "version string, source string, rates array<struct<model_prefix:string, rate:struct<"
        "input_per_million:bigint, cache_read_per_million:bigint, cache_write_per_million:bigint,"
        " output_per_million:bigint>>>"
    )
    return check_overrides(spark.read.schema(schema).json(path, multiLine=True))


def check_overrides(document: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = document.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(blank(F.col("version")) | blank(F.col("source"))).alias("unnamed"),
        F.count_if(F.coalesce(F.size("rates"), F.lit(0)) < 1).alias("empty"),
        F.count_if(F.exists("rates", lambda r: blank(r["model_prefix"]))).alias("no_prefix"),
    ).first()
    if not bad["n"] or bad["unnamed"]:
        raise PricingError("pricing version and source are required")
    if bad["empty"]:
        raise PricingError("at least one pricing rate is required")
    if bad["no_prefix"]:
        raise PricingError("model prefixes cannot be empty")
    return document.select("version", "source", F.explode("rates").alias("r")).select(
        "version",
        "source",
        F.lower(F.trim("r.model_prefix")).alias("model_prefix"),
        F.col("r.rate.input_per_million").alias("input_rate"),
        F.col("r.rate.output_per_million").alias("output_rate"),
        F.col("r.rate.cache_read_per_million").alias("cache_read_rate"),
        F.col("r.rate.cache_write_per_million").alias("cache_write_rate"),
    )

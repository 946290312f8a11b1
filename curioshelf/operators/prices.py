"""Price and exchange-rate tables with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curioshelf.operators.asof import as_of
from curioshelf.operators.ranking import grouped_rank

# How long a cached row stays fresh, how many cards one refresh may ask for, the base
# currency, and the price fields.
TIME_TO_LIVE = "INTERVAL '24' HOUR"
REFRESH_BATCH = 75
BASE_CURRENCY = "USD"
PRICE_FIELDS = ["usd", "usd_foil", "usd_etched", "eur", "eur_foil", "tix"]


def _time(now: str | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")


def is_fresh(updated_at: Column, now: str | Column) -> Column:
    """Younger than the time to live; an undated row is not fresh."""
    return F.coalesce(updated_at > _time(now) - F.expr(TIME_TO_LIVE), F.lit(False))


def latest(versions: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The newest row per key; of equally new ones always the same, by a hash of their other columns.
    The rank filter is applied on the map side too, so a key with very many versions sends one row
    per task."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c, kind in versions.dtypes if c not in (*keys, *order) and "map<" not in kind]
    ties = [F.xxhash64(*rest).desc()] if rest else []
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order], *ties)
    return (
        versions.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") == 1)
        .drop("_rn")
    )


def price_extract(cards: DataFrame) -> DataFrame:
    """The six price fields of raw card records, as one ``prices`` struct."""
    return cards.select(
        F.col("id").alias("card_id"),
        F.struct(*[F.col(f"prices.{f}").cast("string").alias(f) for f in PRICE_FIELDS]).alias(
            "prices"
        ),
    )


def _fresh_cache(cache: DataFrame, now) -> DataFrame:
    return cache.filter(is_fresh(F.col("updated_at"), now))


def price_fresh(ids: DataFrame, cache: DataFrame, now) -> DataFrame:
    """Requested ids that a fresh cache row answers, with that row."""
    return _fresh_cache(cache, now).join(ids.select("card_id").distinct(), "card_id", "left_semi")


def price_stale(ids: DataFrame, cache: DataFrame, now) -> DataFrame:
    """Requested ids to refresh: stale, undated or not cached."""
    return ids.select("card_id").distinct().join(_fresh_cache(cache, now), "card_id", "left_anti")


def price_resolve(ids: DataFrame, cache: DataFrame, now) -> DataFrame:
    """Every requested id with its fresh cached prices, or with empty ones."""
    return ids.select("card_id").distinct().join(_fresh_cache(cache, now), "card_id", "left")


def price_batches(ids: DataFrame, size: int = REFRESH_BATCH) -> DataFrame:
    """Refresh list in consecutive batches of at most ``size`` ids, numbered from 0."""
    distinct = ids.select("card_id").distinct()
    ranked = grouped_rank(distinct, [], [("card_id", "asc")], "_rn")
    return ranked.select(
        "card_id", F.floor((F.col("_rn") - 1) / size).cast("bigint").alias("batch")
    )


def price_upsert(cache: DataFrame, updates: DataFrame) -> DataFrame:
    """The cache after the updates: the last write per card wins."""
    return latest(cache.unionByName(updates), "card_id", "updated_at")


def valid_code(code: Column) -> Column:
    return F.coalesce(F.upper(code).rlike(r"\A[A-Z]{3}\z"), F.lit(False))


def fx_valid_codes(df: DataFrame, column: str) -> DataFrame:
    """Rows whose currency code, once upper-cased, is three letters; the code is upper-cased."""
    return df.filter(valid_code(F.col(column))).withColumn(column, F.upper(column))


def fx_resolve(requests: DataFrame, rates: DataFrame, now) -> DataFrame:
    """Rate for each requested ``target``, with a ``status``: ok, unknown or malformed."""
    fresh = (
        rates.filter(F.col("base") == BASE_CURRENCY)
        .filter(is_fresh(F.col("updated_at"), now))
        .select(F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    )
    code = F.upper("target")
    rate = F.when(code == BASE_CURRENCY, F.lit(1.0)).otherwise(F.col("_rate"))
    status = (
        F.when(~valid_code(F.col("target")), "malformed")
        .when(F.col("rate").isNull(), "unknown")
        .otherwise("ok")
    )
    return (
        requests.join(fresh, code == F.col("_target"), "left")
        .withColumn("rate", rate)
        .withColumn("status", status)
        .withColumn("target", code)
        .drop("_target", "_rate")
    )


def price_convert(prices: DataFrame, rates: DataFrame, now) -> DataFrame:
    """Price in each requested currency, rounded half up to cents; NULL without a fresh rate.

    ``prices`` has usd and target, in any case; the base currency needs no rate.  ``rates`` has
    base, target, rate and updated_at.
    """
    amount = F.col("usd").cast("decimal(12,2)") * F.col("rate").cast("decimal(18,6)")
    return fx_resolve(prices, rates, now).withColumn("amount", F.round(amount, 2).cast("decimal(18,2)"))


def price_as_of(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests (card_id, at and others) with ``prices``, those last written before ``at`` within the
    time to live; ``log`` has card_id, prices and updated_at."""
    written = log.select("card_id", "prices", "updated_at")
    found = as_of(requests, written, "card_id", "at", "updated_at", TIME_TO_LIVE)
    return found.withColumn("prices", F.col("known.prices")).drop("known")


def price_convert_as_of(payments: DataFrame, log: DataFrame) -> DataFrame:
    """Payments (usd, target, at and others) with the rate in force at their time, and the amount,
    rounded half up to cents; NULL without a rate of the last 24 hours.  ``log`` has base, target, rate
    and updated_at."""
    rates = log.filter(F.col("base") == BASE_CURRENCY).select(F.upper("target").alias("target"), "rate", "updated_at")
    asked = payments.withColumn("target", F.upper("target"))
    found = as_of(asked, rates, "target", "at", "updated_at", TIME_TO_LIVE)
    rate = F.when(F.col("target") == BASE_CURRENCY, F.lit(1.0)).otherwise(F.col("known.rate"))
    amount = F.col("usd").cast("decimal(12,2)") * rate.cast("decimal(18,6)")
    return found.withColumn("rate", rate).withColumn("amount", F.round(amount, 2).cast("decimal(18,2)")).drop("known")


def collection_value_in(
    copies: DataFrame, prices: DataFrame, rates: DataFrame, targets: DataFrame, now
) -> DataFrame:
    """:func:`collection_value` in the currency of each owner (``targets``: owner, target), as
    ``amount``; NULL without a fresh rate."""
    value = collection_value(copies, prices)
    asked = value.join(targets.select("owner", "target"), "owner", "left")
    amount = F.col("value") * F.col("rate").cast("decimal(18,6)")
    return fx_resolve(asked, rates, now).withColumn("amount", F.round(amount, 2).cast("decimal(28,2)"))


def collection_value(copies: DataFrame, prices: DataFrame) -> DataFrame:
    """Value in the base currency, copies and priced copies per owner.  Copies meet their prices row by
    row and are summed per owner in the same task: owners and cards have about as many pairs as there
    are copies, so counts per pair would be one more table of that size.  A card that everyone owns is
    split by the adaptive skew join, where the prices are too many to broadcast."""
    usd = prices.select("card_id", F.col("usd").cast("decimal(12,2)").alias("usd"))
    return copies.select("owner", "card_id").join(usd, "card_id", "left").groupBy("owner").agg(
        F.coalesce(F.sum("usd"), F.lit(0)).cast("decimal(28,2)").alias("value"),
        F.count(F.lit(1)).alias("copies"),
        F.count("usd").alias("priced"),
    )

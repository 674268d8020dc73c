"""Text and request-log jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import lookup

# Asset names, override patterns, rule words and the shapes of keys.
ASSETS = {
    "bitcoin": "BTCUSDT", "btc": "BTCUSDT", "ethereum": "ETHUSDT", "ether": "ETHUSDT", "eth": "ETHUSDT", "solana": "SOLUSDT", "sol": "SOLUSDT", "bnb": "BNBUSDT",
    "ripple": "XRPUSDT", "xrp": "XRPUSDT", "dogecoin": "DOGEUSDT", "doge": "DOGEUSDT", "cardano": "ADAUSDT", "ada": "ADAUSDT", "avalanche": "AVAXUSDT", "avax": "AVAXUSDT",
}
OVERRIDES = [r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions", r"disregard\s+.*instructions?", r"forget\s+.*instructions?", r"system\s+prompt", r"output\s+a\s+profitable\s+strategy", "jailbreak"]
RULE_WORDS = r"(rsi|sma|ema|buy|sell|entry|exit|stop\s*loss|take\s*profit|long|short)"
KEYS = [(r"AIza[0-9A-Za-z_\-]{10,}", "[redacted]"), (r"sk-[A-Za-z0-9_\-]{8,}", "[redacted]"), (r"(?i)(api[_-]?key\s*[:=]\s*['\"]?)[A-Za-z0-9_\-.~+/=]{6,}['\"]?", "$1[redacted]")]
LOG_CHARS = 300
DAY = 86_400_000


def normalise_asset(raw: Column) -> Column:
    """The symbol of a free-text asset, NULL if unknown; case, separators and a quote suffix don't matter."""
    bare = F.regexp_replace(F.lower(F.trim(raw)), r"[\s/_-]", "")
    return lookup(F.regexp_replace(F.regexp_replace(bare, "usdt$", ""), "usd$", ""), ASSETS)


def overrides_without_rule(text: Column) -> Column:
    """Whether a text gives orders to its reader and holds no rule that can be tested."""
    hit = F.lit(False)
    for p in OVERRIDES:
        hit = hit | text.rlike("(?i)" + p)
    return F.coalesce(hit & ~(text.rlike("(?i)" + RULE_WORDS) & text.rlike(r"\d")), F.lit(False))


def redact_keys(text: Column) -> Column:
    """Key-shaped text replaced, cut to 300 characters."""
    for pattern, put in KEYS:
        text = F.regexp_replace(text, pattern, put)
    return F.substring(text, 1, LOG_CHARS)


def check_parameters(params: DataFrame) -> DataFrame:
    """Extracted parameters (…, source, value, quote, reason) with error, NULL if well formed."""
    has = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    error = (
        F.when(~F.coalesce(F.col("source").isin("stated", "assumed", "missing"), F.lit(False)), "unknown source")
        .when((F.col("source") == "stated") & (F.col("value").isNull() | ~has("quote")), "stated needs a value and a quote")
        .when((F.col("source") == "assumed") & (F.col("value").isNull() | ~has("reason")), "assumed needs a value and a reason")
        .when((F.col("source") == "missing") & F.col("value").isNotNull(), "missing has no value")
        .when((F.col("name") == "claim") & F.col("value").isNotNull() & ~F.col("value").between(0, 100), "a claim is 0 to 100")
    )
    return params.withColumn("error", error)


def check_context(fields: DataFrame) -> DataFrame:
    """Extracted context fields (…, source, value, quote, reason), such as a market or a timeframe, with error, NULL if well formed."""
    has = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    error = (
        F.when(~F.coalesce(F.col("source").isin("stated", "assumed"), F.lit(False)), "unknown source")
        .when(~F.length("value").between(1, 32), "a value has 1 to 32 characters")
        .when((F.length("quote") > 500) | (F.length("reason") > 500), "a quote or reason is too long")
        .when((F.col("source") == "stated") & (F.col("value").isNull() | ~has("quote")), "stated needs a value and a quote")
        .when((F.col("source") == "assumed") & ~has("reason"), "assumed needs a reason")
    )
    return fields.withColumn("error", error)


def reconcile_parameters(listed: DataFrame, paths: DataFrame) -> DataFrame:
    """(strategy_id, status, problems): listed parameters (strategy_id, path, value, source) against the strategy's numbers (strategy_id, path, value).

    Every listed path exists with the same value unless it is missing, every
    number is listed; then missing ones need input, else all is found.
    """
    a = listed.withColumn("listed", F.lit(True))
    b = paths.select("strategy_id", "path", F.col("value").alias("own"), F.lit(True).alias("there"))
    j = a.join(b, ["strategy_id", "path"], "full_outer")
    bad = F.col("there").isNull() | F.col("listed").isNull() | ((F.col("source") != "missing") & ~F.col("value").eqNullSafe(F.col("own")))
    g = j.groupBy("strategy_id").agg(F.count_if(bad).alias("problems"), F.coalesce(F.bool_or(F.col("source") == "missing"), F.lit(False)).alias("missing"))
    status = F.when(F.col("problems") > 0, "rejected").when(F.col("missing"), "needs_input").otherwise("found")
    return g.select("strategy_id", status.alias("status"), "problems")


def daily_quota(requests: DataFrame, limit: int = 20) -> DataFrame:
    """Requests (key, ts, id) with allowed and retry_ts, the next midnight, of those denied."""
    day = F.floor(F.col("ts") / DAY)
    n = F.row_number().over(Window.partitionBy("key", "_day").orderBy("ts", "id"))
    out = requests.withColumn("_day", day).withColumn("allowed", n <= limit)
    return out.withColumn("retry_ts", F.when(~F.col("allowed"), (F.col("_day") + 1) * DAY)).drop("_day")

"""Statistics of trades and equity curves. ``keys`` name a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import finite


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def trade_stats(trades: DataFrame, keys: list[str], runs: DataFrame | None = None) -> DataFrame:
    """Counts, rates and averages of return_pct; a return of 0 is a loss. ``runs`` adds the runs without trades."""
    r = F.col("return_pct")
    won, lost = F.when(r > 0, r), F.when(r <= 0, r)
    gross = F.abs(F.sum(lost))
    out = trades.where("return_pct is not null").groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count(won).alias("wins"), F.count(lost).alias("losses"), (100 * F.count(won) / F.count("*")).alias("win_rate_pct"),
        zero(F.avg(won)).alias("avg_win_pct"), zero(F.avg(lost)).alias("avg_loss_pct"), F.when(gross > 0, zero(F.sum(won)) / gross).alias("profit_factor"),
        F.avg(r).alias("expectancy_pct"), F.stddev_pop(r).alias("expectancy_stdev_pct"),
    )
    if runs is None:
        return out
    out = runs.select(*keys).join(out, keys, "left")
    counts = ["trades", "wins", "losses"]
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long") if c in counts else F.lit(0.0)) for c in out.columns if c not in (*keys, "profit_factor")})


def _grown(first: Column, last: Column) -> Column:
    return F.coalesce(F.when(first != 0, 100 * (last / first - 1)), F.lit(0.0))


def _total_return() -> Column:
    return _grown(F.min_by("equity", "idx"), F.max_by("equity", "idx")).alias("total_return_pct")


def _buy_and_hold() -> Column:
    """From the first bar's open to the last bar's close; rows without a bar don't count."""
    at = F.when(F.col("open").isNotNull(), F.col("idx"))
    return _grown(F.min_by("open", at), F.max_by("close", at)).alias("buy_and_hold_pct")


def _with_open(curve: DataFrame) -> DataFrame:
    """Curves of closes alone are held from the first close."""
    return curve if "open" in curve.columns else curve.withColumn("open", F.col("close"))


def return_stats(curve: DataFrame, keys: list[str]) -> DataFrame:
    """total_return_pct of equity, buy_and_hold_pct from the first open to the last close; 0 where the base is 0."""
    return _with_open(curve).groupBy(*keys).agg(_total_return(), _buy_and_hold())


def _order(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("idx")


def drawdown_series(curve: DataFrame, keys: list[str]) -> DataFrame:
    """``curve`` with peak and drawdown_pct of each bar; 0 where the peak is 0."""
    peak = F.max("equity").over(_order(keys).rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("peak", peak).withColumn("drawdown_pct", F.when(F.col("peak") > 0, 100 * (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0))


def max_drawdown(curve: DataFrame, keys: list[str]) -> DataFrame:
    return drawdown_series(curve, keys).groupBy(*keys).agg(F.max("drawdown_pct").alias("max_drawdown_pct"))


def bar_returns(curve: DataFrame, keys: list[str]) -> DataFrame:
    before = F.lag("equity").over(_order(keys))
    return curve.withColumn("before", before).withColumn("growth", F.when(finite(F.col("equity")) & finite(F.col("before")) & (F.col("before") != 0), F.col("equity") / F.col("before")))


def _ratios(bars_per_year: Column) -> list[Column]:
    """sharpe and sortino as aggregates over the rows of ``bar_returns``."""
    r, year = F.col("growth") - 1, F.max(bars_per_year.cast("double"))
    # every bar but the first has a growth, unless a value or its base is unusable
    bad = (F.count_if(F.col("growth").isNull()) > 1) | (F.count_if(~finite(F.col("equity"))) > 0)
    scaled = lambda d: F.when(~bad & (F.count(r) >= 1) & (d > 1e-15), F.avg(r) / d * F.sqrt(year)).otherwise(0.0)
    return [scaled(F.stddev_pop(r)).alias("sharpe"), scaled(F.stddev_pop(F.when(r < 0, r))).alias("sortino")]


def ratio_stats(curve: DataFrame, keys: list[str], bars_per_year: Column) -> DataFrame:
    """sharpe, and sortino over the deviation of the negative returns around their own mean; 0 where undefined."""
    return bar_returns(curve, keys).groupBy(*keys).agg(*_ratios(bars_per_year))


def curve_stats(curve: DataFrame, keys: list[str], bars_per_year: Column) -> DataFrame:
    """All figures of curves: one window pass and one aggregation."""
    rows = bar_returns(drawdown_series(_with_open(curve), keys), keys)
    return rows.groupBy(*keys).agg(_total_return(), _buy_and_hold(), F.max("drawdown_pct").alias("max_drawdown_pct"), *_ratios(bars_per_year))


def calmar(total_return_pct: Column, max_drawdown_pct: Column) -> Column:
    """Return over drawdown, not annualised."""
    return F.when(max_drawdown_pct > 0, total_return_pct / max_drawdown_pct).otherwise(0.0)


def streaks(trades: DataFrame, keys: list[str], order: str = "trade_no") -> DataFrame:
    """The longest runs of wins and of losses in trade order."""
    won = (F.col("return_pct") > 0).alias("won")
    t = trades.where("return_pct is not null").select(*keys, order, won)
    island = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - F.row_number().over(Window.partitionBy(*keys, "won").orderBy(order))
    runs = t.withColumn("island", island).groupBy(*keys, "won", "island").agg(F.count("*").alias("n"))
    longest = lambda w: F.coalesce(F.max(F.when(F.col("won") == w, F.col("n"))), F.lit(0).cast("long"))
    return runs.groupBy(*keys).agg(longest(True).alias("max_win_streak"), longest(False).alias("max_loss_streak"))


def drawdown_periods(curve: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, trough, end, depth_pct, length) of each stretch below a running peak.

    start is the first bar with the peak's value, trough the first lowest bar,
    end the first bar back at the peak or NULL, length up to it or to the last bar.
    """
    w = _order(keys)
    d = drawdown_series(curve.where(finite(F.col("equity"))), keys)
    below = F.col("equity") < F.col("peak")
    rose = F.coalesce(F.col("peak") > F.lag("peak").over(w), F.lit(True))
    d = d.withColumn("start", F.last(F.when(rose, F.col("idx")), ignorenulls=True).over(w)).withColumn("island", F.sum(F.when(below, 0).otherwise(1)).over(w))
    d = d.withColumn("final", F.max("idx").over(Window.partitionBy(*keys))).withColumn("following", F.lead("idx").over(w)).withColumn("below", below)
    found = d.where("below").groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.min_by("idx", F.struct("equity", "idx")).alias("trough"), F.max_by("following", "idx").alias("end"), F.max("drawdown_pct").alias("depth_pct"), F.max("final").alias("final")
    )
    return found.select(*keys, "start", "trough", "end", "depth_pct", (F.coalesce("end", "final") - F.col("start")).alias("length"))


def returns_by(curve: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """(keys, bucket, return_pct): compound growth by 'month' (YYYY-MM) or 'weekday' (Mon..Sun) of the later bar."""
    at = F.timestamp_millis("ts")
    name = F.date_format(at, "yyyy-MM") if bucket == "month" else F.get(F.array(*map(F.lit, ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"])), F.weekday(at))
    g = bar_returns(curve, keys).where("growth is not null")
    return g.groupBy(*keys, name.alias(bucket)).agg((100 * (F.product("growth") - 1)).alias("return_pct"))


def monthly_grid(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each year with a column m01..m12; malformed months are dropped."""
    good = monthly.where(F.col("month").rlike(r"^\d{4}-(0[1-9]|1[0-2])$")).select(*keys, F.substring("month", 1, 4).cast("int").alias("year"), F.concat(F.lit("m"), F.substring("month", 6, 2)).alias("m"), "return_pct")
    return good.groupBy(*keys, "year").pivot("m", [f"m{i:02d}" for i in range(1, 13)]).agg(F.first("return_pct"))


def downsample(curve: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """At most ``most`` points of each run: first, last, and the smallest and largest of equal inner buckets.

    For fewer than four points there is no room for a bucket: the first and the
    last remain, for fewer than two the first.
    """
    whole = Window.partitionBy(*keys)
    c = curve.withColumn("_i", F.row_number().over(_order(keys)) - 1).withColumn("_n", F.count("*").over(whole))
    last = (F.col("_i") == F.col("_n") - 1) if most >= 2 else F.lit(False)
    ends = c.where((F.col("_n") <= most) | (F.col("_i") == 0) | last).select(*keys, "idx", value)
    buckets = (most - 2) // 2
    if buckets < 1:
        return ends
    inner = c.where((F.col("_n") > most) & (F.col("_i") > 0) & (F.col("_i") < F.col("_n") - 1))
    bucket = F.floor((F.col("_i") * buckets - 1) / (F.col("_n") - 2)).cast("int")
    picked = inner.groupBy(*keys, bucket.alias("_b")).agg(F.min(F.struct(value, "idx")).alias("lo"), F.max(F.struct(F.col(value), (-F.col("idx")).alias("m"))).alias("hi"))
    points = picked.select(*keys, F.explode(F.array_distinct(F.array(F.struct(F.col("lo.idx").alias("idx"), F.col(f"lo.{value}").alias(value)), F.struct((-F.col("hi.m")).alias("idx"), F.col(f"hi.{value}").alias(value))))).alias("p"))
    return ends.unionByName(points.select(*keys, "p.idx", f"p.{value}"))


def _joined(trades: DataFrame, curve: DataFrame, keys: list[str], bars_per_year: Column) -> DataFrame:
    figures = curve_stats(curve, keys, bars_per_year)
    found = figures.join(trade_stats(trades, keys), keys, "left")
    counts = ["trades", "wins", "losses"]
    own = [c for c in found.columns if c not in (*keys, *figures.columns, "profit_factor")]
    return found.withColumns({c: F.coalesce(c, F.lit(0).cast("long") if c in counts else F.lit(0.0)) for c in own})


def all_stats(trades: DataFrame, curve: DataFrame, keys: list[str], bars_per_year: Column) -> DataFrame:
    """The thirteen figures of each run: one pass over its curve and one over its trades."""
    return _joined(trades, curve, keys, bars_per_year)


def with_errors(figures: DataFrame, trades: DataFrame, keys: list[str]) -> DataFrame:
    """``figures`` of runs with error, NULL for those that went well, and a row without figures for each run of ``trades`` that ended in one."""
    failed = trades.where("error is not null").groupBy(*keys).agg(F.max("error").alias("error"))
    return figures.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def split_windows(trades: DataFrame, curve: DataFrame, keys: list[str], split: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trades, curve, failed) with part 'IS' or 'OOS'; a trade belongs to the part of its entry bar.

    The OOS curve is 1 at the split's bar and then equity over the last IS
    value. failed has the runs that have no bar on one side or no usable base.
    """
    run = Window.partitionBy(*keys)
    cut = lambda n: F.floor(n.cast("double") * split).cast("int")
    sized = _with_open(curve).withColumn("n", F.count("*").over(run)).withColumn("cut", cut(F.col("n")))
    sized = sized.withColumn("base", F.max(F.when(F.col("idx") == F.col("cut") - 1, F.col("equity"))).over(run))
    good = F.coalesce((F.col("cut") > 0) & (F.col("cut") < F.col("n")) & finite(F.col("base")) & (F.col("base") != 0), F.lit(False))
    inside = F.col("idx") < F.col("cut")
    row = lambda part, equity, *bar: F.struct(part.alias("part"), equity.alias("equity"), *(c.alias(n) for n, c in zip(("ts", "open", "close"), bar, strict=True)))
    own = row(F.when(inside, "IS").otherwise("OOS"), F.when(inside, F.col("equity")).otherwise(F.col("equity") / F.col("base")), F.col("ts"), F.col("open"), F.col("close"))
    anchor = row(F.lit("OOS"), F.lit(1.0), F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    both = F.when(F.col("idx") == F.col("cut") - 1, F.array(own, anchor)).otherwise(F.array(own))
    rows = sized.where(good).select(*keys, "idx", F.explode(both).alias("r")).select(*keys, "idx", "r.*")
    at = curve.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("cut", cut(F.col("n")))
    failed = sized.where(~good).select(*keys, "n").distinct()
    parted = trades.where("trade_no is not null").join(at.where("cut > 0 and cut < n").select(*keys, "cut"), keys)
    return parted.withColumn("part", F.when(F.col("entry_idx") < F.col("cut"), "IS").otherwise("OOS")).drop("cut"), rows, failed


def split_stats(trades: DataFrame, curve: DataFrame, keys: list[str], split: float, bars_per_year: Column) -> DataFrame:
    """The thirteen figures of each run and part."""
    parted, rows, _ = split_windows(trades, curve, keys, split)
    return _joined(parted, rows, [*keys, "part"], bars_per_year).drop("sortino")


def folds(n: int, k: int) -> list[tuple[int, int, int]]:
    """(train end = test start, test end, fold) of k walk-forward folds over n bars."""
    if not 2 <= k <= 10 or n < 5 * (k + 1):
        raise ValueError("2 to 10 folds, with 5 bars for each of k + 1 chunks")
    at = [n * i // (k + 1) for i in range(k + 2)]
    return [(at[f + 1], at[f + 2], f) for f in range(k)]


def _spread(n: Column, mean: Column, squares: Column) -> Column:
    """The deviation of n values of which ``squares`` is the sum of squares; 0 where it is no more than rounding."""
    v = F.greatest(squares / n - mean * mean, F.lit(0.0))
    return F.when(v > 1e-14 * mean * mean, F.sqrt(v)).otherwise(0.0)


def _merge(over: object | None) -> object:
    """Aggregates of a summary's columns: their own values, or those of all chunks up to this one."""
    if over is None:
        return lambda c, how: F.col(c)
    return lambda c, how: how(c).over(over)


def _window_row(over: object | None, kind: str, year: Column) -> list[Column]:
    """The figures of a window of chunks from their summaries; ``kind`` is what growths and drawdowns start from: own, the chunk, or all, the run."""
    of = _merge(over)
    total = lambda c: zero(of(c, F.sum)) if c[:2] != "n_" and c not in ("trades", "wins", "losses") else F.coalesce(of(c, F.sum), F.lit(0).cast("long"))
    n, mean = total(f"n_{kind}"), F.when(total(f"n_{kind}") > 0, total(f"sum_{kind}") / total(f"n_{kind}"))
    spread = _spread(F.when(n > 0, n), mean, total(f"squares_{kind}"))
    # in a run's first chunk the first bar has no growth
    bad = (total(f"n_unknown_{kind}") > (1 if kind == "all" else 0)) | (total("n_unusable") > 0)
    trades, wins, losses = (total(c) for c in ("trades", "wins", "losses"))
    won, lost, all_ = total("won"), total("lost"), F.when(trades > 0, total("won") + total("lost")) / F.when(trades > 0, trades)
    return [
        _grown(of("first_equity", F.first), F.col("last_equity")).alias("total_return_pct"), _grown(of("first_open", F.first), F.col("last_close")).alias("buy_and_hold_pct"), of(f"drawdown_{kind}", F.max).alias("max_drawdown_pct"),
        F.when(~bad & (n > 0) & (spread > 1e-15), mean / spread * F.sqrt(year)).otherwise(0.0).alias("sharpe"),
        trades.alias("trades"), wins.alias("wins"), losses.alias("losses"), zero(F.when(trades > 0, 100 * wins / trades)).alias("win_rate_pct"), zero(F.when(wins > 0, won / wins)).alias("avg_win_pct"), zero(F.when(losses > 0, lost / losses)).alias("avg_loss_pct"),
        F.when(F.abs(lost) > 0, won / F.abs(F.when(lost != 0, lost))).alias("profit_factor"), zero(all_).alias("expectancy_pct"), zero(_spread(F.when(trades > 0, trades), all_, total("squares"))).alias("expectancy_stdev_pct"),
    ]


def walk_forward_stats(trades: DataFrame, curve: DataFrame, keys: list[str], k: int, bars_per_year: Column) -> DataFrame:
    """(keys, fold, part, figures) of k walk-forward folds: of all chunks up to a fold's, and of the chunk after it.

    Each bar and each trade is read once, into the summary of its chunk, and the
    windows of a run are merged from its k + 1 summaries. Runs of fewer than
    5 bars a chunk have no rows. Each window's curve starts from 1.
    """
    chunk = lambda c: F.floor(((F.col(c) + 1) * (k + 1) - 1) / F.col("n")).cast("int").alias("chunk")
    sizes = curve.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= 5 * (k + 1))
    rows = _with_open(curve).withColumn("_year", bars_per_year.cast("double")).join(sizes, keys)
    rows = bar_returns(rows.select(*keys, "idx", "open", "close", "equity", "_year", chunk("idx")), keys)
    run, own = _order(keys), _order([*keys, "chunk"])
    scaled = lambda w: F.col("equity") / F.when(F.first("equity").over(w) != 0, F.first("equity").over(w))
    rows = rows.withColumns({"_all": scaled(run), "_own": scaled(own), "_head": F.row_number().over(own) == 1})
    fall = lambda e, w: F.when(F.max(e).over(w) > 0, 100 * (F.max(e).over(w) - F.col(e)) / F.max(e).over(w)).otherwise(0.0)
    rows = rows.withColumns({"_fall_all": fall("_all", run), "_fall_own": fall("_own", own)})
    r = F.col("growth") - 1
    inner = F.when(~F.col("_head"), r)
    sums = [x for kind, c in (("all", r), ("own", inner)) for x in (F.count(c).alias(f"n_{kind}"), F.sum(c).alias(f"sum_{kind}"), F.sum(c * c).alias(f"squares_{kind}"), F.max(f"_fall_{kind}").alias(f"drawdown_{kind}"))]
    at = F.when(F.col("open").isNotNull(), F.col("idx"))
    chunks = rows.groupBy(*keys, "chunk").agg(
        F.min_by("equity", "idx").alias("first_equity"), F.max_by("equity", "idx").alias("last_equity"), F.min_by("open", at).alias("first_open"), F.max_by("close", at).alias("last_close"), *sums, F.max("_year").alias("_year"),
        F.count_if(F.col("growth").isNull()).alias("n_unknown_all"), F.count_if(F.col("growth").isNull() & ~F.col("_head")).alias("n_unknown_own"), F.count_if(~finite(F.col("equity"))).alias("n_unusable"),
    )
    p = F.col("return_pct")
    made = trades.where("trade_no is not null and return_pct is not null").join(sizes, keys).select(*keys, chunk("entry_idx"), "return_pct").groupBy(*keys, "chunk")
    made = made.agg(F.count("*").alias("trades"), F.count_if(p > 0).alias("wins"), F.count_if(p <= 0).alias("losses"), F.sum(F.when(p > 0, p).otherwise(0.0)).alias("won"), F.sum(F.when(p <= 0, p).otherwise(0.0)).alias("lost"), F.sum(p * p).alias("squares"))
    both = chunks.join(made, [*keys, "chunk"], "left")
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    year = F.col("_year")
    window = lambda name, fold, over, kind: F.struct((F.col("chunk") - fold).alias("fold"), F.lit(name).alias("part"), *_window_row(over, kind, year)).alias(name)
    wide = both.select(*keys, window("IS", 0, before, "all"), window("OOS", 1, None, "own"))
    return wide.select(*keys, F.inline(F.array("IS", "OOS"))).where(F.when(F.col("part") == "IS", F.col("fold") < k).otherwise(F.col("fold") >= 0))


def mean_stats(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Means over folds; counts are rounded half away from zero, profit factors average where there are any."""
    counts = ["trades", "wins", "losses"]
    figures = [c for c in folded.columns if c not in (*keys, "fold", "part", *counts)]
    return folded.groupBy(*keys, "part").agg(*(F.floor(F.avg(c) + 0.5).cast("long").alias(c) for c in counts), *(F.avg(c).alias(c) for c in figures))

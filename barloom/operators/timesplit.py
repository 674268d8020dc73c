"""Long series split by time: no task ever holds more of a series than one bucket of bars.

A bucket is a span of time. What a bar needs from other buckets (a number, the
bar before, the next signal, the state of a recurrence) is a few values for each
bucket, found in windows over buckets and joined back. The results equal those
of ``indicators`` and ``backtest`` on whole series, whatever the span.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barloom.functions.columns import step_ms
from barloom.operators.backtest import TRADE_NAMES
from barloom.operators.clean import SERIES
from barloom.operators.rules import AVERAGES, operands, rules_column
from barloom.sources.paths import materialise

#: Bars of a bucket, if none is missing.
BUCKET_BARS = 4_096


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def numbered(bars: DataFrame, keys: list[str] | None = None, span: Column | None = None, order: str = "ts") -> DataFrame:
    """``bars`` with bucket, idx (the number in the series from 0) and n (the series' length); ``span`` is a bucket's milliseconds."""
    keys = keys or SERIES
    span = span if span is not None else step_ms(F.col("interval")) * BUCKET_BARS
    rows = bars.withColumn("bucket", F.floor(F.col(order) / span).cast("long"))
    series = Window.partitionBy(*keys)
    sizes = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(series.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "bucket", before.alias("_before"), F.sum("_size").over(series).cast("int").alias("n"))
    own = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(order)) - 1
    return rows.join(sizes, [*keys, "bucket"]).withColumn("idx", (F.col("_before") + own).cast("int")).drop("_before")


def with_previous(rows: DataFrame, names: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """``rows`` of ``numbered`` with the values of the bar before, {column: new name}, over the edges of buckets."""
    return _with_neighbour(rows, names, keys or SERIES, 1)


def with_next(rows: DataFrame, names: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """``rows`` of ``numbered`` with the values of the bar after, {column: new name}, over the edges of buckets."""
    return _with_neighbour(rows, names, keys or SERIES, -1)


def _with_neighbour(rows: DataFrame, names: dict[str, str], keys: list[str], way: int) -> DataFrame:
    edge = F.max_by if way > 0 else F.min_by
    far = F.lag if way > 0 else F.lead
    halo = rows.groupBy(*keys, "bucket").agg(edge(F.struct(*names), "idx").alias("_edge"))
    halo = halo.withColumn("_edge", far("_edge").over(Window.partitionBy(*keys).orderBy("bucket")))
    inner = Window.partitionBy(*keys, "bucket").orderBy("idx")
    first = F.row_number().over(inner if way > 0 else Window.partitionBy(*keys, "bucket").orderBy(F.desc("idx"))) == 1
    out = rows.join(halo, [*keys, "bucket"])
    return out.withColumns({new: F.when(first, F.col(f"_edge.{c}")).otherwise(far(c).over(inner)) for c, new in names.items()}).drop("_edge")


def with_next_known(rows: DataFrame, value: Column, name: str, keys: list[str] | None = None) -> DataFrame:
    """``rows`` of ``numbered`` with ``name``: the first ``value`` that isn't NULL from this bar on."""
    keys = keys or SERIES
    rows = rows.withColumn("_v", value)
    later = rows.groupBy(*keys, "bucket").agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("idx"))).alias("_later"))
    series = Window.partitionBy(*keys).orderBy(F.desc("bucket"))
    later = later.withColumn("_later", F.last("_later", ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1)))
    back = Window.partitionBy(*keys, "bucket").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(later, [*keys, "bucket"]).withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(back), "_later")).drop("_v", "_later")


def windowed(rows: DataFrame, back: int, columns: dict[str, Callable[[WindowSpec], Column]], keys: list[str] | None = None, size: int = BUCKET_BARS) -> DataFrame:
    """``rows`` of ``numbered`` with window columns, {name: column of a window}, that look back ``back`` bars at most.

    Bars are dealt to blocks of ``size`` by idx; a block borrows the ``back`` bars
    before it, as many blocks as they may fill, so that its window is complete.
    A column tells the start of a series by idx, as a row number is the block's.
    """
    keys = keys or SERIES
    own = F.floor(F.col("idx") / size)
    blocks = rows.withColumn("_block", F.explode(F.sequence(own, F.floor((F.col("idx") + back) / size))))
    w = Window.partitionBy(*keys, "_block").orderBy("idx")
    return blocks.withColumns({name: f(w) for name, f in columns.items()}).where(F.col("_block") == own).drop("_block")


def split_rules(candles: DataFrame, strategy: dict, span: Column | None = None, size: int = BUCKET_BARS) -> DataFrame:
    """``eval_rules`` of one strategy with each series spread over its buckets; with bucket, idx and n."""
    found = sorted({(o["ind"], o["period"]) for o in operands(strategy) if o["ind"] in AVERAGES})
    slow = [x for x in found if x[0] != "sma"]
    rows = split_recurrences(candles, slow, span) if slow else numbered(candles, span=span)
    means = [n for kind, n in found if kind == "sma"]
    if means:
        mean = lambda n: lambda w: F.when(F.col("idx") >= n - 1, F.avg("close").over(w.rowsBetween(1 - n, 0))) if n >= 1 else F.lit(None).cast("double")
        rows = windowed(rows, max(0, *means, 1) - 1, {f"sma_{n}": mean(n) for n in means}, size=size)
    return windowed(rows, 1, {"entry": lambda w: rules_column(strategy["entry"], w), "exit_": lambda w: rules_column(strategy.get("exit"), w)}, size=size)


# -- recurrences ------------------------------------------------------------------
def affine_scan(rows: DataFrame, channels: dict[str, tuple[Column, int, int, float]], keys: list[str] | None = None) -> DataFrame:
    """``rows`` of ``numbered`` with a column for each channel, {name: (x, start, n, alpha)}: a seeded recurrence over the whole series.

    At bar start + n - 1 it is the mean of the n values of x from start on, from
    then on x * alpha + before * (1 - alpha). A bucket maps what it starts with to
    what it ends with by a line, a * before + b; the lines of a series, one a
    bucket, are composed in their order, and then all buckets run apart.
    """
    keys = keys or SERIES
    names, shapes = list(channels), {c: shape for c, (_, *shape) in channels.items()}
    rows = rows.withColumns({f"_x_{c}": x for c, (x, *_) in channels.items()})
    last = F.max("idx").over(Window.partitionBy(*keys, "bucket"))
    own, seeds, lines = rows.withColumn("_last", last), [], []
    for c, (start, n, alpha) in shapes.items():
        first, x = start + n - 1, F.col(f"_x_{c}")
        inside = F.col("idx").between(start, first)
        seeds += [F.sum(F.when(inside, x)).alias(f"seed_{c}"), F.count_if(inside).alias(f"count_{c}")]
        after = F.col("idx") > first
        lines += [F.count_if(after).alias(f"m_{c}"), F.coalesce(F.sum(F.when(after, alpha * x * F.pow(F.lit(1 - alpha), F.col("_last") - F.col("idx")))), F.lit(0.0)).alias(f"b_{c}")]
    buckets = own.groupBy(*keys, "bucket").agg(*seeds, *lines)

    def compose(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("bucket")
        out = series[[*keys, "bucket"]].copy()
        for c, (_, n, alpha) in shapes.items():
            seed = series[f"seed_{c}"].sum() / n if n >= 1 and series[f"count_{c}"].sum() == n else np.nan
            value, starts = seed, []
            for m, b in zip(series[f"m_{c}"], series[f"b_{c}"], strict=True):
                starts.append(value)
                value = (1 - alpha) ** m * value + b
            out[f"_start_{c}"] = starts
        return out

    started = buckets.groupBy(*keys).applyInPandas(compose, f"{_kinds(rows, [*keys, 'bucket'])}, " + ", ".join(f"_start_{c} double" for c in names))
    kept = [c for c in rows.columns if c not in {f"_x_{n}" for n in names}]

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("idx")
        idx, out = bucket["idx"].to_numpy(), bucket[kept].copy()
        for c, (start, n, alpha) in shapes.items():
            found, after = np.full(len(idx), np.nan), idx >= start + n
            if n >= 1:
                x = np.concatenate([[bucket[f"_start_{c}"].iloc[0]], bucket[f"_x_{c}"].to_numpy(float)[after]])
                line = pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy() if np.isfinite(x[0]) else np.full(len(x), np.nan)
                found[after] = line[1:]
                found[idx == start + n - 1] = line[0]
            out[c] = found
        return out

    return rows.join(started, [*keys, "bucket"]).groupBy(*keys, "bucket").applyInPandas(run, f"{_kinds(rows, kept)}, " + ", ".join(f"`{c}` double" for c in names))


def split_recurrences(candles: DataFrame, wanted: list[tuple[str, int]], span: Column | None = None) -> DataFrame:
    """``candles`` with a column kind_n for each (kind, n) of ema, rsi and atr, as ``with_recurrences`` has it, and bucket, idx and n."""
    rows = with_previous(numbered(candles, span=span), {"close": "_before"})
    close, before = F.col("close"), F.col("_before")
    move = close - before
    width = F.col("high") - F.col("low")
    channels: dict[str, tuple[Column, int, int, float]] = {}
    for kind, n in wanted:
        if kind == "ema":
            channels[f"ema_{n}"] = close, 0, n, 2 / (n + 1) if n >= 1 else 0.0
        elif kind == "atr":
            channels[f"atr_{n}"] = F.when(before.isNull(), width).otherwise(F.greatest(width, F.abs(F.col("high") - before), F.abs(F.col("low") - before))), 0, n, 1 / max(1, n)
        elif kind == "rsi":
            channels[f"_gain_{n}"] = F.greatest(move, F.lit(0.0)), 1, n, 1 / max(1, n)
            channels[f"_loss_{n}"] = F.greatest(-move, F.lit(0.0)), 1, n, 1 / max(1, n)
        else:
            raise ValueError(f"{kind} is no recurrence")
    found = affine_scan(rows, channels)
    for kind, n in wanted:
        if kind == "rsi":
            gain, loss = F.col(f"_gain_{n}"), F.col(f"_loss_{n}")
            found = found.withColumn(f"rsi_{n}", F.when(loss == 0, F.when(gain == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + gain / F.when(loss != 0, loss))))
        name = f"{kind}_{n}"
        found = found.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    return found.drop("_before", *(c for c in channels if c.startswith("_")))


# -- levels -----------------------------------------------------------------------
PRICES = ["open", "high", "low", "close"]
TOUCH = "id long, x int, xp double, why string"


def first_touch(o: np.ndarray, h: np.ndarray, lo: np.ndarray, start: int, sign: int, stop: float, target: float) -> tuple[int, float, str] | None:
    """(bar, price, which) of the first bar from ``start`` on that reaches the stop or the target of a trade; an open beyond a level is the price."""
    a, size = start, 64
    while a < len(o):
        b = min(len(o), a + size)
        opens, near, far = o[a:b], (lo if sign > 0 else h)[a:b], (h if sign > 0 else lo)[a:b]
        out, won = sign * near <= sign * stop, sign * far >= sign * target
        gap_out, gap_won = sign * opens <= sign * stop, sign * opens >= sign * target
        hit = out | won | gap_out | gap_won
        if hit.any():
            k = int(hit.argmax())
            if gap_out[k]:
                return a + k, float(opens[k]), "StopLoss"
            if gap_won[k]:
                return a + k, float(opens[k]), "TakeProfit"
            return (a + k, stop, "StopLoss") if out[k] else (a + k, target, "TakeProfit")
        a, size = b, size * 2
    return None


def first_touches(entries: DataFrame, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``entries`` (keys, bucket, idx, id, until, sign, stop, target) with x, xp, why: the first bar from idx on that reaches a level, at which price, and which.

    It is looked for in the own bucket first. Of the others only the first whose
    lowest low or highest high reaches a level is read, which one row of extremes
    for each bucket tells; the entries of one bucket meet it together, so that
    what meets is at most one bucket of entries and one of bars. Bars after
    ``until`` (NULL: none) need not be looked at: x is NULL or a later bar then.
    ``id`` tells entries apart; a NULL level is none.
    """
    keys = keys or SERIES
    packed = rows.groupBy(*keys, "bucket").agg(F.array_sort(F.collect_list(F.struct("idx", *PRICES))).alias("_bars"))
    level = F.struct("id", "idx", "sign", "stop", "target")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                for i, at, sign, stop, target in zip(row.id, np.searchsorted(row.idx, row.entry), row.sign, row.stop, row.target, strict=True):
                    found = first_touch(row.open, row.high, row.low, int(at), int(sign), *(float(v) if v is not None and v == v else d * int(sign) * np.inf for v, d in ((stop, -1), (target, 1))))
                    if found is not None:
                        out.append((i, int(row.idx[found[0]]), found[1], found[2]))
            yield pd.DataFrame(out, columns=["id", "x", "xp", "why"])

    def met(groups: DataFrame) -> DataFrame:
        each = [("id", "id"), ("idx", "entry"), ("sign", "sign"), ("stop", "stop"), ("target", "target")]
        return groups.select(*(F.col(f"_entries.{c}").alias(new) for c, new in each), *(F.col(f"_bars.{c}").alias(c) for c in ("idx", "open", "high", "low"))).mapInPandas(search, TOUCH)

    aimed = entries.where("stop is not null or target is not null")
    near = materialise(met(aimed.groupBy(*keys, "bucket").agg(F.collect_list(level).alias("_entries")).join(packed, [*keys, "bucket"])), "near")
    resting = aimed.join(near.select("id"), "id", "left_anti")
    extremes = rows.groupBy(*keys, "bucket").agg(F.min(F.least("open", "low")).alias("lo"), F.max(F.greatest("open", "high")).alias("hi"), F.min("idx").alias("start"))
    index = extremes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "lo", "hi", "start"))).alias("_index"))
    lower, upper = F.when(F.col("sign") > 0, F.col("stop")).otherwise(F.col("target")), F.when(F.col("sign") > 0, F.col("target")).otherwise(F.col("stop"))

    def reached(b: Column) -> Column:
        hit = F.coalesce(b["lo"] <= lower, F.lit(False)) | F.coalesce(b["hi"] >= upper, F.lit(False))
        return (b["bucket"] > F.col("bucket")) & (F.col("until").isNull() | (b["start"] <= F.col("until"))) & hit

    far = resting.join(index, keys).withColumn("_to", F.get(F.filter("_index", reached), F.lit(0))["bucket"]).where("_to is not null")
    groups = far.groupBy(*keys, "bucket", "_to").agg(F.collect_list(level).alias("_entries")).drop("bucket").withColumnRenamed("_to", "bucket")
    both = near.unionByName(met(groups.join(packed, [*keys, "bucket"])))
    return entries.join(both, "id", "left")


def resting_fills(orders: DataFrame, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``orders`` (keys, from_idx, side, kind, price) with fill_idx and fill_price: the bar that fills each, from from_idx on, and at what.

    ``rows`` are those of ``numbered``; side is buy or sell, kind market, limit
    or stop. A market order takes the open. A limit to buy and a stop to sell
    wait for the low to come down to the price, the others for the high to come
    up to it; an open beyond the price is what it is filled at. Both are NULL for
    orders that are never filled, and for those from after the last bar on.
    """
    keys = keys or SERIES
    known = materialise(orders.withColumn("id", F.monotonically_increasing_id()), "orders")
    down = (F.col("side") == "buy") == (F.col("kind") == "limit")
    opens = F.col("kind") == "market"
    level = lambda c: F.when(~opens & c, F.col("price"))
    there = rows.select(*keys, F.col("idx").alias("from_idx"), "bucket", F.col("open").alias("_open"))
    entries = known.join(there, [*keys, "from_idx"]).select(*keys, "bucket", F.col("from_idx").alias("idx"), "id", F.lit(None).cast("int").alias("until"), F.lit(1).alias("sign"), level(down).alias("stop"), level(~down).alias("target"), F.when(opens, F.col("_open")).alias("_open"))
    found = first_touches(materialise(entries, "entries"), rows, keys)
    found = found.select("id", F.when(F.col("_open").isNotNull(), F.col("idx")).otherwise(F.col("x")).alias("fill_idx"), F.coalesce("_open", "xp").alias("fill_price"))
    return known.join(found, "id", "left").drop("id")


# -- trades -----------------------------------------------------------------------
def _chain(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The ``entries`` (keys, bucket, idx, then) that are on the path from each series' first one, where then is the idx of the next entry.

    A bucket tells of each of its entries where its path leaves the bucket; from
    bucket to bucket the path is found by doubling, and within them by following.
    """
    kinds = _kinds(entries, keys)

    def leave(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("idx", ascending=False)
        out: dict[int, float] = {}
        for i, then in zip(bucket["idx"], bucket["then"], strict=True):
            out[i] = out.get(then, then) if then == then else then
        return bucket[keys].assign(idx=list(out), to=list(out.values()))

    jumps = entries.select(*keys, "bucket", "idx", F.col("then").cast("double").alias("then")).groupBy(*keys, "bucket").applyInPandas(leave, f"{kinds}, idx int, to double")
    jumps = materialise(jumps.withColumn("to", F.when(~F.isnan("to"), F.col("to")).cast("int")), "jumps")
    start = entries.groupBy(*keys).agg(F.min("idx").alias("idx"))
    entered = jumps.where("to is not null").select(*keys, F.col("to").alias("idx")).unionByName(start).distinct()
    jumps = materialise(jumps.join(entered, [*keys, "idx"], "left_semi"), "jumps")
    reached = materialise(start, "reached")
    while not jumps.where("to is not null").isEmpty():
        more = reached.join(jumps.where("to is not null"), [*keys, "idx"]).select(*keys, F.col("to").alias("idx"))
        if more.isEmpty():
            break
        reached = materialise(reached.unionByName(more).distinct(), "reached")
        twice = jumps.select(*keys, F.col("idx").alias("to"), F.col("to").alias("_on"))
        jumps = materialise(jumps.join(twice, [*keys, "to"], "left").select(*keys, "idx", F.col("_on").alias("to")), "jumps")

    def follow(bucket: pd.DataFrame) -> pd.DataFrame:
        then = dict(zip(bucket["idx"], bucket["then"], strict=True))
        at, path = bucket.loc[bucket["_in"], "idx"], []
        at = int(at.iloc[0]) if len(at) else None
        while at in then:
            path.append(at)
            at = int(then[at]) if then[at] == then[at] else None
        return pd.DataFrame({**{k: bucket[k].iloc[0] for k in keys}, "idx": np.array(path, np.int32)}, index=range(len(path)), columns=[*keys, "idx"])

    marked = entries.select(*keys, "bucket", "idx", F.col("then").cast("double").alias("then")).join(reached.withColumn("_in", F.lit(True)), [*keys, "idx"], "left").fillna(False, ["_in"])
    chosen = marked.groupBy(*keys, "bucket").applyInPandas(follow, f"{kinds}, idx int")
    return entries.join(chosen, [*keys, "idx"], "left_semi")


def split_trades(flagged: DataFrame, keys: list[str] | None = None, side: str = "long", stop_pct: float | None = None, target_pct: float | None = None, cost: float = 0.0007, factor: float = 1.0, rearm: bool = True, span: Column | None = None) -> DataFrame:
    """The trades of ``backtest_trades`` for stops, targets and signals, with each series spread over its buckets.

    ``flagged`` has ts, prices, entry, exit_ and, if used, side. How a trade that
    any signal would open ends hangs on prices and exit signals alone, so all of
    them are ended first. Each then names the signal that could be taken after
    it, and the trades are the path from the first signal on. Trailing stops,
    sessions and fills per day hang on what came before: ``backtest_trades`` has
    them. A run whose equity is used up before a next entry, or that would enter
    at a price of 0 or less, is one row with error.
    """
    keys = keys or SERIES
    has_side = "side" in flagged.columns
    rows = flagged.select(*keys, "ts", *PRICES, "entry", "exit_", *(["side"] if has_side else []))
    rows = materialise(numbered(rows, keys, span), "bars")
    inside = F.col("idx") < F.col("n") - 1
    want = inside & F.coalesce("entry", F.lit(False))
    rows = rows.withColumn("_want", want)
    rows = with_next(with_previous(rows, {"_want": "_opens"} | ({"side": "_side"} if has_side else {}), keys), {"open": "_next_open", "ts": "_next_ts"}, keys)
    rows = with_next_known(rows, F.when(inside & F.coalesce("exit_", F.lit(False)), F.struct((F.col("idx") + 1).alias("x"), F.col("_next_open").alias("xp"), F.col("_next_ts").alias("xts"))), "_rule", keys)
    rows = with_next_known(rows, F.when(F.col("_want"), F.col("idx")), "_signal", keys)
    if rearm:
        rows = with_next_known(rows, F.when(inside & ~F.col("_want"), F.col("_signal")), "_signal", keys)
    rows = materialise(rows, "marked")
    ends = rows.where("idx = n - 1").select(*keys, F.col("ts").alias("_end_ts"), F.col("close").alias("_end_close"))
    sign = F.when((F.col("_side") if has_side else F.lit(side)) == "long", 1).otherwise(-1)
    entries = rows.where("_opens").select(*keys, "bucket", "idx", "n", "ts", F.col("open").alias("price"), sign.alias("sign"), "_rule", F.col("_rule.x").alias("until"), F.monotonically_increasing_id().alias("id"))
    away = lambda pct, way: F.lit(None).cast("double") if pct is None else F.col("price") * (1 + way * F.col("sign") * pct / 100)
    entries = materialise(entries.withColumns({"stop": away(stop_pct, -1), "target": away(target_pct, 1)}), "entries")
    entries = materialise(first_touches(entries, rows, keys), "touched").join(ends, keys)
    by_rule = F.col("until").isNotNull() & (F.col("until") <= F.coalesce("x", F.col("until")))
    forced = F.col("x").isNotNull()
    at = lambda rule, force, end: F.when(by_rule, rule).when(forced, force).otherwise(end)
    ended = entries.withColumns({"exit_idx": at(F.col("until"), F.col("x"), F.col("n") - 1), "exit_price": at(F.col("_rule.xp"), F.col("xp"), F.col("_end_close")), "reason": at(F.lit("Signal"), F.col("why"), F.lit("EndOfData"))})
    # what a trade that ends on a bar may be followed by, and that bar's time
    after = rows.select(*keys, F.col("idx").alias("exit_idx"), F.col("ts").alias("exit_ts"), (F.col("_signal") + 1).alias("then"))
    chosen = _chain(materialise(ended.drop("_rule").join(after, [*keys, "exit_idx"]), "ended"), keys)
    ratio = F.when(F.col("price") > 0, F.col("exit_price") / F.when(F.col("price") > 0, F.col("price")))
    gain = factor * (F.col("sign") * (ratio - 1) - cost * (1 + ratio))
    chosen = materialise(chosen.withColumn("gain", gain), "chosen")
    places = chosen.groupBy(*keys, "bucket").agg(F.count("*").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("idx")) - 1
    faults = chosen.groupBy(*keys).agg(F.min(F.when(F.col("gain") <= -1, F.col("idx"))).alias("_spent"), F.min(F.when(F.col("price") <= 0, F.col("idx"))).alias("_bad"), F.max("idx").alias("_last"))
    spent = F.col("_spent").isNotNull() & (F.col("_spent") < F.col("_last"))
    error = F.when(spent & (F.col("_bad").isNull() | (F.col("_spent") < F.col("_bad"))), "equity used up").when(F.col("_bad").isNotNull(), "bad entry price")
    faults = faults.select(*keys, error.alias("error")).where("error is not null")
    good = chosen.join(places, [*keys, "bucket"]).withColumn("trade_no", (F.col("_before") + own).cast("int")).join(faults, keys, "left_anti")
    name = F.when(F.col("sign") > 0, "long").otherwise("short")
    good = good.select(*keys, "trade_no", F.col("idx").alias("entry_idx"), "exit_idx", F.col("ts").alias("entry_ts"), "exit_ts", name.alias("side"), F.col("price").alias("entry_price"), "exit_price", (100 * F.col("gain")).alias("return_pct"), "reason", F.lit(None).cast("string").alias("error"))
    bad = faults.select(*keys, *(F.lit(None).cast(good.schema[c].dataType).alias(c) for c in TRADE_NAMES if c != "error"), "error")
    return good.unionByName(bad)

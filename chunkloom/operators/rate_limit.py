"""Fixed windows that start at a key's first request, exact and split over time.

The start of each window depends on the one before, which would tie a key to one task. The times of a key with many requests are
therefore cut into blocks of about as many times each, narrower than a window if need be. A block is a jump function: from the
first window that starts in it to the last one, and from there to the block and the first start that follow. Composing all jump functions
with themselves again and again gives jumps over two, four, eight blocks; from a key's first request, the longest jumps first,
they lead to all blocks in which a window starts. The windows of all blocks are then laid out at once. Every step reads a few blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from chunkloom import constants as K
from chunkloom.operators.ranking import running_totals
from chunkloom.session import written

MICROS = 1_000_000
HOT_ROWS = 4096
#: Times in a block of a hot key, at least.
LEAST_BLOCK = 64
SALTS = 32
NEVER = np.iinfo("int64").min // 2


def _block_exits(t: np.ndarray, block_start: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Possible first starts in a block and the last start each leads to."""
    n = len(t)
    following = np.searchsorted(t, t + window)
    last = np.where(following == n, np.arange(n), np.minimum(following, n - 1))
    while True:
        jumped = last[last]
        if np.array_equal(jumped, last):
            break
        last = jumped
    # An open window ends before block_start + window, so later requests cannot be first.
    firsts = min(n, int(np.searchsorted(t, block_start + window)) + 1)
    entry, exits = t[:firsts], t[last[:firsts]]
    run_end = np.append(exits[1:] != exits[:-1], True)
    return entry[run_end], exits[run_end]


def _starts_in_block(t: np.ndarray, open_until: int, window: int) -> list[int]:
    starts = [open_until - window] if len(t) and t[0] < open_until else []
    i = int(np.searchsorted(t, open_until))
    while i < len(t):
        starts.append(int(t[i]))
        i = int(np.searchsorted(t, t[i] + window))
    return starts


def _jumps(blocks: DataFrame, kind: str, window: int) -> DataFrame:
    """(_key, _block, entry, to_block, to): for each possible first start of a block, the next block in which a window starts, and its
    first start there (one that stands for all that lead to the same last start); -1 behind the last request.

    A window that starts in block b ends in block b + q or b + q + 1; if nothing follows there, the first request of the
    next block that has any starts the next one.
    """
    q = F.floor(F.lit(window) / F.col("_span")).cast("long")
    own = blocks.select("_key", "_block", "_span", "entry", "last", q.alias("_q"))
    ends = [own.select(F.col("_key").alias(f"_k{i}"), F.col("_block").alias(f"_b{i}"), F.col("entry").alias(f"entry{i}")) for i in (0, 1)]
    # One row for each block of about ``hot_rows`` times and one for each place that it asks about.
    real = own.select("_key", F.col("_block").alias("_at"), F.lit(1).alias("_real"), F.struct("_block", F.col("entry")[0].alias("first")).alias("_found"), F.lit(None).cast("long").alias("_block"))
    asked = own.select("_key", (F.col("_block") + F.col("_q") + 1).alias("_at"), F.lit(0).alias("_real"), F.lit(None).cast(real.schema["_found"].dataType).alias("_found"), "_block")
    behind = Window.partitionBy("_key").orderBy(F.desc("_at"), "_real").rowsBetween(Window.unboundedPreceding, -1)
    after = real.union(asked).withColumn("_after", F.last("_found", ignorenulls=True).over(behind)).where("_real = 0").select("_key", "_block", "_after")
    met = own.join(after, ["_key", "_block"])
    for i in (0, 1):
        met = met.join(ends[i], (met["_key"] == ends[i][f"_k{i}"]) & (met["_block"] + met["_q"] + i == ends[i][f"_b{i}"]), "left")
    met = met.select("_key", "_block", "_q", "entry", "last", "entry0", "entry1", F.col("_after._block").alias("_after_block"), F.col("_after.first").alias("_after_first"))

    def find(frames):
        for pdf in frames:
            to_block, to = [], []
            for row in pdf.itertuples(index=False, name=None):
                _, block, q, _, last, *near, after_block, after_first = row
                e = np.asarray(last) + window
                target, first = np.full(len(e), -1 if pd.isna(after_block) else int(after_block)), np.full(len(e), -1 if pd.isna(after_first) else int(after_first))
                for i in (1, 0):  # the nearer block last: it goes first
                    if near[i] is not None:
                        there = np.asarray(near[i])
                        at = np.searchsorted(there, e)
                        has = at < len(there)
                        target[has], first[has] = int(block) + int(q) + i, there[at[has]]
                to_block.append(target)
                to.append(first)
            yield pd.DataFrame({"_key": pdf["_key"], "_block": pdf["_block"], "entry": pdf["entry"], "to_block": to_block, "to": to})

    return met.mapInPandas(find, f"_key {kind}, _block long, entry array<long>, to_block array<long>, to array<long>")


def _twice(jumps: DataFrame, kind: str) -> DataFrame:
    """The jump functions composed with themselves. Later entries never land earlier, so what lands in one block is one stretch."""

    def cut(frames):
        for pdf in frames:
            out = []
            for key, block, _, to_block, to in pdf.itertuples(index=False, name=None):
                to_block, to = np.asarray(to_block), np.asarray(to)
                borders = [0, *(np.flatnonzero(np.diff(to_block)) + 1).tolist(), len(to_block)]
                out += [(key, int(to_block[a]), block, a, to[a:b]) for a, b in zip(borders, borders[1:]) if to_block[a] >= 0]
            yield pd.DataFrame(out, columns=["_key", "_block", "_source", "_from", "_to"])

    def look_up(frames):
        for pdf in frames:
            to_block, to = [], []
            for starts, entry, b, t in zip(pdf["_to"], pdf["entry"], pdf["to_block"], pdf["to"]):
                at = np.searchsorted(np.asarray(entry), np.asarray(starts))
                to_block.append(np.asarray(b)[at])
                to.append(np.asarray(t)[at])
            yield pd.DataFrame({"_key": pdf["_key"], "_block": pdf["_source"], "_from": pdf["_from"], "to_block": to_block, "to": to})

    pieces = jumps.mapInPandas(cut, f"_key {kind}, _block long, _source long, _from long, _to array<long>")
    further = pieces.join(jumps, ["_key", "_block"]).select("_key", "_source", "_from", "_to", "entry", "to_block", "to")
    further = further.mapInPandas(look_up, f"_key {kind}, _block long, _from long, to_block array<long>, to array<long>")
    whole = further.groupBy("_key", "_block").agg(F.sort_array(F.collect_list(F.struct("_from", "to_block", "to"))).alias("_p"))
    whole = jumps.select("_key", "_block", "entry").join(whole, ["_key", "_block"], "left")

    def column(name: str):
        known = F.coalesce(F.flatten(F.transform("_p", lambda x: x[name])), F.array().cast("array<long>"))
        return F.concat(known, F.array_repeat(F.lit(-1).cast("long"), F.size("entry") - F.size(known))).alias(name)

    return whole.select("_key", "_block", "entry", column("to_block"), column("to"))


def _visited(blocks: DataFrame, kind: str, window: int) -> DataFrame:
    """(_key, _block, exit): the blocks in which a window starts, and the last start in each."""
    jumps = written(_jumps(blocks, kind, window), "jumps")
    per_key = blocks.groupBy("_key").agg(F.min("_block").alias("_block"), F.count(F.lit(1)).alias("_n"))
    most = per_key.agg(F.max("_n")).head()[0] or 0
    tables = [jumps]
    while 1 << len(tables) < most:
        jumps = written(_twice(jumps, kind), "jumps")
        tables.append(jumps)
        if jumps.where(F.exists("to_block", lambda b: b >= 0)).isEmpty():
            break
    at = blocks.join(per_key.select("_key", "_block"), ["_key", "_block"]).select("_key", "_block", F.col("entry")[0].alias("start"))
    for table in reversed(tables):
        place = F.array_position("entry", F.col("start")).cast("int")
        landed = at.join(table, ["_key", "_block"]).select("_key", F.element_at("to_block", place).alias("_block"), F.element_at("to", place).alias("start"))
        at = written(at.union(landed.where("_block >= 0")), "visited")
    place = F.array_position("entry", F.col("start")).cast("int")
    return blocks.join(at, ["_key", "_block"]).select("_key", "_block", F.element_at("last", place).alias("exit"))


def _hot_starts(times: DataFrame, kind: str, window: int) -> DataFrame:
    """Window starts per (key, block) of keys with many requests; ``times`` has the width of the key's blocks as ``_span``."""

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["_t"].to_numpy())
        block, span = int(pdf["_block"].iat[0]), int(pdf["_span"].iat[0])
        entry, last = _block_exits(t, block * span, window)
        return pd.DataFrame({"_key": pdf["_key"].iat[0], "_block": [block], "_span": [span], "entry": [entry], "last": [last]})

    def lay_out(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["_t"].to_numpy())
        until = pdf["open_until"].iat[0]
        starts = _starts_in_block(t, NEVER if pd.isna(until) else int(until), window)
        return pd.DataFrame({"_key": [pdf["_key"].iat[0]], "_block": [pdf["_block"].iat[0]], "starts": [starts]})

    blocks = written(times.groupBy("_key", "_block").applyInPandas(exits, f"_key {kind}, _block long, _span long, entry array<long>, last array<long>"), "time-blocks")
    exit_of = blocks.select("_key", "_block").join(_visited(blocks, kind, window), ["_key", "_block"], "left")
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opened = exit_of.select("_key", "_block", (F.last("exit", ignorenulls=True).over(earlier) + window).alias("open_until"))
    return (
        times.join(opened, ["_key", "_block"])
        .groupBy("_key", "_block")
        .applyInPandas(lay_out, f"_key {kind}, _block long, starts array<long>")
    )


def _small_starts(times: DataFrame, span: int, window: int) -> DataFrame:
    """Window starts per (key, block) of keys whose requests fit in one array: a fold in the JVM."""
    nothing = F.array().cast("array<long>")

    def step(starts, t):
        fresh = (F.size(starts) == 0) | (t - F.try_element_at(starts, F.lit(-1)) >= window)
        return F.when(fresh, F.concat(starts, F.array(t))).otherwise(starts)

    per_key = times.groupBy("_key").agg(
        F.aggregate(F.array_sort(F.collect_list("_t")), nothing, step).alias("_all"),
        F.collect_set("_block").alias("_blocks"),
    )
    blocks = per_key.select("_key", "_all", F.explode("_blocks").alias("_block"))
    reach = lambda s: (s > F.col("_block") * span - window) & (s < (F.col("_block") + 1) * span)
    return blocks.select("_key", "_block", F.filter("_all", reach).alias("starts"))


def _with_salts(spans: DataFrame) -> DataFrame:
    return written(spans.select("_key", "_span", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")), "hot-keys")


def _narrowed(times: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """Block widths of the hot keys, so narrow that no block holds over twice ``size`` times, also where a key's requests come in bursts."""
    hot = _with_salts(spans)
    while True:
        salted = times.withColumn("_salt", F.pmod("_t", F.lit(SALTS)).cast("int")).join(hot, ["_key", "_salt"])
        full = salted.groupBy("_key", "_span", F.floor(F.col("_t") / F.col("_span"))).agg(F.count(F.lit(1)).alias("_n"))
        full = written(full.groupBy("_key", "_span").agg(F.max("_n").alias("_n")), "fullest-blocks")
        if full.where(F.col("_n") > 2 * size).isEmpty():
            return hot
        # A block of n microseconds holds n times at most, so this ends.
        less = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_span") * F.lit(size) / F.col("_n")).cast("long"))
        hot = _with_salts(full.select("_key", F.when(F.col("_n") > 2 * size, less).otherwise(F.col("_span")).alias("_span")))


def window_starts(
    requests: DataFrame, key: str, ts: str, window_seconds: int, blocks: int = 64, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``window_start`` (microseconds) to each request of a key.

    Keys with up to ``hot_rows`` distinct times are folded in one array each; the others
    take the blocked way. Both give the same answer. Blocks are ``blocks`` windows wide; those of a key with many times are as narrow, also
    less than a window, as it takes for about ``hot_rows`` times in each.
    """
    window = window_seconds * MICROS
    timed = requests.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_key", F.col(key))
    # The distinct times are read several times: stored once, also against lost executors.
    times = written(timed.select("_key", "_t").distinct(), "request-times")
    per_key = times.groupBy("_key").agg(F.count("*").alias("_n"), (F.max("_t") - F.min("_t")).alias("_range")).where(F.col("_n") > hot_rows)
    narrow = F.floor(F.col("_range") * max(hot_rows, LEAST_BLOCK) / F.col("_n")).cast("long")
    spans = per_key.select("_key", F.greatest(F.lit(1).cast("long"), F.least(F.lit(window * blocks), narrow)).alias("_span"))
    hot = _narrowed(times, spans, max(hot_rows, LEAST_BLOCK))
    salted = lambda df: df.withColumn("_salt", F.pmod("_t", F.lit(SALTS)).cast("int"))
    parts = []
    for hot_part in (False, True) if not hot.isEmpty() else (False,):
        split = [
            (salted(df).join(hot, ["_key", "_salt"]) if hot_part else salted(df).join(hot, ["_key", "_salt"], "left_anti").withColumn("_span", F.lit(window * blocks)))
            .drop("_salt").withColumn("_block", F.floor(F.col("_t") / F.col("_span")).cast("long"))
            for df in (timed, times)
        ]
        starts = _hot_starts(split[1], dict(requests.dtypes)[key], window) if hot_part else _small_starts(split[1].drop("_span"), window * blocks, window)
        parts.append(split[0].join(starts, ["_key", "_block"]))
    mine = F.array_max(F.filter("starts", lambda s: s <= F.col("_t")))
    both = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    return both.withColumn("window_start", mine).drop("_key", "_block", "_span", "starts")


def fixed_window_limit(
    requests: DataFrame, key: str, ts: str, request_id: str, window_seconds: int, limit: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the request's number in its window, whether it is allowed, what is left and the reset second."""
    timed = window_starts(requests, key, ts, window_seconds, hot_rows=hot_rows)
    part = F.floor((F.col("_t") - F.col("window_start")) * 16 / F.lit(window_seconds * MICROS))
    order = [F.col("_t"), F.col(request_id)]
    counted = running_totals(timed, [key, "window_start"], part, order, {"count": F.lit(1).cast("long")})
    left = F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col("count"))
    reset = F.floor(F.col("_t") / F.lit(MICROS)) + window_seconds
    return counted.withColumns(
        {"allowed": F.col("count") <= limit, "remaining": left, "reset_epoch": reset}
    ).drop("_t")


def chained_limits(
    requests: DataFrame,
    window_seconds: int = K.RATE_WINDOW_SECONDS,
    ip_limit: int = K.RATE_IP_LIMIT,
    user_limit: int = K.RATE_USER_LIMIT,
) -> DataFrame:
    """Address scope first; only requests it lets through count for the user scope.

    ``requests``: (request_id, ip, user, ts). A request without a user passes the second scope.
    """
    names = ["count", "allowed", "remaining", "reset_epoch"]
    first = fixed_window_limit(requests, "ip", "ts", "request_id", window_seconds, ip_limit)
    by_ip = first.select("request_id", "ip", "user", "ts", *[F.col(n).alias(f"ip_{n}") for n in names])
    # Read three times below: stored once instead of computed again.
    by_ip = written(by_ip, "address-limits")
    passed = by_ip.where(F.col("ip_allowed") & F.col("user").isNotNull())
    second = fixed_window_limit(passed.select("request_id", "user", "ts"), "user", "ts", "request_id", window_seconds, user_limit)
    by_user = second.select("request_id", *[F.col(n).alias(f"user_{n}") for n in names])
    allowed = F.col("ip_allowed") & F.coalesce("user_allowed", F.lit(True))
    return by_ip.join(by_user, "request_id", "left").withColumn("allowed", allowed)

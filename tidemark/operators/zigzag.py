"""The zigzag of ``waves`` in blocks: a symbol's bars may take many tasks.

A block is read once for every state in which the zigzag may enter it.  Going up
from a high H, all that matters is when the first turn down comes, and that is at
a new low of the block that is under H by the share, or where the block itself
falls by it; from that bar on H is forgotten.  So a block is a short list of
(low, state at the block's end), the same for highs, and its own high and low.
These lists, not the bars, are followed from block to block; then every block
knows its entry and finds its turns alone."""

from __future__ import annotations

from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.operators import waves


@dataclass(frozen=True)
class State:
    """way: 1 up, -1 down, 0 before the first turn.  The high and low so far, with
    their positions; going up only the high counts, going down only the low."""

    way: int
    high: float
    high_at: int
    low: float
    low_at: int


#: The extreme that does not count.
NONE = float("nan")


def step(s: State, i: int, c: float, share: float) -> tuple[State, int | None]:
    """The state after a bar, and the position of the turn that it reveals."""
    high, high_at, low, low_at = s.high, s.high_at, s.low, s.low_at
    if s.way >= 0 and c > high:
        high, high_at = c, i
    if s.way <= 0 and c < low:
        low, low_at = c, i
    if s.way >= 0 and c <= high * (1 - share):
        return State(-1, NONE, -1, c, i), high_at
    if s.way <= 0 and c >= low * (1 + share):
        return State(1, c, i, NONE, -1), low_at
    return State(s.way, high, high_at, low, low_at), None


def turns(s: State, first: int, close: list[float], share: float) -> list[int]:
    """Positions of the turns that a block reveals; the first bar is none."""
    out = []
    for i, c in enumerate(close, first):
        s, at = step(s, i, c, share)
        if at:
            out.append(at)
    return out


class Block:
    """A block's ends for the states in which it may be entered."""

    def __init__(self, first: int, close: list[float], share: float):
        self.first, self.close, self.share = first, close, share
        self.known: dict[tuple[int, int], State] = {}
        self.high, self.high_at = max((c, -i) for i, c in enumerate(close))
        self.low, self.low_at = min((c, i) for i, c in enumerate(close))
        self.high_at = -self.high_at

    def end_after(self, way: int, at: int) -> State:
        """The state at the end after a turn into ``way`` that bar ``at`` revealed."""
        path = []
        while (way, at) not in self.known:
            path.append((way, at))
            c = self.close[at]
            s = State(way, c, at, NONE, -1) if way > 0 else State(way, NONE, -1, c, at)
            for i in range(at + 1, len(self.close)):
                s, turn = step(s, i, self.close[i], self.share)
                if turn is not None:
                    way, at = s.way, i
                    break
            else:
                s = State(s.way, s.high, s.high_at + self.first if s.high_at >= 0 else -1, s.low, s.low_at + self.first if s.low_at >= 0 else -1)
                self.known[way, at] = s
        for key in path:
            self.known[key] = self.known[way, at]
        return self.known[way, at]

    def ends(self, way: int) -> tuple[list[tuple[float, int, State]], bool]:
        """For a block entered going ``way``: the bars at which the first turn may
        come (the extreme, its position, the state at the end), and whether the
        last one comes whatever the entry."""
        limit, records, forced = self.close[0], [], False
        for i, c in enumerate(self.close):
            limit = max(limit, c) if way > 0 else min(limit, c)
            forced = c <= limit * (1 - self.share) if way > 0 else c >= limit * (1 + self.share)
            beyond = not records or (c < self.close[records[-1]] if way > 0 else c > self.close[records[-1]])
            if beyond or forced:
                records.append(i)
            if forced:
                break
        states: list[State] = []
        for k in range(len(records) - 1, -1, -1):
            at = records[k]
            last = k + 1 == len(records) or forced and k + 2 == len(records)
            if last or self.turns_before(-way, at, records[k + 1]):
                states.append(self.end_after(-way, at))
            else:
                states.append(states[-1])  # the next record takes the extreme over
        states.reverse()
        return [(self.close[i], i + self.first, s) for i, s in zip(records, states, strict=True)], forced

    def turns_before(self, way: int, at: int, end: int) -> bool:
        c = self.close[at]
        s = State(way, c, at, NONE, -1) if way > 0 else State(way, NONE, -1, c, at)
        for i in range(at + 1, end):
            s, turn = step(s, i, self.close[i], self.share)
            if turn is not None:
                return True
        return False


COLUMNS = "high double, high_at long, low double, low_at long, downs array<double>, sure_down boolean, ups array<double>, sure_up boolean"


def summary(first: int, close: list[float], share: float) -> tuple:
    """The fields of COLUMNS; records flat, seven numbers each."""
    block = Block(first, close, share)
    (downs, sure_down), (ups, sure_up) = block.ends(1), block.ends(-1)
    flat = lambda records: [float(x) for c, at, s in records for x in (c, at, *astuple(s))]
    return (block.high, block.high_at + first, block.low, block.low_at + first, flat(downs), sure_down, flat(ups), sure_up)


def leave(s: State, block, share: float) -> State:
    """The state after a block, from its summary alone."""
    found = []
    for way, wanted, flat, sure in ((1, s.way >= 0, block.downs, block.sure_down), (-1, s.way <= 0, block.ups, block.sure_up)):
        if not wanted:
            continue
        records = [flat[k : k + 7] for k in range(0, len(flat), 7)]
        limit = s.high * (1 - share) if way > 0 else s.low * (1 + share)
        for k, r in enumerate(records):
            if (r[0] <= limit if way > 0 else r[0] >= limit) or (sure and k + 1 == len(records)):
                found.append((r[1], -way, r))
                break
    if found:
        _, _, r = min(found, key=lambda x: x[:2])  # of both at one bar, the turn down
        return State(int(r[2]), r[3], int(r[4]), r[5], int(r[6]))
    high, low = (s.high, s.high_at), (s.low, s.low_at)
    if s.way >= 0 and block.high > s.high:
        high = block.high, block.high_at
    if s.way <= 0 and block.low < s.low:
        low = block.low, block.low_at
    return State(s.way, *high, *low)


def entries(summaries: DataFrame, share: float) -> DataFrame:
    """(symbol, block, way, high, high_at, low, low_at): the state in which each
    block is entered.  One row a block, so a symbol's summaries are one group."""

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        s, out = None, []
        for r in rows.sort_values("block").itertuples(index=False):
            s = s or State(0, r.start, 0, r.start, 0)
            out.append((r.symbol, r.block, *astuple(s)))
            s = leave(s, r, share)
        return pd.DataFrame(out, columns=["symbol", "block", "way", "high", "high_at", "low", "low_at"])

    return summaries.groupBy("symbol").applyInPandas(follow, "symbol string, block long, way long, high double, high_at long, low double, low_at long")


def turning_points(rows: DataFrame, pivot_pct: float) -> DataFrame:
    """(symbol, i) of the first bar, the turns and the last bar of numbered blocks."""
    share = pivot_pct / 100

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        close = rows["close"].tolist()
        found = (rows["symbol"].iloc[0], rows["block"].iloc[0], close[0], *summary(int(rows["i"].iloc[0]), close, share))
        return pd.DataFrame([found], columns=["symbol", "block", "start", *[c.split()[0] for c in COLUMNS.split(", ")]])

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        s = State(*rows[["way", "high", "high_at", "low", "low_at"]].iloc[0])
        at = turns(State(int(s.way), s.high, int(s.high_at), s.low, int(s.low_at)), int(rows["i"].iloc[0]), rows["close"].tolist(), share)
        return pd.DataFrame({"symbol": rows["symbol"].iloc[0], "i": at})

    bars = rows.select("symbol", "block", "i", "close")
    read = bars.groupBy("symbol", "block").applyInPandas(summarise, f"symbol string, block long, start double, {COLUMNS}")
    known = blocks.small(entries(read, share), "entries")
    found = bars.join(known, ["symbol", "block"]).groupBy("symbol", "block").applyInPandas(find, "symbol string, i long")
    ends = rows.groupBy("symbol").agg(F.max("n").alias("n")).select("symbol", F.explode(F.array(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return found.unionByName(ends).distinct()


def volume_so_far(rows: DataFrame) -> DataFrame:
    """``upto``: the volume of the symbol's bars so far, null as 0."""
    v = F.coalesce("volume", F.lit(0))
    sums = rows.groupBy("symbol", "block").agg(F.sum(v).alias("v"))
    before = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("symbol", "block", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("_before"))
    running = blocks.in_block().rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(blocks.small(sums, "volumes"), ["symbol", "block"]).withColumn("upto", (F.sum(v).over(running) + F.col("_before")).cast("long")).drop("_before")


def legs(bars: DataFrame, pivot_pct: float = 5.0, rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """(symbol, seq, a, z, with date, close and upto of both ends, last): the zigzag's
    legs from position a to z; last says that z is the symbol's last bar."""
    dealt = blocks.numbered(blocks.split(bars.select("symbol", "date", "close", "volume"), rows))
    points = blocks.small(turning_points(dealt, pivot_pct), "turns")
    at = volume_so_far(dealt).join(points, ["symbol", "i"]).select("symbol", F.struct("i", "date", "close", "upto", (F.col("i") == F.col("n") - 1).alias("last")).alias("p"))
    by_bar = Window.partitionBy("symbol").orderBy("p.i")
    both = at.select("symbol", (F.row_number().over(by_bar) - 1).alias("seq"), F.col("p").alias("a"), F.lead("p").over(by_bar).alias("z"))
    return both.where("z is not null")


def waves_in_blocks(bars: DataFrame, pivot_pct: float = 5.0, range_pct: float = 3.5, range_days: int = 22, rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """``waves.waves``, equal in every column, with a symbol's bars in many tasks.
    Only the legs of a symbol, not its bars, are one group, where range waves are
    merged from the left."""
    found = legs(bars, pivot_pct, rows)
    kind = dict(bars.dtypes)["date"]
    flat = found.select("symbol", "seq", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "az" for c in ("i", "date", "close", "upto", "last")])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq").reset_index(drop=True)
        close = dict(zip(rows["a_i"], rows["a_close"], strict=True)) | dict(zip(rows["z_i"], rows["z_close"], strict=True))
        merged = waves.merge_ranges(list(zip(rows["a_i"].tolist(), rows["z_i"].tolist(), strict=True)), close, range_pct, range_days)
        first, last = rows.set_index("a_i"), rows.set_index("z_i")
        out = [(rows["symbol"][0], k, t, first["a_date"][a], last["z_date"][z], close[a], close[z], z - a, last["z_upto"][z] - first["a_upto"][a], last["z_last"][z]) for k, (a, z, t) in enumerate(merged)]
        return pd.DataFrame(out, columns=["symbol", "seq", "type", "start_date", "end_date", "start_val", "end_val", "days", "total_vol", "is_open"])

    schema = f"symbol string, seq int, type string, start_date {kind}, end_date {kind}, start_val double, end_val double, days int, total_vol long, is_open boolean"
    return waves.measured(flat.groupBy("symbol").applyInPandas(merge, schema))

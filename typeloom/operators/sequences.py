"""Keystroke sequences as windows: FIFO pairing, intervals, bursts, revision, pointer, cursor; replay.

Every window partitions by the group key (and code), so one hash exchange on the key serves
them all. Order is (ts, seq), seq being the position in the log, which keeps ties stable.
Inputs: ``keys`` with the key columns, code, key, phase, repeat, ts (ms), seq.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.functions.stats import bin_of, percentile_ratio, safe_ratio, variation


@dataclass(frozen=True)
class Knobs:
    exclude_repeats: bool = True
    deletion_keys: tuple[str, ...] = ("Backspace", "Delete")
    insertion_keys: tuple[str, ...] = ("Enter", "Tab")
    long_pause_multiplier: float = 2.0
    entropy_bins: int = 10
    burst_gap_ms: float = 1000.0
    per_keys: float = 100.0
    path_per_keys: float = 100.0


#: Names of the rhythm features, in the order of emission.
TIER1 = (
    "kit_cv", "kit_p90_p50", "kit_p50_p10", "kit_long_pause_fraction", "kit_pause_time_fraction", "kit_pause_entropy",
    "kht_cv", "kht_p90_p50", "kht_p50_p10", "rkdt_cv",
    "revision_delete_ratio", "revision_deletion_episodes_per_100_keys", "revision_immediate_correction_rate",
    "burst_bursts_per_100_keys", "burst_relative_burst_length",
    "mouse_moves_per_100_keys", "mouse_path_length", "cursor_jump_rate",
)


def _is_repeat() -> Column:
    return F.coalesce(F.col("repeat"), F.lit(False))


def key_pairs(keys: DataFrame, by: list[str], knobs: Knobs = Knobs()) -> DataFrame:
    """Each keydown with the keyup that released it, first in first out by code; orphan keyups dropped.

    Running counts of downs d and ups u: the deficit m = max(u - d) so far counts orphan
    ups. An up is matched if it doesn't raise m; it releases the (u - m)-th down.
    """
    rows = keys.where(F.col("code").isNotNull() & F.col("phase").isin("keydown", "keyup"))
    down, up = F.col("phase") == "keydown", F.col("phase") == "keyup"
    if knobs.exclude_repeats:
        rows = rows.where(~(down & _is_repeat()))
    so_far = Window.partitionBy(*by, "code").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    step = Window.partitionBy(*by, "code").orderBy("ts", "seq")
    rows = rows.withColumn("d", F.sum(down.cast("int")).over(so_far)).withColumn("u", F.sum(up.cast("int")).over(so_far))
    rows = rows.withColumn("m", F.greatest(F.max(F.col("u") - F.col("d")).over(so_far), F.lit(0)))
    rows = rows.withColumn("pm", F.coalesce(F.lag("m").over(step), F.lit(0)))
    ranked = rows.where(down | (F.col("m") == F.col("pm"))).withColumn("rank", F.when(down, F.col("d")).otherwise(F.col("u") - F.col("m")))
    of = lambda cond, c: F.max(F.when(cond, F.col(c)))
    pairs = ranked.groupBy(*by, "code", "rank").agg(of(down, "ts").alias("down_ts"), of(down, "seq").alias("down_seq"), of(down, "key").alias("key"), of(up, "ts").alias("up_ts"), of(up, "seq").alias("up_seq"))
    return pairs.where(F.col("down_ts").isNotNull())


def intervals(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Adds iki, hold and rkdt (release to next keydown) to each pair."""
    order = Window.partitionBy(*by).orderBy("down_ts", F.col("up_ts").isNull(), "up_ts", "up_seq", "down_seq")
    return (
        pairs.withColumn("iki", F.col("down_ts") - F.lag("down_ts").over(order))
        .withColumn("hold", F.col("up_ts") - F.col("down_ts"))
        .withColumn("rkdt", F.lead("down_ts").over(order) - F.col("up_ts"))
    )


def keydown_stream(keys: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """Keydowns, repeats left out, null codes included."""
    rows = keys.where(F.col("phase") == "keydown")
    return rows.where(~_is_repeat()) if knobs.exclude_repeats else rows


def rhythm(timed: DataFrame, by: list[str], knobs: Knobs = Knobs()) -> DataFrame:
    """kit_*, kht_*, rkdt_* and burst sizes of each group."""
    whole, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("down_ts", "down_seq")
    x = timed.withColumn("median", F.percentile("iki", F.lit(0.5)).over(whole)).withColumn("low", F.min("iki").over(whole)).withColumn("high", F.max("iki").over(whole))
    x = x.withColumn("long", F.col("iki") > knobs.long_pause_multiplier * F.col("median")).withColumn("bin", bin_of(F.col("iki"), F.col("low"), F.col("high"), knobs.entropy_bins))
    x = x.withColumn("burst", F.sum(F.coalesce((F.col("iki") >= knobs.burst_gap_ms).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n, two = F.count("iki"), F.count("iki") >= 2
    some = F.when((n >= 1) & (F.first("median") != 0), F.lit(1))
    bins = [F.count(F.when(F.col("bin") == b, 1)) for b in range(knobs.entropy_bins)]
    spread = sum((F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0) for c in bins[1:]), F.when(bins[0] > 0, bins[0] * F.log2(bins[0].cast("double"))).otherwise(0.0))
    return x.groupBy(*by).agg(
        variation(F.col("iki")).alias("kit_cv"),
        percentile_ratio(F.col("iki"), 0.9, 0.5).alias("kit_p90_p50"),
        percentile_ratio(F.col("iki"), 0.5, 0.1).alias("kit_p50_p10"),
        (some * safe_ratio(F.count(F.when(F.col("long"), 1)), n)).alias("kit_long_pause_fraction"),
        (some * safe_ratio(F.sum(F.when(F.col("long"), F.col("iki")).otherwise(0.0)), F.max("down_ts") - F.min("down_ts"))).alias("kit_pause_time_fraction"),
        F.when(two, F.when(F.max("iki") == F.min("iki"), F.lit(0.0)).otherwise(F.log2(n.cast("double")) - spread / n)).alias("kit_pause_entropy"),
        variation(F.col("hold")).alias("kht_cv"),
        percentile_ratio(F.col("hold"), 0.9, 0.5).alias("kht_p90_p50"),
        percentile_ratio(F.col("hold"), 0.5, 0.1).alias("kht_p50_p10"),
        variation(F.col("rkdt")).alias("rkdt_cv"),
        F.count("*").alias("n_pairs"),
        (F.max("burst") + 1).alias("n_bursts"),
    )


def revision(stream: DataFrame, by: list[str], knobs: Knobs = Knobs()) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("ts", "seq")
    deletes = F.coalesce(F.col("key").isin(*knobs.deletion_keys), F.lit(False))
    inserts = ~deletes & F.coalesce(F.col("key").isin(*knobs.insertion_keys) | (F.length("key") == 1), F.lit(False))
    x = stream.withColumn("del", deletes).withColumn("ins", inserts)
    x = x.withColumn("before", F.coalesce(F.lag("del").over(order), F.lit(False))).withColumn("after", F.lead("del").over(order))
    many = lambda c: F.count(F.when(c, 1))
    return x.groupBy(*by).agg(
        F.count("*").alias("n_stream"),
        safe_ratio(many(F.col("del")), many(F.col("del")) + many(F.col("ins"))).alias("revision_delete_ratio"),
        safe_ratio(knobs.per_keys * many(F.col("del") & ~F.col("before")), F.count("*")).alias("revision_deletion_episodes_per_100_keys"),
        safe_ratio(many(F.col("ins") & F.col("after")), many(F.col("ins") & F.col("after").isNotNull())).alias("revision_immediate_correction_rate"),
    )


def mouse_path(mouse: DataFrame, by: list[str]) -> DataFrame:
    """n_moves and path (NULL below two events); missing coordinates are 0."""
    order = Window.partitionBy(*by).orderBy("ts", "seq")
    x = mouse.withColumn("px", F.coalesce("x", F.lit(0.0))).withColumn("py", F.coalesce("y", F.lit(0.0)))
    step = F.hypot(F.col("px") - F.lag("px").over(order), F.col("py") - F.lag("py").over(order))
    return x.withColumn("step", step).groupBy(*by).agg(F.count("*").alias("n_moves"), F.when(F.count("*") >= 2, F.sum("step")).alias("path"))


def cursor_jumps(cursor: DataFrame, by: list[str]) -> DataFrame:
    """Share of transitions that are neither one column on nor the next line's start; nulls aren't bridged."""
    order = Window.partitionBy(*by).orderBy("ts", "seq")
    x = cursor.withColumn("pl", F.lag("line").over(order)).withColumn("pc", F.lag("ch").over(order))
    along = (F.col("line") == F.col("pl")) & (F.col("ch") == F.col("pc") + 1)
    onward = (F.col("line") == F.col("pl") + 1) & (F.col("ch") == 0)
    # Without the guard, a null beside a false would count as a jump.
    whole = F.col("line").isNotNull() & F.col("ch").isNotNull() & F.col("pl").isNotNull() & F.col("pc").isNotNull()
    linear = F.when(whole, along | onward)
    return x.groupBy(*by).agg(safe_ratio(F.count(F.when(~linear, 1)), F.count(linear)).alias("cursor_jump_rate"))


def tier1(keys: DataFrame, mouse: DataFrame, cursor: DataFrame, by: list[str], knobs: Knobs = Knobs()) -> DataFrame:
    """The 18 features of each group, wide; groups without any event of a kind have NULLs."""
    timed = rhythm(intervals(key_pairs(keys, by, knobs), by), by, knobs)
    spine = keys.select(by).unionByName(mouse.select(by)).unionByName(cursor.select(by)).distinct()
    x = spine
    for part in (timed, revision(keydown_stream(keys, knobs), by, knobs), mouse_path(mouse, by), cursor_jumps(cursor, by)):
        x = x.join(part, by, "left")
    n = F.col("n_stream")
    x = x.withColumn("burst_bursts_per_100_keys", safe_ratio(knobs.per_keys * F.col("n_bursts"), n))
    x = x.withColumn("burst_relative_burst_length", safe_ratio(F.col("n_pairs") / F.col("n_bursts"), n))
    x = x.withColumn("mouse_moves_per_100_keys", safe_ratio(knobs.per_keys * F.coalesce("n_moves", F.lit(0)), n))
    x = x.withColumn("mouse_path_length", safe_ratio(knobs.path_per_keys * F.col("path"), n))
    return x.select(*by, *TIER1)


class Sheet:
    """Lines of text that keystrokes change at a caret given after the stroke, as the logs give it.

    An Enter doesn't tell where its line was split, so the new line is empty; keys that type
    nothing, such as arrows and modifiers, change nothing.
    """

    def __init__(self):
        self.rows = [""]

    def stroke(self, key: str, line: int, ch: int) -> None:
        self.rows += [""] * (line + 1 - len(self.rows))
        match key:
            case "Backspace" if ch > 0:
                self._cut(line, ch)
            case "Backspace":
                self._join(line - 1)
            case "Delete" if ch < len(self.rows[line]):
                self._cut(line, ch)
            case "Delete":
                self._join(line)
            case "Enter" if line > 0:
                self.rows.insert(line, "")
            case _ if len(key) == 1:
                at = max(0, ch - 1)
                self.rows[line] = self.rows[line][:at] + key + self.rows[line][at:]

    def _cut(self, line: int, at: int) -> None:
        self.rows[line] = self.rows[line][:at] + self.rows[line][at + 1 :]

    def _join(self, line: int) -> None:
        if 0 <= line < len(self.rows) - 1:
            self.rows[line : line + 2] = [self.rows[line] + self.rows[line + 1]]

    def text(self) -> str:
        return "\n".join(self.rows)


def replay(keys: DataFrame, by: list[str]) -> DataFrame:
    """The group's key and the text that its keydowns leave: order-dependent, so one group (an answer) to one call.

    ``keys`` has line and ch too; strokes without them are left out.
    """
    import pandas as pd

    def typed(name, pdf):
        sheet = Sheet()
        rows = pdf.sort_values(["ts", "seq"], kind="stable")
        for key, line, ch in zip(rows["key"], rows["line"], rows["ch"], strict=True):
            if key is not None:
                sheet.stroke(key, int(line), int(ch))
        return pd.DataFrame([[*name, sheet.text()]])

    kinds = dict(keys.dtypes)
    placed = keydown_stream(keys).where(F.col("line").isNotNull() & F.col("ch").isNotNull()).select(*by, "ts", "seq", "key", "line", "ch")
    return placed.groupBy(*by).applyInPandas(typed, ", ".join([*(f"{c} {kinds[c]}" for c in by), "replayed string"]))


def replay_agreement(replayed: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """One row: n, exact, mean_similarity, median_similarity of replayed and stored texts (difflib's ratio)."""
    def ratios(a: pa.Array, b: pa.Array) -> pa.Array:
        from difflib import SequenceMatcher

        return pa.array([SequenceMatcher(a=x, b=y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    both = replayed.join(texts.select(*by, "text").where(F.col("text").isNotNull()), by)
    scored = both.select((F.col("replayed") == F.col("text")).alias("same"), F.arrow_udf(ratios, "double").asNondeterministic()("replayed", "text").alias("r"))
    return scored.agg(F.count("*").alias("n"), F.count_if("same").alias("exact"), F.avg("r").alias("mean_similarity"), F.percentile("r", F.lit(0.5)).alias("median_similarity"))

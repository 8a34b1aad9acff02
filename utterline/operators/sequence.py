"""Operators on ordered rows of a group: islands, windows, overlaps, labels."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship


def islands(df: DataFrame, group: str, start: str, end: str, gap: float, label: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Number runs whose gaps are at most ``gap`` (and whose label stays): adds ``island``, from 1."""
    w = W.partitionBy(group).orderBy(*(order or [start, end]))
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = before.isNull() | (F.col(start) - before > gap)
    if label:
        new = new | (F.lag(label).over(w) != F.col(label))
    return df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")


def merge_islands(df: DataFrame, group: str, start: str, end: str, gap: float, label: str | None = None, least: float = 0.0) -> DataFrame:
    """The runs of ``islands`` as rows; those under ``least`` go."""
    keys = [group, "island", *([label] if label else [])]
    out = islands(df, group, start, end, gap, label).groupBy(*keys).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_rows"))
    return out.where(F.round(F.col(end) - F.col(start), 9) >= least) if least else out


def sliding_windows(df: DataFrame, start: str, end: str, size: float, hop: float, least: float) -> DataFrame:
    """Windows of ``size`` every ``hop`` in each segment; the last is cut at the end and kept if it has ``least``."""
    length = F.col(end) - F.col(start)
    count = F.greatest(F.lit(0), F.floor((length - least) / hop + 1e-6) + 1).cast("int")
    at = F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))).alias("window")
    return df.select("*", at).withColumn("window_start", F.round(F.col(start) + F.col("window") * hop, 6)).withColumn("window_end", F.round(F.least(F.col(end), F.col(start) + F.col("window") * hop + size), 6))


def slot_width(*sides: DataFrame, share: float = 0.9, least: float = 1.0) -> float:
    """Seconds that hold ``share`` of the segments of all sides, about, so that hardly any lies in more than two slots."""
    lengths = reduce(DataFrame.unionByName, [d.select((F.col("end") - F.col("start")).cast("double").alias("n")) for d in sides])
    return max(least, lengths.agg(F.percentile_approx("n", share, 1000)).first()[0] or least)


def overlaps(a: DataFrame, b: DataFrame, key: str, a_id: str, slot: float | None = None, most: int = 64) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` of one file that overlap, with the ``overlap``. Columns: key, a_id, start, end and key, speaker, start, end.

    Joined on the key and on time slots (as wide as most segments are long), so a file's segments meet only those near them. A segment
    over ``most`` slots long would be a row in each; such rows meet in slots ``most`` times as wide, beside all rows of the other side.
    """
    slot = slot or slot_width(a, b)
    left = a.select(key, a_id, F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    right = b.select(key, "speaker", F.col("start").alias("b_start"), F.col("end").alias("b_end"))

    def met(x: DataFrame, y: DataFrame, wide: float) -> DataFrame:
        slots = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / wide), F.floor(F.col(e) / wide))).alias("slot")
        both = x.select("*", slots("a_start", "a_end")).join(y.select("*", slots("b_start", "b_end")), [key, "slot"])
        first = F.floor(F.greatest("a_start", "b_start") / wide) == F.col("slot")  # each pair once
        return both.where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & first).drop("slot")

    long_a, long_b = F.col("a_end") - F.col("a_start") > most * slot, F.col("b_end") - F.col("b_start") > most * slot
    some = left.where("a_end >= a_start"), right.where("b_end >= b_start")
    near = met(some[0].where(~long_a), some[1].where(~long_b), slot)
    far = met(some[0].where(long_a), some[1], most * slot).unionByName(met(some[0].where(~long_a), some[1].where(long_b), most * slot))
    return near.unionByName(far).withColumn("overlap", F.least("a_end", "b_end") - F.greatest("a_start", "b_start"))


def overlap_speaker(a: DataFrame, b: DataFrame, key: str, a_id: str, default: str | None = None) -> DataFrame:
    """The speaker of the largest single overlap, the earliest of equals.

    With ``default`` every row of ``a`` stays: one without overlap gets the file's first segment that ends at or after its start or begins at
    or before its end, else ``default``.
    """
    found = overlaps(a, b, key, a_id).groupBy(key, a_id).agg(F.max_by("speaker", F.struct(F.round("overlap", 6), -F.col("b_start"))).alias("speaker"))
    if default is None:
        return found
    first = b.groupBy(key).agg(F.min_by("speaker", F.struct("start", "end", "speaker")).alias("_first"), F.min(F.struct("start", "end"))["start"].alias("_s"), F.min(F.struct("start", "end"))["end"].alias("_e"))
    fits = (F.col("_e") >= F.col("start")) | (F.col("_s") <= F.col("end"))  # holds for nearly any row, so the file's first it is
    out = a.select(key, a_id, "start", "end").join(found, [key, a_id], "left").join(first, key, "left")
    return out.select(key, a_id, F.coalesce("speaker", F.when(fits, F.col("_first")), F.lit(default)).alias("speaker"))


def overlap_vote(a: DataFrame, b: DataFrame, key: str, a_id: str) -> DataFrame:
    """The speaker of the largest summed overlap, the least name of equals."""
    votes = overlaps(a, b, key, a_id).groupBy(key, a_id, "speaker").agg(F.round(F.sum("overlap"), 6).alias("total"))
    return votes.groupBy(key, a_id).agg(F.min_by("speaker", F.struct(-F.col("total"), F.col("speaker"))).alias("speaker"), F.max("total").alias("total"))


def padded(df: DataFrame, group: str, before: float, after: float) -> DataFrame:
    """Segments widened by ``before`` and ``after``, but not into their neighbours, nor under 0."""
    w = W.partitionBy(group).orderBy("start", "end")
    start = F.greatest(F.lit(0.0), F.coalesce(F.lag("end").over(w), F.lit(0.0)), F.col("start") - before)
    end = F.least(F.coalesce(F.lead("start").over(w), F.lit(float("inf"))), F.col("end") + after)
    return df.withColumn("padded_start", F.least("start", start)).withColumn("padded_end", F.greatest("end", end))


def majority(label: Column, group: str, order: str, reach: int = 1) -> Column:
    """The most frequent label of the neighbours within ``reach``, the least of equals."""
    return F.mode(label, True).over(W.partitionBy(group).orderBy(order).rowsBetween(-reach, reach))


def await_relabel(df: DataFrame, group: str, order: str, await_: Column, greeting: Column, most: int = 5) -> DataFrame:
    """Adds ``should_be_client``: rows strictly between an await and the next greeting, 2 to ``most`` of them, with no other await between."""
    w = W.partitionBy(group).orderBy(order)
    past, ahead = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    df = df.withColumn("_n", F.row_number().over(w)).withColumn("_a", await_).withColumn("_g", greeting)
    pa, pg = (F.max(F.when(F.col(c), F.col("_n"))).over(past) for c in ("_a", "_g"))
    fa, fg = (F.min(F.when(F.col(c), F.col("_n"))).over(ahead) for c in ("_a", "_g"))
    df = df.withColumn("_pa", pa).withColumn("_pg", pg).withColumn("_fa", fa).withColumn("_fg", fg)
    between = F.col("_fg") - F.col("_pa") - 1
    hit = ~F.col("_a") & ~F.col("_g") & F.col("_pa").isNotNull() & F.col("_fg").isNotNull() & ~F.coalesce(F.col("_pg") > F.col("_pa"), F.lit(False)) & ~F.coalesce(F.col("_fa") < F.col("_fg"), F.lit(False)) & (between > 1) & (between <= most)
    return df.withColumn("should_be_client", hit).drop("_n", "_a", "_g", "_pa", "_pg", "_fa", "_fg")


def viterbi(df: DataFrame, group: str, order: str, scores: list[str], penalty: float = 0.2) -> DataFrame:
    """The labels of the best path: a label's score, less ``penalty`` at each change. Needs a group's rows in one task, so groups must be files."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        x = pdf[scores].to_numpy(float)
        best, back = x[0].copy(), []
        for row in x[1:]:
            top = int(best.argmax())
            stay = best >= best[top] - penalty
            back.append([k if stay[k] else top for k in range(len(best))])
            best = row + [best[k] if stay[k] else best[top] - penalty for k in range(len(best))]
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(step[path[-1]])
        return pd.DataFrame({group: pdf[group], order: pdf[order], "label": path[::-1]})

    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    return df.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, label int")


def rolled_windows(df: DataFrame, start: str, end: str, total: Column, size: float = 1.0, hop: float = 0.3, before: float = 0.2, after: float = 0.1, tail: float = 0.3) -> DataFrame:
    """Windows over segments widened by ``before`` and ``after`` within the file's ``total`` seconds; a short segment is one window.

    What is left after the last full window gets a window of ``size`` at the end if, from that window's start, over ``tail`` of a size is left.
    """
    s, e = F.greatest(F.lit(0.0), F.col(start) - before), F.least(total, F.col(end) + after)
    df = df.withColumn("_s", s).withColumn("_e", e).where(F.col("_e") - F.col("_s") > 1e-6)
    n = F.floor((F.col("_e") - F.col("_s") - size) / hop + 1e-9).cast("int") + 1
    full = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.struct((F.col("_s") + k * hop).alias("window_start"), F.least(F.col("_s") + k * hop + size, F.col("_e")).alias("window_end")))
    last = F.col("_s") + (n - 1) * hop
    more = (F.col("_e") - last > tail * size) & (last + size < F.col("_e") - 1e-9)
    rest = F.array(F.struct(F.greatest(F.col("_s"), F.col("_e") - size).alias("window_start"), F.col("_e").alias("window_end")))
    short = F.col("_e") - F.col("_s") <= size + 1e-6
    whole = F.array(F.struct(F.col("_s").alias("window_start"), F.col("_e").alias("window_end")))
    windows = F.when(short, whole).when(more, F.concat(full, rest)).otherwise(full)
    out = df.select("*", F.posexplode(windows).alias("window", "_w"))
    return out.withColumn("window_start", F.round("_w.window_start", 6)).withColumn("window_end", F.round("_w.window_end", 6)).drop("_s", "_e", "_w")


def without_overlaps(df: DataFrame, group: str) -> DataFrame:
    """Adds ``clear_start`` and ``clear_end``: an overlap goes to the earlier segment.

    Each start moves to the end before it and no end lies before its start, so ends are a running maximum: a window, not a loop.
    """
    w = W.partitionBy(group).orderBy("start", "end")
    reach = lambda r: F.max(F.greatest("start", "end")).over(w.rowsBetween(W.unboundedPreceding, r))
    return df.withColumn("clear_start", F.greatest(F.col("start"), reach(-1))).withColumn("clear_end", reach(0))


def aligned_speaker(a: DataFrame, b: DataFrame, key: str, a_id: str, text: str, early: float = 3.0, window: float = 12.0, least: float = 0.2, dominant: float = 0.85, default: str = "Speaker 1") -> DataFrame:
    """key, a_id, speaker of each phrase of ``a`` with a text and a length.

    A phrase that starts before ``early`` goes to the speaker who talks most in its part before ``window``; another to the speaker of
    its longest overlap over ``least``, if that covers ``dominant`` of it, else to who talks most in it; without overlaps to ``default``.
    Of equals the least name, or the earliest overlap.
    """
    said = a.where((F.trim(F.coalesce(F.col(text), F.lit(""))) != "") & (F.col("end") > F.col("start")))
    o = overlaps(said, b, key, a_id)
    cut = F.when(F.col("a_start") < early, F.greatest(F.lit(0.0), F.least("a_end", "b_end", F.lit(window)) - F.greatest("a_start", "b_start"))).otherwise(F.col("overlap"))
    per = o.groupBy(key, a_id, "speaker").agg(F.round(F.sum(cut), 6).alias("total"), F.max(F.when(F.col("overlap") > least, F.struct(F.round("overlap", 6).alias("n"), (-F.col("b_start")).alias("at")))).alias("best"), F.first("a_start").alias("s"), F.first("a_end").alias("e"))
    won = per.groupBy(key, a_id).agg(F.min_by("speaker", F.when(F.col("total") > 0, F.struct(-F.col("total"), F.col("speaker")))).alias("most"), F.max_by("speaker", "best").alias("longest"), F.max("best")["n"].alias("n"), F.first("s").alias("s"), F.first("e").alias("e"))
    clear = (F.col("s") >= early) & F.coalesce(F.col("n") / (F.col("e") - F.col("s")) >= dominant, F.lit(False))
    named = won.select(key, a_id, F.when(clear, F.col("longest")).otherwise(F.col("most")).alias("speaker"))
    return said.select(key, a_id).join(named, [key, a_id], "left").fillna(default, "speaker")


def cut_segments(df: DataFrame, group: str, start: str, end: str, label: str, part: str, gap: float = 0.15, least: float = 1.0, bias: float = 0.04) -> DataFrame:
    """group, start, end, label: labelled windows as segments.

    Windows of one ``part`` that follow within ``gap`` grow a segment while the label stays; where it changes, the segments meet
    midway between the old one's and the new window's middles, plus ``bias``, within both. Segments under ``least`` go, then equal
    neighbours within ``gap`` join. Each cut moves the next segment's start, so a file's windows pass through one Arrow group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, end], kind="stable")
        found: list[list] = []
        held = None
        for s, e, who, where in zip(pdf[start], pdf[end], pdf[label], pdf[part], strict=True):
            near = found and where == held and s - found[-1][1] <= gap + 1e-9
            if near and who == found[-1][2]:
                found[-1][1] = max(found[-1][1], e)
                continue
            if near:
                last = found[-1]
                cut = ((last[0] + last[1]) / 2 + (s + e) / 2) / 2 + bias
                cut = min(max(cut, last[0]), e)
                last[1] = s = cut if cut <= last[1] else max(last[1], min(cut, s))
            found.append([s, e, who])
            held = where
        out: list[list] = []
        for s, e, who in found:
            if e - s < least - 1e-6:
                continue
            if out and who == out[-1][2] and s - out[-1][1] <= gap + 1e-9:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e, who])
        done = pd.DataFrame(out, columns=["start", "end", label])
        done.insert(0, group, pdf[group].iloc[0])
        return done

    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    return df.select(group, start, end, label, part).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, start double, end double, {label} {kinds[label]}")

"""Flowgrams as arrays of hundredths (100 is one base)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order in which nucleotides flow, the key in front of each read, and signal limits in hundredths.
FLOW_ORDER = "TACG"
KEY = "TCAG"
SIGNAL, AMBIGUOUS, HIGH = 50, 70, 949


def cast_hundredths(values: str | Column, exact: bool = True) -> Column:
    """Signals to hundredths: rounded, or cut off as older tools do (2.01 becomes 200)."""
    values = F.col(values) if isinstance(values, str) else values
    return F.transform(values, lambda x: (F.floor(x * 100 + 0.5) if exact else x * 100).cast("int"))


def homopolymers(flows: str | Column) -> Column:
    """Each flow rounded half up to a number of bases."""
    flows = F.col(flows) if isinstance(flows, str) else flows
    return F.transform(flows, lambda x: F.floor((x + 50) / 100).cast("int"))


def flow_to_seq(flows: str | Column, first: int = 0) -> Column:
    """The bases that flows stand for, from flow number first on."""
    flows = F.col(flows) if isinstance(flows, str) else flows
    part = F.slice(flows, first + 1, F.greatest(F.size(flows) - first, F.lit(0))) if first else flows
    base = lambda i: F.substring(F.lit(FLOW_ORDER), (i + first) % 4 + 1, F.lit(1))
    return F.array_join(F.transform(part, lambda x, i: F.repeat(base(i), F.greatest(F.floor((x + 50) / 100), F.lit(0)).cast("int"))), "")


def cumsum(values: str | Column) -> Column:
    """Running sums of an array."""
    values = F.col(values) if isinstance(values, str) else values
    start = F.struct(F.array().cast("array<bigint>").alias("sums"), F.lit(0).cast("bigint").alias("last"))
    return F.aggregate(values, start, lambda acc, x: F.struct(F.concat(acc["sums"], F.array(acc["last"] + x)).alias("sums"), (acc["last"] + x).alias("last")), lambda acc: acc["sums"])


def find_clip(flow_index: str, left: str, right: str) -> Column:
    """(left, right): flow numbers of the clip points, from the steps between called bases."""
    upto = lambda n: F.aggregate(F.slice(flow_index, 1, n), F.lit(0), lambda a, x: a + x.cast("int"))
    return F.struct(upto(F.col(left) + 1).alias("left"), upto(F.col(right)).alias("right"))


def bases_from_flows(flows: str, clip: Column) -> Column:
    return flow_to_seq(F.slice(flows, 1, F.greatest(clip, F.lit(0))))


def flows_to_string(flows: str | Column) -> Column:
    flows = F.col(flows) if isinstance(flows, str) else flows
    return F.array_join(F.transform(flows, lambda x: F.format_string("%.2f", x / F.lit(100.0))), " ")


def quads(flows: str | Column) -> Column:
    """Flows in fours; the last may be shorter."""
    flows = (F.col(flows) if isinstance(flows, str) else flows).cast("array<int>")
    count = F.ceil(F.size(flows) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.slice(flows, k * 4 + 1, F.lit(4)))).otherwise(F.array().cast("array<array<int>>"))


def flowgram_is_empty(quad: Column) -> Column:
    return F.forall(quad, lambda x: x < SIGNAL)


def flowgram_is_high(quad: Column, high: int = HIGH) -> Column:
    return F.exists(quad, lambda x: x > high)


def flowgram_is_ambiguous(quad: Column) -> Column:
    return F.exists(quad, lambda x: (x > SIGNAL) & (x < AMBIGUOUS))


def flowgram_is_valid(quad: Column, high: int = HIGH) -> Column:
    """Of at most four flows; more are an error."""
    good = ~(flowgram_is_empty(quad) | flowgram_is_high(quad, high) | flowgram_is_ambiguous(quad))
    return F.when(F.size(quad) > 4, F.raise_error(F.lit("more than four flows")).cast("boolean")).otherwise(good)


def clean_prefix(flows: str | Column, max_empty: int = 0, high: int = HIGH) -> Column:
    """The flows up to the first bad four. Up to max_empty fours without signal are left out on the way."""
    state = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).alias("empty"), F.lit(True).alias("on"))

    def step(acc: Column, quad: Column) -> Column:
        empty, bad = flowgram_is_empty(quad), flowgram_is_high(quad, high) | flowgram_is_ambiguous(quad)
        on = acc["on"] & F.when(empty, acc["empty"] < max_empty).otherwise(~bad)
        kept = F.when(on & ~empty, F.concat(acc["kept"], quad)).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), (acc["empty"] + (acc["on"] & empty).cast("int")).alias("empty"), on.alias("on"))

    return F.aggregate(quads(flows), state, step, lambda acc: acc["kept"])

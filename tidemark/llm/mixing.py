"""Mix sources to target weights with a proportionate-fair schedule.

Rows of a source are dealt, in a hashed order, to blocks. Block j (from 1) of
a source with weight w is released at slot floor((j - 1) / w) and due at slot
ceil(j / w); in every slot the released block with the earliest deadline runs.
All blocks then run inside their windows, so that after any number of slots no
source is a whole block ahead of, or behind, its target. Weights are taken as
exact fractions, however long the schedule.

The schedule is cut into periods that tasks work out alone. Where a period
starts, every source has run its target rounded down or up; which of them up
follows from the slot alone (``State.ran``), and is such that all windows of
the periods on both sides can still be kept. When a source runs out, the
others go on with their weights scaled up.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 32
#: Least slots of a period; no window is longer than a period.
PERIOD = 1024
#: Default weights are row counts to this power, which lifts small sources.
TEMPERATURE = 0.7
#: Sources that the schedule takes; more are an error.
MAX_SOURCES = 10_000
#: Rows numbered by one task at a time.
BUCKET_ROWS = 2_000


def whole(weights: np.ndarray) -> list[int]:
    """The weights as whole numbers, in exactly the same proportions."""
    exact = [Fraction(float(w)) for w in weights]
    scale = max(x.denominator for x in exact)  # a power of two
    return [int(x * scale) for x in exact]


@dataclass
class Phase:
    """A stretch of slots during which the same sources run."""

    slot: int  # the first
    length: int
    first: np.ndarray  # block of each source that comes next at its start
    share: np.ndarray  # weight of each source, 0 for one that does not run
    period: int

    @property
    def periods(self) -> int:
        return -(-self.length // self.period)


class State:
    """The sources that run in a phase. Slots and blocks count from its start."""

    def __init__(self, share: np.ndarray):
        self.on = np.flatnonzero(share)
        self.weight = whole(share[self.on])
        self.total = sum(self.weight)

    def release(self, k: int, n: int) -> int:
        return n * self.total // self.weight[k]

    def due(self, k: int, n: int) -> int:
        return -(-(n + 1) * self.total // self.weight[k])

    def ran(self, slot: int) -> list[int]:
        """Blocks of each source that run before ``slot``.

        A block whose window holds the slot inside runs on one side of it. Of
        those due first, as many run before as the sum of their targets'
        fractions, rounded down, and of those released last no more than that
        sum, rounded up: then no stretch of slots on either side gets more
        blocks than it holds. The fractions themselves keep these bounds, which
        are on two chains of sets, so whole numbers can; taking the one
        released first whenever the bound asks for one more finds them.
        """
        done, over = map(list, zip(*(divmod(slot * w, self.total) for w in self.weight)))
        inside = sorted((self.due(k, done[k]), k) for k in range(len(done)) if over[k])
        ready, target, up = [], 0, 0
        for _, k in inside:
            heapq.heappush(ready, (self.release(k, done[k]), k))
            target += over[k]
            if target // self.total > up:
                done[heapq.heappop(ready)[1]] += 1
                up += 1
        return done

    def run(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """(source, block) of each slot from ``start`` to ``end``, where
        periods start, by earliest deadline first."""
        done, last = self.ran(start), self.ran(end)
        ready: list[tuple[int, int]] = []
        later = [(self.release(k, n), k) for k, n in enumerate(done) if n < last[k]]
        heapq.heapify(later)
        for t in range(start, end):
            while later and later[0][0] <= t:
                k = heapq.heappop(later)[1]
                heapq.heappush(ready, (self.due(k, done[k]), k))
            k = heapq.heappop(ready)[1]
            yield k, done[k]
            done[k] += 1
            if done[k] < last[k]:
                heapq.heappush(later, (self.release(k, done[k]), k))


def schedule(blocks: np.ndarray, weights: np.ndarray, period: int = PERIOD) -> list[Phase]:
    """Phases that run all ``blocks`` of every source. Sources without a weight
    above 0 run after the others, as often as each other."""
    left, phases, slot = blocks.astype(np.int64).copy(), [], 0
    while left.any():
        share = np.where((left > 0) & (weights > 0), weights, 0.0)
        if not share.any():
            share = (left > 0).astype(np.float64)
        state = State(share)
        rest = left[state.on].tolist()
        size = max(period, -(-state.total // min(state.weight)) + 2)
        # the first period in which a source runs out
        low, high = 0, min(-(-n * state.total // w) for n, w in zip(rest, state.weight)) // size + 1
        while low + 1 < high:
            mid = (low + high) // 2
            low, high = (low, mid) if any(n >= m for n, m in zip(state.ran(mid * size), rest)) else (mid, high)
        length, done = low * size, state.ran(low * size)
        for k, n in state.run(length, length + size):
            length += 1
            done[k] = n + 1
            if done[k] == rest[k]:
                break
        phases.append(Phase(slot, length, blocks - left, share, size))
        left[state.on] -= np.array(done)
        slot += length
    return phases


def period_slots(phases: list[Phase], p: int, number: int) -> tuple[np.ndarray, ...]:
    """(source, block, slot, release, deadline) of a phase's period; the last
    two count from the start of the schedule."""
    ph = phases[p]
    state, start = State(ph.share), number * ph.period
    ran = [(k, n, start + i, state.release(k, n), state.due(k, n))
           for i, (k, n) in zip(range(ph.length - start), state.run(start, start + ph.period))]
    k, n, slot, release, due = np.array(ran, np.int64).reshape(-1, 5).T
    source = state.on[k]
    return source, n + ph.first[source], slot + ph.slot, release + ph.slot, due + ph.slot


def slots_of(phases: list[Phase], source: np.ndarray, block: np.ndarray):
    """(slot, phase, release, deadline) of blocks, from all periods."""
    at = {}
    for p, ph in enumerate(phases):
        for number in range(ph.periods):
            for s, n, slot, release, due in zip(*(c.tolist() for c in period_slots(phases, p, number))):
                at[s, n] = slot, p, release, due
    found = [at[key] for key in zip(source.tolist(), block.tolist())]
    return tuple(np.array(found, np.int64).reshape(-1, 4).T)


def _placed(docs: DataFrame, source: str, id_col: str, text: str | None, weights: Mapping | None, block: int,
            period: int, seed: int) -> DataFrame:
    """Rows with block, slot, phase, release, deadline and position."""
    counts = docs.groupBy(F.col(source).alias("s")).count().limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    counts = sorted(((r.s, r["count"]) for r in counts), key=lambda r: (r[0] is not None, str(r[0])))
    kind = docs.schema[source].dataType.simpleString()
    # one row for each source: at most MAX_SOURCES
    numbers = docs.sparkSession.createDataFrame(
        [(s, k, -(-n // BUCKET_ROWS)) for k, (s, n) in enumerate(counts)], f"_s {kind}, _source int, _parts long")
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = (docs.join(F.broadcast(numbers), docs[source].eqNullSafe(numbers["_s"])).drop("_s")
            .withColumn("_order", order)
            .withColumn("_part", F.shiftright(F.shiftrightunsigned("_order", 32) * F.col("_parts"), 32)))
    sizes = rows.groupBy("_source", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("_source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), "_n")
    # the blocks that a bucket's rows are in, with their slots: a few dozen
    here = F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("_n") - 1) / block)))
    slots = _slots(docs.sparkSession, _plan(counts, weights, block, period))
    start = (start.withColumn("_block", here).join(slots, ["_source", "_block"])
             .groupBy("_source", "_part", "_start").agg(F.array_sort(F.collect_list(F.struct(*slots.columns[1:]))).alias("_slots")))
    ties = [F.xxhash64(F.col(text))] if text else []
    inside = Window.partitionBy("_source", "_part").orderBy("_order", F.coalesce(F.col(id_col).cast("string"), F.lit("")), *ties)
    nth = F.col("_start") + F.col("_row") - 1
    own = F.col("_slots")[(F.col("_block") - F.col("_slots")[0]["_block"]).cast("int")]
    rows = (rows.withColumn("_row", F.row_number().over(inside)).join(start, ["_source", "_part"])
            .withColumn("_block", F.floor(nth / block)).withColumn("_own", own))
    return rows.select(*docs.columns, F.col("_block").alias("block"), "_own.slot", "_own.phase", "_own.release", "_own.deadline",
                       (F.col("_own.slot") * block + F.pmod(nth, F.lit(block))).alias("position"))


def _plan(counts: list[tuple], weights: Mapping | None, block: int, period: int) -> list[Phase]:
    n = np.array([c for _, c in counts], np.float64)
    w = n ** TEMPERATURE if weights is None else np.array([float(weights.get(s, 0)) for s, _ in counts])
    if len(w) and not (w > 0).any():
        raise ValueError("no source has a weight above 0")
    return schedule(-(-n.astype(np.int64) // block), w, period)


def _slots(spark: SparkSession, phases: list[Phase]) -> DataFrame:
    """(_source, _block, slot, phase, release, deadline) of all blocks."""
    held, ends = spark.sparkContext.broadcast(phases), np.cumsum([ph.periods for ph in phases])
    out = "_source int, _block long, slot long, phase int, release long, deadline long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                p = int(np.searchsorted(ends, k, "right"))
                source, block, slot, release, due = period_slots(held.value, p, k - int(ends[p]) + held.value[p].periods)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(source.astype(np.int32)), pa.array(block), pa.array(slot), pa.array(np.full(len(slot), p, np.int32)),
                     pa.array(release), pa.array(due)], ["_source", "_block", "slot", "phase", "release", "deadline"])

    return spark.range(int(ends[-1]) if len(ends) else 0).mapInArrow(place, out)


def mix(docs: DataFrame, weights: Mapping | None = None, id_col: str = "doc_id", source: str = "source",
        text: str | None = "text", block: int = BLOCK, period: int = PERIOD, seed: int = 17) -> DataFrame:
    """(id, source, block, slot, phase, release, deadline, position) of every row.

    Sorting by position gives the mix: source blocks interleaved so that, while
    the same sources last, none is a block or more off its target. Nothing is
    dropped or repeated. Weights name sources; None means row counts to the
    power ``TEMPERATURE``; sources without a weight above 0 come after the others.
    Null is a source like any other. Positions are distinct; they have gaps
    where a source's last block is short. Equal rows follow each other.
    """
    cols = [F.col(id_col).alias("_id"), F.col(source).alias("_src"), *([F.col(text).alias("_text")] if text else [])]
    narrow = docs.select(*cols)
    if text:
        narrow = narrow.select("_id", "_src", F.coalesce(F.xxhash64("_text"), F.lit(0)).alias("_text"))
    rows = _placed(narrow, "_src", "_id", "_text" if text else None, weights, block, period, seed)
    return rows.select(F.col("_id").alias(id_col), F.col("_src").alias(source), *rows.columns[len(narrow.columns):])


def mixed(docs: DataFrame, weights: Mapping | None = None, id_col: str = "doc_id", source: str = "source",
          text: str = "text", block: int = BLOCK, period: int = PERIOD, seed: int = 17) -> DataFrame:
    """``docs`` with all columns and rows, sorted into the order of the mix."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    at = {c: f"c{k}" for k, c in enumerate(names)}
    out = _placed(plain, at[source], at[id_col], at[text], weights, block, period, seed)
    return out.orderBy("position").select(*[F.col(c).alias(n) for n, c in at.items()])

"""Training schedules: greedy fills of a token budget, whole cycles, and their checks."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import save

#: The last cycle that a schedule can have; one that needs more has a budget far beyond its rows.
MOST_CYCLES = 10_000
#: So few rows of a cycle that may still fit are folded by the driver: about 2 MB.
FOLDED = 10_000


def _order(seed: int, namespace: str, cycle: Column | int, id_: str) -> Column:
    cycle = F.lit(str(cycle)) if isinstance(cycle, int) else cycle.cast("string")
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(namespace), cycle, F.col(id_).cast("string")), 256)


def _written(df: DataFrame) -> DataFrame:
    return save(df, "schedule")


def _dealt(df: DataFrame, *order: str) -> DataFrame:
    """`df` in ranges of `order`, held, with the range as `_p`: all rows of one are before those of the next."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _written(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))


def _key(seed: int, namespace: str, cycle: Column | int) -> Column:
    return F.concat(_order(seed, namespace, cycle, "record_id"), F.coalesce("record_id", F.lit("")))


def _fill(rows: DataFrame, room: int) -> tuple[DataFrame, int]:
    """One cycle that does not fit as a whole: the rows taken in the order of `_k`, and the room left.

    Each round takes all rows before the first that does not fit, found by the ranges' sums and a
    running sum within one range. From there on only rows not larger than the room left can be
    taken, so the next round looks at no others, until few enough are left for a fold.
    """
    spark, size = rows.sparkSession, F.col("sequence_tokens")
    dealt = _dealt(rows, "_k")
    stops, rooms, folded = [], [], []
    while True:
        rest = dealt.where((size <= room) & (F.col("_k") > (stops[-1] if stops else "")))
        sums = sorted(tuple(r) for r in rest.groupBy("_p").agg(F.sum(size), F.count(F.lit(1))).collect())
        if sum(n for _, _, n in sums) <= FOLDED:
            for r in sorted(rest.select("_k", "record_id", "sequence_tokens").collect(), key=lambda r: r["_k"]):
                if r["sequence_tokens"] <= room:
                    room -= r["sequence_tokens"]
                    folded.append(tuple(r))
            break
        upto = list(accumulate(t for _, t, _ in sums))
        rooms.append(room)
        if upto[-1] <= room:
            room -= upto[-1]
            break
        at = next(i for i, t in enumerate(upto) if t > room)
        before = upto[at] - sums[at][1]
        running = F.sum(size).over(Window.partitionBy("_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        within = rest.where(F.col("_p") == sums[at][0]).withColumn("_upto", running).where(F.col("_upto") > room - before)
        stop, taken = within.agg(F.min("_k"), F.min_by(F.col("_upto") - size, "_k")).first()
        stops.append(stop)
        room -= before + taken
    after = F.array(*map(F.lit, stops)).cast("array<string>")
    room_of = F.get(F.array(*map(F.lit, rooms)).cast("array<bigint>"), F.size(F.filter(after, lambda s: s < F.col("_k"))))
    bulk = dealt.where((size <= room_of) & ~F.array_contains(after, F.col("_k"))).select("_k", "record_id", "sequence_tokens")
    return bulk.unionByName(spark.createDataFrame(folded, bulk.schema)), room


def greedy(df: DataFrame, id_: str, tokens: str, budget: int, seed: int, namespace: str, per_step: int) -> DataFrame:
    """Cycle after cycle in hash order, take each row that still fits the budget, until none does.

    While all rows that fit the room left fit it together, whole cycles are placed at once; any other
    cycle is filled in rounds (`_fill`). Cycles past MOST_CYCLES are an error. Rows larger than the
    budget never fit. Ids are unique. An empty table gives no items.
    """
    rows = _written(df.select(F.col(id_).cast("string").alias("record_id"), F.col(tokens).cast("long").alias("sequence_tokens")))
    parts, cycle, left = [rows.limit(0).select(F.lit("").alias("_k"), "record_id", "sequence_tokens", F.lit(0).alias("cycle"))], 0, budget
    while True:
        fits = rows.where(F.col("sequence_tokens") <= left)
        n, total = fits.agg(F.count(F.lit(1)), F.sum("sequence_tokens")).first()
        if not n:
            break
        # Rows without tokens always fit: alone they end only a budget that is used up.
        whole = left // total if total else 1 if left == 0 else MOST_CYCLES + 1
        if cycle + max(whole, 1) - 1 > MOST_CYCLES:
            raise RuntimeError("schedule cycle limit exceeded")
        if whole:
            placed = fits.withColumn("cycle", F.explode(F.sequence(F.lit(cycle), F.lit(cycle + whole - 1))))
            parts.append(placed.select(_key(seed, namespace, F.col("cycle")).alias("_k"), "record_id", "sequence_tokens", "cycle"))
            left -= whole * total
        else:
            taken, left = _fill(fits.withColumn("_k", _key(seed, namespace, cycle)), left)
            parts.append(taken.withColumn("cycle", F.lit(cycle)))
        cycle += max(whole, 1)
        if left <= 0:
            break
        if cycle > MOST_CYCLES:
            raise RuntimeError("schedule cycle limit exceeded")
    out = _dealt(reduce(DataFrame.unionByName, parts), "cycle", "_k")
    counts = sorted(tuple(r) for r in out.groupBy("_p").count().collect())
    starts = out.sparkSession.createDataFrame([(p, e - n) for (p, n), e in zip(counts, accumulate(n for _, n in counts))], "_p int, _start long")
    in_range = F.row_number().over(Window.partitionBy("_p").orderBy("cycle", "_k")) - 1
    out = out.withColumn("_i", in_range).join(F.broadcast(starts), "_p").withColumn("cursor", (F.col("_start") + F.col("_i")).cast("long"))
    return out.select(
        "cursor", "record_id", "sequence_tokens", "cycle", F.floor(F.col("cursor") / per_step).alias("accumulation_group"), (F.floor(F.col("cursor") / per_step) + 1).alias("optimizer_step")
    )


def whole_cycles(df: DataFrame, id_: str, tokens: str, cycles: int, seed: int, namespace: str, per_step: int) -> DataFrame:
    """Every row once in each cycle, in hash order."""
    n = df.count()
    return greedy(df, id_, tokens, cycles * (df.agg(F.coalesce(F.sum(tokens), F.lit(0))).first()[0] or 0), seed, namespace, per_step) if n else greedy(df, id_, tokens, 0, seed, namespace, per_step)


def totals(items: DataFrame, budget: int, warmup: float = 0.05, fractions: tuple[float, ...] = (0.5, 1.0)) -> DataFrame:
    """One row: items, processed and residual tokens, optimizer and warm-up steps, checkpoint steps."""
    steps = F.coalesce(F.max("optimizer_step"), F.lit(0))
    at = F.array_sort(F.array_distinct(F.array(*(F.greatest(F.lit(1), F.least(F.col("optimizer_steps"), F.ceil(F.col("optimizer_steps") * f))) for f in fractions))))
    return items.agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum("sequence_tokens"), F.lit(0)).alias("processed_tokens"), steps.alias("optimizer_steps")).select(
        "n_items", "processed_tokens", (F.lit(budget) - F.col("processed_tokens")).alias("residual_tokens"), "optimizer_steps", F.ceil(F.col("optimizer_steps") * warmup).alias("warmup_steps"), at.alias("checkpoint_steps")
    )


def exposures(items: DataFrame) -> DataFrame:
    """How often each record is seen."""
    return items.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.sum("sequence_tokens").alias("tokens"))


def check(items: DataFrame, lengths: DataFrame, per_step: int, budget: int) -> DataFrame:
    """One row of findings on a frozen schedule: each must be 0 or true for it to hold.

    lengths: record_id, sequence_tokens. Order arithmetic is checked row by row, gaps by counts.
    """
    joined = items.join(lengths.select("record_id", F.col("sequence_tokens").alias("_n")), "record_id", "left")
    step = F.floor(F.col("cursor") / per_step)
    return joined.agg(
        F.count_if(F.col("_n").isNull()).alias("unknown_records"), F.count_if(F.col("_n") != F.col("sequence_tokens")).alias("wrong_lengths"),
        F.count_if((F.col("accumulation_group") != step) | (F.col("optimizer_step") != step + 1)).alias("wrong_steps"),
        ((F.count(F.lit(1)) == 0) | ((F.min("cursor") == 0) & (F.max("cursor") == F.count(F.lit(1)) - 1) & (F.count_distinct("cursor") == F.count(F.lit(1))))).alias("gapless"),
        (F.coalesce(F.sum("sequence_tokens"), F.lit(0)) <= budget).alias("within_budget"),
    )

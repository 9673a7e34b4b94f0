"""Slots that take the first attempt whose keys are free, decided for many slots at a time.

Slots have an order; each has attempts in order, each attempt one or more keys. A slot takes its first
attempt none of whose keys is excluded or held by an earlier slot. That is a loop over slots, but an
answer is certain long before its turn: an attempt that is a slot's first free one is settled as
soon as no earlier slot that is still open could ask for any of its keys. So keys keep, in rounds, the
earliest slot that may ask for them; slots whose first free attempt is kept by all its keys settle,
attempts that meet a settled slot's key are gone, and what is left goes on. Rounds are as many as the
longest chain of slots each waiting for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, save

#: Attempts that are left and go through the loop itself, on the driver: some MB.
FEW = 20_000


def _loop(rows: list) -> list[tuple]:
    """The loop over slots, for the rest."""
    held: set[str] = set()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["slot"], r["attempt"])):
        if r["slot"] not in out and not held.intersection(r["keys"]):
            out[r["slot"]] = r["attempt"]
            held.update(r["keys"])
    return list(out.items())


def first_free(attempts: DataFrame, taken: DataFrame, few: int = FEW) -> DataFrame:
    """slot, attempt, keys, n_rejected, status for each slot of `attempts` (slot, attempt, keys: array of
    strings); `taken` has excluded keys (key).

    ACCEPTED slots have the attempt they take; EXHAUSTED ones, all of whose attempts collide, have nulls.
    n_rejected: attempts refused before. Slots and attempts are ordered by value; (slot, attempt) is
    unique. Null keys are none, and repeated ones count once.
    """
    attempts = save(attempts.select("slot", "attempt", F.array_distinct(F.filter("keys", lambda k: k.isNotNull())).alias("keys")), "attempts")
    gone = taken.where("key is not null").select("key").distinct()
    asks = attempts.select("slot", "attempt", F.explode("keys").alias("key"))
    bad = asks.join(gone, "key", "left_semi").select("slot", "attempt").distinct()
    state = save(attempts.join(bad, ["slot", "attempt"], "left_anti"), "open")
    settled: list[DataFrame] = []
    while True:
        if state.count() <= few:
            settled.append(attempts.sparkSession.createDataFrame(_loop(state.collect()), state.select("slot", "attempt").schema))
            break
        asks = state.select("slot", "attempt", F.explode("keys").alias("key"))
        asks = asks.join(asks.groupBy("key").agg(F.min("slot").alias("_best")), "key")
        first = state.groupBy("slot").agg(F.min("attempt").alias("attempt"))
        waits = asks.where("_best <> slot").select("slot", "attempt").distinct()
        won = save(first.join(waits, ["slot", "attempt"], "left_anti"), "settled")
        settled.append(won)
        keys = state.join(won, ["slot", "attempt"], "left_semi").select(F.explode("keys").alias("key"))
        left = state.join(won.select("slot"), "slot", "left_anti")
        lost = left.select("slot", "attempt", F.explode("keys").alias("key")).join(keys, "key", "left_semi").select("slot", "attempt").distinct()
        before, state = state, save(left.join(lost, ["slot", "attempt"], "left_anti"), "open")
        release(before)
    all_settled = settled[0]
    for s in settled[1:]:
        all_settled = all_settled.unionByName(s)
    taken_by = all_settled.select(F.col("slot").alias("_slot"), F.col("attempt").alias("_attempt"))
    joined = attempts.join(taken_by, F.col("slot") == F.col("_slot"), "left")
    chosen = F.col("attempt") == F.col("_attempt")
    return joined.groupBy("slot").agg(
        F.max("_attempt").alias("attempt"), F.max(F.when(chosen, F.col("keys"))).alias("keys"), F.count_if(F.col("_attempt").isNull() | (F.col("attempt") < F.col("_attempt"))).alias("n_rejected"),
        F.when(F.max("_attempt").isNull(), "EXHAUSTED").otherwise("ACCEPTED").alias("status"),
    )


def quota_slots(quotas: DataFrame, keys: list[str], quota: str, order: list[str]) -> DataFrame:
    """A row for each slot of each stratum's quota: `keys`, slot_in_group (from 0), and slot, an array that
    orders slots by `order` and then by their number. No global numbering, so no single task."""
    rows = quotas.where(F.col(quota) > 0).select(*keys, F.explode(F.sequence(F.lit(0), F.col(quota).cast("int") - 1)).alias("slot_in_group"))
    number = F.lpad(F.col("slot_in_group").cast("string"), 10, "0")
    return rows.withColumn("slot", F.concat_ws("\u001f", *(F.col(c).cast("string") for c in order), number))


def audits(filled: DataFrame, quotas: DataFrame, keys: list[str], quota: str, taken: DataFrame) -> DataFrame:
    """Findings that bar a pool from being committed, none if it is sound: finding, detail, n. A quota not
    met, a slot exhausted, a key held twice, a key that is excluded."""
    accepted = filled.where("status = 'ACCEPTED'")
    have = accepted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    short = quotas.select(*keys, quota).join(have, keys, "left").where(F.coalesce("_n", F.lit(0)) != F.col(quota))
    held = accepted.select(F.explode("keys").alias("key"))
    twice = held.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    barred = held.join(taken.select("key").distinct(), "key", "left_semi")
    parts = [
        short.select(F.lit("QUOTA_NOT_MET").alias("finding"), F.concat_ws("|", *keys).alias("detail"), (F.col(quota) - F.coalesce("_n", F.lit(0))).cast("long").alias("n")),
        filled.where("status = 'EXHAUSTED'").groupBy(F.concat_ws("|", *keys).alias("detail")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("ATTEMPTS_EXHAUSTED").alias("finding"), "detail", "n"),
        twice.select(F.lit("KEY_HELD_TWICE").alias("finding"), F.col("key").alias("detail"), F.col("_n").alias("n")),
        barred.groupBy(F.col("key").alias("detail")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("KEY_EXCLUDED").alias("finding"), "detail", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


"""Stage machines: which events of a run are legal, where it stands, and where it can go on.

A machine is a finite automaton. Its events in order are a fold; but what an event does is a map from
states to states, and maps compose. So in a batch the events are sorted by run and order in range
partitions, each partition folds its own runs, and for the run it starts in the middle of it gives
the composed map; one row for each partition tells the next where that run stands. A run of a third of
all events is folded in pieces like any other. In a stream each run's state is kept by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import save

SUMMARY = "state string, n_events long, n_illegal long, first_illegal long, resumes_at string"


@dataclass(frozen=True)
class Machine:
    """`legal`: (state, event) to the next state; any other event is illegal and leaves the state. `resume`:
    the event to go on with from a state, none where a run has ended."""

    start: str
    legal: dict[tuple[str, str], str]
    resume: dict[str, str]

    @property
    def states(self) -> list[str]:
        return sorted({self.start, *self.legal.values(), *(s for s, _ in self.legal)})

    @staticmethod
    def line(stages: list[str], failed: str = "failed") -> Machine:
        """Stages one after the other; a failure keeps the stage, and a stage can be repeated."""
        states = ["new", *stages]
        legal = {(a, b): b for a, b in zip(states, stages)} | {(s, s): s for s in stages} | {(s, failed): s for s in states}
        return Machine("new", legal, dict(zip(states, stages)))


@dataclass
class _Run:
    """What a fold knows after some events of a run."""

    state: str
    n: int = 0
    illegal: int = 0
    first: int | None = None

    def take(self, machine: Machine, event: str | None, at: int) -> bool:
        to = machine.legal.get((self.state, event))
        self.n += 1
        if to is None:
            self.illegal += 1
            self.first = at if self.first is None else self.first
            return False
        self.state = to
        return True


def runs(events: DataFrame, run: str, order: list[str], event: str, machine: Machine) -> DataFrame:
    """For each run: its last state, n_events, n_illegal, first_illegal (place in the run, from 0, of the
    first illegal event, null: none), resumes_at (the event to go on with, null: ended).

    `order` should be total within a run. A null event is illegal; a null run is a run of its own; an empty
    table has no runs. Rows equal in run and order are taken in any order of theirs.
    """
    kind = events.schema[run].dataType.simpleString()
    rows = events.select(F.col(run).cast("string").alias("run"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(event).cast("string").alias("event"))
    keys = ["run", *(f"o{i}" for i in range(len(order)))]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    states = machine.states
    schema = f"part int, piece int, run string, entry string, {SUMMARY}"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, piece, current, folds, out = TaskContext.get().partitionId(), 0, None, [], []

        def close() -> None:
            out.extend((part, piece, current, entry, r.state, r.n, r.illegal, r.first, None) for entry, r in folds)

        for frame in frames:
            for name, e in zip(_none(frame["run"]), _none(frame["event"])):
                if not folds or name != current:
                    if folds:
                        close()
                        piece += 1
                    # The first run of a partition may have begun before it: all states are folded at once.
                    current, folds = name, [(s, _Run(s)) for s in (states if piece == 0 else [machine.start])]
                for _, r in folds:
                    r.take(machine, e, r.n)
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        if folds:
            close()
            yield pd.DataFrame(out, columns=_COLUMNS)

    folded = save(spread.select("run", "event").mapInPandas(fold, schema), "folded")
    # A run lies in one partition, but for those that are a partition's first or last: those pieces are few.
    last = folded.groupBy("part").agg(F.max("piece").alias("_last"))
    folded = folded.join(F.broadcast(last), "part")
    edge = (F.col("piece") == 0) | (F.col("piece") == F.col("_last"))
    inner = folded.where(~edge).select("run", *_names())
    joined: dict[str | None, _Run] = {}
    pieces = sorted(folded.where(edge).collect(), key=lambda r: (r["part"], r["piece"]))  # at most states + 1 rows for each partition
    for _, rows_of in groupby(pieces, key=lambda r: (r["part"], r["piece"])):
        choices = {r["entry"]: r for r in rows_of}
        known = joined.setdefault(next(iter(choices.values()))["run"], _Run(machine.start))
        r = choices[known.state]
        if r["first_illegal"] is not None and known.first is None:
            known.first = known.n + r["first_illegal"]
        known.n, known.illegal, known.state = known.n + r["n_events"], known.illegal + r["n_illegal"], r["state"]
    edges = events.sparkSession.createDataFrame([(k, r.state, r.n, r.illegal, r.first, None) for k, r in joined.items()], f"run string, {SUMMARY}")
    return with_resume(inner.unionByName(edges), machine).withColumn("run", F.col("run").cast(kind)).withColumnRenamed("run", run)


def _none(texts: pd.Series) -> pd.Series:
    return texts.astype(object).where(texts.notna(), None)


_COLUMNS = ["part", "piece", "run", "entry", "state", "n_events", "n_illegal", "first_illegal", "resumes_at"]


def _names() -> list[str]:
    return _COLUMNS[4:]


def with_resume(df: DataFrame, machine: Machine) -> DataFrame:
    pairs = F.create_map(*(F.lit(x) for pair in machine.resume.items() for x in pair)) if machine.resume else F.create_map().cast("map<string,string>")
    return df.withColumn("resumes_at", F.try_element_at(pairs, F.col("state")))


def stream(events: DataFrame, run: str, order: list[str], event: str, machine: Machine) -> DataFrame:
    """The same of a stream, in update mode: each run's row whenever it has new events. Events of a run
    come in order from one trigger to the next; within a trigger they are sorted. Runs are not null."""
    columns = [run, *order, event]
    kind = events.schema[run].dataType.simpleString()

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r = _Run(*state.get) if state.exists else _Run(machine.start)
        if r.first is not None and r.first < 0:
            r.first = None
        batch = pd.concat(list(frames)).sort_values(order, kind="stable")
        for e in _none(batch[event]):
            r.take(machine, e, r.n)
        state.update((r.state, r.n, r.illegal, -1 if r.first is None else r.first))
        yield pd.DataFrame({run: [key[0]], "state": [r.state], "n_events": [r.n], "n_illegal": [r.illegal], "first_illegal": pd.array([r.first], "Int64"), "resumes_at": [machine.resume.get(r.state)]})

    grouped = events.select(*columns).groupBy(run)
    return grouped.applyInPandasWithState(update, f"{run} {kind}, {SUMMARY}", "state string, n long, illegal long, first long", "update", GroupStateTimeout.NoTimeout)

"""Convergence detection over a stream of (layout_id, step, speed, diagonal), one state per layout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.settle import WINDOW, Detector

OUTPUT = "layout_id long, step int, moving_average double, quiet_run int, converged boolean"


def detect(stream: DataFrame) -> DataFrame:
    """One row per step seen; the state is the window of speeds and the run length. Steps of one batch are put in order."""
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = Detector()
        if state.exists:
            speeds, d.quiet = state.get
            d.speeds.extend(speeds)
        rows = pd.concat(list(batches)).sort_values("step", kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            done = d.push(float(r.speed), float(r.diagonal))
            out.append((key[0], int(r.step), sum(d.speeds) / WINDOW if len(d.speeds) == WINDOW else float("nan"), d.quiet, done))
        state.update((list(d.speeds), d.quiet))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")])
    return stream.groupBy("layout_id").applyInPandasWithState(advance, OUTPUT, "speeds array<double>, quiet int", "append", GroupStateTimeout.NoTimeout)

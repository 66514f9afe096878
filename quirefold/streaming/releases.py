"""The release tracker as a keyed stateful stream.

The batch form is ``operators.activity.release_states``; over the same observations in the same order both give the same states.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, observed_at timestamp, tip int, seen int, release_number int, first_number int, released_at timestamp"
STATE = "seen int, release_number int, first_number int, released_at timestamp"


def step(seen: int, pending: tuple | None, tip: int, ongoing: bool, at: object) -> tuple[int, tuple | None]:
    """(seen, pending) after one observation; pending is (number, first, at) of a release, or None."""
    if seen > 0 and tip > seen and ongoing:
        first = min(pending[1], seen + 1) if pending else seen + 1
        pending = (tip, first, at)
    elif not ongoing or tip < seen:
        pending = None
    return max(seen, tip), pending


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, pending = 0, None
    if state.exists:
        seen, number, first, released = state.get
        pending = None if number is None else (number, first, released)
    out = []
    # Observations of a key within one micro-batch are few; they are put in order of time.
    for at, tip, ongoing in pd.concat(list(frames)).sort_values(["at", "tip"])[["at", "tip", "ongoing"]].itertuples(index=False):
        seen, pending = step(seen, pending, int(tip), bool(ongoing), at)
        out.append((key[0], at, int(tip), seen, *(pending or (None, None, pd.NaT))))
    state.update((seen, *((pending[0], pending[1], pending[2].to_pydatetime()) if pending else (None, None, None))))
    yield pd.DataFrame(out, columns=["key", "observed_at", "tip", "seen", "release_number", "first_number", "released_at"]).astype(
        {"release_number": "Int32", "first_number": "Int32", "released_at": "datetime64[us]"}
    )


def track(observations: DataFrame) -> DataFrame:
    """The state after each observation of a stream with key, at, tip and ongoing."""
    return observations.groupBy("key").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(observations: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Works off what is there and stops, as a periodic poll does; the states so far, from the Parquet files at ``path``.

    The checkpoint carries the state to the next run, and with it each observation is written exactly once.
    """
    query = track(observations).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return observations.sparkSession.read.schema(OUTPUT).parquet(path)

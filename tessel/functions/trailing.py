"""Trailing statistics at months' ends, inside tasks that get whole symbols in order of days.

Only the rows that end a month are computed, all of a batch together: each step adds one more day of every window, oldest
first, as the built-in aggregates do over a frame, so that results equal theirs bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows gathered before the symbols that are complete among them are worked on.
GATHERED = 64_000
STATISTICS = ("avg_dv_21", "ma_252", "sharpe_3m", "vol_21", "illiq_21")


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column's numbers, and where it has any."""
    return column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _divided(a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a / b, without a value where b is zero."""
    has = has_a & has_b & (b != 0)
    return a / np.where(has, b, 1.0), has


def _window(x: np.ndarray, has: np.ndarray, first: np.ndarray, at: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, population deviation, whether there are `least` values) of the n rows to each place `at`, none before `first`."""
    count, total, mean, spread = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
    for back in range(n - 1, -1, -1):
        row = at - back
        own = (row >= first) & has[row]  # a place before the batch is before `first` too
        v = x[row]
        count = count + own
        total = np.where(own, total + v, total)
        d = v - mean
        step = d / np.maximum(count, 1.0)
        spread = np.where(own, spread + d * (d - step), spread)
        mean = np.where(own, mean + step, mean)
    known = count >= least
    size = np.where(known, count, 1.0)
    return total / size, np.sqrt(spread / size), known


def _month_ends(rows: pa.Table, schema: pa.Schema, strict: bool) -> pa.RecordBatch:
    """The rows of whole symbols that end a month, with their statistics."""
    column = {name: rows.column(name).combine_chunks() for name in rows.column_names}
    close, has_close = _values(column["close"])
    volume, has_volume = _values(column["dollar_vol"])
    place = np.arange(len(close))
    first = np.maximum.accumulate(np.where(_starts(column["symbol"]), place, 0))
    filled_from = np.maximum.accumulate(np.where(has_close, place, -1))
    has_filled = filled_from >= first
    filled = close[filled_from]
    before = np.maximum(place - 1, 0)
    ret, has_ret = _divided(filled, has_filled, filled[before], has_filled[before] & (place > first))
    ret = ret - 1
    illiquid, has_illiquid = _divided(np.abs(ret), has_ret, volume, has_volume)

    at = np.flatnonzero(column["last"].fill_null(False).to_numpy(zero_copy_only=False))
    where = pa.array(at)
    day, end = column["date"].take(where), column["month_end"].take(where)
    asked = np.ones(len(at), bool)
    if strict:
        asked = pc.equal(day, end).fill_null(False).to_numpy(zero_copy_only=False)
    some, low = at[asked], first[at[asked]]
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    mean, _, known = _window(volume, has_volume, low, some, 21, 10)
    found["avg_dv_21"] = mean, known
    mean, _, known = _window(close, has_close, low, some, 252, 126)
    found["ma_252"] = mean, known
    mean, spread, known = _window(ret, has_ret, low, some, 63, 40)
    found["sharpe_3m"] = _divided(mean, known, spread, known)
    _, spread, known = _window(ret, has_ret, low, some, 21, 15)
    found["vol_21"] = spread, known
    mean, _, known = _window(illiquid, has_illiquid, low, some, 21, 15)
    found["illiq_21"] = mean, known

    def full(name: str) -> pa.Array:
        values, known, (v, k) = np.zeros(len(at)), np.zeros(len(at), bool), found[name]
        values[asked], known[asked] = v, k
        return pa.array(values, mask=~known)

    columns = [column["symbol"].take(where), day, end, column["close"].take(where).cast(pa.float64()), *map(full, STATISTICS)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _starts(symbol: pa.Array) -> np.ndarray:
    """Where another symbol begins; the first row of all is one."""
    codes = symbol.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def month_ends(strict: bool, gathered: int = GATHERED):
    """For mapInArrow over (symbol, date, month_end, last, close, dollar_vol), whole symbols in order of days."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        schema = None
        with np.errstate(all="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                if schema is None:
                    s = batch.schema
                    schema = pa.schema([s.field("symbol"), s.field("date"), s.field("month_end"), pa.field("close", pa.float64()), *[pa.field(n, pa.float64()) for n in STATISTICS]])
                held.append(batch)
                if sum(b.num_rows for b in held) < gathered:
                    continue
                rows = pa.Table.from_batches(held)
                begun = int(np.flatnonzero(_starts(rows.column("symbol").combine_chunks()))[-1])  # the last symbol may go on
                if begun:
                    yield _month_ends(rows.slice(0, begun), schema, strict)
                held = rows.slice(begun).to_batches()
            if held:
                yield _month_ends(pa.Table.from_batches(held), schema, strict)

    return run

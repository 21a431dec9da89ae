"""Recursions over series of any length, by composable maps.

A recursion such as an exponential average is an affine map of its state: whatever the
rows between, the state after them is P * state + Q.  A series is cut into chunks of
rows; every chunk tells its P and Q, a pass over the chunks alone gives each chunk the
state that it starts with, and then all chunks run side by side.  So a series with all
rows of a table is spread over as many tasks as it has chunks, where ``recursive.scan``
needs a task per key.  Results are those of ``scan``, seeds and gaps included.

Recursions over other recursions (an average of an average) take one round for each
level.  The trailing stops and the double stochastic are no affine maps: ``scan`` has them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import recursive
from tickloom.functions.rolling import ROLLING, percent_of
from tickloom.functions.totals import running_totals
from tickloom.sources.tables import stored

#: Rows of a chunk.
CHUNK = 50_000
NAN = float("nan")


def _trailing(x: np.ndarray) -> int:
    """Rows after the last value."""
    known = np.flatnonzero(~np.isnan(x))
    return len(x) - 1 - int(known[-1]) if len(known) else len(x)


@dataclass
class State:
    """What a recursion carries from row to row: `y`, or the rows it still collects for
    its seed; `gap` rows without a value since y; `count` values; the last inputs."""

    y: float = NAN
    gap: int = 0
    count: int = 0
    begun: bool = False
    seed: list = field(default_factory=list)
    last: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Smooth:
    """y += alpha * (x - y) from a seed: the mean (times `scale`) of the first `collect`
    rows from the first value on, after `skip` of them.  A row without a value keeps y; its
    weight decays, except with `hold`, where a second input says which rows count."""

    alpha: float
    collect: int = 1
    skip: int = 0
    scale: float = 1.0
    out: float = 1.0
    least: int = 1
    hold: bool = False
    at: int | None = None      # row of the seed where it does not follow from the first value

    @property
    def reach(self) -> int:
        return max(self.collect + self.skip, (self.at or 0) + 1)

    def run(self, state: State, x: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, State]:
        st, y, i = replace(state, seed=list(state.seed)), np.full(len(x), NAN), 0
        counts = np.cumsum(~np.isnan(x)) + st.count
        if not st.begun:
            if not st.seed:
                # a chunk holds more rows than any seed, so this is the first one
                i = recursive._first_valid(x) if self.at is None else min(self.at - self.collect + 1, len(x))
            full = self.collect + self.skip
            take = min(full - len(st.seed), len(x) - i)
            st.seed += x[i:i + take].tolist()
            i += take
            if len(st.seed) == full and take > 0:
                st.y, st.begun, st.gap = float(np.mean(st.seed[self.skip:])) * self.scale, True, 0
                y[i - 1] = st.y
        if st.begun and i < len(x):
            rest = x[i:]
            if self.hold:
                keep = used[i:].astype(bool)
                y[i:], st.y = self._held(st.y, rest, keep)
            elif np.isnan(st.y):
                got = pd.Series(rest).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()
                y[i:] = got
                st.y, st.gap = got[-1], _trailing(rest)
            else:
                before = np.concatenate(([st.y], np.full(st.gap, NAN)))
                got = pd.Series(np.concatenate((before, rest))).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()
                y[i:] = got[len(before):]
                st.gap = st.gap + len(rest) if np.isnan(rest).all() else _trailing(rest)
                st.y = got[-1]
        st.count = int(counts[-1]) if len(x) else st.count
        if self.least > 1:
            y = np.where(counts >= self.least, y, NAN)
        return y * self.out, st

    def _held(self, y: float, x: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, float]:
        out = np.full(len(x), NAN)
        got = recursive._smooth(np.concatenate(([y], x[keep])), self.alpha, 0, y)
        out[keep] = got[1:]
        out = pd.Series(np.concatenate(([y], out))).ffill().to_numpy()[1:]
        return out, float(got[-1])

    def tell(self, x: np.ndarray, used: np.ndarray | None = None) -> dict:
        """The map of rows for a state that has begun: the first value, then P and Q."""
        keep = used.astype(bool) if self.hold else ~np.isnan(x)
        at = np.flatnonzero(keep)
        if not len(at):
            return {"lead": len(x), "any": False, "count": int((~np.isnan(x)).sum())}
        zero = x[at[0]:].copy() if not self.hold else x[at].copy()
        zero[0] = 0.0
        steps = np.diff(at) if not self.hold else np.ones(len(at) - 1)
        old = (1 - self.alpha) ** steps
        return {"lead": int(at[0]), "any": True, "first": float(x[at[0]]), "count": int((~np.isnan(x)).sum()),
                "p": float(np.prod(old / (old + self.alpha))), "q": float(pd.Series(zero).ewm(alpha=self.alpha, adjust=False).mean().iloc[-1]),
                "trail": int(len(x) - 1 - at[-1])}

    def pass_over(self, st: State, told: dict) -> State:
        if not told["any"]:
            return replace(st, gap=st.gap + told["lead"], count=st.count + told["count"])
        if np.isnan(st.y):
            first = told["first"]
        else:
            old = (1 - self.alpha) ** (1 if self.hold else 1 + st.gap + told["lead"])
            first = (old * st.y + self.alpha * told["first"]) / (old + self.alpha)
        return replace(st, y=told["p"] * first + told["q"], gap=told["trail"], count=st.count + told["count"])


@dataclass
class Adaptive:
    """``recursive.adaptive``: the weight of a row follows from the n rows before it."""

    n: int

    @property
    def reach(self) -> int:
        return self.n

    def _weights(self, x: np.ndarray) -> np.ndarray:
        """Of the rows from the n-th on."""
        move = x[self.n:] - x[:-self.n]
        path = np.convolve(np.abs(np.diff(x)), np.ones(self.n), "valid")
        er = np.where((path <= move) | (path == 0), 1.0, np.abs(move) / np.where(path == 0, 1, path))
        return (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2

    def run(self, state: State, x: np.ndarray) -> tuple[np.ndarray, State]:
        known = np.concatenate((state.last, x))
        st, out, before = replace(state), np.full(len(known), NAN), len(state.last)
        if len(known) > self.n or (st.begun and len(x)):
            y = st.y if st.begun else known[self.n - 1]
            first = before if st.begun else self.n
            if first < len(known):
                weight = self._weights(known)[first - self.n:]
                for i, (w, v) in enumerate(zip(weight.tolist(), known[first:].tolist()), first):
                    y += (v - y) * w
                    out[i] = y
                st.y, st.begun = y, True
        st.last = known[-self.n:]
        return out[before:], st

    def tell(self, x: np.ndarray, before: np.ndarray) -> dict:
        weight = self._weights(np.concatenate((before, x)))
        p, q = 1.0, 0.0
        for w, v in zip(weight.tolist(), x.tolist()):
            p, q = p * (1 - w), q + (v - q) * w
        return {"p": p, "q": q, "last": np.concatenate((before, x))[-self.n:]}

    def pass_over(self, st: State, told: dict) -> State:
        return replace(st, y=told["p"] * st.y + told["q"], last=told["last"])


@dataclass
class Previous:
    """The value n rows before."""

    n: int

    @property
    def reach(self) -> int:
        return self.n

    def run(self, state: State, x: np.ndarray) -> tuple[np.ndarray, State]:
        known = np.concatenate((np.full(self.n - len(state.last), NAN), state.last, x))
        return known[:len(x)], replace(state, last=known[-self.n:])

    def tell(self, x: np.ndarray, before: np.ndarray) -> dict:
        return {"last": np.concatenate((before, x))[-self.n:]}

    def pass_over(self, st: State, told: dict) -> State:
        return replace(st, last=told["last"])


@dataclass
class Windowed:
    """A statistic of a trailing window (functions/rolling.py): the rows it needs are carried."""

    kernel: str
    params: dict

    @property
    def reach(self) -> int:
        return self.params["n"] + self.params.get("shift", 0)

    def run(self, state: State, x: np.ndarray) -> tuple[np.ndarray, State]:
        known = np.concatenate((state.last, x))
        y = ROLLING[self.kernel](known, **self.params)
        return y[len(state.last):], replace(state, last=known[-self.reach:])

    tell, pass_over = Previous.tell, Previous.pass_over

    @property
    def n(self) -> int:
        return self.reach


@dataclass
class Compound:
    start: float
    reach = 0

    def run(self, state: State, x: np.ndarray) -> tuple[np.ndarray, State]:
        y = (state.y if state.begun else 1.0) * np.cumprod(1.0 + np.nan_to_num(x))
        return self.start * y, replace(state, y=float(y[-1]) if len(y) else state.y, begun=state.begun or len(x) > 0)

    def tell(self, x: np.ndarray) -> dict:
        return {"p": float(np.prod(1.0 + np.nan_to_num(x)))}

    def pass_over(self, st: State, told: dict) -> State:
        return replace(st, y=st.y * told["p"])


def recursion(kernel: str, params: dict):
    """The map of a kernel of ``recursive``."""
    n = params.get("n")
    made = {"ema": lambda: Smooth(2.0 / (n + 1), n, at=params.get("at")), "wilder": lambda: Smooth(1.0 / n, n),
            "ewm": lambda: Smooth(2.0 / (params["span"] + 1), least=params.get("min_periods", 1)),
            "decayed_sum": lambda: Smooth(1.0 / n, n - 1, scale=(n - 1) / n, out=n),
            "held": lambda: Smooth(1.0 / n, n, skip=1, hold=True),
            "adaptive": lambda: Adaptive(n), "previous": lambda: Previous(n), "compound": lambda: Compound(params["start"])}
    if kernel in made:
        return made[kernel]()
    return Windowed(kernel, params) if kernel in ROLLING else None


def _dx(p, m, t):
    both = p + m
    dx = np.divide(100 * np.abs(p - m), both, out=np.zeros(len(p)), where=(both > 0) & (t > 0))
    return np.where(np.isnan(t), NAN, dx)


def _usable(p, m, t):
    return ((p + m > 0) & (t > 0)).astype(float)


def rise(x):
    return np.maximum(x, 0.0)


def fall(x):
    return np.maximum(-x, 0.0)


POINTWISE = {name: recursive.KERNELS[name] for name in ("difference", "band", "strength", "where_known")} | {
    "_dx": _dx, "_usable": _usable, "rise": rise, "fall": fall, "percent_of": percent_of}


def _unfolded(steps: Iterable) -> list[tuple]:
    """Steps with the directional index as three sums, their ratio and an average."""
    out = []
    for name, kernel, inputs, params in steps:
        if kernel == "directional_index":
            sums = [f"_{name}_{k}" for k in "pmt"]
            out += [(s, "decayed_sum", (i,), {"n": params["n"]}) for s, i in zip(sums, inputs)]
            out += [(f"_{name}_dx", "_dx", tuple(sums), {}), (f"_{name}_used", "_usable", tuple(sums), {}),
                    (name, "held", (f"_{name}_dx", f"_{name}_used"), {"n": params["n"]})]
        elif kernel in POINTWISE or recursion(kernel, params):
            out.append((name, kernel, tuple(inputs), params))
        else:
            raise ValueError(f"{kernel} is no composable map; use recursive.scan")
    return out


def _rounds(steps: list[tuple]) -> list[list[tuple]]:
    """Steps by level: a recursion comes a level after what it reads."""
    level: dict[str, int] = {}
    for name, kernel, inputs, _ in steps:
        level[name] = max((level.get(i, 0) for i in inputs), default=0) + (kernel not in POINTWISE)
    return [[s for s in steps if level[s[0]] == k] for k in range(max(level.values(), default=0) + 1)]


def _arrays(table: pa.Table, names: Iterable[str]) -> dict[str, np.ndarray]:
    return {n: table.column(n).to_numpy().astype(float) for n in dict.fromkeys(names)}


def _filled_in(table: pa.Table, have: dict[str, np.ndarray], steps: list[tuple], states: dict) -> None:
    """The columns of `steps` from the states before the chunk, added to `have`."""
    for name, kernel, inputs, params in steps:
        x = [have[i] for i in inputs]
        have[name] = POINTWISE[kernel](*x, **params) if kernel in POINTWISE else recursion(kernel, params).run(states[name], *x)[0]


def _inputs(table: pa.Table, steps: list[tuple]) -> dict[str, np.ndarray]:
    made = {s[0] for s in steps}
    return _arrays(table, [i for s in steps for i in s[2] if i not in made])


def _states(start: pa.Table) -> dict:
    return {name: st for told in start.column("start").to_pylist() for name, st in cloudpickle.loads(told).items()}


def _told(done: list[tuple], steps: list[tuple]):
    """One row per chunk: of every recursion the state after the chunk as the first one,
    its first rows, and the map of the others.  The steps in `done` are computed again from
    the states that they start with."""
    def run(table: pa.Table, start: pa.Table | None = None) -> pa.Table:
        table = table.sort_by("__row")
        have, out = _inputs(table, [*done, *steps]), {}
        with np.errstate(all="ignore"):
            _filled_in(table, have, done, _states(start) if start is not None else {})
            for name, kernel, inputs, params in steps:
                r, x = recursion(kernel, params), [have[i] for i in inputs]
                head, rest = [a[:r.reach] for a in x], [a[r.reach:] for a in x]
                told = None
                if len(rest[0]):
                    told = r.tell(rest[0], head[0]) if isinstance(r, Adaptive | Previous | Windowed) else r.tell(*rest)
                out[name] = (r.run(State(), *x)[1], head, told)
        return pa.table({"key": table.column("key").slice(0, 1), "__chunk": table.column("__chunk").slice(0, 1),
                         "told": pa.array([cloudpickle.dumps(out)], pa.binary())})

    return run if any(s[1] not in POINTWISE for s in done) else lambda table: run(table)


def _started(steps: list[tuple]):
    """The state before every chunk of a key, from what its chunks tell."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__chunk")
        states = {name: State() for name, *_ in steps}
        starts = []
        with np.errstate(all="ignore"):
            for told in table.column("told").to_pylist():
                starts.append(cloudpickle.dumps(states))
                chunk, after = cloudpickle.loads(told), {}
                for name, kernel, _, params in steps:
                    r, st = recursion(kernel, params), states[name]
                    fresh, head, rest = chunk[name]
                    if not st.begun and not st.seed and not len(st.last):
                        after[name] = fresh
                        continue
                    st = r.run(st, *head)[1]
                    after[name] = r.pass_over(st, rest) if rest is not None else st
                states = after
        return pa.table({"key": table.column("key"), "__chunk": table.column("__chunk"), "start": pa.array(starts, pa.binary())})

    return run


def _filled(steps: list[tuple]):
    def run(rows: pa.Table, start: pa.Table) -> pa.Table:
        rows = rows.sort_by("__row")
        have = _inputs(rows, steps)
        with np.errstate(all="ignore"):
            _filled_in(rows, have, steps, _states(start))
        for name, *_ in steps:
            rows = rows.append_column(name, pa.array(have[name], pa.float64(), from_pandas=True))
        return rows

    return run


def scan_long(df: DataFrame, steps: list[tuple[str, str, tuple, dict]], order: tuple[str, ...] = ("ts",),
              chunk: int = CHUNK) -> DataFrame:
    """``recursive.scan`` for keys of any length, with three more steps: `previous` (the
    value n rows before), `rise` and `fall` (the positive part of x and of -x).  Rows are ordered by `order`, which tells
    the rows of a key apart.  `chunk` is the number of rows that a task holds; it should be
    longer than the longest seed.  A null key is a series of its own."""
    asked = [s[0] for s in steps]
    steps = _unfolded(steps)
    rounds = _rounds(steps)
    reach = max([recursion(k, p).reach for _, k, _, p in steps if k not in POINTWISE], default=0)
    if chunk <= reach:
        raise ValueError(f"a chunk needs more than {reach} rows")
    rows = running_totals(df, ["key"], [F.col(c) for c in order], {"__row": F.lit(1)})
    rows = rows.withColumn("__chunk", F.floor(F.col("__row") / chunk))
    key, done, starts = rows.schema["key"], [], None
    small = T.StructType([key, T.StructField("__chunk", T.LongType()), T.StructField("told", T.BinaryType())])
    ends = T.StructType([key, T.StructField("__chunk", T.LongType()), T.StructField("start", T.BinaryType())])
    # a round moves its inputs only; what earlier rounds made is made again from a state per chunk
    for plain in filter(None, rounds):
        if work := [s for s in plain if s[1] not in POINTWISE]:
            made = {s[0] for s in done}
            needed = list(dict.fromkeys(i for s in [*done, *work] for i in s[2] if i not in made))
            chunks = rows.select("key", "__chunk", "__row", *needed).groupBy("key", "__chunk")
            told = chunks.applyInArrow(_told(done, work), small) if starts is None else \
                chunks.cogroup(starts.groupBy("key", "__chunk")).applyInArrow(_told(done, work), small)
            # one row per chunk
            new = stored(told.groupBy("key").applyInArrow(_started(work), ends))
            starts = new if starts is None else starts.unionAll(new)
        done += plain
    if starts is None:
        starts = rows.select("key", "__chunk").distinct().withColumn("start", F.lit(cloudpickle.dumps({})))
    schema = T.StructType(rows.schema.fields + [T.StructField(s[0], T.DoubleType()) for s in done])
    rows = rows.groupBy("key", "__chunk").cogroup(starts.groupBy("key", "__chunk")).applyInArrow(_filled(done), schema)
    return rows.select(*df.columns, *asked)

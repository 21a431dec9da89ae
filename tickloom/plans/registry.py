"""Feature registry: named columns, what they read, and how a table is built.

A definition is a function of ``c``; reading ``c.close`` both returns the column
and records the dependency.  ``build`` takes the names a caller wants, follows
the dependencies, and emits one ``select`` per dependency level, so every shared
intermediate is computed once and unused ones never enter the plan.  Recursive
columns are gathered into a single grouped pass between the levels that feed it
and the levels that use it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import frames as W
from tickloom.functions.long_scan import scan_long
from tickloom.functions.recursive import scan

BASE = ("key", "ts", "open", "high", "low", "close", "volume", "vix", W.ROW)


class _Reader:
    def __init__(self):
        self._seen: dict[str, Column] = {}

    def __getattr__(self, name: str) -> Column:
        if name not in self._seen:
            self._seen[name] = F.col(name)
        return self._seen[name]

    __getitem__ = __getattr__


@dataclass
class Feature:
    name: str
    group: str
    define: Callable[[_Reader], Column] | None = None
    step: tuple | None = None          # (kernel, inputs, parameters)
    weekly: str | None = None          # column of the weekly series to bring down
    lookahead: bool = False

    def resolve(self, windows: W.SharedWindows) -> Node:
        if self.step:
            return Node(self, tuple(self.step[1]))
        if self.define:
            reader = _Reader()
            with windows.collecting() as used:
                column = self.define(reader)
            return Node(self, tuple(reader._seen), column, used)
        return Node(self, ())


@dataclass
class Node:
    """A feature as one plan uses it: what it reads, and its column."""
    feature: Feature
    deps: tuple[str, ...]
    column: Column | None = None
    windows: set[str] | None = None


FEATURES: dict[str, Feature] = {}
GROUPS: dict[str, list[str]] = {}


def _add(f: Feature) -> None:
    if f.name in FEATURES:
        raise ValueError(f"column defined twice: {f.name}")
    FEATURES[f.name] = f
    if not f.name.startswith("_"):
        GROUPS.setdefault(f.group, []).append(f.name)


def group(gid: str, *, lookahead: bool = False):
    """Decorator: the function returns ``{name: definition}`` for one group.

    A definition is a function of the reader, a recursive step from ``step`` or
    a weekly column from ``weekly``.  Names with a leading underscore are
    intermediates."""
    def wrap(fn):
        for name, d in fn().items():
            if isinstance(d, Feature):
                _add(Feature(name, gid, step=d.step, weekly=d.weekly))
            else:
                _add(Feature(name, gid, define=d, lookahead=lookahead))
        return fn
    return wrap


def step(kernel: str, *inputs: str, **params) -> Feature:
    return Feature("", "", step=(kernel, inputs, params))


def weekly(column: str) -> Feature:
    return Feature("", "", weekly=column)


def closure(names: Iterable[str], windows: W.SharedWindows | None = None) -> dict[str, Node]:
    """The wanted columns and everything they read, dependencies first."""
    out: dict[str, Node] = {}
    windows = windows or W.SharedWindows()

    def visit(n: str):
        if n in BASE or n in out:
            return
        node = FEATURES[n].resolve(windows)
        for d in node.deps:
            visit(d)
        out[n] = node

    for n in names:
        visit(n)
    return out


def is_lookahead(name: str) -> bool:
    return any(n.feature.lookahead for n in closure([name]).values())


def _emit(df: DataFrame, nodes: dict[str, Node], windows: W.SharedWindows) -> DataFrame:
    """Add plain definitions level by level; columns already present are skipped.

    A level is two selects: its window calls, each once, and what is made of them."""
    have = set(df.columns)
    todo = {n: node for n, node in nodes.items() if n not in have}
    while todo:
        ready = [n for n, node in todo.items() if all(d in have for d in node.deps)]
        if not ready:
            raise ValueError(f"unresolved columns: {sorted(todo)}")
        calls = set().union(*[todo[n].windows for n in ready]) - have
        if calls:
            df = df.select("*", *windows.named(calls))
        df = df.select("*", *[todo[n].column.alias(n) for n in ready])
        have.update(ready)
        have.update(calls)
        for n in ready:
            del todo[n]
    return df


def _feeding(nodes: dict[str, Node], steps: dict[str, Node]) -> dict[str, Node]:
    """Plain columns that the recursive pass reads, directly or not."""
    wanted: set[str] = set()

    def visit(n: str):
        if n not in BASE and n not in wanted:
            if nodes[n].feature.step:
                raise ValueError(f"{n}: a recursive column may read another one only directly")
            wanted.add(n)
            for d in nodes[n].deps:
                visit(d)

    for node in steps.values():
        for d in node.deps:
            if d not in steps:
                visit(d)
    return {n: node for n, node in nodes.items() if n in wanted}


def _following(nodes: dict[str, Node], steps: dict[str, Node]) -> set[str]:
    """Plain columns that read the recursive pass, directly or not; nodes come dependencies first."""
    out: set[str] = set()
    for n, node in nodes.items():
        if n not in steps and any(d in steps or d in out for d in node.deps):
            out.add(n)
    return out


def build(bars: DataFrame, names: Iterable[str], vix: DataFrame | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Bars -> ``key, ts`` and the named columns, one row per bar.

    ``vix`` is an optional second series ``(ts, vix)``, aligned by exact date.
    ``chunk_rows`` runs the recursions in chunks of so many rows (functions/long_scan.py)
    instead of a task per key."""
    from tickloom.operators.align import align_second_series, weekly_to_daily

    names = list(names)
    windows = W.SharedWindows()
    nodes = closure(names, windows)
    df = bars
    if any("vix" in node.deps for node in nodes.values()):
        if vix is None:
            raise ValueError("these columns need a second series")
        df = align_second_series(df, vix)
    wk = {n: node.feature.weekly for n, node in nodes.items() if node.feature.weekly}
    if wk:
        df = weekly_to_daily(df, wk)
    df = df.withColumn(W.ROW, W.row_index())

    steps = {n: node for n, node in nodes.items() if node.feature.step}
    plain = {n: node for n, node in nodes.items() if node.column is not None}
    if steps:
        feeding, after = _feeding(nodes, steps), _following(nodes, steps)
        if any(plain[n].windows for n in after):
            df = _emit(df, feeding, windows)
        else:
            # all windows come before the pass, so nothing after it needs the rows by key again
            df = _emit(df, {n: node for n, node in plain.items() if n not in after}, windows)
            read = {"key", "ts", *names, *(i for node in steps.values() for i in node.deps), *(d for n in after for d in plain[n].deps)}
            df = df.select(*[c for c in df.columns if c in read])
            plain = {n: plain[n] for n in plain if n in after}
        todo = [(n, *node.feature.step) for n, node in steps.items()]
        df = scan_long(df, todo, chunk=chunk_rows) if chunk_rows else scan(df, todo)
    df = _emit(df, plain, windows)
    return df.select("key", "ts", *names)

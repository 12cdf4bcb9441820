"""Minimum-cost parse of a CSV record: the fewest quotes and separators to insert or delete.

A record is read as a string over four classes: quote, separator, line break and anything else
(runs of which count as one symbol). Four states describe a cell: at its start, in a bare cell,
inside quotes, after a quote that may close the cell or begin a doubled quote. Copying a symbol
costs nothing, inserting or deleting a quote or a separator costs one. `parse` searches the
table (symbol, state, cell number) in order of cost so far plus a lower bound of the cost to the
end. The bound is exact but for the number of cells, of which it tells only one too many, several
too many and too few apart; missing cells count one each. So the search keeps near the cheapest
parse at any number of symbols and cells. Records of plain cells only are settled by counting.

The edit operations state the reason. `free_cost` is the same table without the cell number: if
the cheapest parse into any number of cells needs edits, the record fails by `quoting`; if only
that into the header's number does, by `columns`; if neither does, it has cost zero and its cells.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_START, _BARE, _QUOTED, _AFTER = range(4)
_SYMBOL = re.compile(r'"|,|\r|\n|[^",\r\n]+')
#: Cells too many, as the bound sees them: fewer than none, none, one, more. What one more or one less can lead to.
_LESS, _MORE = ((0,), (0,), (1,), (2, 3)), ((0, 1), (2,), (3,), (3,))
_FAR = 60_000
PARSED = "cells array<string>, n int, reason string, edits string"


def _copy(state: int, kind: str) -> int | None:
    """State after copying a symbol, -1 for the start of the next cell, None if no cell allows it."""
    if state == _QUOTED:
        return _AFTER if kind == '"' else _QUOTED
    if kind == '"':
        return {_START: _QUOTED, _AFTER: _QUOTED}.get(state)
    if kind == ",":
        return -1
    return _BARE if kind == "x" and state in (_START, _BARE) else None


def _symbols(raw: str) -> list[tuple[str, str]]:
    return [(t if t in '",' else "n" if t in "\r\n" else "x", t) for t in _SYMBOL.findall(raw)]


def free_cost(symbols: list[tuple[str, str]]) -> tuple[int, list[str] | None]:
    """(cost, cells) of the cheapest parse into any number of cells; the cells only of a parse without edits.

    One row of the table, a cost for each state, is kept; while the parse of cost zero lives, its
    cells are too. There is at most one, as every symbol has one way to be copied.
    """
    free: int | None = _START
    cells: list[str] = []
    part: list[str] = []
    for kind, text in symbols:
        after = _copy(free, kind)
        if after == -1:
            cells.append("".join(part))
            part, free = [], _START
            continue
        if kind != '"' or (free, after) == (_AFTER, _QUOTED):
            part.append(text)
        free = after
        if free is None:
            break
    if free is not None and free != _QUOTED:
        return 0, [*cells, "".join(part)]
    costs = _settled([0, _FAR, _FAR, _FAR])
    for kind, _ in symbols:
        later = [_FAR] * 4
        for state, cost in enumerate(costs):
            after = _copy(state, kind)
            if after is not None:
                after = _START if after == -1 else after
                later[after] = min(later[after], cost)
            if kind in '",':
                later[state] = min(later[state], cost + 1)
        costs = _settled(later)
    return min(costs[_START], costs[_BARE], costs[_AFTER]), None


def zero_cost(symbols: list[tuple[str, str]]) -> list[str] | None:
    """Cells of a record that needs no edit, else None."""
    return free_cost(symbols)[1]


def _settled(costs: list[int]) -> list[int]:
    """Costs of the states after inserting quotes and separators where that is cheaper."""
    while True:
        better = list(costs)
        for state, cost in enumerate(costs):
            after = _copy(state, '"')
            if after is not None:
                better[after] = min(better[after], cost + 1)
            if state != _QUOTED:
                better[_START] = min(better[_START], cost + 1)
        if better == costs:
            return costs
        costs = better


def _moves() -> tuple[dict[str, list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Steps between places (4 * state + cells too many): per symbol kind (from, to, price), and (from, to) of insertions."""
    over, still = {k: [] for k in '",xn'}, []
    for state in range(4):
        for e in range(4):
            for kind, steps in over.items():
                after = _copy(state, kind)
                if after is not None:
                    swallowed = kind == "," and state == _QUOTED
                    steps += [(4 * state + e, 4 * (_START if after == -1 else after) + to, 0) for to in (_LESS[e] if swallowed else (e,))]
                if kind in '",':
                    steps += [(4 * state + e, 4 * state + to, 1) for to in (_LESS[e] if kind == "," else (e,))]
            if _copy(state, '"') is not None:
                still.append((4 * state + e, 4 * _copy(state, '"') + e))
            if state != _QUOTED:
                still += [(4 * state + e, 4 * _START + to) for to in _MORE[e]]
    return over, still


_OVER, _STILL = _moves()


def _bounds(kinds: list[str]) -> array:
    """Least cost to the end from each symbol and place, 16 numbers a symbol."""
    now = [0 if e == 1 and state != _QUOTED else _FAR for state in range(4) for e in range(4)]
    out = array("H", bytes(32 * (len(kinds) + 1)))
    for i in range(len(kinds), -1, -1):
        if i < len(kinds):
            later, now = now, [_FAR] * 16
            for a, b, price in _OVER[kinds[i]]:
                if later[b] + price < now[a]:
                    now[a] = later[b] + price
        better = True
        while better:
            better = False
            for a, b in _STILL:
                if now[b] + 1 < now[a]:
                    now[a], better = now[b] + 1, True
        out[16 * i : 16 * i + 16] = array("H", now)
    return out


def _plain_edits(at: list[int], symbols: list[tuple[str, str]], n: int) -> str:
    """Cheapest edits of a record of plain cells: missing separators at its start, one too many deleted, several within quotes around the first cells."""
    separators = [at[i] for i, (kind, _) in enumerate(symbols) if kind == ","]
    many = len(separators) + 1 - n
    if many <= 0:
        return "; ".join(["insert , at 0"] * -many)
    if many == 1:
        return f"delete , at {separators[0]}"
    return f'insert " at 0; insert " at {separators[many] if n > 1 else at[-1]}'


def cheapest_edits(symbols: list[tuple[str, str]], n: int) -> str | None:
    """Edits of the cheapest parse into exactly `n` cells, as text; None if `n` is below one."""
    if n < 1:
        return None
    at = [0]
    for _, text in symbols:
        at.append(at[-1] + len(text))
    kinds = [kind for kind, _ in symbols]
    if '"' not in kinds and "n" not in kinds:
        return _plain_edits(at, symbols, n)
    end, bounds = len(symbols), _bounds(kinds)
    left = [0] * (end + 1)
    for i in range(end - 1, -1, -1):
        left[i] = left[i + 1] + (kinds[i] == ",")

    def bound(i: int, state: int, cell: int) -> int:
        many = cell + left[i] - n
        return max(-many, bounds[16 * i + 4 * state + min(max(many, -1), 2) + 1])

    # A node is ((i * 4) + state) * (n + 1) + cell; came holds the node before, times four, plus what was done.
    width = n + 1
    first = _START * width + 1
    came, cost = {first: -1}, {first: 0}
    queues = defaultdict(deque, {bound(0, _START, 1): deque([first])})
    while queues:
        total = min(queues)
        queue = queues[total]
        while queue:
            node = queue.popleft()
            rest, cell = divmod(node, width)
            i, state = rest >> 2, rest & 3
            spent = cost[node]
            if spent + bound(i, state, cell) != total:
                continue
            if i == end and cell == n and state != _QUOTED:
                steps = []
                while came[node] >= 0:
                    node, step = divmod(came[node], 4)
                    if step:
                        i = node // width >> 2
                        steps.append(f"delete {kinds[i]} at {at[i]}" if step == 1 else f"insert {'\",'[step - 2]} at {at[i]}")
                return "; ".join(reversed(steps))
            moves = []
            if i < end:
                kind = kinds[i]
                after = _copy(state, kind)
                if after is not None:
                    moves.append((i + 1, _START, cell + 1, 0, 0) if after == -1 else (i + 1, after, cell, 0, 0))
                if kind in '",':
                    moves.append((i + 1, state, cell, 1, 1))
            after = _copy(state, '"')
            if after is not None:
                moves.append((i, after, cell, 1, 2))
            if state != _QUOTED:
                moves.append((i, _START, cell + 1, 1, 3))
            for j, s, c, price, step in moves:
                to = (j * 4 + s) * width + c
                if c <= n and spent + price < cost.get(to, 1 << 60):
                    cost[to], came[to] = spent + price, node * 4 + step
                    due = spent + price + bound(j, s, c)
                    queues[due].append(to) if due > total else queue.appendleft(to)
        del queues[total]
    return None


def parse(raw: str, n: int) -> tuple[list[str] | None, int, str | None, str | None]:
    """(cells, their number, reason, edits) of one record under a header of `n` cells."""
    symbols = _symbols(raw)
    cost, cells = free_cost(symbols)
    if cost:
        return None, 0, "quoting", cheapest_edits(symbols, n)
    if len(cells) != n:
        return None, len(cells), "columns", cheapest_edits(symbols, n)
    return cells, n, None, None


def parse_column(raw: Column, n: Column) -> Column:
    """`parse` as a column of PARSED. Records without quotes and line breaks and with the right
    number of separators are split on the JVM: their cost is zero by definition. Only the rest
    crosses to Python, in Arrow batches."""

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raws, ns in batches:
            yield pd.DataFrame([(None, None, None, None) if r is None else parse(r, int(k)) for r, k in zip(raws, ns)], columns=["cells", "n", "reason", "edits"])

    split = F.split(raw, ",", -1)
    plain = ~raw.rlike(r'["\r\n]') & (F.size(split) == n)
    hard = run(F.when(~plain, raw), F.when(~plain, n))
    easy = F.struct(split.alias("cells"), n.cast("int").alias("n"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("edits"))
    return F.when(plain, easy).otherwise(hard)

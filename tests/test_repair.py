import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.sources.repair import _copy, _symbols, cheapest_edits, free_cost, parse, zero_cost


def apply(raw, edits):
    """Carries the edits out, from the right so that places stay true."""
    steps = [e.split(" ") for e in edits.split("; ") if e]
    for what, sign, _, at in reversed(steps):
        at = int(at)
        raw = raw[:at] + sign + raw[at:] if what == "insert" else raw[:at] + raw[at + 1 :]
    return raw


def test_plain_and_quoted():
    assert parse('a,"b ""q"" c",', 3) == (["a", 'b "q" c', ""], 3, None, None)
    assert parse("C\\\\,1", 2)[0] == ["C\\\\", "1"]
    assert parse('"two\nlines",5', 2)[0] == ["two\nlines", "5"]
    assert parse("", 1) == ([""], 1, None, None)


def test_reasons():
    assert parse('a,b"c', 2)[2:] == ("quoting", 'delete " at 3')
    assert parse('"a" ,b', 2)[2] == "quoting"
    assert parse("line\nbreak,b", 2)[2] == "quoting"
    assert parse("a,b,c", 2)[2:] == ("columns", "delete , at 1") or parse("a,b,c", 2)[2] == "columns"
    assert parse("a", 3)[2] == "columns"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab,"\n', max_size=12), st.integers(1, 4))
def test_edits_repair(raw, n):
    """The cheapest edits lead to a well-formed record of n cells, and cost nothing only if it was one."""
    edits = cheapest_edits(_symbols(raw), n)
    assert edits is not None
    fixed = zero_cost(_symbols(apply(raw, edits)))
    assert fixed is not None and len(fixed) == n
    own = zero_cost(_symbols(raw))
    assert (edits == "") == (own is not None and len(own) == n)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab,"\n', max_size=10))
def test_free_cost_is_the_least_over_all_numbers_of_cells(raw):
    """The reason rests on it: no edits but those of the cheapest parse into any number of cells."""
    symbols = _symbols(raw)
    cost, cells = free_cost(symbols)
    edits = [e for n in range(1, len(raw) + 3) if (e := cheapest_edits(symbols, n)) is not None]
    assert cost == min(len(e.split("; ")) if e else 0 for e in edits) and (cost == 0) == (cells is not None)


def test_wide_broken_record():
    raw = ",".join(['"a"'] * 2047 + ['"b'])
    cells, _, reason, edits = parse(raw, 2048)
    assert (cells, reason, len(edits.split("; "))) == (None, "quoting", 1)
    assert len(zero_cost(_symbols(apply(raw, edits)))) == 2048


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\n \\', max_size=6), min_size=2, max_size=5))
def test_round_trip(cells):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    assert parse(out.getvalue(), len(cells))[0] == cells


def test_long_record():
    raw = ",".join(["x" * 50_000] * 20) + '"'
    assert parse(raw, 20)[2] == "quoting"
    assert parse(",".join("a" * 3_000_000), 2)[2] == "columns"


def cost_of(raw, n):
    """Least number of edits, by relaxing the whole table until nothing changes."""
    symbols = _symbols(raw)
    cost, again = {(0, 0, 1): 0}, [(0, 0, 1)]
    while again:
        i, state, cell = again.pop()
        copy = lambda kind: {-1: (0, cell + 1), None: None}.get(_copy(state, kind), (_copy(state, kind), cell))
        to = [((i, *copy(k)), 1) for k in '",' if copy(k) and not (state == 2 and k == ",")]
        if i < len(symbols):
            to += [((i + 1, *copy(symbols[i][0])), 0)] if copy(symbols[i][0]) else []
            to += [((i + 1, state, cell), 1)] if symbols[i][0] in '",' else []
        for node, price in to:
            if node[2] <= n and cost[i, state, cell] + price < cost.get(node, 1 << 60):
                cost[node] = cost[i, state, cell] + price
                again.append(node)
    return min(c for (i, state, cell), c in cost.items() if i == len(symbols) and cell == n and state != 2)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab,,""\n', max_size=16), st.integers(1, 7))
def test_edits_are_fewest(raw, n):
    edits = cheapest_edits(_symbols(raw), n)
    assert len([e for e in edits.split("; ") if e]) == cost_of(raw, n)


@pytest.mark.parametrize(
    ("raw", "n", "cost"),
    [
        (",".join(["a"] * 2_047 + ['b"c']), 2_048, 1),
        (",".join(['"a"'] * 1_500), 2_048, 548),
        (",".join(['"a,b"'] * 2_049), 2_048, 1),
        (",".join(["a"] * 3_000 + ['"b"']), 2_048, 2),
        ("\n".join(["a,b,c"] * 20_000), 11, 8),
        (",".join(['"a"'] * 12_000), 11, 11_989),
        (",".join("a" * 3_000_000), 2, 2),
    ],
)
def test_edits_of_large_tables(raw, n, cost):
    cells, _, reason, edits = parse(raw, n)
    assert cells is None and reason and len(edits.split("; ")) == cost
    assert len(zero_cost(_symbols(apply(raw, edits)))) == n

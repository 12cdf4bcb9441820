"""Plain forms of the operators, for comparison."""

import collections
import re

import regex

WS = "\t\n\x0b\x0c\r \x85\xa0                　"
MARKUP = regex.compile(r"</?[A-Za-z][^<>\n]*>|\[/?[A-Za-z*][^\[\]\n]*\]|&#?[0-9A-Za-z]{1,10};")


def key(x):
    return (x or "").strip(WS)


def seen(rows, history):
    old, out = {key(h) for h in history} - {""}, set()
    for o, x in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if key(x):
            if key(x) in old:
                out.add(o)
            old.add(key(x))
    return out


def within(a, b, k):
    if abs(len(a) - len(b)) > k:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > k:
            return False
    return row[-1] <= k


def repeats(rows):
    """(first_id, dup_id) by comparing each row with every accepted one."""
    accepted, out = [], set()
    for i, x in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        x = key(x)
        if not x:
            continue
        hit = next((j for j, y in accepted if x == y or (len(x) >= 24 and len(y) >= 24 and within(x, y, 2))), None)
        if hit is None:
            accepted.append((i, x))
        else:
            out.add((hit, i))
    return out


def record(body):
    ld = lambda s: "".join(regex.findall(r"[\p{L}\p{N}]", s)).lower()
    out = []
    for piece in re.split("[;|\n]", body):
        if piece.strip(WS):
            name, _, value = re.match(r"(?s)([^=:]*)([=:]?)(.*)", piece).groups()
            name = {"smiles": "input"}.get(ld(name), ld(name))
            rest = "".join(c for c in value if c not in WS and c not in "\"'`“”‘’«»")
            exact = name == "input" or re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", rest)
            out.append((name, rest.lower() if exact else ld(value)))
    return tuple(sorted(out))


def same_records(rows):
    first, out = {}, set()
    for i, b in sorted(rows, key=lambda r: r[0]):
        if key(b):
            if (r := record(b)) in first:
                out.add((first[r], i))
            else:
                first[r] = i
    return {(a, b) for a, b in out if a != b}


def words(text):
    return [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", MARKUP.sub(" ", text or ""))]


def leaked(docs, items, n=8):
    grams = collections.defaultdict(set)
    for i, p in items:
        w = words(p)
        for a in range(len(w) - n + 1):
            grams[tuple(w[a : a + n])].add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for a in range(len(w) - n + 1) for i in grams.get(tuple(w[a : a + n]), ())}


def shared(docs, n=200):
    first, out = {}, set()
    for d, t in docs:
        for a in range(len(t or "") - n + 1):
            other = first.setdefault(t[a : a + n], d)
            if other != d:
                out |= {other, d}
    return out


def shared_chars(docs, n=200):
    """Characters of each document in windows of `n` that also stand in another one."""
    held, out = collections.defaultdict(set), {}
    for d, t in docs:
        for a in range(len(t or "") - n + 1):
            held[t[a : a + n]].add(d)
    for d, t in docs:
        end = total = 0
        for a in range(len(t or "") - n + 1):
            if len(held[t[a : a + n]]) > 1:
                total += a + n - max(end, a)
                end = a + n
        out[d] = total
    return out

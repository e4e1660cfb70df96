"""Exact, line and near dedup and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from firnline.llm import exact_dedup, line_dedup, near, near_dedup
from firnline.llm.common import components

LONG = "alpha beta gamma delta " * 20_000


def rows_of(df, *names):
    return {tuple(r) for r in df.select(*names).collect()}


def linked(sets, percent=80):
    """Smallest member of the component of each key of ``sets``."""
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            copy = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.randint(1, 70))))
    return texts


def without_repeated_lines(docs):
    """The text that is left of each of ``docs`` (doc_id, text)."""
    at = {}
    for i, t in docs:
        for p, x in enumerate(line_dedup.plain_lines(t)):
            if x:
                at.setdefault(x, []).append((i, p))
    first = {x: min(v) for x, v in at.items()}
    sets = {first[x]: {x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in at}
    keep = set(linked(sets).values())
    left = {}
    for i, t in docs:
        lines = zip(line_dedup.plain_lines(t), (t or "").split("\n"))
        kept = [y for p, (x, y) in enumerate(lines) if not x or (i, p) in keep]
        left[i] = None if t is None else "\n".join(kept)
    return left


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(i + 1000, i + 1001) for i in range(60)] + [(5, 5), (None, 4)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    sets = {}
    for i, (a, b) in enumerate(edges):
        if a is not None and a != b:
            sets.setdefault(a, set()).add(i)
            sets.setdefault(b, set()).add(i)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in sets}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("fan_in", [2, 32])
def test_exact_groups(documents, fan_in):
    rows = [(9, "a  b"), (3, "a b"), (4, "a\t\nb"), (5, " a b"), (6, None), (7, ""), (8, "é"), (1, LONG), (2, LONG)]
    rows += [(3, "a b")] + [(100 + i, f"copy {i % 2}") for i in range(40)] + [(None, "é")]
    got = exact_dedup.exact_groups(documents(rows), fan_in=fan_in).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[ \t-\r]+", " ", t or ""), []).append(i)
    want = []
    for text, ids in groups.items():
        keep = min(i for i in ids if i is not None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(ids), digest) for i in ids]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["digest"].hex()) for r in got), key=key) == sorted(want, key=key)


def test_exact_empty_and_kept_rows(documents):
    assert exact_dedup.exact_groups(documents([])).count() == 0
    kept = exact_dedup.drop_copies(documents([(2, "a"), (1, "a"), (3, None)]))
    assert rows_of(kept, "doc_id", "score") == {(1, "x"), (3, "x")}


@pytest.mark.parametrize("width,seed", [(2, 1), (5, 2)])
def test_near_groups(documents, width, seed):
    texts = corpus(seed)
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, " \n"), (503, "One"), (504, "one"), (505, LONG)]
    got = near_dedup.near_groups(documents(rows + [(None, "one")]), width=width)
    got = {r["id"]: (r["size"], r["component_id"]) for r in got.collect()}
    sets = {i: shingles(t, width) for i, t in rows}
    roots = linked(sets)
    assert {k: v for k, v in got.items() if k is not None} == {i: (len(sets[i]), roots[i]) for i in sets}
    assert got[None] == (1, None)


def test_near_groups_empty_and_kept_rows(documents):
    assert near_dedup.near_groups(documents([])).count() == 0
    text = " ".join(f"w{i}" for i in range(100))
    docs = documents([(3, text), (2, text + " more"), (4, "other"), (None, text)])
    assert rows_of(near_dedup.drop_near_copies(docs), "doc_id", "score") == {(2, "x"), (4, "x"), (None, "x")}


def test_spanning_forest_takes_the_shortest_edges():
    rng = np.random.default_rng(3)
    for n in (2, 9, 40):
        u, v = rng.integers(0, n, (2, 3 * n))
        d = rng.integers(0, 5, 3 * n).astype(float)
        labels = near.merged(np.arange(n), np.array([0]), np.array([n - 1]))
        roots, want = labels.copy(), []
        for i in np.lexsort([v, u, d]):
            if roots[u[i]] != roots[v[i]]:
                want.append(i)
                roots[roots == max(roots[u[i]], roots[v[i]])] = min(roots[u[i]], roots[v[i]])
        got = near.spanning(u, v, d, labels)
        assert len(got) == len(want) and sorted(d[got]) == sorted(d[want])
        assert (near.merged(labels, labels[u[got]], labels[v[got]]) == roots).all()
    assert len(near.spanning(u[:0], v[:0], d[:0], labels)) == 0


@pytest.mark.parametrize("block, main, rounds", [(7, 5, 8), (1024, 8192, 1), (50, 3, 0), (7, 5, 1)])
def test_open_buckets_are_settled_exactly(spark, monkeypatch, block, main, rounds):
    for name, value in (("BLOCK", block), ("MAIN", main), ("ROUNDS", rounds)):
        monkeypatch.setattr(near, name, value)
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 1 << 62, 150).astype(np.uint64)
    sets = {i: np.sort(np.r_[shared, rng.integers(0, 1 << 62, int(rng.integers(30, 80))).astype(np.uint64)]) for i in range(200)}
    for i in range(1, 180, 9):
        x = sets[i].copy()
        x[rng.choice(len(x), 12, replace=False)] = rng.integers(0, 1 << 62, 12).astype(np.uint64)
        sets[i + 4] = np.sort(x)
    stored = spark.createDataFrame([(i, len(x), bytearray(x.tobytes())) for i, x in sets.items()], "id long, size long, shingles binary")
    items = spark.createDataFrame([(i, [7]) for i in sets], "id long, keys array<long>")
    found = near.near_components(items, lambda ids: stored.join(ids, "id", "left_semi"), 80)
    got = {i: i for i in sets} | dict(found.select("id", "root").collect())
    assert got == linked({i: set(x.tolist()) for i, x in sets.items()})
    assert got[5] == 1


def test_line_dedup(documents):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefgh ", k=rng.randint(1, 90))) for _ in range(40)]
    docs = []
    for i in range(30):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice("xyz")
            lines.append("".join(line))
        docs.append((i, "\n".join(lines)))
    docs += [(50, None), (51, ""), (52, "\n\n"), (53, "Hi\nhi\n HI "), (54, LONG), (55, LONG)]
    got = dict(line_dedup.dedup_lines(documents(docs)).select("doc_id", "text").collect())
    assert got == without_repeated_lines(docs)
    assert got[53] == "Hi" and got[55] == "" and got[50] is None
    assert line_dedup.dedup_lines(documents([])).count() == 0
    assert line_dedup.dedup_lines(documents(docs)).columns == documents(docs).columns

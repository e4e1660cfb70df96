"""Regression trees of many fits, grown in the same passes over the rows.

The engine fits one model after the other, and a level of one tree costs it a job. Here every fit of a cross-validation (all areas
left out, all trees of their forests) grows a level in one pass: a task sums count and target by node, feature and bin, the sums
are added up by Spark, and the best cut of a node is found where its sums meet. Rows are kept as codes of at most ``CELLS``
values or quantiles of a feature, found over all rows once; the 32 bins of a fit are chosen among them from the counts of its own
training rows by the engine's rule. So are the cuts (variance; the first feature and the lowest cut of equal gains). Without draws the
trees are the engine's where a feature has at most ``CELLS`` values (tested); of more, the engine takes bins from a sample and
this module from all rows. Models are handed on as Spark ML models. Sums of squares are not kept: impurities in them are -1.
"""

from __future__ import annotations

import json
import math
import pickle
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.session import shared_folder

CELLS = 2048
BINS = 32
BLOCK = 32_768
#: Bytes of sums a task keeps in one pass; more nodes than that are counted in several.
TASK_BYTES = 96_000_000
#: Bytes of all tasks' sums that may meet on the driver; more are added up by a shuffle.
DRIVER_BYTES = 48_000_000
#: Gains below are rounding, as for the engine.
EPSILON = 2.0**-52
#: Boosted trees keep sums for pairs of features, so their depth is bounded here.
BOOSTED_DEPTH = 6
WRITERS = 4

#: A cut that no code is above, and the mask of a node's feature and cut.
NEVER = (1 << 16) - 1

#: The rows of a fit: ("all",), ("outer", i), ("inner", i, j) or ("final", j), without the area named last.
Part = tuple
Block = dict


def kept_rows(block: Block, part: Part) -> np.ndarray:
    if part[0] == "all":
        return np.ones(len(block["y"]), bool)
    if part[0] == "inner":
        return (block["outer"] != part[1]) & (block["inner"][part[1]] != part[2])
    return block[part[0]] != part[1]


def held_rows(block: Block, part: Part) -> np.ndarray:
    if part[0] == "inner":
        return (block["outer"] != part[1]) & (block["inner"][part[1]] == part[2])
    return block[part[0]] == part[1]


# values and codes


def counted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their counts."""
    found, at = np.unique(values, return_inverse=True)
    return found, np.bincount(at, counts)


def shortened(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` neighbouring groups of about as many rows, named by their largest value."""
    if len(values) <= most:
        return values, counts
    ends = np.cumsum(counts)
    last = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, most + 1) / most).clip(max=len(ends) - 1))
    return values[last], np.diff(ends[last], prepend=0)


def cell_ends(rows: DataFrame, names: Sequence[str]) -> list[tuple[np.ndarray, bool]]:
    """For each feature the largest value of each cell, and whether a cell is a single value. One pass."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(np.zeros(0), np.zeros(0), True) for _ in names]
        open_: list[list[np.ndarray]] = [[] for _ in names]
        size = 0

        def close() -> None:
            for i, parts in enumerate(open_):
                values, counts, exact = known[i]
                fresh = np.sort(np.concatenate([np.zeros(0), *parts]))
                first = np.flatnonzero(np.diff(fresh, prepend=-np.inf))
                values, counts = counted(np.r_[values, fresh[first]], np.r_[counts, np.diff(np.append(first, len(fresh)))])
                exact = exact and len(values) <= 2 * CELLS
                known[i] = (*shortened(values, counts, 2 * CELLS), exact)
                parts.clear()

        for batch in batches:
            for i, c in enumerate(batch.columns):
                open_[i].append(complete(c))
            size += batch.num_rows
            if size >= 8 * BLOCK:
                close()
                size = 0
        close()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(known)], pa.binary())], ["known"])

    total = [(np.zeros(0), np.zeros(0), True) for _ in names]
    for (packed,) in rows.select(*names).mapInArrow(summed, "known binary").collect():
        for i, (values, counts, exact) in enumerate(pickle.loads(packed)):
            found = counted(np.r_[total[i][0], values], np.r_[total[i][1], counts])
            exact = exact and total[i][2] and len(found[0]) <= CELLS
            total[i] = (*shortened(*found, 8 * CELLS), exact)
    out = []
    for values, counts, exact in total:
        if not exact:
            values = np.r_[shortened(values, counts, CELLS)[0][:-1], np.inf]
        out.append((values, exact))
    return out


def complete(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False).astype(float)
    if column.null_count or np.isnan(values).any():
        raise ValueError("features or target have missing values")
    return values


def blocks_of(rows: DataFrame, features: Sequence[str], target: str, inner: int, ends: list) -> RDD:
    """The rows as codes of their cells, in blocks of ``BLOCK`` rows at most."""
    width = len(features)

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, size = [], 0

        def block() -> pa.RecordBatch:
            columns = [pa.chunked_array([b.column(i) for b in open_]).combine_chunks() for i in range(width + 3 + inner)]
            codes = [np.searchsorted(e[:-1], complete(c)).astype(np.uint16) for c, (e, _) in zip(columns, ends)]
            areas = [c.to_numpy(zero_copy_only=False).astype(np.int8) for c in columns[width + 1 :]]
            made = {
                "codes": np.ascontiguousarray(np.stack(codes, axis=1)), "y": complete(columns[width]),
                "outer": areas[0], "final": areas[1], "inner": areas[2:],
            }
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made, 5)], pa.binary())], ["block"])

        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, BLOCK - size)
                batch = batch.slice(taken.num_rows)
                open_.append(taken)
                size += taken.num_rows
                if size == BLOCK:
                    yield block()
                    open_, size = [], 0
        if size:
            yield block()

    columns = [*features, F.col(target).cast("double"), "outer_area", "final_area", *[f"inner_area_{i}" for i in range(inner)]]
    found = rows.select(*columns).mapInArrow(packed, "block binary").rdd
    # the number of a block is the seed of its rows' draws
    return found.mapPartitionsWithIndex(lambda i, rs: ({**pickle.loads(r[0]), "draw": [(i, j)]} for j, r in enumerate(rs)))


def engine_cuts(counts: np.ndarray, ends: np.ndarray, exact: bool) -> np.ndarray:
    """The engine's cuts between bins from the rows of each cell."""
    met = np.flatnonzero(counts)
    between = (ends[met[:-1]] + ends[met[1:]]) / 2 if exact else ends[met[:-1]]
    n = counts.sum()
    cuts = int(min(BINS, n)) - 1
    if len(between) <= cuts:
        return between
    stride, at, out = n / (cuts + 1), counts[met[0]], []
    goal = stride
    for i in range(1, len(met)):
        before, at = at, at + counts[met[i]]
        if abs(before - goal) < abs(at - goal):
            out.append(between[i - 1])
            goal += stride
    return np.array(out)


@dataclass
class Bins:
    """For a fit the cuts of each feature, the bin of each cell, and the last cell of each bin."""

    n: int
    cuts: list[np.ndarray]
    table: np.ndarray  # feature, cell
    last: np.ndarray  # feature, bin


def bins_of(blocks: RDD, parts: Sequence[Part], ends: list, areas: int) -> dict[Part, Bins]:
    """One pass for the rows by area and cell, from which all fits' bins follow."""
    sizes = [len(e) for e, _ in ends]
    families = sorted({("inner", p[1]) if p[0] == "inner" else ("final",) if p[0] == "final" else ("outer",) for p in parts})

    def counts(own: Iterable[Block]) -> Iterator[tuple]:
        total = [[np.zeros((areas, s), np.int64) for s in sizes] for _ in families]
        for block in own:
            for family, sums in zip(families, total):
                if family[0] == "inner":
                    rows = block["outer"] != family[1]
                    area, codes = block["inner"][family[1]][rows], block["codes"][rows]
                else:
                    area, codes = block[family[0]], block["codes"]
                for f, s in enumerate(sizes):
                    sums[f] += np.bincount(area * np.int64(s) + codes[:, f], minlength=areas * s).reshape(areas, s)
        yield from ((f, [sums[f] for sums in total]) for f in range(len(sizes)))

    def cut(found: tuple) -> tuple:
        f, sums = found
        by, (last, exact) = dict(zip(families, sums)), ends[f]
        out = {}
        for part in parts:
            table = by["inner", part[1]] if part[0] == "inner" else by["final",] if part[0] == "final" else by["outer",]
            own = table.sum(0) - (0 if part[0] == "all" else table[part[-1]])
            out[part] = (int(own.sum()), engine_cuts(own, last, exact) if own.sum() else np.zeros(0))
        return f, out

    found = dict(
        blocks.mapPartitions(counts)
        .reduceByKey(lambda a, b: [x + y for x, y in zip(a, b)], len(sizes))
        .map(cut)
        .collect()
    )
    out = {}
    for part in parts:
        cuts = [found[f][part][1] for f in range(len(sizes))]
        table = np.zeros((len(sizes), max(sizes)), np.uint8)
        last = np.full((len(sizes), BINS), max(sizes))
        for f, (own, (e, _)) in enumerate(zip(cuts, ends)):
            table[f, : len(e)] = np.searchsorted(own, e)
            last[f] = np.searchsorted(table[f, : len(e)], np.arange(BINS), side="right") - 1
        out[part] = Bins(found[0][part][0], cuts, table, last)
    return out


# trees


@dataclass
class Plant:
    """The trees of one set of rows that differ in the smallest leaf (``sizes``) alone. A node that several of
    them share has all of them as owners and is counted once. ``draw`` numbers the weights of a forest's tree."""

    part: Part
    sizes: tuple[int, ...]
    draw: int = -1
    n: list[float] = field(default_factory=lambda: [0.0])
    total: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        kinds = range(len(self.sizes))
        self.owners = [tuple(kinds)]
        self.feature = [[-1] for _ in kinds]
        self.cut = [[0] for _ in kinds]
        self.child = [[0] for _ in kinds]  # the left one; its own number for a leaf
        self.gain = [[-1.0] for _ in kinds]

    def split(self, found: np.ndarray, picks: np.ndarray | None, deeper: bool) -> None:
        """Grows a level by the rows of ``best_cuts``: one for each tree and open node."""
        opened = []
        for a, node in enumerate(self.open):
            kinds: dict[tuple, list[int]] = {}
            for v in self.owners[node]:
                gain, slot, cut, n_left, left, n, total = found[v, a]
                self.n[node], self.total[node] = n, total
                if gain > EPSILON:
                    kinds.setdefault((slot, cut, gain, n_left, left, n, total), []).append(v)
            for (slot, cut, gain, n_left, left, n, total), same in kinds.items():
                at = len(self.n)
                for v in same:
                    self.feature[v][node] = int(slot if picks is None else picks[a, int(slot)])
                    self.cut[v][node], self.child[v][node], self.gain[v][node] = int(cut), at, float(gain)
                self.n += [n_left, n - n_left]
                self.total += [left, total - left]
                self.owners += [tuple(same)] * 2
                for v in range(len(self.sizes)):
                    self.feature[v] += [-1, -1]
                    self.cut[v] += [0, 0]
                    self.child[v] += [at, at + 1]
                    self.gain[v] += [-1.0, -1.0]
                least = 2 * min(self.sizes[v] for v in same)
                opened += [i for i in (at, at + 1) if deeper and self.n[i] >= least]
        self.open = opened

    def job(self, picks: np.ndarray | None, bins: Bins, in_cells: bool) -> dict:
        """What a task needs to place its rows in the open nodes; leaves lead to themselves."""
        slot = np.full((len(self.sizes), len(self.n)), -1)
        for a, node in enumerate(self.open):
            slot[self.owners[node][0], node] = a
        trees = [(steps(*self.walk(v, bins, in_cells)), slot[v]) for v in range(len(self.sizes)) if (slot[v] >= 0).any()]
        return {"part": self.part, "draw": self.draw, "m": len(self.open), "sizes": self.sizes, "trees": trees, "picks": picks}

    def walk(self, v: int, bins: Bins, in_cells: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feature, cut, child = (np.array(x[v]) for x in (self.feature, self.cut, self.child))
        inner = feature >= 0
        if in_cells:
            cut = bins.last[feature.clip(0), cut]
        return feature.clip(0), np.where(inner, cut, NEVER), child

    def mean(self, node: int) -> float:
        return float(self.total[node] / self.n[node])

    def nodes(self, v: int, depth: int, bins: Bins) -> list[dict]:
        """The tree of ``sizes[v]``, ``depth`` levels deep at most, as the engine stores it."""
        out: list[dict] = []
        stack = [(0, 0, None, "")]
        while stack:  # a node before its left, then its right child
            node, level, above, side = stack.pop()
            at = len(out)
            if above is not None:
                out[above][side] = at
            f = self.feature[v][node]
            ends = f < 0 or level == depth
            n, total = float(self.n[node]), float(self.total[node])
            out.append({
                "id": at, "prediction": self.mean(node), "impurity": -1.0, "impurityStats": [n, total, math.nan], "rawCount": round(n),
                "gain": -1.0 if ends else self.gain[v][node], "leftChild": -1, "rightChild": -1,
                "split": {
                    "featureIndex": -1 if ends else f, "numCategories": -1,
                    "leftCategoriesOrThreshold": [] if ends else [float(bins.cuts[f][self.cut[v][node]])],
                },
            })
            if not ends:
                left = self.child[v][node]
                stack += [(left + 1, level + 1, at, "rightChild"), (left, level + 1, at, "leftChild")]
        return out


def steps(feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """Feature, cut and left child of each node in one number."""
    return feature | cut << 16 | child << 32


def placed(codes: np.ndarray, base: np.ndarray, packed: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row after ``depth`` steps; ``codes[base + f]`` is its code of feature f."""
    node = np.zeros(len(base), np.int64)
    for _ in range(depth):
        step = packed.take(node)
        code = step & NEVER
        code += base
        code = codes.take(code)
        node = step >> 32
        step >>= 16
        step &= NEVER
        node += code > step
    return node


def best_cuts(counts: np.ndarray, totals: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """Gain, slot, last bin of the left child, its rows and total, rows and total of the node: a row for each of
    ``sizes`` and node. The sums are by slot, node and bin."""
    n, t = np.cumsum(counts, axis=2, dtype=float), np.cumsum(totals, axis=2)
    n_all, t_all = n[:, :, -1:], t[:, :, -1:]
    n_left, left = n[:, :, :-1], t[:, :, :-1]
    n_right, right = n_all - n_left, t_all - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = n_left * n_right / (n_all * n_all) * (left / n_left - right / n_right) ** 2
    fewest = np.minimum(n_left, n_right)
    out = np.zeros((len(sizes), counts.shape[1], 7))
    nodes = np.arange(counts.shape[1])
    for v, size in enumerate(sizes):
        allowed = np.where(fewest >= size, gain, -1.0).transpose(1, 0, 2).reshape(len(nodes), -1)
        at = allowed.argmax(1)
        slot, cut = np.divmod(at, BINS - 1)
        out[v] = np.stack(
            [allowed[nodes, at], slot, cut, n_left[slot, nodes, cut], left[slot, nodes, cut], n_all[slot, nodes, 0], t_all[slot, nodes, 0]],
            axis=1,
        )
    return out


#: Poisson law of mean one for 16 random bits, as the draws of a bootstrap.
POISSON = np.searchsorted(
    np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)
).astype(np.uint8)


def drawn(block: Block, seed: int, draw: int) -> np.ndarray:
    sizes = block.get("sizes", [len(block["y"])])
    bits = [np.random.default_rng([seed, draw, *d]).integers(0, 1 << 16, n, np.uint16) for d, n in zip(block["draw"], sizes)]
    return POISSON.take(np.concatenate(bits))


def merged(blocks: Iterable[Block], rows: int) -> Iterator[Block]:
    """Blocks put together until they have ``rows`` rows."""
    open_: list[Block] = []
    for block in blocks:
        open_.append(block)
        if sum(len(b["y"]) for b in open_) >= rows:
            yield joined(open_)
            open_ = []
    if open_:
        yield joined(open_)


def joined(blocks: list[Block]) -> Block:
    if len(blocks) == 1:
        return blocks[0]
    out = {k: np.concatenate([b[k] for b in blocks]) for k in ("codes", "y", "outer", "final")}
    inner = [np.concatenate(i) for i in zip(*[b["inner"] for b in blocks])]
    return {**out, "inner": inner, "draw": [d for b in blocks for d in b["draw"]], "sizes": [len(b["y"]) for b in blocks]}


def level_sums(blocks: Iterable[Block], jobs: list[dict], tables: dict[Part, np.ndarray], depth: int, seed: int) -> list[tuple]:
    """Rows and total of the target by slot, node and bin for each job."""
    width = len(next(iter(tables.values())))
    out = []
    for job in jobs:
        shape = (width if job["picks"] is None else job["picks"].shape[1], job["m"] * BINS)
        out.append((np.zeros(shape, np.int32), np.zeros(shape)))
    wide = max(job["m"] for job in jobs) * BINS
    for block in merged(blocks, BLOCK if wide <= BLOCK // 4 else min(8 * wide, 8 * BLOCK)):
        forest = jobs[0]["picks"] is not None
        weights = {t: drawn(block, seed, t) for t in {job["draw"] for job in jobs}} if forest else {}
        cells = None if forest else np.ascontiguousarray(block["codes"].T).astype(np.int64)
        for part, group in groupby(zip(jobs, out), lambda jo: jo[0]["part"]):
            rows = np.flatnonzero(kept_rows(block, part))
            if forest:
                table = tables[part]
                codes = table.ravel().take(block["codes"][rows] + np.arange(width) * table.shape[1]).ravel()
                y = block["y"][rows]
                for job, sums in group:
                    add_drawn(codes, y, weights[job["draw"]][rows], width, job, sums, depth)
            else:
                table = tables[part].astype(np.int64)
                for job, sums in group:
                    add_rows(block, cells, rows, table, job, sums, depth)
    return [(n.reshape(len(n), -1, BINS), t.reshape(len(t), -1, BINS)) for n, t in out]


def add_rows(block: Block, cells: np.ndarray, rows: np.ndarray, table: np.ndarray, job: dict, sums: tuple, depth: int) -> None:
    flat, width, m = block["codes"].ravel(), len(cells), job["m"]
    for packed, slot in job["trees"]:
        at = slot.take(placed(flat, rows * width, packed, depth))
        met = np.flatnonzero(at >= 0)
        own, at = (rows, at) if len(met) == len(rows) else (rows.take(met), at.take(met))
        y = block["y"].take(own)
        add(lambda f: table[f].take(cells[f].take(own)), at, m, None, y, sums)


def add_drawn(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, job: dict, sums: tuple, depth: int) -> None:
    own = np.flatnonzero(weight)
    for packed, slot in job["trees"]:
        at = slot.take(placed(codes, own * width, packed, depth))
        met = np.flatnonzero(at >= 0)
        rows, at = (own, at) if len(met) == len(own) else (own.take(met), at.take(met))
        w = weight.take(rows).astype(float)
        base = rows * width
        add(lambda s: codes.take(base + job["picks"][:, s].take(at)).astype(np.int64), at, job["m"], w, w * y.take(rows), sums)


def add(code, at: np.ndarray, m: int, w: np.ndarray | None, wy: np.ndarray, sums: tuple) -> None:
    """Adds rows in the nodes ``at`` to both sums by slot, node and bin. Two slots share a count where it is smaller than the rows."""
    slots = len(sums[0])
    paired = slots - slots % 2 if m * BINS * BINS <= len(at) else 0
    size = m * BINS * BINS
    place = at * (BINS * BINS)
    for s in range(0, paired, 2):
        index = code(s)
        index *= BINS
        index += code(s + 1)
        index += place
        for total, weights in zip(sums, (w, wy)):
            both = np.bincount(index, weights, size).reshape(m, BINS, BINS)
            total[s] += both.sum(2).ravel().astype(total.dtype)
            total[s + 1] += both.sum(1).ravel().astype(total.dtype)
    place = at * BINS
    for s in range(paired, slots):
        index = code(s)
        index += place
        for total, weights in zip(sums, (w, wy)):
            total[s] += np.bincount(index, weights, m * BINS).astype(total.dtype)


def grow(blocks: RDD, plants: list[Plant], bins: dict[Part, Bins], depth: int, picked: int | None = None, seed: int = 7) -> None:
    """Grows all plants to ``depth``. ``picked`` features are drawn for each node of a forest."""
    sc, tasks = blocks.context, blocks.getNumPartitions()
    width = len(next(iter(bins.values())).cuts)
    rng = np.random.default_rng([seed, 1 << 20])
    in_cells = picked is None
    tables = sc.broadcast({part: b.table for part, b in bins.items()})
    for level in range(depth):
        live = [p for p in plants if p.open]
        while live:
            now, size = [], 0
            while live and (not now or size + len(live[0].open) * (picked or width) * BINS * 12 <= TASK_BYTES):
                now.append(live.pop(0))
                size += len(now[-1].open) * (picked or width) * BINS * 12
            picks = [
                None if picked is None else np.sort(rng.random((len(p.open), width)).argsort(1)[:, :picked], axis=1) for p in now
            ]
            jobs = sc.broadcast([p.job(q, bins[p.part], in_cells) for p, q in zip(now, picks)])
            found = best_of_level(blocks, jobs, tables, level, seed, size * tasks > DRIVER_BYTES)
            for p, q, f in zip(now, picks, found):
                p.split(f, q, level + 1 < depth)
            jobs.unpersist()
    tables.unpersist()


def best_of_level(blocks: RDD, jobs, tables, depth: int, seed: int, shuffled: bool) -> list[np.ndarray]:
    """``best_cuts`` for each job. Tasks' sums are added in the order of the tasks, so that a run repeats."""

    def sums(task: int, own: Iterable[Block]) -> Iterator[tuple]:
        for j, (n, t) in enumerate(level_sums(own, jobs.value, tables.value, depth, seed)):
            step = max(1, (1 << 20) // (len(n) * BINS * 12))
            for a in range(0, n.shape[1], step):
                yield (j, a), (task, n[:, a : a + step], t[:, a : a + step])

    def best(key: tuple, parts: list[tuple]) -> tuple:
        n = t = None
        for _, n_own, t_own in sorted(parts, key=lambda p: p[0]):
            n, t = (n_own, t_own) if n is None else (n + n_own, t + t_own)
        return key, best_cuts(n, t, jobs.value[key[0]]["sizes"])

    def gathered(own: Iterable[tuple]) -> dict:
        by: dict[tuple, list[tuple]] = {}
        for key, part in own:
            by.setdefault(key, []).append(part)
        return by

    found = blocks.mapPartitionsWithIndex(sums)
    if shuffled:
        keys = {k: i for i, k in enumerate(sorted(
            (j, a) for j, job in enumerate(jobs.value) for a in range(0, job["m"], step_of(job, tables.value))
        ))}
        parts = found.partitionBy(min(len(keys), 4 * blocks.getNumPartitions()), lambda k: keys[k])
        rows = parts.mapPartitions(lambda own: [best(k, v) for k, v in gathered(own).items()]).collect()
    else:
        rows = [best(k, v) for k, v in gathered(found.collect()).items()]
    by_job: dict[int, list[tuple]] = {}
    for (j, a), cut in rows:
        by_job.setdefault(j, []).append((a, cut))
    return [np.concatenate([c for _, c in sorted(by_job[j], key=lambda x: x[0])], axis=1) for j in range(len(by_job))]


def step_of(job: dict, tables: dict[Part, np.ndarray]) -> int:
    slots = len(next(iter(tables.values()))) if job["picks"] is None else job["picks"].shape[1]
    return max(1, (1 << 20) // (slots * BINS * 12))


def held_errors(blocks: RDD, plants: dict[Part, Plant], bins: dict[Part, Bins], depths: Sequence[int]) -> dict[Part, np.ndarray]:
    """Rows of the area left out, and summed squared error on them by size and depth."""
    trees = blocks.context.broadcast({
        part: [
            (steps(*p.walk(v, bins[part], True)), np.array(p.total) / np.array(p.n))
            for v in range(len(p.sizes))
        ]
        for part, p in plants.items()
    })

    def errors(own: Iterable[Block]) -> Iterator[tuple]:
        out: dict[Part, np.ndarray] = {}
        for block in own:
            flat, width = block["codes"].ravel(), block["codes"].shape[1]
            for part, kinds in trees.value.items():
                rows = np.flatnonzero(held_rows(block, part))
                y = block["y"].take(rows)
                found = [len(rows)]
                for packed, mean in kinds:
                    found += [((mean.take(placed(flat, rows * width, packed, d)) - y) ** 2).sum() for d in depths]
                out[part] = out.get(part, 0.0) + np.array(found, float)
        yield from out.items()

    return dict(blocks.mapPartitions(errors).reduceByKey(lambda a, b: a + b, 1).collect())


# boosting


def boosted_blocks(bins: dict[Part, Bins]):
    """The training rows of each fit with their bins, two features to a number, and what is left of the target."""
    tables = {part: b.table for part, b in bins.items()}

    def made(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for part, table in tables.items():
            rows = np.flatnonzero(kept_rows(block, part))
            codes = [table[f].take(block["codes"][rows, f]).astype(np.uint16) for f in range(len(table))]
            codes += [np.zeros(len(rows), np.uint16)] * (len(codes) % 2)
            out.append((np.stack([a * BINS + b for a, b in zip(codes[::2], codes[1::2])]), block["y"][rows]))
        return out

    return made


def boosted_nodes(pairs: np.ndarray, tree: tuple, depth: int) -> np.ndarray:
    """The node of each row after ``depth`` steps, one node at a time, as there are few."""
    feature, cut, child = tree[:3]
    node = np.zeros(pairs.shape[1], np.int64)
    level = [0]
    for _ in range(depth):
        step, below = np.zeros(pairs.shape[1], np.int64), []
        for i in level:
            if child[i] == i:
                continue
            pair = pairs[feature[i] // 2]
            right = ((pair & (BINS - 1)) if feature[i] % 2 else (pair >> 5)) > cut[i]
            move = right + (child[i] - i)
            step += move if len(level) == 1 and i == 0 else np.where(node == i, move, 0)
            below += [child[i], child[i] + 1]
        node += step
        level = below
    return node


def boosted_sums(own: Iterable[list], trees: list[tuple], depth: int, counting: bool) -> list[np.ndarray]:
    """As ``level_sums``, rows and total in one array; two features share a count."""
    out: list[np.ndarray] = []
    for block in own:
        out = out or [np.zeros((2, len(block[0][0]), t[4], BINS * BINS)) for t in trees]
        for (pairs, left), tree, sums in zip(block, trees, out):
            m = tree[4]
            if not m:
                continue
            size, rows = m * BINS * BINS, None
            if depth:
                at = tree[3].take(boosted_nodes(pairs, tree, depth))
                rows = np.flatnonzero(at >= 0)
                left, at = left.take(rows), at.take(rows) * (BINS * BINS)
            for i, pair in enumerate(pairs):
                index = (pair if rows is None else pair.take(rows)).astype(np.int64)
                if rows is not None:
                    index += at
                sums[1, i] += np.bincount(index, left, size).reshape(m, -1)
                if counting:
                    sums[0, i] += np.bincount(index, minlength=size).reshape(m, -1)
    found = []
    for sums in out:
        both = sums.reshape(2, sums.shape[1], sums.shape[2], BINS, BINS)
        found.append(np.stack([both.sum(4), both.sum(3)], axis=2).reshape(2, -1, sums.shape[2], BINS))
    return found


def boost(blocks: RDD, bins: dict[Part, Bins], depth: int, size: int, trees: int, step: float) -> list[list[Plant]]:
    """Boosted trees of squared loss for every fit, all fits in the same passes: by fit, its trees. Of two children the one
    with fewer rows is counted; the other's sums are what it leaves of the parent's."""
    width = len(next(iter(bins.values())).cuts)
    state = blocks.map(boosted_blocks(bins)).persist(StorageLevel.MEMORY_AND_DISK)
    out: list[list[Plant]] = [[] for _ in bins]
    root_counts: dict[int, np.ndarray] = {}
    done: RDD | None = None
    for m in range(trees):
        plants = [Plant(part, (size,)) for part in bins]
        sums: list[dict[int, np.ndarray]] = [{} for _ in bins]  # of the level above, by the left child
        scale = 1.0 if m == 0 else 2.0  # later trees are fitted to the gradient
        for level in range(depth):
            jobs, fresh = [], []
            for p, b, above in zip(plants, bins.values(), sums):
                larger = {i + (p.n[i] <= p.n[i + 1]) for i in above if i in p.open and i + 1 in p.open}
                fresh.append([i for i in p.open if i not in larger])
                slot = np.full(len(p.n), -1)
                slot[fresh[-1]] = np.arange(len(fresh[-1]))
                jobs.append((*p.walk(0, b, False), slot, len(fresh[-1])))
            if not any(j[4] for j in jobs):
                break
            counting = level > 0 or not root_counts
            parts = state.mapPartitions(lambda own, j=jobs, d=level, c=counting: [boosted_sums(own, j, d, c)]).collect()
            if done is not None:
                done.unpersist()
                done = None
            parts = [own for own in parts if own]
            for k, p in enumerate(plants):
                if not p.open:
                    continue
                total = np.sum([own[k] for own in parts], axis=0)[:, :width]
                if level == 0:
                    total[0] = root_counts.setdefault(k, total[0].copy())
                found = {i: total[:, :, a] for a, i in enumerate(fresh[k])}
                for i, parent in sums[k].items():
                    for a, b in ((i, i + 1), (i + 1, i)):
                        if a in p.open and a not in found:
                            found[a] = parent - found[b]
                both_sums = np.stack([found[i] for i in p.open], axis=2)
                opened = p.open
                p.split(best_cuts(both_sums[0], scale * both_sums[1], p.sizes), None, level + 1 < depth)
                sums[k] = {p.child[0][i]: found[i] for i in opened if p.feature[0][i] >= 0}
        for own, p in zip(out, plants):
            own.append(p)
        if m + 1 < trees:
            weight = 1.0 if m == 0 else step
            moves = [(*p.walk(0, b, False), weight * np.array(p.total) / np.array(p.n)) for p, b in zip(plants, bins.values())]

            def moved(block: list, moves: list = moves) -> list:
                return [(pairs, left - t[3].take(boosted_nodes(pairs, t, depth))) for (pairs, left), t in zip(block, moves)]

            done, state = state, state.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
    state.unpersist()
    return out


# Spark ML models


NODE = pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
    ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
    ("split", pa.struct([
        ("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32()),
    ])),
])


def as_model(spark: SparkSession, estimator: Estimator, width: int, trees: list[list[dict]], weights: Sequence[float] = ()):
    """The model ``estimator`` would fit, from the nodes of its trees: written as the engine writes it and loaded."""
    kind = {
        DecisionTreeRegressor: DecisionTreeRegressionModel, RandomForestRegressor: RandomForestRegressionModel,
        GBTRegressor: GBTRegressionModel,
    }[type(estimator)]
    path = shared_folder(spark)

    def described(model: type, names: Iterable[str] | None = None) -> dict:
        known = None if names is None else set(names)
        chosen, usual = (
            {p.name: v for p, v in own.items() if known is None or p.name in known} for own in (estimator._paramMap, estimator._defaultParamMap)
        )
        return {
            "class": f"org.apache.spark.ml.regression.{model.__name__}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
            "uid": f"{model.__name__}_{uuid.uuid4().hex[:12]}", "paramMap": chosen, "defaultParamMap": usual,
        }

    top = {**described(kind), "numFeatures": width}
    if kind is DecisionTreeRegressionModel:
        data = pa.Table.from_batches([pa.RecordBatch.from_struct_array(pa.array(trees[0], NODE))])
    else:
        top["numTrees"] = len(trees)
        data = pa.table({
            "treeID": pa.array([i for i, t in enumerate(trees) for _ in t], pa.int32()),
            "nodeData": pa.array([n for t in trees for n in t], NODE),
        })
        names = [p.name for p in DecisionTreeRegressor().params]
        rows = [(i, json.dumps(described(DecisionTreeRegressionModel, names)), float(w)) for i, w in enumerate(weights)]
        spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(data).coalesce(1).write.parquet(f"{path}/data")
    spark.createDataFrame([(json.dumps(top),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return kind.load(path)


# cross-validation


def grows(estimator: Estimator, maps: Sequence[dict], searched: bool) -> bool:
    """Whether this module fits ``estimator``: by its class, with no setting that is not followed here."""
    followed = {"maxDepth", "minInstancesPerNode", "seed", "labelCol", "featuresCol", "predictionCol", "maxMemoryInMB", "cacheNodeIds",
                "checkpointInterval"}
    own = {
        DecisionTreeRegressor: set(), RandomForestRegressor: {"numTrees", "featureSubsetStrategy"}, GBTRegressor: {"maxIter", "stepSize"},
    }.get(type(estimator))
    if own is None or (searched and own):
        return False
    point = estimator if searched else estimator.copy(maps[0])
    named = {p.name for p in point._paramMap} | {p.name for m in maps for p in (m if searched else ())}
    if isinstance(estimator, GBTRegressor) and point.getMaxDepth() > BOOSTED_DEPTH:
        return False
    return named <= followed | own and min([point.getMaxDepth(), *[m[p] for m in maps for p in m if p.name == "maxDepth"]]) >= 1


def picked_features(strategy: str, width: int) -> int | None:
    """The engine's reading of ``featureSubsetStrategy`` for a forest of regression trees; None is all."""
    named = {"sqrt": math.ceil(math.sqrt(width)), "all": width, "auto": math.ceil(width / 3), "onethird": math.ceil(width / 3),
             "log2": max(1, math.ceil(math.log2(width)))}
    if strategy in named:
        return named[strategy]
    value = float(strategy)
    return min(int(value), width) if value > 1 or "." not in strategy else math.ceil(value * width)


@dataclass
class Grown:
    fold_models: list
    final_model: object
    log: list[tuple[int, int, int, float]]  # outer, inner, grid_index, mse


def cross_validated(
    placed_rows: DataFrame, features: Sequence[str], target: str, estimator: Estimator, maps: Sequence[dict], searched: bool,
    k: int, final: bool, same: bool,
) -> Grown:
    """Models without each of ``k`` outer areas and, if ``final``, on all rows, tuned if ``searched``. ``placed_rows`` has the area
    columns; ``same`` says that the areas of the final model are the outer ones."""
    spark = placed_rows.sparkSession
    tuning: dict[tuple[int, int], Part] = {}
    if searched:
        tuning = {(i, j): ("inner", i, j) for i in range(k) for j in range(k)}
        if final:
            tuning |= {(-1, j): ("outer" if same else "final", j) for j in range(k)}
    fits: dict[int, Part] = {i: ("outer", i) for i in range(k)} | ({-1: ("all",)} if final else {})
    parts = list(dict.fromkeys([*tuning.values(), *fits.values()]))
    ends = cell_ends(placed_rows, features)
    blocks = blocks_of(placed_rows, features, target, k, ends).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        bins = bins_of(blocks, parts, ends, k)
        if any(not bins[p].n for p in fits.values()):
            raise ValueError("no rows to train on")
        bins = {p: b for p, b in bins.items() if b.n}
        points = [estimator.copy(m) for m in maps] if searched else [estimator.copy(maps[0])]
        if not isinstance(estimator, DecisionTreeRegressor):
            models = ensembles(spark, blocks, points[0], {p: bins[p] for p in fits.values()}, len(features))
            found = [models[fits[i]] for i in fits]
            return Grown(found[:k], found[k] if final else None, [])
        sizes = tuple(dict.fromkeys(e.getMinInstancesPerNode() for e in points))
        depths = tuple(dict.fromkeys(e.getMaxDepth() for e in points))
        plants = {part: Plant(part, sizes) for part in bins}
        grow(blocks, list(plants.values()), bins, max(depths))
        log = []
        if searched:
            errors = held_errors(blocks, {p: plants[p] for p in tuning.values() if p in plants}, bins, depths)
            for (label, j), part in tuning.items():
                if part not in errors or not errors[part][0]:
                    continue
                by = errors[part][1:].reshape(len(sizes), len(depths)) / errors[part][0]
                for i, e in enumerate(points):
                    at = sizes.index(e.getMinInstancesPerNode()), depths.index(e.getMaxDepth())
                    log.append((label, j, i, float(by[at])))
        chosen = chosen_points(log)

        def model(label: int) -> object:
            own, part = points[chosen.get(label, 0)], fits[label]
            nodes = plants[part].nodes(sizes.index(own.getMinInstancesPerNode()), own.getMaxDepth(), bins[part])
            return as_model(spark, own, len(features), [nodes])

        with ThreadPoolExecutor(WRITERS) as pool:
            models = list(pool.map(model, fits))
        return Grown(models[:k], models[k] if final else None, log)
    finally:
        blocks.unpersist()


def chosen_points(log: Iterable[tuple[int, int, int, float]]) -> dict[int, int]:
    """Grid point with the smallest sum of scores by outer area; the first minimum wins."""
    sums: dict[int, dict[int, float]] = {}
    for label, _, i, score in log:
        by = sums.setdefault(label, {})
        by[i] = by.get(i, 0.0) + score
    return {label: min(sorted(by), key=by.get) for label, by in sums.items()}


def ensembles(spark: SparkSession, blocks: RDD, estimator: Estimator, bins: dict[Part, Bins], width: int) -> dict[Part, object]:
    depth, size = estimator.getMaxDepth(), estimator.getMinInstancesPerNode()
    if isinstance(estimator, GBTRegressor):
        n, step = estimator.getMaxIter(), estimator.getStepSize()
        boosted = dict(zip(bins, boost(blocks, bins, depth, size, n, step)))
        weights = [1.0] + [step] * (n - 1)
    else:
        n = estimator.getNumTrees()
        plants = [Plant(part, (size,), draw) for part in bins for draw in range(n)]
        grow(blocks, plants, bins, depth, picked_features(estimator.getFeatureSubsetStrategy(), width), estimator.getSeed())
        boosted = {part: [p for p in plants if p.part == part] for part in bins}
        weights = [1.0] * n
    with ThreadPoolExecutor(WRITERS) as pool:
        def model(part: Part) -> object:
            return as_model(spark, estimator, width, [p.nodes(0, depth, bins[part]) for p in boosted[part]], weights)

        return dict(zip(boosted, pool.map(model, boosted)))

"""Classification trees that grow until their leaves are pure.

A level of a tree costs Spark ML a dense histogram for each node, feature and task, whatever few rows the node has; a
tree with a node for every other row asks for more than it can shuffle. So Spark ML grows the top of the tree, and the rows of
each of its leaves, some ``LEAF_ROWS`` of them, go on in one task, which sorts them by node and bin and reads all splits of a level
off running counts. Both parts choose among the same bins by the same rule (entropy; the first feature and the lowest cut of equal
gains), so the depth of the top changes no prediction.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.operators.filters import check_features
from firnline.session import shared_folder

BINS = 32
LEAF_ROWS = 20_000
TASK_ROWS = 50_000


def cuts(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Where each feature's bins begin: halfway between its values if they are few, else at its quantiles."""
    kinds = rows.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    few = [f for f in features if kinds[f] <= 2 * bins]
    values = rows.agg(*[F.sort_array(F.collect_set(f)).alias(f) for f in few]).first() if few else {}
    exact = {f for f in few if len(values[f]) <= bins}
    many = [f for f in features if f not in exact]
    quantiles = dict(zip(many, rows.approxQuantile(many, [i / bins for i in range(1, bins)], 0.001))) if many else {}
    out = []
    for f in features:
        inner = [(a + b) / 2 for a, b in zip(values[f], values[f][1:])] if f in exact else quantiles[f]
        out.append([-math.inf, *(sorted(set(inner)) or [0.0]), math.inf])  # a constant has one bin in use
    return out


def leaf_depths(model: DecisionTreeClassificationModel, spark: SparkSession) -> list[int]:
    """The depth of each leaf, in the order of their numbers."""
    path = shared_folder(spark)
    model.save(path)
    tree = {r["id"]: r for r in spark.read.parquet(f"{path}/data").select("id", "leftChild", "rightChild").collect()}
    out, stack = [], [(0, 0)]
    while stack:
        at, depth = stack.pop()
        if tree[at]["leftChild"] < 0:
            out.append(depth)
        else:
            stack += [(tree[at]["rightChild"], depth + 1), (tree[at]["leftChild"], depth + 1)]
    return out


def terms(share: np.ndarray) -> np.ndarray:
    return share * (np.log(np.where(share > 0, share, 1.0)) / np.log(2.0))


#: The terms of the entropy by total and count, for nodes of fewer rows than this.
KNOWN = 513
TERMS = np.ravel(terms(np.minimum(np.arange(KNOWN) / np.maximum(np.arange(KNOWN), 1)[:, None], 1.0)))


def entropy(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """By column of ``counts``, which has a row for each class."""
    few = total < KNOWN
    if few.all():
        at, out = total.astype(np.int64) * KNOWN, np.zeros(len(total))
        for row in counts:
            out -= TERMS[at + row]
        return out
    out = np.zeros(len(total))
    if few.any():
        out[few] = entropy(counts[:, few], total[few])
    many = np.zeros(len(total) - few.sum())
    for row in counts[:, ~few]:
        many -= terms(row / total[~few])
    out[~few] = many
    return out


def best_cuts(
    node: np.ndarray, codes: np.ndarray, labels: np.ndarray, orders: list[np.ndarray], counts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: no cut gains anything) and last bin of the left child for each node. ``codes`` and ``orders`` (its rows by bin)
    are by feature; ``counts`` has the rows of each class as a row, nodes as columns."""
    total = counts.sum(0)
    impurity, start = entropy(counts, total), np.cumsum(total) - total
    mixed = impurity > 0
    kinds = np.arange(len(counts), dtype=labels.dtype)[:, None]
    gains, feature, last = np.zeros(len(total)), np.full(len(total), -1), np.zeros(len(total), np.int64)
    node = node.astype(np.uint16 if len(total) < 1 << 16 else np.int64)  # 16 bits are sorted by radix
    for f, by_code in enumerate(orders):
        order = by_code[np.argsort(node[by_code], kind="stable")]
        of, code = node[order], codes[f][order]
        ends = np.flatnonzero((of[1:] == of[:-1]) & (code[1:] != code[:-1]) & mixed[of[1:]])
        if not len(ends):
            continue
        of = of[ends]
        running = np.zeros((len(counts), len(order) + 1), np.int32)
        np.cumsum(labels[order] == kinds, axis=1, out=running[:, 1:])
        left = running[:, ends + 1] - running[:, start[of]]
        right = counts[:, of] - left
        n_left = ends + 1 - start[of]
        n_right = total[of] - n_left
        gain = impurity[of] - n_left / total[of] * entropy(left, n_left) - n_right / total[of] * entropy(right, n_right)
        first = np.flatnonzero(np.diff(of.astype(np.int64), prepend=-1))
        met, size = of[first], np.diff(np.append(first, len(of)))
        most = np.maximum.reduceat(gain, first)
        hits = np.flatnonzero(gain == np.repeat(most, size))
        hits = hits[np.flatnonzero(np.diff(of[hits].astype(np.int64), prepend=-1))]
        better = most > gains[met]
        gains[met[better]], feature[met[better]], last[met[better]] = most[better], f, code[ends[hits[better]]]
    return feature, last


def grown(codes: np.ndarray, labels: np.ndarray, train: np.ndarray, depth: int) -> np.ndarray:
    """Predictions of the tree of the rows ``train`` for all rows, ``depth`` levels deep at most. ``codes`` is by feature."""
    kinds = int(labels[train].max()) + 1
    out = np.zeros(len(labels), np.int64)
    rows, node = np.arange(len(labels)), np.zeros(len(labels), np.int64)
    for level in range(depth + 1):
        own = train[rows]
        mine, n = rows[own], int(node.max()) + 1
        counts = np.bincount(labels[mine] * np.int64(n) + node[own], minlength=n * kinds).reshape(kinds, n)
        out[rows] = counts.argmax(0)[node]
        # nodes of one class end here
        live = ((counts > 0).sum(0) > 1)[node]
        if level == depth or not live.any():
            break
        rows, node, own = rows[live], np.unique(node[live], return_inverse=True)[1], own[live]
        mine, n = rows[own], int(node.max()) + 1
        counts = np.bincount(labels[mine] * np.int64(n) + node[own], minlength=n * kinds).reshape(kinds, n)
        own_codes = codes[:, mine]
        orders = [np.argsort(c, kind="stable") for c in own_codes]
        feature, last = best_cuts(node[own], own_codes, labels[mine], orders, counts)
        live = feature[node] >= 0
        rows, node = rows[live], node[live]
        if not len(rows):
            break
        right = codes[feature[node], rows] > last[node]
        node = np.unique(node * 2 + right, return_inverse=True)[1]
    return out


def predictions(
    rows: DataFrame, features: Sequence[str], label: str, train: Column, keep: Sequence[str], max_depth: int = 30,
    seed: int = 7, top_depth: int | None = None,
) -> DataFrame:
    """``keep``, ``label`` and ``prediction`` for every row, by the tree of the rows ``train`` holds for."""
    features = check_features(features)
    own = rows.where(train)
    n = own.count()
    if not n:
        raise ValueError("no rows to train on")
    codes = [f"_code_{i}" for i in range(len(features))]
    bucketed = Bucketizer(splitsArray=cuts(own, features), inputCols=features, outputCols=codes).transform(
        rows.select(*dict.fromkeys([*features, *keep, label]), F.coalesce(train, F.lit(False)).alias("_train"))
    )
    # sums, as the codes of a Bucketizer are marked as categories without an order
    bucketed = bucketed.withColumns({c: F.col(c) + F.lit(0.0) for c in codes})
    binned = VectorAssembler(inputCols=codes, outputCol="_codes").transform(bucketed)
    if top_depth is None:
        top_depth = max(0, math.ceil(math.log2(n / LEAF_ROWS)))
    top = DecisionTreeClassifier(
        labelCol=label, featuresCol="_codes", impurity="entropy", maxDepth=min(top_depth, max_depth), maxBins=2 * BINS, seed=seed
    ).fit(binned.where("_train"))
    depths = leaf_depths(top, rows.sparkSession)
    top = top.copy({top.leafCol: "_leaf", top.predictionCol: "_p", top.rawPredictionCol: "", top.probabilityCol: ""})
    columns = [F.col(c).cast("tinyint").alias(c) for c in codes]
    placed = top.transform(binned).select(F.col("_leaf").cast("int").alias("_leaf"), *keep, label, "_train", *columns)
    out = placed.select(*keep, label, F.lit(0.0).alias("prediction"))

    def grow(leaf: pa.Table) -> pa.Table:
        train_ = leaf.column("_train").to_numpy()
        # classes of rows that do not train do not count
        labels = np.where(train_, leaf.column(label).fill_null(0).to_numpy(), 0).astype(np.int32)
        binned_ = np.stack([leaf.column(c).to_numpy() for c in codes])
        found = grown(binned_, labels, train_, max_depth - depths[leaf.column("_leaf")[0].as_py()])
        return leaf.select([*keep, label]).append_column("prediction", pa.array(found.astype(float)))

    return placed.repartition(1 + n // TASK_ROWS, "_leaf").groupBy("_leaf").applyInArrow(grow, out.schema)

"""Steps that MinHash operators share: hashed shingle sets, signatures, buckets, exact verification.

A shingle is a 64-bit hash; a set is its sorted distinct hashes as little-endian bytes. Buckets are
``(key, id)`` rows; they are never expanded into all pairs. A bucket's centre is the member that meets most
others over all its buckets. Every set is first verified against the centres of its buckets. Then only open buckets
are carried, those that hold several components. In them, every member outside the largest component is compared
with all members of other components by sizes and parity bitmaps, which never reject a link. A task hands on a spanning
forest of the pairs that may be links, the likeliest first, and not all of them; it is verified. A bucket whose
forests all hold is settled; in the others the pairs that failed are left out and the verified ones count as
connected. After ``ROUNDS`` such rounds all pairs that are left are handed on at once, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import components, dropped, small, written

CACHE_WORDS = 100_000
#: Members of a largest component from which on buckets that share it become one.
MERGE = 64
#: Rounds of settling in which a group hands on a spanning forest.
ROUNDS = 1
#: Members of an open bucket that are compared at a time with as many others, or with ``MAIN`` members of
#: its largest component.
BLOCK, MAIN = 1024, 8192
#: Bits of a parity bitmap: ``SPARSE`` times the set's size to the next power of two, between these.
SPARSE, LEAST_BITS, MOST_BITS = 4, 64, 16384
#: Pairs that are verified at a time.
SLICE = 500
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hash by word, kept for the words a worker has met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


WORD_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    return (x ^ (x >> np.uint64(29))) * M2


def word_shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words, A-Z lower-cased, words between ASCII
    white space; a shorter text is one shingle, a text without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out + h[i : i + len(out)])
    return distinct(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values in a row, where each set that is not empty starts, and which sets those are."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    starts = np.r_[0, np.cumsum(sizes[full])[:-1]].astype(np.int64) if len(full) else np.empty(0, np.int64)
    values = np.concatenate(sets) if len(full) else np.empty(0, np.uint64)
    return values, starts, full


def minhashes(values: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` minhashes of each set as rows."""
    rng = np.random.default_rng(seed)
    masks = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    factors = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(starts), n), np.uint64)
    for i in range(n if len(starts) else 0):
        out[:, i] = np.minimum.reduceat((values ^ masks[i]) * factors[i], starts)
    return out


def folded(columns: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit key from the values of each row."""
    out = np.full(len(columns), salt + 1, np.uint64)
    for i in range(columns.shape[1]):
        out = mixed(out + columns[:, i])
    return out


def lists(rows: int, full: np.ndarray, keys: np.ndarray) -> pa.Array:
    """Keys of the full sets as a list column, empty lists for the empty sets."""
    sizes = np.zeros(rows, np.int64)
    sizes[full] = keys.shape[1]
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).reshape(-1)))


def stored_sets(values: list[memoryview]) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint64) for v in values]


def verify(
    pairs: DataFrame, sets: DataFrame, percent: int, unpack: Callable[[list], list[np.ndarray]] = stored_sets
) -> DataFrame:
    """The pairs ``(a, b)`` with ``100 * intersection >= percent * union``; ``unpack`` turns stored
    ``shingles`` of ``sets(id, shingles)`` into sorted distinct hashes, once for each set of a slice. Only the sets
    that pairs ask for are shuffled: their ids are broadcast to the sets if they are few (counted)."""
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = sets.join(small(written(asked)), "id", "left_semi")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
            pairs = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()))
            stored: dict[int, memoryview] = {}
            for i, (a, b) in enumerate(pairs):
                if a not in stored:
                    stored[a] = batch.column("sa")[i].as_buffer()
                if b not in stored:
                    stored[b] = batch.column("sb")[i].as_buffer()
            known = dict(zip(stored, unpack(list(stored.values()))))
            hits = []
            for i, (a, b) in enumerate(pairs):
                x, y = known[a], known[b]
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(x) + len(y) - len(distinct(np.concatenate([x, y])))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        hits.append(i)
            yield batch.take(pa.array(hits, pa.int64())).select(["a", "b"])

    with_sets = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
    return with_sets.mapInArrow(exact, "a long, b long")


def near_components(
    items: DataFrame, sets_for, percent: int, unpack: Callable[[list], list[np.ndarray]] = stored_sets
) -> DataFrame:
    """``(id, root)`` for each id of ``items(id, keys)`` that is linked to another.

    Any two sets that share a key are compared, or already are in one component; ``sets_for(ids)`` gives ``(id, size, shingles)``
    of the asked ids, ``shingles`` as ``unpack`` reads them. A key that a third of all items share is
    pre-aggregated in the map tasks; the keys that occur more than once come back to their members
    as a counted broadcast, beyond its bound as a skewed join, one row for each member. Tables are deleted
    when their successors are written.
    """
    keys = items.select("id", F.explode("keys").alias("key"))
    low = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "zstd")
    buckets = written(keys.join(small(low), "key").select("key", "id", "n"), "zstd")
    dropped(low)
    # a bucket's centre is the member that meets most others over all its buckets: what copies were made from
    weights = buckets.groupBy("id").agg(F.sum("n").alias("weight"))
    weighed = buckets.join(weights, "id")
    best = F.max_by("id", F.struct("weight", -F.col("id")))
    centres = weighed.groupBy("key").agg(best.alias("a"))
    stars = written(buckets.join(centres, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "zstd")
    met = stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()
    sets = written(sets_for(small(written(met))), "zstd")
    links = written(verify(stars.select("a", "b"), sets, percent, unpack))
    roots = components(links)
    placed = buckets.where("n > 2").select("key", "id").join(sets.select("id", "size"), "id").join(roots, "id", "left")
    state = still_open(placed.withColumn("root", F.coalesce("root", "id")))
    tried, more = None, None
    for turn in range(ROUNDS + 1):
        if state.isEmpty():
            break
        pairs = written(across(state, sets, percent, tried, turn < ROUNDS, unpack))
        each = pairs.select("a", "b").distinct()
        found = written(verify(each, sets, percent, unpack).withColumn("holds", F.lit(True)))
        known = written(each.join(found, ["a", "b"], "left").withColumn("holds", F.coalesce("holds", F.lit(False))))
        more = found if more is None else more.unionByName(found)
        tried = known if tried is None else tried.unionByName(known)
        failed = pairs.join(known.where("not holds"), ["a", "b"], "left_semi").select("key").distinct()
        last, state = state, written(state.join(failed, "key", "left_semi"), "zstd")
        dropped(last, pairs)
    if more is not None and not more.isEmpty():
        edges = roots.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
        last, roots = roots, components(edges.unionByName(more.select("a", "b")))
        dropped(last)
    dropped(buckets, sets, stars)
    return roots


def still_open(placed: DataFrame) -> DataFrame:
    """The rows of the buckets of ``placed(key, id, size, root)`` that hold several components. Buckets with the
    same largest component, if it has ``MERGE`` members or more there, become one: near copies meet in
    most tables, and so each of them is carried once and not once for each table."""
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    shares = counts.groupBy("key").agg(
        F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main")
    )
    open_keys = shares.where("roots > 1").select(
        "key", F.when(F.col("n_main") >= MERGE, F.xxhash64("main", F.lit(1))).otherwise(F.col("key")).alias("to")
    )
    rows = placed.join(open_keys, "key").select(F.col("to").alias("key"), "id", "size", "root")
    return written(rows.distinct(), "zstd")


def parities(sets: list[np.ndarray]) -> list[bytes]:
    """Bitmaps of the sets: bit i tells whether an odd number of hashes falls on it. The bits in which
    two maps of one length differ are never more than the hashes that only one of the sets has."""
    out = []
    for s in sets:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(SPARSE * len(s) - 1, 0).bit_length()))
        at = (s >> np.uint64(16)) & np.uint64(bits - 1)
        odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits each map of ``x`` differs from each of ``y``, rows of 64-bit words; the longer
    maps are folded to the length of the shorter ones."""
    while x.shape[1] != y.shape[1]:
        if x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        else:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
    out = np.zeros((len(x), len(y)), np.int64)
    for i in range(x.shape[1]):
        out += np.bitwise_count(x[:, i, None] ^ y[None, :, i])
    return out


def across(
    rest: DataFrame,
    sets: DataFrame,
    percent: int,
    tried: DataFrame | None = None,
    forest: bool = False,
    unpack: Callable[[list], list[np.ndarray]] = stored_sets,
) -> DataFrame:
    """Pairs ``(key, a, b)`` of ``rest(key, id, size, root)`` in one bucket and different components that can
    reach ``percent`` by their sizes and parity bitmaps and are not in ``tried(a, b, holds)``: all of them, or with
    ``forest`` for each group a spanning forest of its components, made of the most likely pairs.

    These members are cut into blocks of about ``BLOCK``. Every two blocks meet in a group, and every block
    meets the members of the largest component, in parts of about ``MAIN``; members of the largest component
    never meet each other. So groups are bounded, and the work is the number of other members times all."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
            found = parities(unpack([x.as_buffer() for x in batch.column("shingles")]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "bits"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("members")[i].values
                a, b = candidates(rows, percent, forest)
                key = pa.array(np.full(len(a), batch.column("key")[i].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([key, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["key", "a", "b"])

    asked = rest.select("id").distinct()
    bits = sets.join(asked, "id", "left_semi").select("id", "shingles").mapInArrow(maps, "id long, bits binary")
    lists = ("not", "linked")
    if tried is None:
        bits = bits.withColumns({c: F.array().cast("array<long>") for c in lists})
    else:
        both = tried.select(F.col("a").alias("id"), F.col("b").alias("x"), "holds")
        both = both.unionByName(tried.select(F.col("b").alias("id"), F.col("a").alias("x"), "holds"))
        known = both.join(asked, "id", "left_semi").groupBy("id").agg(
            F.collect_list("x").alias("not"), F.collect_list(F.when(F.col("holds"), F.col("x"))).alias("linked")
        )
        bits = bits.join(known, "id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<long>")) for c in lists})
    counts = rest.groupBy("key", "root").agg(F.count("*").alias("n"))
    shares = counts.groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n")
    )
    blocks = F.ceil((F.col("n") - F.col("n_main")) / BLOCK)
    parts = F.ceil(F.col("n_main") / MAIN)
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), parts).otherwise(blocks))
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # groups (i, j): blocks i <= j of other members; or block i and, as -1 - j, part j of the largest component
    with_main = lambda i, j: F.struct(i.alias("i"), (-1 - j).alias("j"))
    groups = F.when(F.col("is_main"), F.transform(up_to(blocks), lambda x: with_main(x, F.col("block")))).otherwise(
        F.concat(
            F.transform(up_to(blocks), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j"))),
            F.transform(up_to(parts), lambda x: with_main(F.col("block"), x)),
        )
    )
    members = (
        rest.join(shares, "key")
        .withColumn("is_main", F.col("root") == F.col("main"))
        .withColumn("block", mine)
        .withColumn("meet", F.explode(groups))
        .withColumn("side", F.when(F.col("is_main"), 2).otherwise(F.when(F.col("block") == F.col("meet.i"), 0).otherwise(1)))
        .join(bits, "id")
    )
    together = members.groupBy("key", "meet.i", "meet.j").agg(
        F.collect_list(F.struct("id", "size", "root", "side", "bits", *lists)).alias("members")
    )
    return together.select("key", "members").mapInArrow(meet, "key long, a long, b long")


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels after nodes labelled ``a`` and ``b`` are connected, the smallest of each component."""
    to = np.arange(len(labels))
    while True:
        last = to
        low = np.minimum(to[a], to[b])
        to = to.copy()
        np.minimum.at(to, a, low)
        np.minimum.at(to, b, low)
        to = to[to]
        if (to == last).all():
            return to[labels]


def spanning(u: np.ndarray, v: np.ndarray, d: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which of the edges between nodes ``u`` and ``v`` are the shortest spanning forest of what ``labels``
    (the smallest node of each component) leave apart: every component takes its shortest edge, until none is left."""
    place = np.lexsort([v, u, d])
    u, v, kept = u[place], v[place], []
    while len(place):
        a, b = labels[u], labels[v]
        live = a != b
        u, v, a, b, place = u[live], v[live], a[live], b[live], place[live]
        shortest = np.full(len(labels), len(place))
        at = np.arange(len(place))
        np.minimum.at(shortest, a, at)
        np.minimum.at(shortest, b, at)
        taken = np.unique(shortest[shortest < len(place)])
        kept.append(place[taken])
        labels = merged(labels, a[taken], b[taken])
    return np.concatenate([np.empty(0, np.int64), *kept])


def candidates(rows: pa.StructArray, percent: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group, members of side 0 with those of the other side (with each other if there is none)."""
    ids, sizes, roots, side = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("id", "size", "root", "side"))
    maps, nots, linked = (rows.field(c).to_pylist() for c in ("bits", "not", "linked"))
    known, nodes = np.unique(roots, return_inverse=True)
    labels = np.arange(len(known))
    place = {x: i for i, x in enumerate(ids.tolist())}
    ends = [(i, place[x]) for i, partners in enumerate(linked) for x in partners if x in place]
    if ends:
        a, b = np.array(ends).T
        labels = merged(labels, nodes[a], nodes[b])
    groups = labels[nodes]
    kinds: dict[int, np.ndarray] = {}
    lengths = np.array([len(m) for m in maps])
    for n in np.unique(lengths):
        kinds[int(n)] = np.flatnonzero(lengths == n)
    words = {n: np.frombuffer(b"".join(maps[k] for k in at), np.uint64).reshape(len(at), -1) for n, at in kinds.items()}
    alone = (side == 0).all()
    out = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for n, left_all in kinds.items():
        of_left = np.flatnonzero(side[left_all] == 0)
        for m, right_all in kinds.items():
            of_right = np.arange(len(right_all)) if alone else np.flatnonzero(side[right_all] != 0)
            right = right_all[of_right]
            for k in range(0, len(of_left), 256):
                at = of_left[k : k + 256]
                left = left_all[at]
                x, y = left[:, None], right[None, :]
                ok = groups[x] != groups[y]
                ok &= 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])
                if alone:
                    ok &= ids[x] < ids[y]
                for u, row in enumerate(left.tolist()):
                    if nots[row]:
                        ok[u] &= ~np.isin(ids[right], nots[row])
                rows_, columns = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
                if not len(rows_):
                    continue
                distance = differing(words[n][at[rows_]], words[m][of_right[columns]])
                both = (sizes[left[rows_]][:, None] + sizes[right[columns]][None, :]).astype(float)
                near = ok[np.ix_(rows_, columns)] & ((100 + percent) * distance <= (100 - percent) * both)
                u, v = np.nonzero(near)
                new = (left[rows_[u]], right[columns[v]], distance[u, v] / both[u, v])
                out = tuple(np.concatenate(x) for x in zip(out, new))
                if forest:
                    keep = spanning(nodes[out[0]], nodes[out[1]], out[2], labels)
                    out = tuple(x[keep] for x in out)
    return ids[out[0]].astype(np.int64), ids[out[1]].astype(np.int64)

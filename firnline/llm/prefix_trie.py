"""Prefix trie of conversations from padded matrices of turn identifiers.

A turn's identifier is 12 bytes of the SHA-256 of role and text and, in the last 4, the text's
length in bytes; a conversation is the row of its turns' identifiers. The rows are range-sharded by
(row, conv_id), so that even a conversation that a third of all share spreads over shards. A shard is
read in slices of at most ``CELLS`` cells and ``ROWS`` rows, each a matrix padded with zeros: a lexsort
orders it, cells that differ from the row above are OR-accumulated along the row and so mark where the
nodes of every depth start, and ``reduceat`` sums up each depth. All sums are of rows, with a node's
own share given to the row where it starts, so nodes that reach over a slice's edge need only be added up:
they leave as partial rows with a digest of their prefix and are recombined by one grouping. Each
shard gets how many turns its first row shares with the row before it, two numbers for each shard.

Defined cases: rows without a conv_id belong to no conversation; turns are ordered by ``turn``, null
first, equal ones by their identifiers; null roles and texts are empty; an empty table has no nodes.
One conversation is one row of 16 bytes a turn, which a task holds. SHA-256 of the members' list of
one node is sequential: lists that reach over slices are hashed from chunks of ``ROWS`` identifiers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.llm.common import checkpointed, crc32_sql, table, workers_see_package, written

TURN = 16
CELLS = 1 << 18
ROWS = 4096
NOTHING = hashlib.sha256(b"").hexdigest()
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
SCHEMA = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends string, node binary, parent binary, slice long"
)


def sequences(conversations: DataFrame, group: int = 1) -> DataFrame:
    """``(base, conv_id, key)``: each conversation's turns as one binary row, ``base`` is its conv_id
    less what remains by ``group``. Conversations of one base are in one partition."""
    conv = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.unhex(F.concat(F.substring(digest, 1, 2 * TURN - 8), F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % group).alias("base"), conv.alias("conv_id"), F.col("turn"), turn.alias("turn_id")
    )
    turns = F.sort_array(F.collect_list(F.struct("turn", "turn_id")))
    key = F.unhex(F.array_join(F.transform(turns, lambda x: F.hex(x["turn_id"])), ""))
    return rows.repartition("base").groupBy("base", "conv_id").agg(key.alias("key"))


def with_heads(rows: DataFrame, shared: int, modulus: int) -> DataFrame:
    """``(conv_id, key)``: the first crc32(conv_id) % ``modulus`` (at most ``shared``) turns are those of
    the base conversation, the others the conversation's own after as many."""
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.substring("key", 1, TURN * shared))).alias("head")
    together = rows.groupBy("base").agg(head, F.collect_list(F.struct("conv_id", "key")).alias("members"))
    each = together.select("head", F.inline("members"))
    n = (F.crc32(F.col("conv_id").cast("string")) % modulus).cast("int") * TURN
    nothing = F.lit(b"")
    return each.select(
        "conv_id",
        F.concat(F.coalesce(F.substring(F.col("head"), F.lit(1), n), nothing), F.substring(F.col("key"), n + 1, F.length("key"))).alias("key"),
    )


def shared_turns(a: bytes, b: bytes) -> int:
    x, y = (np.frombuffer(v, f"V{TURN}")[: min(len(a), len(b)) // TURN] for v in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else len(x)


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list[memoryview]]:
    return batch.column(0).to_numpy(), [memoryview(x.as_buffer()) for x in batch.column(1)]


def slices(keys: list, cells: int = CELLS, most: int = ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of ``most`` rows or fewer whose padded matrix has at most ``cells`` cells (a longer row
    stands alone)."""
    start, width = 0, 1
    for i, k in enumerate(keys):
        wider = max(width, len(k) // TURN)
        if i > start and (i - start == most or (i - start + 1) * wider > cells):
            yield start, i
            start, wider = i, max(1, len(k) // TURN)
        width = wider
    if keys:
        yield start, len(keys)


def prefix_digests(key: bytes) -> list[bytes]:
    """A digest of every prefix, the empty one first."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for i in range(0, len(key), TURN):
        h.update(key[i : i + TURN])
        out.append(h.copy().digest())
    return out


def nodes_of(convs: np.ndarray, keys: list, shared: int, before: int, number: int) -> pa.RecordBatch:
    """The nodes of one slice. ``shared`` turns its first row has in common with the row before it, which
    has ``before`` turns; -1 and -1 if no row stands before it."""
    lengths = np.array([len(k) // TURN for k in keys], np.int64)
    n, width = len(keys), int(lengths.max())
    filled = np.arange(width) < lengths[:, None]
    flat = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)
    matrix = np.zeros((n, width, 2), np.uint64)
    matrix[filled] = flat
    columns = [matrix[:, j, i] for j in range(width - 1, -1, -1) for i in (1, 0)]
    order = np.lexsort([convs, *columns]) if n > 1 else np.zeros(1, np.int64)
    matrix, lengths, convs, filled = matrix[order], lengths[order], convs[order], filled[order]

    changed = np.ones((n, width), bool)
    changed[1:] = (matrix[1:] != matrix[:-1]).any(2)
    changed[0] = np.arange(width) >= shared
    np.logical_or.accumulate(changed, axis=1, out=changed)
    above = np.r_[before, lengths[:-1]]
    common = np.minimum(np.minimum((~changed).sum(1), lengths), above)
    common[0] = shared
    starts = changed & filled
    # a row is a new sequence unless it repeats the row above; then that one may have been extended
    new = ~((common == lengths) & (above == lengths))
    extends = (common == above) & (above < lengths) & (above >= 0)
    size = (matrix[:, :, 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    saved = np.where(filled & ~starts, size, 0)
    saved = np.c_[saved, np.zeros(n, np.int64)][:, ::-1].cumsum(1)[:, ::-1]

    first, last = (prefix_digests(bytes(keys[order[i]])) for i in (0, n - 1))
    parts: list[list] = []
    upper: tuple | None = None
    for depth in range(width + 1):
        at = np.flatnonzero(lengths >= depth)
        fresh = starts[at, depth - 1].copy() if depth else np.zeros(len(at), bool)
        fresh[0] = True
        cut = np.flatnonzero(fresh)
        rows = at[cut]
        sums = lambda x: np.add.reduceat(x[at].astype(np.int64), cut)
        low = np.minimum.reduceat(convs[at], cut)
        count = np.diff(np.r_[cut, len(at)])
        children = sums(starts[:, depth]) if depth < width else np.zeros(len(cut), np.int64)
        leaves = sums(new) - sums(extends & (above >= depth))
        gain = sums(saved[:, max(depth - 1, 0)])
        node: list[bytes | None] = [None] * len(cut)
        if at[-1] == n - 1:
            node[-1] = last[depth]
        if at[0] == 0 and shared >= depth:
            node[0] = first[depth]
        members = sums(lengths == depth)
        ends = []
        for i, r, m in zip(node, rows.tolist(), members.tolist()):
            text = ",".join(map(str, convs[r : r + m].tolist())) if m else ""
            ends.append(text if i is not None else hashlib.sha256(text.encode()).hexdigest() if m else NOTHING)
        if upper is None:
            parents, of = np.full(len(cut), -1), [None] * len(cut)
            known = np.zeros(len(cut), bool)
        else:
            up = np.searchsorted(upper[0], rows, "right") - 1
            parents, of = upper[1][up], [upper[2][i] for i in up.tolist()]
            known = np.array([x is None for x in of])
        parts.append([low, np.full(len(cut), depth), parents, known, count, children, leaves, gain, ends, node, of])
        upper = (rows, low, node)
    join = lambda i: np.concatenate([p[i] for p in parts])
    flat_list = lambda i: [x for p in parts for x in p[i]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(join(0)),
            pa.array(join(1)),
            pa.array(join(2), mask=~join(3)),
            *[pa.array(join(i)) for i in (4, 5, 6, 7)],
            pa.array(flat_list(8), pa.string()),
            pa.array(flat_list(9), pa.binary()),
            pa.array(flat_list(10), pa.binary()),
            pa.array(np.full(sum(len(p[0]) for p in parts), number)),
        ],
        ["conv_id", "depth", "parent_conv_id", *SUMS, "ends", "node", "parent", "slice"],
    )


def edges(sharded: DataFrame) -> dict[int, tuple[int, int]]:
    """For each shard with rows: the turns its first row shares with the last row before it, and how
    many turns that one has. Two integers for each shard come to the driver."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.column(1)[0].as_py() if first is None else first
                last = batch.column(1)[batch.num_rows - 1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "first": first, "last": last}])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                above = x["above"]
                row = {"shard": x["shard"], "shared": -1, "before": -1}
                if above is not None:
                    row.update(shared=shared_turns(x["first"], above), before=len(above) // TURN)
                yield pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.int64()) for c in row]))

    found = written(sharded.mapInArrow(ends, "shard long, first binary, last binary"))
    above = found.select("shard", "first", F.lag("last").over(Window.orderBy("shard")).alias("above"))
    rows = above.mapInArrow(compare, "shard long, shared long, before long").collect()
    return {r["shard"]: (r["shared"], r["before"]) for r in rows}


def trie(rows: DataFrame, cells: int = CELLS, most: int = ROWS) -> DataFrame:
    """All nodes of the trie of ``rows(conv_id, key)``, one row for each: ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    workers_see_package(rows.sparkSession)
    sharded = rows.select("conv_id", "key").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    sharded = checkpointed(sharded)
    known = edges(sharded)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        shared, before = known.get(shard, (-1, -1))
        number, last = shard << 32, None
        for batch in batches:
            convs, keys = rows_of(batch)
            for i, j in slices(keys, cells, most):
                if last is not None:
                    shared, before = shared_turns(bytes(keys[i]), last), len(last) // TURN
                yield nodes_of(convs[i:j], keys[i:j], shared, before, number)
                number, last = number + 1, bytes(keys[j - 1])

    found = written(sharded.mapInArrow(build, SCHEMA))
    whole, partial = found.where("node is null"), found.where("node is not null")
    merged = written(
        partial.groupBy("node").agg(
            F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in SUMS],
        )
    )
    names = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    lists = member_lists(partial.where("ends <> ''"))
    columns = ["conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256"]
    over_edges = (
        merged.join(lists, "node", "left")
        .join(names, "parent", "left")
        .select("conv_id", "depth", F.col("above").alias("parent_conv_id"), *SUMS, F.coalesce("list", F.lit(NOTHING)).alias("ends_sha256"))
    )
    whole = whole.withColumnRenamed("ends", "ends_sha256")
    # a slice names few partial parents; their children are joined by (slice, parent)
    named = whole.where("parent is not null").select("slice", "parent").distinct().join(names, "parent")
    below = whole.where("parent is not null").join(named, ["slice", "parent"]).withColumn("parent_conv_id", F.col("above"))
    return whole.where("parent is null").select(columns).unionByName(below.select(columns)).unionByName(over_edges.select(columns))


def member_lists(chunks: DataFrame) -> DataFrame:
    """``(node, list)``: the SHA-256 of each node's chunks ``ends`` in the order of their slices."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = h = None
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                key, text = key.as_py(), text.as_py().encode()
                if key == node:
                    h.update(b"," + text)
                    continue
                if node is not None:
                    yield row(node, h)
                node, h = key, hashlib.sha256(text)
        if node is not None:
            yield row(node, h)

    def row(node: bytes, h) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], ["node", "list"])

    ordered = chunks.select("node", "slice", "ends").repartition("node").sortWithinPartitions("node", "slice")
    return ordered.select("node", "ends").mapInArrow(digest, "node binary, list string")


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per node of the rebuilt conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(with_heads(sequences(turns, 5), 8, 9))


_TURNS = """
turns AS (SELECT conv_id, turn, substr(sha256(strlen(r) || ':' || r || t), 1, 24) || printf('%08x', strlen(t)) AS id
          FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids FROM turns GROUP BY conv_id)"""

OP13_SQL = f"""
WITH {_TURNS},
headed AS (SELECT o.conv_id, o.ids, coalesce(b.ids, []) AS base, {crc32_sql("CAST(o.conv_id AS VARCHAR)")} % 9 AS h
           FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
built AS (SELECT conv_id, list_concat(base[1:h], ids[h + 1:]) AS ids FROM headed),
members AS (SELECT conv_id, len(ids) AS n, d, array_to_string(ids[1:d], '') AS key FROM built, unnest(range(0, len(ids) + 1)) u(d)),
nodes AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
          FROM members GROUP BY d, key),
tree AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children,
                CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * CAST('0x' || right(n.key, 8) AS BIGINT) END AS own_saved
         FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = substr(n.key, 1, 32 * (n.d - 1))
         LEFT JOIN (SELECT d - 1 AS d, substr(key, 1, 32 * (d - 1)) AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL) c
              ON c.d = n.d AND c.key = n.key),
below AS (SELECT a AS d, substr(key, 1, 32 * a) AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum(own_saved) AS saved
          FROM tree, unnest(range(0, d + 1)) u(a) GROUP BY ALL)
SELECT conv_id, t.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM tree t JOIN below b ON b.d = t.d AND b.key = t.key
"""

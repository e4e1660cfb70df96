"""Merkle manifest of a table: leaves by group, subroots, one root, inclusion proofs.

Every row is a leaf, the SHA-256 of its fields. The leaves of a group (a source) stand in the order of
``doc_id``, and runs of ``FAN`` nodes become one node until one is left; the groups' subroots become
the root in the same way. No leaf is sorted to find its place. Identifiers are set as bits of 64-bit
words, 64 words make a container with a map of the words it has (empty words take no room), and each
word and container knows how many rows come before it. A row's place is its container's base, its
word's base and the number of bits below its own: a few bit operations beside one join by container.
Places are keys of slot arrays: ``place >> 4`` names the node, ``place & 15`` the slot, so each level is
one grouping with groups of sixteen, however large a source is.

Defined cases: a null ``doc_id`` comes first, as the smallest 64-bit integer would; rows that share an
identifier stand in the order of their leaf digests and equal rows beside each other; a null source
is the first group; an empty table gives no rows. Everything runs in DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.llm.common import crc32_sql, small, table, written

#: Nodes in a run; a place's low bits are its slot.
FAN, SHIFT = 16, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Entries of one directory that are added up in one window: 2 ** DIRECTORY.
DIRECTORY = 12
SMALLEST = -(1 << 63)
#: Copies of one row that one task numbers.
CHUNK = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_of(fields: list[Column]) -> Column:
    """Each field as ``-`` if null, else its number of UTF-8 bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return sha(
        F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])
    )


def leaf_table(docs: DataFrame, claimed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(s, doc_id, k, leaf, claim)``: the group as a string that sorts null first, the identifier,
    its place in the order, the leaf and the leaf with the columns ``claimed`` in place of their own."""
    own = [F.col(c) for c in fields]
    other = [(claimed or {}).get(c, F.col(c)) for c in fields]
    s = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    key = F.col("doc_id").cast("long")
    leaf = leaf_of(own)
    return docs.select(
        s.alias("s"),
        key.alias("doc_id"),
        F.coalesce(key, F.lit(SMALLEST)).alias("k"),
        leaf.alias("leaf"),
        (leaf_of(other) if claimed else leaf).alias("claim"),
    )


def bases(rows: DataFrame, group: list[str], key: str, then: list[str]) -> DataFrame:
    """``rows`` with ``base``: the sum of ``n`` over the rows of the group that stand before it by the
    integer ``key`` and the columns ``then``. A window holds the entries that share all but the low
    bits of the key; above it stand directories of directories, so no window grows with a group."""
    most = rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if most <= 1 << DIRECTORY:
        return rows.withColumn("base", before(Window.partitionBy(*group).orderBy(key, *then)))
    up, block = F.shiftright(key, DIRECTORY), f"{key}_block"
    blocks = rows.groupBy(*group, up.alias(block)).agg(F.sum("n").alias("n"))
    upper = bases(written(blocks), group, block, []).select(*group, block, F.col("base").alias("above"))
    inside = rows.withColumn(block, up)
    inside = inside.withColumn("within", before(Window.partitionBy(*group, block).orderBy(key, *then)))
    joined = inside.join(upper, [*group, block])
    return joined.withColumn("base", F.col("above") + F.col("within")).drop(block, "above", "within")


def low_bits(at: Column) -> Column:
    """Ones below bit ``at``."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), at.cast("int")))


def bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def low6(c: Column) -> Column:
    return c.bitwiseAND(F.lit(63).cast("long"))


def containers(leaves: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(s, c, n_group, base, present, words)`` by 4096 identifiers: a bitmap of the words that are
    there, and for each of these its bits, the rows before it and its repeated identifiers; and
    ``(s, k, extra)`` of the identifiers of more than one row, or None."""
    words = written(
        leaves.groupBy("s", F.shiftright("k", 6).alias("w")).agg(
            F.bit_or(bit(low6(F.col("k")))).alias("bits"), F.count("*").alias("n")
        )
    )
    crowded = words.where(F.col("n") > F.bit_count("bits"))
    none = F.array().cast("array<struct<at:long,extra:long>>")
    repeated = None
    if crowded.isEmpty():
        words = words.withColumn("more", none)
    else:
        near = small(written(crowded.select("s", "w")))
        counts = leaves.select("s", "k", F.shiftright("k", 6).alias("w")).join(near, ["s", "w"], "left_semi")
        repeated = written(counts.groupBy("s", "k").agg((F.count("*") - 1).alias("extra")).where("extra > 0"))
        more = repeated.groupBy("s", F.shiftright("k", 6).alias("w")).agg(
            F.collect_list(F.struct(low6(F.col("k")).alias("at"), "extra")).alias("more")
        )
        words = words.join(more, ["s", "w"], "left").withColumn("more", F.coalesce("more", none))
    found = words.groupBy("s", F.shiftright("w", 6).alias("c")).agg(
        F.sum("n").alias("n"),
        F.bit_or(bit(low6(F.col("w")))).alias("present"),
        F.sort_array(F.collect_list(F.struct(low6(F.col("w")).alias("i"), "bits", "n", "more"))).alias("list"),
    )
    ranked = F.aggregate(
        "list",
        F.struct(F.lit(0).cast("long").alias("rows"), F.array().cast("array<struct<bits:long,before:long,more:array<struct<at:long,extra:long>>>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["rows"] + x["n"]).alias("rows"),
            F.concat(acc["out"], F.array(F.struct(x["bits"].alias("bits"), acc["rows"].alias("before"), x["more"].alias("more")))).alias("out"),
        ),
    )["out"]
    found = written(found.select("s", "c", "n", "present", ranked.alias("words")))
    sizes = found.groupBy("s").agg(F.sum("n").alias("n_group"))
    return bases(found, ["s"], "c", []).drop("n").join(sizes, "s"), repeated


def rank_in(k: Column) -> Column:
    """Rows of the joined container before the identifier ``k``."""
    at = low6(F.shiftright(k, 6))
    word = F.element_at("words", (F.bit_count(F.col("present").bitwiseAND(low_bits(at))) + 1).cast("int"))
    below = low6(k)
    extra = F.aggregate(
        word["more"], F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["at"] < below, x["extra"]).otherwise(0)
    )
    return word["before"] + F.bit_count(word["bits"].bitwiseAND(low_bits(below))) + extra


def placed(leaves: DataFrame) -> DataFrame:
    """``(s, place, n_group, doc_id, leaf, claim)`` of every row of a leaf table, places from 0 on."""
    index, repeated = containers(leaves)
    index = written(index)
    kept = ["s", "place", "n_group", "doc_id", "leaf", "claim"]

    def looked_up(rows: DataFrame) -> DataFrame:
        joined = rows.withColumn("c", F.shiftright("k", 12)).join(index, ["s", "c"])
        return joined.withColumn("place", F.col("base") + rank_in(F.col("k")))

    if repeated is None:
        return looked_up(leaves).select(*kept)
    keys = small(repeated.select("s", "k"))
    single = looked_up(leaves.join(keys, ["s", "k"], "left_anti")).select(*kept)
    # rows that share an identifier: equal ones once with their number, then by digest
    equal = leaves.join(keys, ["s", "k"], "left_semi").groupBy("s", "k", "doc_id", "leaf", "claim").agg(F.count("*").alias("n"))
    prefix = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")
    inside = bases(written(equal.withColumn("digits", prefix)), ["s", "k"], "digits", ["leaf"])
    starts = small(written(looked_up(repeated).select("s", "k", "n_group", F.col("place").alias("start"))))
    several = inside.join(starts, ["s", "k"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    spread = several.repartition(F.col("leaf"), F.col("chunk"))
    copy = F.explode(F.sequence("chunk", F.least(F.col("chunk") + CHUNK, F.col("n")) - 1))
    many = spread.withColumn("copy", copy).withColumn("place", F.col("start") + F.col("base") + F.col("copy"))
    return single.unionByName(many.select(*kept))


def node_of(digests: Column) -> Column:
    return sha(F.concat_ws("", digests))


@dataclass
class Levels:
    """The slot arrays ``(s, g, n, kids)`` from the lowest level up, ``n`` nodes before the grouping, and
    ``(s, digest)`` of what remains for each tree."""

    arrays: list[DataFrame]
    tops: DataFrame


def reduced(nodes: DataFrame) -> Levels:
    """Runs of nodes ``(s, place, n, digest)``, ``n`` the nodes of the tree, to one node for each ``s``."""
    arrays, tops = [], nodes.where("n = 1").select("s", "digest")
    while not nodes.where("n > 1").isEmpty():
        slot = F.struct(F.col("place").bitwiseAND(F.lit(FAN - 1).cast("long")).alias("i"), "digest")
        level = written(
            nodes.where("n > 1")
            .groupBy("s", F.shiftright("place", SHIFT).alias("g"))
            .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(slot))["digest"].alias("kids"))
        )
        arrays.append(level)
        nodes = level.select("s", F.col("g").alias("place"), F.ceil(F.col("n") / FAN).alias("n"), node_of(F.col("kids")).alias("digest"))
        tops = tops.unionByName(nodes.where("n = 1").select("s", "digest"))
    return Levels(arrays, tops)


def step(kids: Column, at: Column) -> Column:
    """The siblings before and after the slot ``at`` (from 0)."""
    at = at.cast("int")
    return F.struct(
        F.concat_ws("", F.slice(kids, F.lit(1), at)).alias("before"),
        F.concat_ws("", F.slice(kids, at + 2, F.lit(FAN))).alias("after"),
    )


def paths(levels: list[DataFrame], over: DataFrame) -> DataFrame:
    """``(s, g, kids, path, subroot)`` of the lowest slot arrays: ``path`` holds the siblings from the
    node above the array up to the root; ``over(s, path, subroot)`` gives what stands above each tree."""
    found = None
    for level in reversed(levels):
        top = level.where(F.col("n") <= FAN).join(over, "s")
        here = top.select(*level.columns, "path", "subroot")
        if found is not None:
            above = found.select("s", F.col("g").alias("up"), F.col("kids").alias("run"), "path", "subroot")
            lower = level.where(F.col("n") > FAN).withColumn("up", F.shiftright("g", SHIFT)).join(above, ["s", "up"])
            own = F.array(step(F.col("run"), F.col("g").bitwiseAND(F.lit(FAN - 1).cast("long"))))
            here = here.unionByName(lower.select(*level.columns, F.concat(own, "path").alias("path"), "subroot"))
        found = here
    return found


def numbered(groups: DataFrame) -> DataFrame:
    """``groups(s, digest)`` with their ``place`` in the order of ``s``: a range for each partition, and the
    ranges' sizes, a number for each, added up."""
    ranged = written(groups.repartitionByRange("s").sortWithinPartitions("s").withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33).alias("part")
    sizes = ranged.groupBy(part).agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    place = F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("part", part).join(F.broadcast(starts), "part").select("s", "digest", place.alias("place"))


def manifest(leaves: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row of a leaf
    table. ``proof_sha256`` is the digest of the row's siblings from its run up to the root, left to right;
    ``folded_root`` what these give with the row's ``claim``, and ``verified`` whether it is the root."""
    leaves = written(leaves)
    slot = F.struct(F.col("place").bitwiseAND(F.lit(FAN - 1).cast("long")).alias("i"), "doc_id", "leaf", "claim")
    lowest = written(
        placed(leaves)
        .groupBy("s", F.shiftright("place", SHIFT).alias("g"))
        .agg(F.first("n_group").alias("n"), F.sort_array(F.collect_list(slot)).alias("rows"))
    )
    digest = F.when(F.col("n") == 1, F.col("rows")[0]["leaf"]).otherwise(node_of(F.col("rows")["leaf"]))
    nodes = lowest.select("s", F.col("g").alias("place"), F.ceil(F.col("n") / FAN).alias("n"), digest.alias("digest"))
    tree = reduced(nodes)
    groups = written(tree.tops)
    order = numbered(groups)
    upper = reduced(order.select(F.lit("").alias("s"), "place", F.lit(groups.count()).cast("long").alias("n"), "digest"))
    found = upper.tops.first()
    root = found["digest"] if found else None
    steps = "array<struct<before:string,after:string>>"
    nothing = leaves.sparkSession.createDataFrame([("", [], "")], f"s string, path {steps}, subroot string")
    if upper.arrays:
        runs = paths(upper.arrays, nothing)
        sources = order.withColumn("g", F.shiftright("place", SHIFT)).join(runs.select("g", "kids", "path"), "g")
        own = F.array(step(F.col("kids"), F.col("place").bitwiseAND(F.lit(FAN - 1).cast("long"))))
        over = sources.select("s", F.concat(own, "path").alias("path"), F.col("digest").alias("subroot"))
    else:
        over = groups.select("s", F.array().cast(steps).alias("path"), F.col("digest").alias("subroot"))
    over = written(over)
    leaf_runs = lowest.select("s", "g", "n", F.col("rows")["leaf"].alias("kids"), "rows")
    above = paths([leaf_runs, *tree.arrays], over)
    one = F.col("n") == 1
    full = lambda i: F.when(one, F.col("path")).otherwise(F.concat(F.array(step(F.col("kids"), i)), F.col("path")))

    def answer(row: Column) -> Column:
        path = full(row["i"])
        text = F.concat_ws("", F.transform(path, lambda e: F.concat(e["before"], e["after"])))
        folded = F.aggregate(path, row["claim"], lambda acc, e: sha(F.concat(e["before"], acc, e["after"])))
        return F.struct(
            row["doc_id"].alias("doc_id"), row["leaf"].alias("leaf"), sha(text).alias("proof_sha256"), folded.alias("folded_root")
        )

    rows = above.select("subroot", F.inline(F.transform("rows", answer)))
    return rows.select(
        "doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"),
    )


def op12_merkle_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document, texts of one in five documents lower-cased in the claim."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    claim = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return manifest(leaf_table(docs, {"text": claim}))


def manifest_sql(levels: int = 6, upper: int = 4) -> str:
    """The contract in DuckDB SQL, for up to ``FAN ** levels`` rows a source and ``FAN ** upper`` sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    head = " || ".join(field(c) for c in FIELDS[:-1])
    out = [
        f"""docs AS (SELECT doc_id, source, sha256({head} || {field("text")}) AS leaf, sha256({head} || {field("claimed")}) AS claim
  FROM (SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS claimed FROM documents))""",
        """l0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
  count(*) OVER (PARTITION BY source) AS n, leaf AS digest FROM docs)""",
    ]

    def climb(name: str, by: str, count: int) -> None:
        for i in range(1, count + 1):
            out.append(
                f"""{name}{i} AS MATERIALIZED (SELECT {by}, place // {FAN} AS place, CAST(ceil(any_value(n) / {FAN}) AS BIGINT) AS n, list(digest ORDER BY place) AS kids,
  CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest FROM {name}{i - 1} GROUP BY {by}, place // {FAN})"""
            )

    def descend(start: str, name: str, on: str, place: str, count: int) -> str:
        for i in range(1, count + 1):
            at = f"(({place} // {FAN ** (i - 1)}) % {FAN})"
            left, right = f"array_to_string(k.kids[1:{at}], '')", f"array_to_string(k.kids[{at} + 2:], '')"
            out.append(
                f"""{start}{i} AS MATERIALIZED (SELECT p.* EXCLUDE (proof, folded), proof || {left} || {right} AS proof,
  CASE WHEN len(k.kids) = 1 AND k.n = 1 AND p.{place}_n <= {FAN ** (i - 1)} THEN folded ELSE sha256({left} || folded || {right}) END AS folded
  FROM {start}{i - 1} p JOIN {name}{i} k ON {on} AND k.place = p.{place} // {FAN ** i})"""
            )
        return f"{start}{count}"

    climb("l", "source", levels)
    out.append(
        f"""s0 AS MATERIALIZED (SELECT 0 AS one, source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM l{levels})"""
    )
    climb("s", "one", upper)
    out.append(
        """p0 AS (SELECT doc_id, leaf, l0.source, l0.place AS low, l0.n AS low_n, s0.place AS high, s0.n AS high_n, s0.digest AS subroot, '' AS proof, claim AS folded
  FROM l0 JOIN s0 ON s0.source IS NOT DISTINCT FROM l0.source)"""
    )
    end = descend("p", "l", "k.source IS NOT DISTINCT FROM p.source", "low", levels)
    out.append(f"q0 AS (SELECT * FROM {end})")
    end = descend("q", "s", "true", "high", upper)
    return (
        "WITH " + ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM {end}, s{upper} r"""
    )


OP12_SQL = manifest_sql()

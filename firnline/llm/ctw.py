"""Language-model scores by context-tree weighting over bytes.

A text is its words with A-Z lower-cased, single spaces between them and a line feed at the end; line
feeds also stand before it. Every byte is decomposed into eight binary decisions, and for each decision
there is a tree of contexts, the last 0 to ``DEPTH`` bytes. A node's counts of zeros and ones give the
Krichevsky-Trofimov estimate, and a node's weighted probability is half its own estimate's and half
the product of its children's; the deepest nodes have only their own. A decision is predicted by the
mixture of the estimates along its path with the weights that the training texts give, down to
the deepest context seen in training, which takes what is left. Per byte of text, 1 / log10(2) times the
score is the code length in bits. Without training texts every byte is predicted alike.

How it runs. Texts go into chunks of about ``CHUNK`` bytes. A chunk's distinct n-grams of DEPTH + 1 bytes
and distinct words are counted inside it, so what is shuffled follows the distinct n-grams of a chunk and not
its bytes; counts of all chunks are added up by n-gram. Weights go up the tree and predictions come
down in blocks of two levels: all n-grams of a block that share the shorter context are computed
together, at most 256 * 256 of them whatever the corpus is, and only node sums and mixtures pass from
block to block. Values go back to the chunks that asked for them, where the texts are scored. Nothing is
broadcast, and the driver receives three numbers.

Defined cases: null and empty texts are one end token; a row with a null identifier is held out; rows
that share an identifier are scored each; an empty table gives no rows. Words are counted by 64-bit
hashes, n-grams by their exact codes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.llm.common import table, text_of, workers_see_package, written

DEPTH = 5
#: Levels of contexts that are computed together, from the deepest on; each block's n-grams are
#: grouped by its shorter context, so that a group has at most 256 * 256 of them.
BLOCKS = ((4, 5), (2, 3), (0, 1))
CHUNK = 32 << 20
#: Bytes whose n-grams are made at a time.
RUN = 1 << 20
#: N-grams for each group of contexts, about.
GROUP = 200_000
TABLE_BITS = 21
#: Rows that are packed at a time.
PACK = 1 << 19
SPREAD = np.uint64(0x9E3779B97F4A7C15)
END = b"\n"
HALF = np.log(0.5)


def plain(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split()) + END


def codes(raws: list[bytes]) -> np.ndarray:
    """The code of every byte with its ``DEPTH`` bytes before it, for each of the texts."""
    pad = END * DEPTH
    b = np.frombuffer(b"".join(pad + r for r in raws), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raws], np.int64)
    at = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(raws) + 1) * DEPTH, sizes)
    out = np.zeros(len(at), np.uint64)
    for i in range(DEPTH, -1, -1):
        out = (out << np.uint64(8)) | b[at - i]
    return out


def runs(raws: list[bytes], size: int = RUN) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` bytes."""
    start = total = 0
    for i, r in enumerate(raws):
        if i > start and total + len(r) > size:
            yield start, i
            start, total = i, 0
        total += len(r)
    if raws:
        yield start, len(raws)


def hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def words_of(raw: bytes) -> list[bytes]:
    """The words and the end."""
    return [*raw.split(), END]


# Texts, chunks, counts


def chunked(docs: DataFrame, train: Column) -> DataFrame:
    """``(chunk, doc_id, train, raw)``, written once: the texts as they are scored. Input partitions much
    smaller than a chunk are read together, as small chunks share few n-grams."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            raws = [plain(t) for t in batch.column(2).to_pylist()]
            of = []
            for r in raws:
                if filled and filled + len(r) > CHUNK:
                    chunk, filled = chunk + 1, 0
                filled += len(r)
                of.append(chunk)
            columns = [pa.array(of, pa.int64()), batch.column(0), batch.column(1), pa.array(raws, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "doc_id", "train", "raw"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("t"), text_of().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.coalesce(-(-size // CHUNK) or 1)
    return written(rows.mapInArrow(assign, "chunk long, doc_id long, train boolean, raw binary"), "zstd")


class Tally:
    """Distinct n-grams (kind 0) and hashes of words (kind 1) of one chunk with their numbers in training
    texts, as sorted arrays that are merged run by run."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}

    def add(self, raws: list[bytes], train: bool) -> None:
        for i, j in runs(raws):
            self.keep(0, *np.unique(codes(raws[i:j]), return_counts=True), train)
            words: Counter = Counter()
            for r in raws[i:j]:
                words.update(words_of(r))
            self.keep(1, hashes(words), np.fromiter(words.values(), np.int64, len(words)), train)

    def keep(self, kind: int, key: np.ndarray, n: np.ndarray, train: bool) -> None:
        self.parts[kind].append((key, n if train else np.zeros(len(n), np.int64)))
        if len(self.parts[kind]) == 8:
            self.parts[kind] = [self.merged(kind)]

    def merged(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = zip(*self.parts[kind])
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        for kind in (0, 1):
            key, n = self.merged(kind)
            for i in range(0, len(key), 1 << 16):
                part = slice(i, i + (1 << 16))
                size = len(key[part])
                columns = [np.full(size, chunk), np.full(size, kind, np.int32), key[part].view(np.int64), n[part]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["chunk", "kind", "key", "n"])


def tallied(texts: DataFrame) -> DataFrame:
    """``(chunk, kind, key, n)``: n-grams (kind 0) and words (kind 1) of each chunk, and how often they
    occur in its training texts. A chunk that two tasks read has rows of both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tally = None, Tally()
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            train = batch.column(1).to_numpy(zero_copy_only=False)
            raws = batch.column(2).to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if now is not None and chunks[i] != now:
                    yield from tally.rows(now)
                    tally = Tally()
                now = int(chunks[i])
                for flag in (True, False):
                    tally.add([r for r, t in zip(raws[i:j], train[i:j]) if t == flag], flag)
        if now is not None:
            yield from tally.rows(now)

    return written(texts.select("chunk", "train", "raw").mapInArrow(count, "chunk long, kind int, key long, n long"), "zstd")


# The tree, two levels at a time


def log_gamma(x: np.ndarray) -> np.ndarray:
    x, shift = x.astype(float).copy(), np.zeros(len(x))
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    y = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def log_kt(a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any order of so many zeros and ones."""
    return log_gamma(a0 + 0.5) + log_gamma(a1 + 0.5) - log_gamma(a0 + a1 + 1) - np.log(np.pi)


class Level:
    """The n-grams of one context length: for each of the eight decisions the nodes, in code order."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.code, self.node, self.keys, self.counts, self.bit = code, [], [], [], []
        for j in range(8):
            key = code >> np.uint64(8 - j)
            new = np.r_[True, key[1:] != key[:-1]]
            node = np.cumsum(new) - 1
            bit = ((code >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            size = int(node[-1]) + 1
            ones = np.bincount(node, n * bit, size)
            self.counts.append((np.bincount(node, n, size) - ones, ones))
            self.node.append(node)
            self.keys.append(key[new])
            self.bit.append(bit)
        self.weight: list[np.ndarray] = []

    def weigh(self, below: list[np.ndarray] | None) -> list[np.ndarray]:
        """The nodes' log weighted probabilities from their children's sums (None at the deepest level)."""
        out = []
        for j in range(8):
            own = log_kt(*self.counts[j])
            both = own if below is None else HALF + np.logaddexp(own, below[j])
            self.weight.append(np.ones(len(own)) if below is None else np.exp(HALF + own - both))
            out.append(both)
        return out

    def mix(self, state: np.ndarray) -> np.ndarray:
        """``state[gram, decision]`` is (mixed so far, weight left, deepest estimate seen)."""
        for j in range(8):
            a0, a1 = (a[self.node[j]] for a in self.counts[j])
            seen = a0 + a1 > 0
            estimate = (np.where(self.bit[j], a1, a0) + 0.5) / (a0 + a1 + 1)
            weight = self.weight[j][self.node[j]]
            mixed, left, last = state[:, j, 0], state[:, j, 1], state[:, j, 2]
            state[:, j, 0] = np.where(seen, mixed + left * weight * estimate, mixed)
            state[:, j, 1] = np.where(seen, left * (1 - weight), left)
            state[:, j, 2] = np.where(seen, estimate, last)
        return state


def low_code(code: np.ndarray, depth: int) -> np.ndarray:
    """The code of the last ``depth`` context bytes and the byte."""
    return code & np.uint64((1 << (8 * (depth + 1))) - 1)


class Block:
    """Two levels, ``low`` and ``low + 1``, of whole groups of n-grams (sorted codes of the deeper level)."""

    def __init__(self, code: np.ndarray, n: np.ndarray, low: int, sums: pa.Table | None):
        self.low = low
        short, self.up = np.unique(low_code(code, low), return_inverse=True)
        self.deep = Level(code, n)
        self.short = Level(short, np.bincount(self.up, n, len(short)))
        inbound = None
        if sums is not None:
            inbound = [np.zeros(len(k)) for k in self.deep.keys]
            key, at, value = (sums[c].to_numpy() for c in ("key", "at", "value"))
            for j in range(8):
                here = at == j
                where = np.searchsorted(self.deep.keys[j], key[here].view(np.uint64))
                np.add.at(inbound[j], where, value[here])
        deep = self.deep.weigh(inbound)
        below = []
        for j in range(8):
            first = np.flatnonzero(np.r_[True, np.diff(self.deep.node[j]) > 0])
            parent = self.short.node[j][self.up[first]]
            below.append(np.bincount(parent, deep[j], len(self.short.keys[j])))
        self.total = self.short.weigh(below)

    def sums(self) -> Iterator[pa.RecordBatch]:
        """Sums for the nodes of the next block, contexts one byte shorter."""
        for j in range(8):
            key = self.short.keys[j] & np.uint64((1 << (8 * (self.low - 1) + j)) - 1)
            key, at = np.unique(key, return_inverse=True)
            value = np.bincount(at, self.total[j], len(key))
            columns = [key.view(np.int64), np.full(len(key), j, np.int32), value]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "at", "value"])

    def states(self, inbound: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """The mixtures of the deeper n-grams from those of contexts shorter than this block's."""
        state = np.zeros((len(self.short.code), 8, 3))
        if inbound is None:
            state[:, :, 1], state[:, :, 2] = 1.0, 0.5
        else:
            known, values = inbound
            state[:] = values[np.searchsorted(known, low_code(self.short.code, self.low - 1))]
        return self.deep.mix(self.short.mix(state)[self.up])


def sorted_grams(grams: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    code = grams["key"].to_numpy().view(np.uint64)
    by = np.argsort(code)
    return code[by], grams["n"].to_numpy()[by].astype(float)


def masked(code: Column, n: int) -> Column:
    """The last ``n`` bytes."""
    return code.bitwiseAND(F.lit((1 << (8 * n)) - 1).cast("long"))


def grouped(rows: DataFrame, low: int, groups: int) -> DataFrame:
    """With ``bucket``, the same for all codes that share the last ``low`` context bytes."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(masked(F.shiftright("key", 8), low)), F.lit(groups)))


SUMS = "key long, at int, value double"


def values(grams: DataFrame) -> DataFrame:
    """``(key, value)``: the natural log of the probability of each n-gram's last byte after the others, for
    ``grams(key, n)`` with their training numbers."""
    levels, groups = {}, {}
    for low, high in BLOCKS:
        level = grams
        if high < DEPTH:
            level = written(grams.groupBy(masked(F.col("key"), high + 1).alias("key")).agg(F.sum("n").alias("n")))
        groups[low] = max(1, -(-level.count() // GROUP)) if low else 1
        levels[low] = grouped(level, low, groups[low])
        grams = level
    sums: dict[int, DataFrame] = {}
    for low, high in BLOCKS[:-1]:
        total = _upward(levels[low], low, sums.get(low)).groupBy("key", "at").agg(F.sum("value").alias("value"))
        # a node of the next block: its context is above the bits of the byte that lead to it
        under = low - 2
        short = masked(F.expr("shiftright(key, at)"), under)
        sums[under] = written(total.withColumn("bucket", F.pmod(F.xxhash64(short), F.lit(groups[under]))))
    states: DataFrame | None = None
    for low, high in reversed(BLOCKS):
        inbound = None
        if states is not None:
            asked = levels[low].select("bucket", masked(F.col("key"), low).alias("key")).distinct()
            inbound = asked.join(states, "key")
        states = _downward(levels[low], low, high, sums.get(low), inbound)
        if high < DEPTH:
            states = written(states)
    return states


def _upward(level: DataFrame, low: int, sums: DataFrame | None) -> DataFrame:
    def climb(grams: pa.Table, found: pa.Table | None = None) -> pa.Table:
        if not grams.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "at": pa.array([], pa.int32()), "value": pa.array([], pa.float64())})
        return pa.Table.from_batches(Block(*sorted_grams(grams), low, found).sums())

    by = level.groupBy("bucket")
    if sums is None:
        return by.applyInArrow(lambda grams: climb(grams), SUMS)
    return by.cogroup(sums.groupBy("bucket")).applyInArrow(lambda grams, found: climb(grams, found), SUMS)


def _downward(level: DataFrame, low: int, high: int, sums: DataFrame | None, inbound: DataFrame | None) -> DataFrame:
    """``(key, state)`` of the block's deeper n-grams, or ``(key, value)`` at full depth."""
    nothing = "bucket long, kind int, key long, at int, value double, state binary"
    beside = level.sparkSession.createDataFrame([], nothing)
    if sums is not None:
        beside = beside.unionByName(sums.select("bucket", F.lit(0).alias("kind"), "key", "at", "value"), allowMissingColumns=True)
    if inbound is not None:
        beside = beside.unionByName(inbound.select("bucket", F.lit(1).alias("kind"), "key", "state"), allowMissingColumns=True)
    last = high == DEPTH

    def descend(grams: pa.Table, other: pa.Table) -> pa.Table:
        if not grams.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), name: pa.array([], pa.float64() if last else pa.binary())})
        code, n = sorted_grams(grams)
        kind = other["kind"].to_numpy()
        known = None
        if inbound_given:
            rows = other.filter(pa.array(kind == 1))
            key = rows["key"].to_numpy().view(np.uint64)
            by = np.argsort(key)
            flat = np.frombuffer(b"".join(rows["state"].to_pylist()), np.float64).reshape(-1, 8, 3)
            known = key[by], flat[by]
        block = Block(code, n, low, other.filter(pa.array(kind == 0)) if sums_given else None)
        state = block.states(known)
        keys = pa.array(code.view(np.int64))
        if last:
            p = state[:, :, 0] + state[:, :, 1] * state[:, :, 2]
            return pa.table({"key": keys, name: pa.array(np.log(p).sum(1))})
        return pa.table({"key": keys, name: pa.array([s.tobytes() for s in state], pa.binary())})

    name, sums_given, inbound_given = "value" if last else "state", sums is not None, inbound is not None
    schema = f"key long, {name} {'double' if last else 'binary'}"
    return level.groupBy("bucket").cogroup(beside.groupBy("bucket")).applyInArrow(descend, schema)


# Scores


class Values:
    """Values by code: a direct-mapped table, behind it a sorted array."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        by = np.argsort(key)
        self.key, self.value = key[by], value[by]
        slot = self.slots(self.key)
        self.slot_key = np.full(1 << TABLE_BITS, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.slot_value = np.zeros(1 << TABLE_BITS)
        self.slot_key[slot], self.slot_value[slot] = self.key, self.value

    @staticmethod
    def slots(key: np.ndarray) -> np.ndarray:
        return ((key * SPREAD) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        slot = self.slots(key)
        out = self.slot_value[slot]
        other = np.flatnonzero(self.slot_key[slot] != key)
        out[other] = self.value[np.searchsorted(self.key, key[other])]
        return out


SCORES = "doc_id long, train boolean, n_bytes long, n_tokens long, n_known long, log_counts double, log_p double"
PACKED = "chunk long, kind int, keys binary, numbers binary"


def packed(answers: DataFrame) -> DataFrame:
    """``answers(chunk, kind, key, number)`` with the keys and numbers of a task's rows for one chunk and kind
    in one row, which makes a shuffle by chunk less than half as large."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACK:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, kind, key, number = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        by = np.lexsort([key, kind, chunk])
        chunk, kind, key, number = chunk[by], kind[by], key[by], number[by]
        cut = np.r_[0, np.flatnonzero((np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1, len(chunk)]
        for i, j in zip(cut, cut[1:]):
            columns = [[chunk[i]], [kind[i]], [key[i:j].tobytes()], [number[i:j].tobytes()]]
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["chunk", "kind", "keys", "numbers"])

    return answers.select("chunk", "kind", "key", "number").mapInArrow(pack, PACKED)


def unpacked(found: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    rows = found.filter(pa.array(found["kind"].to_numpy() == kind))
    return tuple(
        np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in (("keys", np.uint64), ("numbers", np.float64))
    )


def scored(texts: DataFrame, answers: DataFrame, n: int, v: int) -> DataFrame:
    """``SCORES`` of every row of ``texts`` from its chunk's ``answers(chunk, kind, keys, numbers)``: values of
    n-grams and training numbers of words."""

    def score(docs: pa.Table, found: pa.Table) -> pa.Table:
        grams, words = Values(*unpacked(found, 0)), Values(*unpacked(found, 1))
        raws = docs["raw"].to_pylist()
        p, tokens, seen, base = [], [], [], []
        for i, j in runs(raws):
            sums = np.r_[0.0, np.cumsum(grams.of(codes(raws[i:j])))]
            ends = np.cumsum([len(r) for r in raws[i:j]])
            p.append(np.diff(sums[np.r_[0, ends]]))
            index: dict[bytes, int] = {}
            of = [[index.setdefault(w, len(index)) for w in words_of(r)] for r in raws[i:j]]
            counts = words.of(hashes(index))
            sizes = np.array([len(x) for x in of])
            flat = counts[np.fromiter((x for one in of for x in one), np.int64, sizes.sum())]
            starts = np.cumsum(sizes) - sizes
            tokens.append(sizes)
            seen.append(np.add.reduceat((flat > 0).astype(np.int64), starts))
            base.append(np.add.reduceat(np.log10((flat + 0.1) / (n + 0.1 * (v + 1))), starts))
        whole = lambda parts, kind: pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind))
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "train": docs["train"],
                "n_bytes": pa.array([len(r) for r in raws], pa.int64()),
                "n_tokens": whole(tokens, np.int64),
                "n_known": whole(seen, np.int64),
                "log_counts": whole(base, np.float64),
                "log_p": whole(p, np.float64),
            }
        )

    return texts.groupBy("chunk").cogroup(packed(answers).groupBy("chunk")).applyInArrow(score, SCORES)


def ctw_scores(docs: DataFrame, train: Column) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``; the rows where ``train`` holds are learnt from.

    ``n_tokens`` words and the end, ``n_known`` of them in the training texts, ``train_tokens``,
    ``base_score`` (log10, token counts alone), ``score`` (log10 of the model's probability of the text)
    and ``bits_per_byte``.
    """
    workers_see_package(docs.sparkSession)
    texts = chunked(docs, train)
    found = tallied(texts)
    grams = found.where("kind = 0")
    learnt = values(written(grams.groupBy("key").agg(F.sum("n").alias("n"))))
    by_word = Window.partitionBy("key")
    first = (F.row_number().over(by_word.orderBy("chunk")) == 1).alias("first")
    words = written(found.where("kind = 1").select("chunk", "key", F.sum("n").over(by_word).alias("n"), first))
    total = words.where("first and n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    answers = (
        grams.select("chunk", "key").join(learnt, "key").select("chunk", F.lit(0).alias("kind"), "key", F.col("value").alias("number"))
    ).unionByName(words.select("chunk", F.lit(1).alias("kind"), "key", F.col("n").cast("double").alias("number")))
    rows = scored(texts, answers, n, v)
    score = F.col("log_p") / F.log(F.lit(10.0))
    return rows.select(
        "doc_id",
        "train",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        F.col("log_counts").alias("base_score"),
        score.alias("score"),
        (-F.col("log_p") / F.log(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return ctw_scores(docs, ~held_out).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )

"""Merkle manifest and prefix trie against brute force."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from firnline.llm import merkle, prefix_trie

SMALLEST = -(1 << 63)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i : i + 16])) for i in range(0, len(low), 16)])
    return levels


def siblings(levels, place):
    out = []
    for nodes in levels[:-1]:
        start = place // 16 * 16
        run, i = nodes[start : start + 16], place - start
        out.append(("".join(run[:i]), "".join(run[i + 1 :])))
        place //= 16
    return out


def manifest_by_hand(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    if not rows:
        return []
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (SMALLEST if r[0] is None else r[0], leaf(r)))
        trees[s] = climbed([leaf(r) for r in groups[s]])
    top = climbed([trees[s][-1][0] for s in order])
    root, lower = top[-1][0], str.maketrans(merkle.UPPER, merkle.LOWER)
    out = []
    for k, s in enumerate(order):
        for place, r in enumerate(groups[s]):
            path = siblings(trees[s], place) + siblings(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            folded = leaf(r[:4] + (r[4].translate(lower),) if tampered else r)
            for before, after in path:
                folded = sha(before + folded + after)
            proof = sha("".join(b + a for b, a in path))
            out.append((r[0], leaf(r), trees[s][-1][0], root, proof, folded, folded == root))
    return out


def manifest_rows(spark, rows):
    df = spark.createDataFrame(
        [(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string"
    ).repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    claim = F.when(tampered, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))
    out = merkle.manifest(merkle.leaf_table(df, {"text": claim}))
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in out.select(*names).collect()), key=repr)


def test_manifest_of_no_row_and_one_row(spark):
    assert manifest_rows(spark, []) == []
    one = [(None, None, None, None, None)]
    assert manifest_rows(spark, one) == manifest_by_hand(one)
    assert manifest_rows(spark, one)[0][4] == sha("")


def test_manifest_equals_brute_force(spark):
    rng = random.Random(1)
    texts, sources = ["Ab", "x\x00Y", "é" * 50, None, "", "Z" * 30_000], ["s0", "s0", "s1", "é", None, "S"]
    rows = [
        (i * rng.choice([1, 1, 7]) if rng.random() > 0.03 else None, rng.choice(sources), "en", rng.choice([1, None]), rng.choice(texts))
        for i in range(700)
    ]
    rows += rows[:30] + [rows[3]] * 40  # equal rows
    rows += [(7, "s0", "en", i, f"T{i}") for i in range(60)]  # one identifier, different rows
    rows += [(x, "s0", None, 1, "Q") for x in (-5, SMALLEST, (1 << 63) - 1)]
    rows += [(i, f"u{i}", "en", 1, "z") for i in range(60)]  # many sources of one row
    assert manifest_rows(spark, rows) == sorted(manifest_by_hand(rows), key=repr)


def test_places_with_directories_of_directories(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIRECTORY", 2)
    rng = random.Random(4)
    rows = [(rng.randrange(-(1 << 18), 1 << 18), rng.choice(["a", None]), "en", 1, "t") for _ in range(300)]
    assert manifest_rows(spark, rows) == sorted(manifest_by_hand(rows), key=repr)


def turn_id(role, text):
    r, t = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(r)).encode() + b":" + r + t).hexdigest()[:24] + f"{len(t):08x}"


def trie_by_hand(rows):
    """Rows (conv_id, turn, role, text)."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, turn_id(r, x), r or "", x or ""))
    own = {c: [v[3:] for v in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    nodes, children, leaves, saved = {}, {}, {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    for key in sorted(nodes, key=len, reverse=True):
        below = children.get(key, [])
        leaves[key] = sum(leaves[x] for x in below) or 1
        size = len(key[-1][1].encode()) if key else 0
        saved[key] = (len(nodes[key]) - 1) * size + sum(saved[x] for x in below)
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if built[c] == key)
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), len(children.get(key, [])), leaves[key], saved[key], sha(ends)))
    return sorted(out, key=repr)


def trie_rows(spark, rows, *bounds):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    out = prefix_trie.trie(prefix_trie.with_heads(prefix_trie.sequences(df.repartition(3), 5), 8, 9), *bounds)
    names = ("conv_id", "depth", "parent_conv_id", *prefix_trie.SUMS, "ends_sha256")
    return sorted((tuple(r) for r in out.select(*names).collect()), key=repr)


def made_up(n, vocabulary, longest):
    rng = random.Random(n)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            text = rng.choice([None, "", "é"]) if rng.random() < 0.05 else f"w{rng.randrange(vocabulary)}"
            rows.append((c, None if rng.random() < 0.02 else t, rng.choice(["u", None]), text))
    # a third of all conversations are equal, and some share only a base that is missing
    rows += [(1000 + i, j, "u", "w0") for i in range(n // 2) for j in range(3)]
    rows += [(5001, 0, "u", "late"), (5003, 0, "u", "late"), (5003, 0, "u", "late")]
    rng.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark):
    rows = made_up(200, 3, 12)
    want = trie_by_hand(rows)
    assert trie_rows(spark, rows) == want
    for cells, most in ((64, 7), (4, 1)):  # nodes that reach over slices
        assert trie_rows(spark, rows, cells, most) == want


def test_trie_of_empty_and_odd_tables(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 0, "u", "x")]) == []
    odd = [(0, None, None, None), (None, 1, "u", "y"), (4, 0, "u", "z" * 50_000)]
    assert trie_rows(spark, odd) == trie_by_hand(odd)
    long = [(5, t, "u", f"t{t % 3}") for t in range(3000)] + [(6, t, "u", f"t{t % 3}") for t in range(2990)]
    assert trie_rows(spark, long, 256, 8) == trie_by_hand(long)

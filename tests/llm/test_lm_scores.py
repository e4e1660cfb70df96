"""Context-tree weighting against a plain recursion over dictionaries."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from firnline.llm import ctw

DEPTH = ctw.DEPTH


def plain(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def decisions(raw):
    s = b"\n" * DEPTH + raw
    for k in range(DEPTH, len(s)):
        for j in range(8):
            yield s[k - DEPTH : k], (256 | s[k]) >> (8 - j), (s[k] >> (7 - j)) & 1


def kt(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)


def is_held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def scores_by_hand(rows):
    train = [plain(t) for i, t in rows if not is_held_out(i)]
    counts, children, whole, weight = {}, {}, {}, {}
    for raw in train:
        for context, node, b in decisions(raw):
            for d in range(DEPTH + 1):
                counts.setdefault((d, context[DEPTH - d :], node), [0, 0])[b] += 1
    for d, context, node in counts:
        if d:
            children.setdefault((d - 1, context[1:], node), []).append((d, context, node))
    for key in sorted(counts, key=lambda k: -k[0]):
        own = kt(*counts[key])
        if key[0] == DEPTH:
            whole[key], weight[key] = own, 1.0
        else:
            below = sum(whole[x] for x in children.get(key, []))
            whole[key] = math.log(0.5) + np.logaddexp(own, below)
            weight[key] = math.exp(math.log(0.5) + own - whole[key])
    tokens = Counter()
    for raw in train:
        tokens.update([*raw.split(), "end"])
    n, v = sum(tokens.values()), len(tokens)
    out = []
    for i, t in rows:
        total = 0.0
        for context, node, b in decisions(plain(t)):
            mixed, left, last = 0.0, 1.0, 0.5
            for d in range(DEPTH + 1):
                key = (d, context[DEPTH - d :], node)
                if key in counts:
                    last = (counts[key][b] + 0.5) / (sum(counts[key]) + 1)
                    mixed += left * weight[key] * last
                    left *= 1 - weight[key]
            total += math.log10(mixed + left * last)
        words = [*plain(t).split(), "end"]
        base = sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((i, is_held_out(i), len(words), sum(tokens[w] > 0 for w in words), n, base, total))
    return out


def scores(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(parts)
    out = ctw.ctw_scores(df, F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
    out = out.select("doc_id", ~F.col("train"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return [tuple(r) for r in out.collect()]


def same(got, want):
    by = lambda r: (repr(r[:5]), r[6])
    got, want = sorted(got, key=by), sorted(want, key=by)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def test_scores_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "cat", "Sat", "öl", "x" * 30, "a", "b"]
    rows = [(i if i % 17 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 20)))) for i in range(80)]
    rows += [(5, None), (6, "  "), (7, "\x0b\x1c zz"), (8, "long " * 2000)] * 2
    same(scores(spark, rows), scores_by_hand(rows))


def test_scores_with_small_groups_and_chunks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdef  ") for _ in range(120))) for i in range(60)]
    monkeypatch.setattr(ctw, "GROUP", 50)
    same(scores(spark, rows, 7), scores_by_hand(rows))


def test_scores_of_small_tables(spark):
    assert scores(spark, []) == []
    for rows in ([(1, None)], [(None, "ab c")]):
        same(scores(spark, rows), scores_by_hand(rows))
    (row,) = scores(spark, [(None, "ab c")])
    assert row[3:6] == (0, 0, 0.0) and math.isclose(row[6], 5 * math.log10(1 / 256))


def test_predictions_of_a_byte_sum_to_one(spark):
    """All 256 bytes after each of some contexts, seen and unseen."""
    rng = random.Random(8)
    text = "".join(rng.choice("abc ") for _ in range(4000)).encode()
    code, n = np.unique(ctw.codes([text]), return_counts=True)
    known = dict(zip(code.tolist(), n.tolist()))
    contexts = [*{c >> 8 for c in list(known)[:20]}, 0x7A7A7A7A7A, 0x7A7A616263]
    wanted = [(c << 8) | b for c in contexts for b in range(256)]
    rows = [(k, known.get(k, 0)) for k in {*wanted, *known}]
    value = {r["key"]: r["value"] for r in ctw.values(spark.createDataFrame(rows, "key long, n long")).collect()}
    for c in contexts:
        assert math.isclose(sum(math.exp(value[(c << 8) | b]) for b in range(256)), 1.0, rel_tol=1e-9)


def test_held_out_texts_are_predicted_better_than_by_counts(spark):
    """Each word is followed by one of three: contexts know what counts of words cannot."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(60)]
    follow = {w: rng.sample(words, 3) for w in words}

    def text():
        out = [rng.choice(words)]
        for _ in range(60):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    out = [r for r in scores(spark, [(i, text()) for i in range(300)]) if r[1]]
    assert out and all(r[6] > r[5] for r in out)

"""BPE, fingerprints, classifiers."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firnline.llm import bpe, fingerprints, near, quality, toxicity

ODD = ["", " ", "a", "<|endoftext|>", "x<|endoftext|> y", "\n\n  b", "it's 1234", "é😀\x85\x1c", "ab" * 400, "the " * 30_000, "\u2088\ud7ff"]


def test_bpe_equals_the_library():
    library, own = Tokenizer.from_file(bpe.default_path()), bpe.bpe_of(bpe.default_path())
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "\t", "<|endoftext|>", "the", "Ünder", "1", "!!", "\x85", "\x1c", "\u3000", "'ll", "😀", "x" * 200]
    for text in ODD + ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(400)]:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert own.decode(packed) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_long_words_merge_alike():
    own, rng = bpe.bpe_of(bpe.default_path()), random.Random(2)
    for n in (3, 60, 128):
        word = "".join(rng.choices("abehnorstx", k=n)).encode()
        assert own.merge(word) == own._merge_long(word)


def test_bpe_columns(documents):
    docs = documents([(i, t) for i, t in enumerate(ODD)] + [(99, None)])
    coded = bpe.decode(bpe.encode(docs, bpe.default_path()), bpe.default_path())
    rows = coded.collect()
    assert len(rows) == len(ODD) + 1 and all(r["decoded"] == (r["text"] or "") for r in rows)
    digests = {r["doc_id"]: r for r in bpe.round_trip_digests(docs.select("doc_id", "text"), bpe.default_path()).collect()}
    for r in rows:
        assert digests[r["doc_id"]]["n_tokens"] * 4 == len(r["ids"])
        assert digests[r["doc_id"]]["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
        assert digests[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode(documents([]), bpe.default_path()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 23])
def test_fingerprint_chain(documents, n):
    rng = random.Random(n)
    texts = ["".join(rng.choices("abcdé 😀", k=rng.choice([0, 1, 7, 300]))) for _ in range(n)]
    texts[2:4] = [None, texts[1]] if n > 3 else []
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_chain(documents(rows)).collect()}
    assert sorted(got) == list(range(n))
    for i, t in rows:
        text, after = t or "", rows[i - 1][1] or ""
        half = len(text) // 2
        want = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        one, two, three = fingerprints.fingerprints([x.encode() for x in (text, want, after)])
        assert got[i]["fingerprint"] == fingerprints.hexed([one])[0]
        assert got[i]["edited_fingerprint"] == fingerprints.hexed([two])[0]
        assert got[i]["near_edited"] == fingerprints.likeness(one[None], two[None])[0]
        assert got[i]["near_next"] == fingerprints.likeness(one[None], three[None])[0]


def test_fingerprints_are_local_and_do_not_depend_on_the_batch():
    rng = random.Random(5)
    body = "".join(rng.choices("abcdefghij ", k=6000)).encode()
    others = ["".join(rng.choices("klmnopqrst ", k=6000)).encode(), b"", b"aaaaaaaa" * 500]
    alone = fingerprints.fingerprints([body])
    batch = fingerprints.fingerprints(others + [body, b"shifted by some bytes" + body])
    assert (alone[0] == batch[3]).all()
    assert fingerprints.likeness(batch[3:4], batch[4:5])[0] > 0.9
    assert fingerprints.likeness(batch[3:4], batch[0:1])[0] < 0.1
    assert fingerprints.likeness(batch[1:2], batch[1:2])[0] == 1.0


def labelled(documents, spark, good, bad, n=160):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(bad if i % 3 == 0 else good, k=rng.randint(5, 60)))) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)] + [(None, 1), (5, None)], "doc_id long, label int")
    return documents(rows + [(900, None), (901, ""), (902, "good " * 50_000), (None, "x")]), labels


def test_quality_separates_held_out_rows(documents, spark):
    docs, labels = labelled(documents, spark, ["river", "stone", "meadow", "cloud"], ["$$$", "BUY!!", "NOW!!", "|"])
    train = labels.where(F.coalesce(quality.fold("doc_id", 3), F.lit(0)) != 1)
    model = quality.fit(docs.select("doc_id", "text"), train)
    out = quality.score(docs, model)
    assert out.columns[:-1] == docs.columns and out.columns[-1].startswith("score_")
    rows = [(r["doc_id"], r[-1]) for r in out.collect()]
    assert len(rows) == 164 and all(0 <= s <= 1 for _, s in rows)
    test = [(i, s) for i, s in rows if i is not None and i < 900 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == (i % 3 == 0) for i, s in test]) > 0.95


def test_quality_without_labels(documents, spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    docs = documents([(1, "a"), (2, None)])
    assert [r[-1] for r in quality.score(docs, quality.fit(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    assert [r[-1] for r in quality.score(docs, quality.fit(docs, one)).collect()] == [1.0, 1.0]
    assert quality.score(documents([]), quality.fit(documents([]), none)).count() == 0


def test_toxicity_separates_and_both_ways_agree(documents, spark):
    docs, labels = labelled(documents, spark, ["river", "stone", "meadow", "cloud"], ["rotten", "vile", "stone", "foul"])
    docs, part = docs.select("doc_id", "text"), quality.fold("doc_id", 5)
    fits = [toxicity.fit(docs, labels.where(part.isin(1, 2, 3)), labels.where(part == 4), n) for n in (10**6, 0)]
    assert fits[0].arrays is not None and fits[1].arrays is None
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, m).collect()} for m in fits)
    assert one.keys() == two.keys() and len(one) == 164
    assert max(abs(one[k] - two[k]) for k in one) < 1e-5
    test = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(one[i] >= 0.5) == (i % 3 == 0) for i in test]) > 0.95


def test_toxicity_without_labels(documents, spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    docs = documents([(1, "a"), (2, None)]).select("doc_id", "text")
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none, none)).collect()] == [0.5, 0.5]


def test_toxicity_exact_ratio_of_a_known_model():
    scorer = toxicity.Scorer({(0, 3): (np.array([5], np.uint64), np.array([2.0], np.float32)), (1, 4): (np.array([0], np.uint64), np.array([0.5], np.float32))})
    asked = np.array([5, 7, 5 + (1 << 24)], np.uint64)
    assert scorer.exact(asked).tolist() == scorer.ratios(asked).tolist() == [2.5, 0.5, 2.0]


def test_a_workers_kept_words_stay_few_and_early_ones_stay():
    model = bpe.Bpe(bpe.default_path())
    for i in range(250_000):
        model.words[f" w{i}"]
    assert len(model.words) <= 100_000
    assert " w0" in model.words and model.words[" w249999"] == bpe.Bpe(bpe.default_path()).encode(" w249999")
    assert near.CACHE_WORDS <= 100_000


def test_a_worker_keeps_the_compressors_of_one_model():
    for i in range(5):
        quality.compressor(b"some text %d " % i * 50).compress(b"text")
    assert quality.compressor.cache_info().currsize <= 2

"""Byte-level BPE encoding and decoding with a contiguous rank array for each word.

A text is cut at the special tokens and then into words by the pre-tokenizer's pattern. A word's
parts stand in two parallel arrays: the symbol at each boundary and the rank of the pair that starts
there. The merge loop looks for the smallest rank (the leftmost where ranks tie), deletes the
boundary between the two parts and looks up the two neighbouring ranks anew. Words repeat, so each
Python worker keeps the packed identifiers of words it has met. The array is scanned once for each
merge, which suits short words; above ``SCAN_LIMIT`` bytes the same merges, in the same order, are
found with a heap, so that a text without a break stays near-linear.

The vocabulary is read on each worker from the path of a tokenizers JSON file, a parameter.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.common import own_name, table

SCAN_LIMIT = 128
CACHE_WORDS = 100_000
NONE = 1 << 60
#: Fixed value: the pre-tokenizer's pattern that the file's kind (byte level) implies; L, N, S, V
#: and O stand for letter, number, white space, any but white space, and other.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|{S}+(?!{V})|{S}+"
#: Code points that became letters and numbers after Unicode 16, the version to match;
#: the installed pattern library may know a later one.
NEWER_LETTERS = (
    (0x0558, 0x0558),
    (0x058B, 0x058C),
    (0x088F, 0x088F),
    (0x0C5C, 0x0C5C),
    (0x0CDC, 0x0CDC),
    (0x208F, 0x208F),
    (0x209D, 0x209F),
    (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF),
    (0x10940, 0x10959),
    (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB),
    (0x11DF1, 0x11DF1),
    (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2),
    (0x18E00, 0x19191),
    (0x191A0, 0x191D2),
    (0x1B123, 0x1B128),
    (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
NEWER_NUMBERS = (
    (0x11DE0, 0x11DE9),
    (0x1246F, 0x1246F),
    (0x12475, 0x1247F),
    (0x12550, 0x12686),
    (0x16FF4, 0x16FF6),
)
#: The three classes up to U+024F, where the standard library's faster patterns serve.
LATIN = {"L": r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "N": r"0-9\xb2\xb3\xb9\xbc-\xbe", "S": r"\t-\r \x85\xa0"}


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary file: printable Latin-1
    characters stand for themselves, the others for the code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.cache
def splitters() -> tuple[re.Pattern, re.Pattern, regex.Pattern]:
    """What finds a character above U+024F, the words of texts without one, the words of any."""
    letters, numbers = (
        "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)
        for ranges in (NEWER_LETTERS, NEWER_NUMBERS)
    )
    any_text = WORDS.format(
        L=rf"[\p{{L}}--[{letters}]]",
        N=rf"[\p{{N}}--[{numbers}]]",
        S=r"\s",
        V=r"\S",
        O=rf"[[^\s\p{{L}}\p{{N}}]||[{letters}{numbers}]]",
    )
    latin = WORDS.format(
        **{k: f"[{v}]" for k, v in LATIN.items()},
        V=f"[^{LATIN['S']}]",
        O="[^" + "".join(LATIN.values()) + "]",
    )
    return re.compile("[^\x00-\u024f]"), re.compile(latin), regex.compile("(?V1)" + any_text)


class Words(dict):
    """Packed identifiers by word, computed where missing."""

    def __init__(self, model: Bpe):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        ids = self.model.merge(word.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= SCAN_LIMIT:
            if len(self) >= CACHE_WORDS:
                for late in list(self)[CACHE_WORDS // 2 :]:  # frequent words are met early
                    del self[late]
            self[word] = packed
        return packed


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        back = {c: b for b, c in byte_characters().items()}
        self.first = [vocab[byte_characters()[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        known |= {i: content.encode() for content, i in self.special.items()}
        self.bytes = [known.get(i) for i in range(max(known) + 1)]
        longest_first = sorted(filter(None, self.special), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        self.words = Words(self)

    def merge(self, word: bytes) -> list[int]:
        """The identifiers of one word."""
        if len(word) > SCAN_LIMIT:
            return self._merge_long(word)
        parts = [self.first[b] for b in word]
        get = self.rank.get
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            new = parts[i] = self.made[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | new, NONE)
            if i < len(ranks):
                ranks[i] = get(new << 32 | parts[i + 1], NONE)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        """The same merges by a heap of (rank, position) over linked parts."""
        parts = [self.first[b] for b in word]
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = []

        def push(i: int, j: int) -> None:
            if 0 <= i and j < len(parts):
                rank = self.rank.get(parts[i] << 32 | parts[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            push(i, i + 1)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue  # one of the two parts has been merged meanwhile
            parts[i], parts[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            push(before[i], i)
            push(i, after[i])
        return [p for p in parts if p >= 0]

    def encode(self, text: str | None) -> bytes:
        """The identifiers as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        beyond, latin, any_text = splitters()
        cut = (any_text if beyond.search(text) else latin).findall
        if not self.special:
            return b"".join(map(self.words.__getitem__, cut(text)))
        out = []
        for i, piece in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(struct.pack("<I", self.special[piece]))
            else:
                out.extend(map(self.words.__getitem__, cut(piece)))
        return b"".join(out)

    def decode(self, packed: bytes | None) -> str:
        """The text of identifiers; bytes that are no UTF-8 become the replacement character,
        identifiers outside the vocabulary raise an error."""
        ids = np.frombuffer(packed or b"", "<u4").tolist()
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def bpe_of(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the packed identifiers of the whole text as binary column ``out``.

    Null and empty texts give no identifiers. All other columns stay; if ``out`` is taken, the
    column gets a longer name (see ``own_name``).
    """

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = bpe_of(path)
        for texts in batches:
            yield pa.array([model.encode(t.as_py()) for t in texts], pa.binary())

    return docs.withColumn(own_name(docs, out), ids(F.col(text)))


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text of the packed identifiers; null identifiers give the empty text."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = bpe_of(path)
        for packed in batches:
            yield packed.map(model.decode, na_action=None)

    return tokens.withColumn(own_name(tokens, out), texts(F.col(ids)))


def round_trip_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text: encoding and decoding in
    one pass, so that neither identifiers nor texts leave the worker."""
    kept = [c for c in docs.columns if c != text]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = bpe_of(path)
        for texts in batches:
            rows = []
            for t in texts:
                packed = model.encode(t)
                back = model.decode(packed).encode()
                rows.append(
                    (
                        len(packed) // 4,
                        hashlib.sha256(packed).hexdigest(),
                        hashlib.sha256(back).hexdigest(),
                    )
                )
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    name = own_name(docs, "found")
    return docs.select(*kept, both(F.col(text)).alias(name)).select(*kept, f"{name}.*")


def default_path() -> str:
    """The file of the query; it lies with the installed library on every worker."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip_digests(docs, default_path())

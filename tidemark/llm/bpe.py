"""Byte-pair encoding by a priority queue of merge ranks over a doubly linked symbol list, and its decoding.

The vocabulary file is read in each Python worker from the path given; it is neither copied nor trained.
Texts stream through in Arrow batches. A word met again comes from a memo of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table, whole_text

VOCABULARY = "word_bpe_49k.json"
#: Words kept in a worker's memo before it is emptied.
MEMO_WORDS = 200_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next free code from 256."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def merged(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the merges of a word: lowest rank first, leftmost among equals.

    `before` and `after` link the living symbols. A queue entry is stale, and skipped, if a symbol it names has
    been merged away or changed since.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = []
    for i in range(n - 1):
        if found := ranks.get((symbols[i], symbols[i + 1])):
            queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, whole = heapq.heappop(queue)
        j = after[i] if symbols[i] == left else -1
        if j < 0 or symbols[j] != right:
            continue
        symbols[i], symbols[j] = whole, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if found := ranks.get((whole, symbols[k])):
                heapq.heappush(queue, (found[0], i, whole, symbols[k], found[1]))
        h = before[i]
        if h >= 0 and (found := ranks.get((symbols[h], whole))):
            heapq.heappush(queue, (found[0], h, symbols[h], whole, found[1]))
    return [s for s in symbols if s >= 0]


class Memo(dict):
    """Word to (packed ids, joined vocabulary strings); a new word is encoded on first use."""

    def __init__(self, encode_word):
        super().__init__()
        self.encode_word = encode_word

    def __missing__(self, word: str):
        ids, strings = self.encode_word(word)
        made = self[word] = (struct.pack(f"<{len(ids)}I", *ids), " ".join(strings))
        return made


class WordBpe:
    """Encoder and decoder of one vocabulary file: lower-case words, an end mark on each word's last symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        vocabulary = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.inner = [vocabulary.get(s) for s in byte_symbols()]
        self.final = [vocabulary.get(s + suffix) for s in byte_symbols()]
        self.strings = {i: s for s, i in vocabulary.items()}
        self.special = {a["content"]: a["id"] for a in held["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        # White space as the library's pattern has it; \x1c to \x1f are symbols to it.
        space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{space}\p{{L}}\p{{N}}]+").findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.memo = Memo(self.encode_word)

    def encode_word(self, word: str) -> tuple[list[int], list[str]]:
        data = word.encode("utf-8")
        symbols = [*(self.inner[b] for b in data[:-1]), self.final[data[-1]]]
        ids = merged([s for s in symbols if s is not None], self.ranks)
        return ids, [self.strings[i] for i in ids]

    @staticmethod
    def lower(text: str) -> str:
        """Each character by itself: a final sigma has no form of its own here."""
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        packed, strings = [], []
        for part in self.parts(text):
            if part in self.special:
                packed.append(struct.pack("<I", self.special[part]))
                strings.append(part)
            elif part:
                found = [self.memo[w] for w in self.words(self.lower(unicodedata.normalize("NFC", part)))]
                packed.extend([f[0] for f in found])
                strings.extend([f[1] for f in found])
        return b"".join(packed), " ".join(strings)

    def decode(self, packed: bytes) -> str:
        """Vocabulary strings joined by a space, as a file without a decoder asks."""
        return " ".join([self.strings[i] for (i,) in struct.iter_unpack("<I", packed)])


@lru_cache(maxsize=2)
def coder(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, token_ids (array of int). Null texts are empty and have no token.

    Needs doc_id and text and reads nothing else; repeated rows are encoded alike.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            packed = [own.encode(t)[0] for t in batch.column("text").to_pylist()]
            ends = [0]
            for p in packed:
                ends.append(ends[-1] + len(p) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), ids], ["doc_id", "n_tokens", "token_ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text("text").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, token_ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of encode_documents' result: doc_id, text. No ids, or a null, give an empty text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = coder(path).strings
        for batch in batches:
            texts = [" ".join([strings[i] for i in ids or ()]) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                packed, back = own.encode(text)
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text("text").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text and decode it again."""
    return round_trip(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op8_bpe_round_trip": op8_bpe_round_trip}

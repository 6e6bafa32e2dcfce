"""Byte-pair encoding and decoding without the tokenizer library.

A piece becomes a doubly linked list of symbols; a priority queue holds the merges of neighbours by rank, then place.
A popped merge whose symbols have changed is stale and skipped.  Decoding puts vocabulary strings together.  The rules
around it (special tokens, normaliser, pattern, byte alphabet, word ends) are read from the tokenizer's JSON file.

Defined results: a null text is an empty one, without ids; a null identifier is kept; repeated rows give repeated
rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, tokens

#: Fixed value: bytes that a worker's cache of words, and that of pieces, may take.
CACHE_BYTES = 96 << 20


def merged(symbols: list[int], rules: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges, lowest rank first and leftmost among equals, until none fits; ``rules``: pair to (rank, new symbol)."""
    n = len(symbols)
    ids, after, before, queue = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), []
    for i in range(n - 1):
        if rule := rules.get((ids[i], ids[i + 1])):
            queue.append((rule[0], i, ids[i], ids[i + 1], rule[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, new = heapq.heappop(queue)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue  # stale: one of the two was merged meanwhile
        ids[i], ids[j], k = new, -1, after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if rule := rules.get((new, ids[k])):
                heapq.heappush(queue, (rule[0], i, new, ids[k], rule[1]))
        h = before[i]
        if h >= 0 and (rule := rules.get((ids[h], new))):
            heapq.heappush(queue, (rule[0], h, ids[h], new, rule[1]))
    return [x for x in ids if x >= 0]


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-pair models are supported")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.word_end = model.get("end_of_word_suffix") or ""
        alphabet = tokens.byte_alphabet()
        self.inner = [vocab.get(alphabet[b], -1) for b in range(256)]
        self.final = [vocab.get(alphabet[b] + self.word_end, -1) for b in range(256)]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if (pair := (vocab[a], vocab[b])) not in self.rules:
                self.rules[pair] = (rank, vocab[a + b])
        normalizer = config.get("normalizer") or {}
        self.steps = [n["type"] for n in normalizer.get("normalizers", [normalizer] if normalizer else [])]
        if set(self.steps) - {"NFC", "Replace", "Lowercase"}:
            raise ValueError("unknown normaliser")
        pre = config["pre_tokenizer"]
        split = next((p for p in pre.get("pretokenizers", []) if p["type"] == "Split"), None)
        self.pattern = regex.compile(split["pattern"]["Regex"] if split else tokens.BYTE_LEVEL_PATTERN)
        #: white space is never part of a piece: words can be kept by themselves
        self.by_word = split is not None
        self.byte_decoder = (config.get("decoder") or {}).get("type") == "ByteLevel"
        self.bytes_of = {c: b for b, c in alphabet.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces, self.words = tokens.Cache(self._piece, CACHE_BYTES), tokens.Cache(self._whole, CACHE_BYTES)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        symbols = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        return array("I", merged(symbols, self.rules)).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join([self.pieces[piece] for piece in self.pattern.findall(tokens.normal(text, self.steps))])

    def _whole(self, text: str) -> bytes:
        if self._special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join([array("I", [self.special[t]]).tobytes() if t in self.special else self._plain(t) for t in self._special.split(text) if t])

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as unsigned 32-bit little-endian bytes."""
        if not text:
            return b""
        if not self.by_word or tokens._ODD.search(text):
            return self._whole(text)
        return b"".join([self.words[word] for word in text.split()])

    def encode(self, text: str | None) -> list[int]:
        return list(memoryview(self.encode_bytes(text)).cast("I"))

    def decode(self, ids) -> str:
        """Special tokens are kept; without a decoder of its own a tokenizer's strings are put together with spaces."""
        strings = self.strings
        if not self.byte_decoder:
            return " ".join([strings[i] for i in ids])
        joined = "".join([strings[i] for i in ids])
        return bytes(b for c in joined for b in ([self.bytes_of[c]] if c in self.bytes_of else c.encode())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(tokenizer: str) -> Codec:
    """This worker's codec, with its cache."""
    if tokenizer not in _CODECS:
        _CODECS[tokenizer] = Codec(tokens.resolve(tokenizer))
    return _CODECS[tokenizer]


def _over(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, make, names: list[str], schema: str) -> DataFrame:
    store.importable(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        own = codec(tokenizer)
        for whole in batches:
            for batch in tokens.small_batches(whole, 1, 4 << 20):
                rows = [make(own, t) for t in batch.column(1).to_pylist()]
                columns = [pa.array(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    chosen = docs.select(store.column(id_col).alias("doc_id"), store.column(text_col).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, unsigned 32-bit little-endian), decoded."""

    def make(own: Codec, text):
        ids = own.encode_bytes(text)
        return ids, own.decode(memoryview(ids).cast("I"))

    return _over(docs, tokenizer, id_col, text_col, make, ["ids", "decoded"], "ids binary, decoded string")


def codec_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and texts are digested where they are made."""

    def make(own: Codec, text):
        ids = own.encode_bytes(text)
        decoded = own.decode(memoryview(ids).cast("I"))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()

    return _over(docs, tokenizer, id_col, text_col, make, ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string")

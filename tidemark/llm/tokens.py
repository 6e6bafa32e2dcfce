"""Token ids from public tokenizer files, by the ``tokenizers`` library, a batch of texts at a time.

A text is cut only where every pre-tokenizer piece ends anyway, so the ids of the chunks, put together, are the ids
of the whole text.  Chunks repeat far more than texts do: those of a batch are numbered (a dictionary of Arrow), each
different one is encoded once, and the ids of the texts are gathered from there with arrays.  Words are kept for the
next batches in arrays of bounded size.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

#: Text bytes encoded at a time; bytes of a worker's small cache; words and their ids' bytes that a worker
#: keeps, half of them from the time before the other half.
BATCH_BYTES, CACHE_BYTES, KNOWN_WORDS, KNOWN_BYTES = 8 << 20, 4 << 20, 800_000, 24 << 20

_RUN = re.compile(r"\s\s")
#: A piece always ends where a run of two or more white spaces begins.
_CUT = re.compile(r"(?<=\S)(?=\s\s)")
_LEAD = re.compile(r"\s*")
#: White space to Python but not to the tokenizers' patterns.
_ODD = re.compile("[\x1c-\x1f]")
#: Texts of a byte-level tokenizer that can't be cut before every space: a space inside or at the end of a longer run
#: of white space belongs to the piece before it; and the mark of a text's first chunk.
_HEAD = "\x00"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_UNEVEN = rf"{_SPACE} (?:{_SPACE}|\z)|{_HEAD}"

#: A letter or digit after which marks begin a piece, whatever the normaliser; and the marks (neither apostrophes nor
#: what special tokens are written with).
_PLAIN, _MARKS = "[A-Za-z0-9À-ÖØ-öø-ÿ]", '.,;:!?*%$&#+=/-_~^@()[]{}"'


def resolve(tokenizer: str) -> str:
    """A path as it stands, or the name of a file of the installed public tokenizers."""
    if os.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


#: Fixed value: the pattern of byte-level pre-tokenizers that bring none of their own.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def normal(text: str, steps: list[str]) -> str:
    """The normaliser steps; white space stays as it is, since no piece of a by-word pattern holds any."""
    for step in steps:
        if step == "NFC":
            text = text if text.isascii() else unicodedata.normalize("NFC", text)
        elif step == "Lowercase":
            text = text.lower() if text.isascii() else "".join([c.lower() for c in text])
    return text


class Cache(dict):
    """A dict that makes what it lacks and starts anew beyond ``most`` bytes of keys and values (and 200 for each pair)."""

    def __init__(self, make, most: int = CACHE_BYTES):
        super().__init__()
        self.make, self.most, self.used = make, most, 0

    def keep(self, key, value):
        self.used += 200 + len(key) + (8 * len(value) if isinstance(value, (bytes, list)) else 8)
        if self.used > self.most:
            self.clear()
            self.used = 200
        self[key] = value
        return value

    def __missing__(self, key):
        return self.keep(key, self.make(key))


def numbered(strings):
    """An Arrow array's different values, and for each entry the place of its value there."""
    coded = strings.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def gathered(flat, starts, sizes):
    """The runs of the array ``flat`` from ``starts``, ``sizes`` long each, one after the other, and their ends."""
    import numpy as np

    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat[at], ends


def _lists(found: list[list[int]]):
    """Their lengths and all their numbers."""
    import numpy as np

    n = np.fromiter(map(len, found), np.int64, len(found))
    return n, np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))


class Known:
    """Words and their ids in arrays, in two halves: when the younger is full it becomes the older one."""

    def __init__(self):
        self.halves = [None, None]  # (words, ids, starts, sizes)

    def find(self, words):
        """ids, starts, sizes of an Arrow array of words (-1: not known)."""
        import numpy as np
        import pyarrow.compute as pc

        flats, starts, sizes, base = [np.empty(0, np.uint32)], np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64), 0
        for half in self.halves:
            if half is not None:
                keys, flat, at, n = half
                i = pc.index_in(words, value_set=keys).fill_null(-1).to_numpy(zero_copy_only=False)
                hit = i >= 0
                starts[hit], sizes[hit] = at[i[hit]] + base, n[i[hit]]
                flats.append(flat)
                base += len(flat)
        return np.concatenate(flats), starts, sizes

    def keep(self, words, flat, sizes) -> None:
        import numpy as np
        import pyarrow as pa

        if self.halves[0] is not None:
            keys, old, _, n = self.halves[0]
            if len(keys) + len(words) > KNOWN_WORDS // 2 or keys.nbytes + old.nbytes + words.nbytes + flat.nbytes > KNOWN_BYTES // 2:
                self.halves = [None, self.halves[0]]
            else:
                words, flat, sizes = pa.concat_arrays([keys, words]), np.concatenate([old, flat]), np.concatenate([n, sizes])
        most = KNOWN_WORDS // 2
        if len(words) > most:
            words, sizes = pa.concat_arrays([words[:most]]), sizes[:most]
            flat = flat[: int(sizes.sum())].copy()
        if words.nbytes + flat.nbytes <= KNOWN_BYTES // 2:
            self.halves[0] = (words, flat, np.cumsum(sizes) - sizes, sizes)


def words_of(texts):
    """Words at ASCII white space of an Arrow array of texts (nulls count as empty): the words, and the texts' ends among them."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    words, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    some = pc.not_equal(words, "")
    if pc.all(some).as_py() is False:  # white space at an end of a text gives an empty word
        filled = some.to_numpy(zero_copy_only=False)
        upto = np.concatenate(([0], np.cumsum(filled)))
        return words.filter(some), upto[np.cumsum(sizes)]
    return words, np.cumsum(sizes)


class ChunkEncoder:
    """Texts to ids as unsigned 32-bit little-endian numbers.

    Chunks: for a byte-level tokenizer with its own pattern, a word with the space before it; for one that drops
    white space, a word.  Their pieces go to the library's model; anything else goes to the library whole.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(resolve(tokenizer))
        self.library.no_padding()
        self.library.no_truncation()
        state = lambda part: json.loads(part.__getstate__()) if part is not None else {}
        pre, normalizer = state(self.library.pre_tokenizer), state(self.library.normalizer)
        self.steps = [n["type"] for n in normalizer.get("normalizers", [normalizer] if normalizer else [])]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind, pattern = "whole", ""
        if not self.steps and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind, pattern = "spaced", BYTE_LEVEL_PATTERN
        elif pre.get("type") == "Sequence" and getattr(self.library.model, "end_of_word_suffix", None) and not set(self.steps) - {"NFC", "Replace", "Lowercase"}:
            split = next((p for p in pre["pretokenizers"] if p["type"] == "Split"), {})
            # every alternative of the pattern excludes white space, and what it leaves out is removed
            if split.get("behavior") == "Removed" and split.get("invert") and "[^\\s" in split["pattern"].get("Regex", ""):
                self.kind, pattern = "words", split["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.model = self.library.model
        self.letters = {b: c for b, c in byte_alphabet().items() if ord(c) != b}
        self.space = self.letters[ord(" ")]
        self.latin = {chr(i): chr(i).encode().decode("latin-1").translate(self.letters) for i in range(256)}
        self.pieces, self.known = Cache(self._piece), Known()

    def _ids(self, mapped: str) -> list[int]:
        return [t.id for t in self.model.tokenize(mapped)]

    def _piece(self, piece: str) -> list[int]:
        return self._ids(piece.encode("utf-8").decode("latin-1").translate(self.letters))

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _chunk(self, chunk: str) -> list[int]:
        spaced = self.kind == "spaced"
        word = chunk[1:] if spaced else chunk
        if word.isalpha() and max(word) <= "ÿ" and (chunk[0] == " " or not spaced):  # one piece, with the space before it
            if not spaced and "Lowercase" in self.steps:
                word = word.lower()
            mapped = word if word.isascii() else "".join(map(self.latin.__getitem__, word))
            return self._ids(self.space + mapped if spaced else mapped)
        for s in self.special:
            if s in chunk:
                return self._whole(chunk)
        found = self.pattern.findall(normal(chunk, self.steps))
        return self._piece(found[0]) if len(found) == 1 else [i for p in found for i in self.pieces[p]]

    def encode(self, text: str | None) -> list[int]:
        """All ids of one text; null counts as empty."""
        if not text:
            return []
        if self.kind == "words" and not _ODD.search(text):
            return [i for w in text.split() for i in self._chunk(w)]
        if self.kind == "spaced":
            ids = []
            for segment in _CUT.split(text) if _RUN.search(text) else [text]:
                lead = _LEAD.match(segment).end()
                head, *tails = segment[lead:].split(" ")
                ids += self._chunk(segment[:lead] + head)
                for c in tails:
                    ids += self._chunk(" " + c)
            return ids
        return self._whole(text)

    def _cut(self, texts):
        """Chunks of an Arrow array of texts (those of ``kind`` spaced marked or without their space), and the texts' ends among them."""
        import numpy as np
        import pyarrow.compute as pc

        if self.kind == "words":
            return words_of(texts)
        lists = pc.split_pattern(pc.binary_join_element_wise(_HEAD, texts, ""), " ")
        return lists.flatten(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))

    def _words(self, words):
        """ids, starts, sizes of different words (of kind spaced: as ``_cut`` gives them)."""
        import numpy as np
        import pyarrow as pa

        flat, starts, sizes = self.known.find(words)
        new = sizes < 0
        missing = words.filter(pa.array(new))
        chunks = missing.to_pylist()
        if self.kind == "spaced":
            chunks = [c[1:] if c[:1] == _HEAD else " " + c for c in chunks]
        n, more = _lists(list(map(self._chunk, chunks)))
        starts[new], sizes[new] = len(flat) + np.cumsum(n) - n, n
        self.known.keep(missing, more, n)
        return np.concatenate([flat, more]), starts, sizes

    def _gathered(self, texts):
        """Ids of all texts, one after the other, and each text's number of ids."""
        import numpy as np
        import pyarrow.compute as pc

        chunks, ends = self._cut(texts)
        different, at = numbered(chunks)
        # marks at a chunk's end, after a letter or digit, are a piece of their own: words are looked up without them
        words = pc.ascii_rtrim(different, characters=_MARKS)
        plain = pc.match_substring_regex(words, _PLAIN + r"\z")
        words, word = numbered(pc.if_else(plain, words, different))
        marks, mark = numbered(pc.if_else(plain, pc.replace_substring_regex(different, "(?s)^.*" + _PLAIN, ""), ""))
        flat, starts, sizes = self._words(words)
        n, ends_of = _lists([self.pieces[m] if m else [] for m in marks.to_pylist()])
        both = np.empty((2, len(different), 2), dtype=np.int64)
        both[0, :, 0], both[1, :, 0] = starts[word], sizes[word]
        both[0, :, 1], both[1, :, 1] = (len(flat) + np.cumsum(n) - n)[mark], n[mark]
        flat = np.concatenate([flat, ends_of])
        flat, upto = gathered(flat, both[0].ravel(), both[1].ravel())
        upto, sizes = upto[1::2], both[1].sum(axis=1)
        ids, upto = gathered(flat, (upto - sizes)[at], sizes[at])
        return ids, np.diff(np.concatenate(([0], upto))[ends], prepend=0)

    def encode_all(self, texts):
        """Ids of an Arrow array of texts, one text after the other, and each text's number of ids; null counts as empty."""
        import numpy as np
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        if self.kind == "whole":
            single = np.ones(len(texts), dtype=bool)
        elif self.kind == "spaced":
            single = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        else:
            single = np.zeros(len(texts), dtype=bool)
        if not single.any():
            return self._gathered(texts)
        by_one = [np.array(self.encode(texts[i].as_py()), dtype=np.uint32) for i in np.flatnonzero(single).tolist()]
        rest, of_rest = self._gathered(texts.filter(~single))
        sizes = np.empty(len(texts), dtype=np.int64)
        sizes[~single], sizes[single] = of_rest, [len(x) for x in by_one]
        ends = np.cumsum(sizes)
        ids, others = np.empty(int(ends[-1]), dtype=np.uint32), np.ones(int(ends[-1]), dtype=bool)
        for x, end in zip(by_one, ends[single].tolist()):
            ids[end - len(x) : end], others[end - len(x) : end] = x, False
        ids[others] = rest
        return ids, sizes


def with_end(ids, sizes, end_id: int):
    """The ids with ``end_id`` after each text's, and the numbers of ids."""
    import numpy as np

    return np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1


def binaries(values, sizes):
    """An Arrow array of binaries: runs of ``sizes`` entries of the array ``values``."""
    import numpy as np
    import pyarrow as pa

    ends = np.concatenate(([0], np.cumsum(sizes))) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(tokenizer: str) -> ChunkEncoder:
    """This worker's encoder (workers are used again); one at a time, so that a worker holds one tokenizer."""
    if tokenizer not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer] = ChunkEncoder(tokenizer)
    return _ENCODERS[tokenizer]


def small_batches(batch, text_column: int, most_bytes: int = BATCH_BYTES):
    """Slices of an Arrow record batch whose texts take about ``most_bytes`` (at least a row each), by their real sizes."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(text_column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most_bytes, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def tidy() -> None:
    """Give back, at a task's end, the memory that Arrow and the C library hold for later; workers live on."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)

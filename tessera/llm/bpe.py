"""BPE encoding and decoding.

A piece is encoded by a priority queue of merge ranks over a doubly linked list of its symbols: the cheapest pair is merged
first (ties: leftmost), the pairs beside it are queued anew, and entries whose symbols have changed since are skipped. A
document is decoded by concatenating the vocabulary strings of its ids.

The vocabulary file is JSON in the format of the tokenizers library: NFC, white space to one space, lower case; pieces by the
file's own pattern; bytes mapped to printable characters; an end-of-word mark on the last symbol. The library itself only
normalises and splits words outside Latin-1.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import map_batches, text_or_empty

#: Encoded words that a worker keeps; beyond it the older half is dropped (a matter of speed only).
CACHE_WORDS = 1_000_000
#: Characters that Python's split() takes for white space and the file's pattern does not.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
#: White space by Unicode's property.
SPACE = regex.compile(r"\p{White_Space}+")


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable Latin-1, else from 256 on in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, more = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


def is_latin(text: str) -> bool:
    """Whether a text has Latin-1 characters only, which NFC leaves as they are."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Bpe:
    """One vocabulary: encode() and decode() as the tokenizers library, without special tokens added."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.first = [self.ids[s] for s in byte_symbols()]
        self.last = [self.ids[s + self.suffix] for s in byte_symbols()]
        #: (left << 20 | right) -> (rank << 20 | merged)
        self.merges: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges.setdefault(self.ids[left] << 20 | self.ids[right], rank << 20 | self.ids[left + right])
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pieces = regex.compile(splits[0]["pattern"]["Regex"])
        self.unicode = Tokenizer.from_file(path)
        self.apart = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.mixed: dict[str, tuple[bytes, bytes]] = {}
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(16)]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece. A queue entry is rank, position and merged id in one integer, so that ties go to the left."""
        n = len(piece) - 1
        first = self.first
        ids = [first[b] for b in piece]
        ids[n] = self.last[piece[n]]
        if not n:
            return ids
        merges = self.merges
        queue = []
        for at in range(n):
            found = merges.get(ids[at] << 20 | ids[at + 1])
            if found is not None:
                queue.append((found >> 20) << 60 | at << 20 | found & 0xFFFFF)
        if not queue:
            return ids
        heapq.heapify(queue)
        before, after = list(range(-1, n)), list(range(1, n + 2))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            at = entry >> 20 & 0xFFFFFFFFFF
            right = after[at]
            if right > n or ids[at] < 0:
                continue
            merged = entry & 0xFFFFF
            if merges.get(ids[at] << 20 | ids[right]) != entry >> 60 << 20 | merged:
                continue
            ids[at] = merged
            ids[right] = -1
            beyond = after[at] = after[right]
            if beyond <= n:
                before[beyond] = at
                found = merges.get(merged << 20 | ids[beyond])
                if found is not None:
                    push(queue, (found >> 20) << 60 | at << 20 | found & 0xFFFFF)
            left = before[at]
            if left >= 0:
                found = merges.get(ids[left] << 20 | merged)
                if found is not None:
                    push(queue, (found >> 20) << 60 | left << 20 | found & 0xFFFFF)
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> tuple[bytes, bytes]:
        """Ids (little-endian unsigned 32-bit) and spaced vocabulary strings of a normalised text without white space.

        Single pieces are kept apart from words of several pieces, which are put together from their pieces.
        """
        found = self.old.get(word)
        if found is None:
            pieces = self.split(word)
            if len(pieces) > 1:
                known = self.words
                each = [known.get(p) or self.word(p) for p in pieces]
                found = b"".join([e[0] for e in each]), b" ".join([e[1] for e in each])
                if len(word) <= 64:
                    if len(self.mixed) >= CACHE_WORDS // 4:
                        self.mixed.clear()
                    self.mixed[word] = found
                return found
            ids = self.merge(pieces[0].encode())
            strings = self.strings
            found = self.pack[len(ids)](*ids) if len(ids) < 16 else np.array(ids, dtype="<u4").tobytes(), " ".join([strings[i] for i in ids]).encode()
        if len(word) <= 64:
            if len(self.words) >= CACHE_WORDS // 2:
                self.old, self.words = self.words, {}
            self.words[word] = found
        return found

    def split(self, word: str) -> list[str]:
        """Pieces of a word. Characters outside Latin-1 go by the library's Unicode tables, so that new letters agree."""
        if word.isalpha() and is_latin(word):
            return [word]
        if is_latin(word):
            return self.pieces.findall(word)
        return [word[a:b] for _, (a, b) in self.unicode.pre_tokenizer.pre_tokenize_str(word)]

    def normal(self, text: str) -> list[str]:
        """NFC, lower case character by character, split at white space."""
        if not is_latin(text):
            return [w for w in self.unicode.normalizer.normalize_str(text).split(" ") if w]
        lower = text.lower()
        return [w for w in SPACE.split(lower) if w] if NOT_SPACE.search(lower) else lower.split()

    def parts(self, text: str) -> tuple[bytes, list[bytes]]:
        """Ids as bytes and the spaced vocabulary strings, word by word, of a text in which special strings stand for their ids."""
        known, mixed, word = self.words, self.mixed, self.word
        ids: list[bytes] = []
        strings: list[bytes] = []
        sections = self.apart.split(text) if self.apart and "<|" in text else [text]
        for section in sections:
            if section in self.special:
                ids.append(self.special[section].to_bytes(4, "little"))
                strings.append(section.encode())
                continue
            for w in self.normal(section):
                found = known.get(w)
                if found is None:
                    found = mixed.get(w)
                    if found is None:
                        found = word(w)
                        known = self.words
                ids.append(found[0])
                strings.append(found[1])
        return b"".join(ids), [s for s in strings if s]

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return np.frombuffer(self.parts(text)[0], dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by spaces, as the library joins where a file names no decoder; unknown ids are left out."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


@functools.cache
def load(path: str) -> Bpe:
    """The vocabulary at a path, once per worker process."""
    return Bpe(path)


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row of documents.

    Null text is empty text and gives no ids; repeated rows give repeated rows; an empty table gives an empty one; other
    columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
        decoded = [bpe.decode(i) for i in ids]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return map_batches(documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, "doc_id long, ids array<int>, decoded string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded() reduced to digests where it is made.

    The ids are digested as little-endian unsigned 32-bit integers, the decoded text in UTF-8.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        counts, ids_hash, text_hash = [], [], []
        for text in batch.column(1).to_pylist():
            ids, strings = bpe.parts(text)
            counts.append(len(ids) // 4)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            text_hash.append(hashlib.sha256(b" ".join(strings)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

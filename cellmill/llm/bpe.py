"""Byte-level BPE encoding and decoding.

A text is cut at special tokens, then into words by the pre-tokeniser's pattern. Each word is merged in a contiguous rank
array: part boundaries and, beside each, the rank of the pair that starts there. The smallest rank is found by a
scan, its boundary deleted and the two neighbouring ranks refreshed. Words are short, so the scan beats a heap; words
above LONG_WORD parts take a heap over linked parts instead, so that one endless word costs n log n and not n * n.
Merged words are remembered in two tables of bounded size: when the newer is full it becomes the older one, and words
found there move on, so frequent words stay.

A file that asks for a normalizer, a prefix space, whole-word look-ups or other things that aren't done here is refused.

Edge cases: a null text counts as empty (no ids, empty text back); repeated rows are encoded each; an empty table gives
an empty result; only the named columns are read, so others may be called anything.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cellmill.llm.common import slices

#: Fixed values of the byte-level format: the pattern of words. White space is Unicode's, named as such.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts that are all ASCII.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
LONG_WORD = 96
CACHE_WORDS = 1 << 17
CACHED_CHARS = 64
NO_PAIR = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next code point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: What a file must say where it says anything, because nothing else is implemented.
_ASSUMED = {
    "": {"normalizer": None, "post_processor": None},
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "decoder": {"type": "ByteLevel"},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
    "added_tokens": {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False},
}


def check_spec(spec: dict) -> None:
    """Raises ValueError for a file that asks for what this module does not do."""
    for part, wanted in _ASSUMED.items():
        given = [spec] if not part else spec.get(part) if part == "added_tokens" else [spec.get(part) or {}]
        for section in given or ():
            for name, value in wanted.items():
                if section.get(name, value) not in (value, "" if value is None else value):
                    raise ValueError(f"{part or 'tokenizer'}.{name} is {section[name]!r}; only {value!r} is supported")


class Codec:
    """Encoder and decoder of one vocabulary file (a tokenizer description in JSON with a byte-level BPE model)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.tokens: dict[int, bytes] = {i: as_bytes(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = [0] * 256
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab.get(c, -1)
        self.ranks: dict[int, int] = {}  # of a pair of ids
        self.made: list[int] = []  # the id that the merge of a rank makes
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.words, self.ascii_words = regex.compile(WORDS).findall, re.compile(ASCII_WORDS).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.special else None
        self.cache: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Merges the byte ids of one word."""
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        rank, made = self.ranks.get, self.made
        ranks = [rank(a << 32 | b, NO_PAIR) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NO_PAIR:
            at = ranks.index(least)
            parts[at] = made[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(parts[at] << 32 | parts[at + 1], NO_PAIR)
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 32 | parts[at], NO_PAIR)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[k], i, k) for i in range(n - 1) if (k := parts[i] << 32 | parts[i + 1]) in ranks]
        heapq.heapify(heap)
        while heap:
            least, i, key = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or parts[i] << 32 | parts[j] != key:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = self.made[least], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (k := parts[a] << 32 | parts[b]) in ranks:
                    heapq.heappush(heap, (ranks[k], a, k))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> list[int]:
        """The ids of a word that isn't in the newer table."""
        ids = self.older.get(word) or self.merge(list(map(self.byte_ids.__getitem__, word.encode())))
        if len(word) <= CACHED_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.older = self.cache.copy()
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def forget(self) -> None:
        """Empties the tables of merged words."""
        self.cache.clear()
        self.older = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known, word_ids = self.cache.get, self._word
        for piece in self.cuts(text) if self.cuts and text else (text or "",):
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                for word in (self.ascii_words if piece.isascii() else self.words)(piece):
                    out += known(word) or word_ids(word)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, built once in each Python process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """One row per row of docs: id_col, ids (array of int) and, if wanted, decoded: the text made from these ids."""

    def run(batches):
        model = codec(path)
        for batch in slices(batches, 64):
            ids = [model.encode(t) for t in batch.column(1).to_pylist()]
            out = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(map(model.decode, ids), pa.string())] * decoded, names=names)
        model.forget()  # the process goes on to other tasks

    names = [id_col, "ids"] + ["decoded"] * decoded
    rows = docs.select(docs[id_col], docs[text_col])
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * decoded)

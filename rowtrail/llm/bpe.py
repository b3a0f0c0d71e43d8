"""BPE encoding and decoding by a prefix-sharing trie traversal.

The distinct words of a batch are inserted into a trie of bytes. A depth-first
walk gives each node one number: the last token of the encoding of the prefix
that ends there. That token is the only vocabulary entry ``t`` that is a suffix
of the prefix and that may follow the last token of what is left without ``t``.
Prefixes that words share are therefore encoded once, and the encoding of a word
is read backwards along its own path.

Two tokens may stand side by side if plain pair merging of their joined bytes
never merges across their border. The answers are kept in a table.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended

#: How byte-level BPE cuts a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and pairs of tokens after which a worker's tables are dropped and built anew. This bounds memory and changes no result.
MAX_CACHED, MAX_PAIRS = 300_000, 300_000
#: Characters of text whose words share one trie.
TRIE_CHARS = 1_500_000
START = -1
NEVER = 1 << 60


def printable_bytes() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The ids, merge ranks and added tokens of a tokenizer file's JSON text."""

    def __init__(self, text: str):
        file, byte = json.loads(text), printable_bytes()
        encoded = lambda s: bytes(byte[c] for c in s)
        self.ids = {encoded(s): i for s, i in file["model"]["vocab"].items() if all(c in byte for c in s)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        for content in self.special:
            self.ids.pop(content.encode(), None)
        merges = (m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])
        self.ranks = {(encoded(a), encoded(b)): rank for rank, (a, b) in enumerate(merges)}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: c.encode() for c, i in self.special.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes}
        self.heads = {b[:n] for b in self.ids for n in range(len(b) + 1)}
        alternatives = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.special_pattern = regex.compile(f"({'|'.join(alternatives)})") if alternatives else None
        self.split = regex.compile(SPLIT)

    def parts(self, text: str) -> list[str]:
        """The text between added tokens, at even places, and these tokens, at odd ones."""
        if self.special_pattern and any(x in text for x in self.special):
            return self.special_pattern.split(text)
        return [text]

    def text(self, ids: bytes) -> str:
        """Decode little-endian unsigned 32-bit ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def merged(self, data: bytes) -> list[bytes]:
        return self.merging(data)[-1][1]

    def merging(self, data: bytes) -> list[tuple[int, list[bytes]]]:
        """Plain pair merging of the bytes of one token: the parts after each rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        steps = [(START, parts)]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.ranks.get(p, len(self.ranks)))
            if best not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == best:
                    out.append(best[0] + best[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
            steps.append((self.ranks[best], parts))
        return steps


class State:
    """The longest suffix of a path that begins some token, and the tokens that end there."""

    __slots__ = ("tail", "after", "tokens")

    def __init__(self, tail: bytes, tokens: list[tuple[int, int]]):
        self.tail, self.after, self.tokens = tail, {}, tokens


class TrieEncoder:
    """Encodes sets of words; keeps the encodings of words it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.encoded: dict[str, bytes] = {}
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple[list, list]] = {}
        self.start = State(b"", [])
        self.states = {b"": self.start}

    def edge(self, token: int) -> tuple[list, list]:
        """What stands at the left and right edge of a token while its bytes are merged.

        Each list holds (part, rank of the merge that replaces it); the last rank is infinite.
        """
        known = self.edges.get(token)
        if known is None:
            steps = self.v.merging(self.v.bytes[token])
            known = ([], [])
            for side, at in zip(known, (0, -1), strict=True):
                part = steps[0][1][at]
                for rank, parts in steps[1:]:
                    if parts[at] != part:
                        side.append((part, rank))
                        part = parts[at]
                side.append((part, NEVER))
            self.edges[token] = known
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes never merges across the border of the two tokens.

        Merges run by rank, and at equal rank from left to right.
        """
        if left == START:
            return len(self.v.merged(self.v.bytes[right])) == 1
        ranks, ends, begins = self.v.ranks, self.edge(left)[1], self.edge(right)[0]
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], begins[j]
            rank = ranks.get((a, b), NEVER)
            if rank < a_until and rank <= b_until:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def step(self, state: State, byte: int) -> State:
        tail = state.tail + bytes((byte,))
        while tail not in self.v.heads:
            tail = tail[1:]
        found = self.states.get(tail)
        if found is None:
            ids = self.v.ids
            found = State(tail, [(len(tail) - i, ids[tail[i:]]) for i in range(len(tail)) if tail[i:] in ids])
            self.states[tail] = found
        state.after[byte] = found
        return found

    def learn(self, words: set[str]) -> None:
        """Insert the new words into a trie and encode them all in one walk."""
        new = words - self.encoded.keys()
        if len(self.encoded) + len(new) > MAX_CACHED:
            self.encoded.clear()
            new = words
        if len(self.adjacent) > MAX_PAIRS:
            self.adjacent.clear()
        gc.disable()  # the trie has no cycles, and looking for some takes most of the time
        try:
            self.walk(self.trie(new))
        finally:
            gc.enable()

    @staticmethod
    def trie(words: set[str]) -> dict:
        root: dict = {}
        for word in words:
            node = root
            for byte in word.encode("utf-8", "surrogatepass"):
                below = node.get(byte)
                if below is None:
                    below = node[byte] = {}
                node = below
            node[START] = word
        return root

    def walk(self, root: dict) -> None:
        """Depth first: a node's last token, found from the last tokens above it on the path."""
        adjacent, encoded, packed = self.adjacent, self.encoded, self.v.packed
        last, lengths = [START], [0]  # of the path's prefixes: last token, and its length
        stack = [(root, 0, self.start)]
        while stack:
            node, depth, state = stack.pop()
            if depth:
                del last[depth:], lengths[depth:]
                for length, token in state.tokens:
                    before = last[depth - length]
                    fits = adjacent.get((before, token))
                    if fits is None:
                        fits = adjacent[before, token] = self.may_follow(before, token)
                    if fits:
                        last.append(token)
                        lengths.append(length)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            for key, child in node.items():
                if key != START:
                    stack.append((child, depth + 1, state.after.get(key) or self.step(state, key)))
                else:
                    ids, at = [], depth
                    while at:
                        ids.append(packed[last[at]])
                        at -= lengths[at]
                    ids.reverse()
                    encoded[child] = b"".join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        pieces, words = [], set()
        for text in texts:
            own: list = []
            for i, part in enumerate(self.v.parts(text)):
                own.append([part] if i % 2 else self.v.split.findall(part))
                if not i % 2:
                    words.update(own[-1])
            pieces.append(own)
        self.learn(words)
        word_ids, special = self.encoded.__getitem__, lambda content: self.v.packed[self.v.special[content]]
        return [b"".join(b"".join(map(special if i % 2 else word_ids, part)) for i, part in enumerate(own)) for own in pieces]


@lru_cache(maxsize=2)
def encoder_for(tokenizer_json: str) -> TrieEncoder:
    """One for each Python worker, so that later tasks find what earlier ones have learned."""
    return TrieEncoder(Vocabulary(tokenizer_json))


def in_blocks(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Cut the texts into lists of about ``most`` characters; a longer text stands alone."""
    block, chars = [], 0
    for text in texts:
        if block and chars + len(text) > most:
            yield block
            block, chars = [], 0
        block.append(text)
        chars += len(text)
    if block:
        yield block


def encoded_blocks(batch: pa.RecordBatch, text_at: int, encoder: TrieEncoder) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    done = 0
    for block in in_blocks(((x.as_py() or "") for x in batch.column(text_at)), TRIE_CHARS):
        yield batch.slice(done, len(block)), encoder.encode(block)
        done += len(block)


def encode(docs: DataFrame, tokenizer_json: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids of each row's whole text.

    ``tokenizer_json`` is the content of a byte-level BPE tokenizer file. Returns
    the columns ``keep``, ``n_tokens`` long, and ``ids`` binary: little-endian
    unsigned 32-bit integers. Added tokens found in a text get their own id. A
    null text counts as empty and has no ids; repeated rows give repeated rows;
    an empty table gives an empty table; other columns are not read.
    """
    if {"n_tokens", "ids"} & set(keep):
        raise ValueError("keep clashes with the columns that encode() adds")
    schema = extended(docs.select(*keep).schema, "n_tokens long, ids binary")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_json)
        for batch in it:
            for rows, ids in encoded_blocks(batch, len(keep), encoder):
                columns = [rows.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string")).mapInArrow(batches, schema)


def decode(encoded: DataFrame, tokenizer_json: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """Texts of encoded rows: the columns ``keep`` and ``text``.

    Bytes that are not UTF-8 become U+FFFD. Null ids count as none.
    """
    schema = extended(encoded.select(*keep).schema, "text string")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_for(tokenizer_json).v
        for batch in it:
            texts = [vocabulary.text(x.as_py() or b"") for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*keep, F.col(ids_col)).mapInArrow(batches, schema)


def digests(docs: DataFrame, tokenizer_json: str, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode, decode what was encoded, and return the digests of both: key, n_tokens, ids_sha256, decoded_sha256.

    One Python worker does both, so that a task needs one set of tables. Nulls,
    repeated rows and empty tables are treated as in encode().
    """
    schema = extended(docs.select(key).schema, "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_json)
        for batch in it:
            for rows, ids in encoded_blocks(batch, 1, encoder):
                columns = [len(x) // 4 for x in ids], [sha256(x) for x in ids], [sha256(encoder.v.text(x).encode("utf-8")) for x in ids]
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], names=schema.names)

    return docs.select(key, F.col(text_col).cast("string")).mapInArrow(batches, schema)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

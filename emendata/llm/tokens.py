"""Token counts: byte-pair merging with a heap over a linked list, counting without ids.

A text is cut into pre-tokens; each distinct pre-token is merged once per worker and its count kept.
The count of a pre-token is its number of bytes less the number of merges.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The public pre-token pattern of byte-level vocabularies.
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Distinct pieces remembered by one worker before it starts over; bounds memory, never results.
REMEMBERED = 1_500_000
SLICE_BYTES = 16 << 20


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class MergeCounter:
    """Counts tokens as the vocabulary file (JSON text) would give them, special strings counting one each."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.width = len(vocab) + len(spec["added_tokens"]) + 1
        self.first = [vocab[c] for c in byte_symbols()]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[a] * self.width + vocab[b], (rank, vocab[a + b]))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pretoken = regex.compile(PRETOKEN)
        self.known: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """Symbols left after all merges, lowest rank first and leftmost among equals."""
        n = len(data)
        if n < 2:
            return n
        pairs, width = self.pairs, self.width
        symbol = [self.first[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (found := pairs.get(symbol[i] * width + symbol[i + 1])) is not None:
                heap.append((found[0], i))
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i = heapq.heappop(heap)
            if symbol[i] < 0 or (j := after[i]) >= n:
                continue
            found = pairs.get(symbol[i] * width + symbol[j])
            if found is None or found[0] != rank:
                continue  # the pair changed since it was queued
            symbol[i], symbol[j] = found[1], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := pairs.get(symbol[i] * width + symbol[k])) is not None:
                    heapq.heappush(heap, (found[0], i))
            if (p := before[i]) >= 0 and (found := pairs.get(symbol[p] * width + symbol[i])) is not None:
                heapq.heappush(heap, (found[0], p))
        return left

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total, known = 0, self.known
        for piece in self.pretoken.findall(text):
            count = known.get(piece)
            if count is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                count = self.merged(piece.encode())
                if len(piece) <= 64:
                    known[piece] = count
            total += count
        return total

    def whole(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text (null: 0).

        A single space between two non-space characters always starts a pre-token, so texts are cut there and
        each distinct piece is counted once. Texts with special strings or other spacing are counted whole.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(texts, " ")
        coded = split.values.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        table = np.empty(len(pieces), np.int64)
        odd = np.zeros(len(pieces), bool)
        memory, special = self.pieces, self.special
        for i, piece in enumerate(pieces):
            count = memory.get(piece)
            if count is None:
                if not piece or piece[0].isspace() or piece[-1].isspace() or (special and special.search(piece)):
                    count = -1
                else:
                    count = self.plain(" " + piece)
                if len(piece) <= 64:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[piece] = count
            table[i], odd[i] = count, count < 0
        codes = coded.indices.to_numpy(zero_copy_only=False)
        offsets = split.offsets.to_numpy()
        starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        running = np.concatenate([[0], np.cumsum(table[codes])])
        strange = np.concatenate([[0], np.cumsum(odd[codes])])
        out = running[ends] - running[starts]
        plain = strange[ends] == strange[starts]
        for i in range(len(texts)):
            if not plain[i] or (special and " " in special.pattern):
                out[i] = self.whole(texts[i].as_py())
            else:
                head = pieces[codes[starts[i]]]  # the first piece has no space before it
                out[i] += self.plain(head) - table[codes[starts[i]]]
        return out


@lru_cache(maxsize=4)
def counter(vocabulary: str) -> MergeCounter:
    return MergeCounter(vocabulary)


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Parts of a batch of about ``most`` bytes each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield texts.slice(at, i - at)
            at, total = i, 0
        total += size
    if at < len(texts):
        yield texts.slice(at)


def token_count(text: Column, vocabulary_path: str) -> Column:
    """A long: tokens of the text by the byte-level vocabulary file. Null counts 0, as the empty text does.

    Special strings inside a text count one token each; nothing is added, cut or padded. Works on whole texts of
    any length; the heap form costs n log n for a pre-token of n bytes.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        engine = counter(vocabulary)
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        parts = [engine.counts(x) for x in slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())

    return count(text)


def with_token_counts(docs: DataFrame, vocabulary_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """All columns of ``docs`` and n_bytes, n_tokens (longs), over_limit (boolean); columns of those names are replaced.

    No shuffle: rows stay where they are. Repeated rows are counted each. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    body = F.col(f"`{text}`")
    return docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(body, vocabulary_path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)

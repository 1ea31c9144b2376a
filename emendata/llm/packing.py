"""Packing: concatenate and cut.

Pass one tokenises and stores each document's ids with its start inside its partition. The partition totals give,
by a prefix sum, the offset of every partition, so pass two places each document without moving it and cuts it
where a window of the global stream ends. A document cut at a window leaves boundary records on both sides.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emendata.llm.common import stored
from emendata.llm.tokens import slices

#: Distinct words remembered by one worker before it starts over; bounds memory, never results.
REMEMBERED = 1_000_000
#: Bytes of text that are looked up at a time.
LOOKED_UP = 4 << 20
#: Words that are joined for one call of the tokenizer.
JOINED = 2_000


def lean(word: str) -> bool:
    """Whether lower-casing is all that the tokenizer's normaliser does to a word: Latin letters, but for the dotted I,
    whose small form has two code points."""
    return word.isascii() or (max(word) < "\u0250" and "\u0130" not in word)


class Encoder:
    """Ids of texts by a tokenizer that drops white space, word by word, each distinct word encoded once.

    Words of Latin letters are lower-cased here and encoded without the tokenizer's normaliser, which would leave
    them as they are; all others go through it.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lean = Tokenizer.from_str(json.dumps(json.loads(vocabulary) | {"normalizer": None}))
        # A control character as a separate word; texts that hold one are encoded whole.
        self.mark = "\x01"
        self.mark_ids = self.ids(self.mark)
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([""], pa.large_string())
        self.begins, self.lengths, self.store = np.zeros(1, np.int32), np.zeros(1, np.int32), np.empty(0, np.uint32)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, unseen: list[str], tokenizer) -> None:
        """Append the ids of new words to the store."""
        stores, begins, lengths, at = [self.store], [self.begins], [self.lengths], len(self.store)
        for low in range(0, len(unseen), JOINED):
            part = unseen[low : low + JOINED]
            ids = np.array(tokenizer.encode(f" {self.mark} ".join(part), add_special_tokens=False).ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark_ids[0])
            if len(self.mark_ids) != 1 or len(marks) != len(part) - 1:
                each = [self.ids(word) for word in part]
                ids = np.array([x for word in each for x in word], np.uint32)
                length = np.fromiter(map(len, each), np.int64, len(each))
                begin = np.cumsum(length) - length
            else:
                begin = np.concatenate([[0], marks + 1])
                length = np.concatenate([marks, [len(ids)]]) - begin
            stores.append(ids)
            begins.append((at + begin).astype(np.int32))
            lengths.append(length.astype(np.int32))
            at += len(ids)
            if at >= 1 << 31:
                raise ValueError("words of more than 2 billion ids in one slice")
        self.store, self.begins, self.lengths = np.concatenate(stores), np.concatenate(begins), np.concatenate(lengths)

    def known(self, words: pa.Array) -> np.ndarray:
        """The place of each of these distinct words in the store. Words are remembered as they are written, in one
        Arrow array, which takes a tenth of the memory of a dictionary of strings."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count and len(self.words) + at.null_count > REMEMBERED:
            self.forget()
            at = pc.index_in(words, value_set=self.words)
        if not at.null_count:
            return at.to_numpy(zero_copy_only=False)
        missing = pc.is_null(at)
        unseen = words.filter(missing)
        listed = unseen.to_pylist()
        plain = np.fromiter(map(lean, listed), bool, len(listed))
        order = np.argsort(~plain, kind="stable")
        places = np.empty(len(listed), np.int32)
        places[order] = len(self.words) + np.arange(len(listed), dtype=np.int32)
        self.learn([w.lower() for w, p in zip(listed, plain.tolist(), strict=True) if p], self.lean)
        if not plain.all():
            self.learn([w for w, p in zip(listed, plain.tolist(), strict=True) if not p], self.tokenizer)
        self.words = pa.concat_arrays([self.words, unseen.take(pa.array(order))])
        out = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).copy()
        out[missing.to_numpy(zero_copy_only=False)] = places
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # Characters that Python and the tokenizer do not both take as white space, marks, and special strings.
        odd = pc.match_substring_regex(texts, "[\\x00-\\x08\\x0e-\\x1f]|" + "|".join(_quoted(s) for s in self.special or ["\x01"]))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts) if odd.any() else texts
        split = pc.utf8_split_whitespace(plain)
        coded = split.values.dictionary_encode()
        places = self.known(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        offsets = split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        del plain, split, coded
        per_word = self.lengths[places]
        running = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])
        counts = running[offsets[1:]] - running[offsets[:-1]]
        total = int(running[-1])
        if total >= 1 << 31:
            raise ValueError("a text of more than 2 billion ids is more than one row can hold")
        moved = self.begins[places] - running[:-1].astype(np.int32)
        del places, running
        at = np.repeat(moved, per_word)
        at += np.arange(total, dtype=np.int32)
        ids = self.store[at]
        del at
        if odd.any():
            bounds = np.concatenate([[0], np.cumsum(counts)])
            parts = [
                np.array(self.ids(texts[i].as_py()), np.uint32) if odd[i] else ids[bounds[i] : bounds[i + 1]]
                for i in range(len(texts))
            ]
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            ids = np.concatenate(parts)
        return ids, counts


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def tokenized(docs: DataFrame, vocabulary_path: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Per document: id, part, at (ids before it in its part), doc_tokens, ids (16 or 32 bits each, little-endian)."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    kind = docs.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("part", T.IntegerType()),
            T.StructField("at", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def run(batches):
        engine, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            row = 0
            for texts in slices(batch.column(1), LOOKED_UP):
                ids, counts = engine.encode(texts)
                whole = np.empty(len(ids) + len(counts), np.uint16 if len(ids) == 0 or ids.max() < 65536 else np.uint32)
                ends = np.cumsum(counts + 1)
                keep = np.ones(len(whole), bool)
                keep[ends - 1] = False
                whole[keep], whole[ends - 1] = ids, end_id
                width = whole.itemsize
                # The width is told by the length: ids are 2 bytes where the value is doc_tokens * 2 long.
                limits = np.concatenate([[0], ends * width])
                if limits[-1] >= 1 << 31:
                    raise ValueError("a text of 2 GB of ids is more than one row can hold")
                data = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(limits.astype(np.int32)), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(counts)),
                        pa.array(np.full(len(counts), part, np.int32)),
                        pa.array(at + ends - (counts + 1)),
                        pa.array(counts + 1),
                        data,
                    ],
                    names=schema.fieldNames(),
                )
                at += int(ends[-1]) if len(ends) else 0
                row += len(counts)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    end_id: int = 2,
    window: int = 4096,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Cut the stream of all documents' ids into windows; one row per piece of a document in a window.

    Columns: doc_id, start (ids of the document before the piece), length, ids (binary, unsigned 32 bits
    little-endian each), doc_tokens, sequence_id and offset (from 0, without gaps), cut_before and cut_after
    (the piece is a boundary record: its document goes on in the window before or after).

    Null texts are empty and have the end id only; rows that repeat are packed each; other columns are not read.
    Only the last window is short, so only it is padded. The driver sees one number per partition of the input,
    whatever the number of documents. Order follows the partitions of the input.
    """
    table = stored(tokenized(docs, vocabulary_path, end_id, doc_id, text))
    totals = {r.part: r.n for r in table.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}
    bases = np.zeros(max(totals, default=0) + 2, np.int64)
    for part, n in totals.items():
        bases[part + 1] = n
    known = table.sparkSession.sparkContext.broadcast(np.cumsum(bases))
    kind = docs.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("cut_before", T.BooleanType()),
            T.StructField("cut_after", T.BooleanType()),
        ]
    )

    def run(batches):
        for batch in batches:
            part, at, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            begin = known.value[part] + at
            first, last = begin // window, (begin + n - 1) // window
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] + nth
            low = np.maximum(sequence * window, begin[row])
            high = np.minimum((sequence + 1) * window, (begin + n)[row])
            start, length = low - begin[row], high - low
            values = batch.column(4)
            out = []
            for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                raw = values[r].as_buffer()
                kind = np.uint16 if len(raw) == 2 * n[r] else np.uint32
                out.append(np.frombuffer(raw, kind)[s : s + k].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(out, pa.binary()),
                    pa.array(n[row]),
                    pa.array(sequence),
                    pa.array(low - sequence * window),
                    pa.array(start > 0),
                    pa.array(start + length < n[row]),
                ],
                names=schema.fieldNames(),
            )

    return table.mapInArrow(run, schema)

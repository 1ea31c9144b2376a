"""Document fingerprints: content-defined chunks, their digests, and containment by length.

A gear hash over the last 32 bytes marks boundaries, with a strict mask before the normal chunk length and a loose one
after it, so lengths gather around the normal one. An insertion moves boundaries only near it. The fingerprint of a
text is the sorted set of its chunk digests, each with its chunk's length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emendata.llm.common import row_key, stored
from emendata.llm.tokens import slices

WINDOW, LEAST, NORMAL, MOST = 32, 32, 64, 256
STRICT, LOOSE = 8, 5  # bits
DIGEST = 6  # bytes
GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, dtype=np.uint32)
ITEM = 2 * DIGEST + 3  # characters of a chunk in a fingerprint: digest and length in hex


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum over the last 32 bytes of GEAR[byte] shifted by its distance, by doubling the window."""
    h = GEAR[data]
    m = 1
    while m < WINDOW:
        longer = h.copy()
        longer[m:] += h[:-m] << np.uint32(m)
        h, m = longer, 2 * m
    return h


def chunks(texts: list[bytes]) -> list[dict[bytes, int]]:
    """The digests of each text's chunks, with their lengths.

    A boundary is looked for LEAST bytes after the last one at the earliest; the window is not longer than that, so
    what stands before a chunk never moves its end.
    """
    whole = b"".join(texts)
    # The top bits depend on all of the window.
    high = gear_hashes(np.frombuffer(whole, np.uint8)) if whole else np.empty(0, np.uint32)
    loose_at = np.flatnonzero(high >> np.uint32(32 - LOOSE) == 0)
    strict_at = loose_at[high[loose_at] >> np.uint32(32 - STRICT) == 0].tolist()
    loose_at = loose_at.tolist()
    out, at = [], 0
    for text in texts:
        end, found = at + len(text), {}
        while at < end:
            limit = min(at + MOST, end)
            i = bisect_left(strict_at, at + LEAST - 1)
            cut = strict_at[i] + 1 if i < len(strict_at) else end
            if cut > at + NORMAL:
                i = bisect_left(loose_at, at + NORMAL - 1)
                cut = loose_at[i] + 1 if i < len(loose_at) else end
            cut = min(cut, limit)
            found[hashlib.blake2b(whole[at:cut], digest_size=DIGEST).digest()] = cut - at
            at = cut
        out.append(found)
    return out


def written(found: dict[bytes, int]) -> str:
    return "".join([f"{d.hex()}{n:03x}" for d, n in sorted(found.items())])


def read(fingerprint: str) -> dict[str, int]:
    """The digests of a fingerprint, with their lengths."""
    cut = range(0, len(fingerprint), ITEM)
    return {fingerprint[i : i + 2 * DIGEST]: int(fingerprint[i + 2 * DIGEST : i + ITEM], 16) for i in cut}


def containment(a: dict, b: dict) -> float:
    """The share of the length in ``a`` whose digests are in ``b``; empty ones are contained in empty ones only."""
    total = sum(a.values())
    if not total:
        return 1.0 if not b else 0.0
    return sum(n for d, n in a.items() if d in b) / total


def edited(text: str, following: str) -> str:
    """``text`` with its last half, rounded down, replaced by as many first code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = (
    ("n_chars", T.LongType()),
    ("edited_sha256", T.StringType()),
    ("fingerprint", T.StringType()),
    ("edited_fingerprint", T.StringType()),
    ("near_edited", T.DoubleType()),
    ("near_next", T.DoubleType()),
)
EDGES = (("_part", T.IntegerType()), ("_first", T.BooleanType()), ("_last", T.BooleanType()), ("_text", T.StringType()))


def compared(texts: list[str], following: list[str], known: list[dict] | None = None) -> list[tuple]:
    """The FIELDS of each text held against the one that follows it."""
    if known is None:
        known = chunks([x.encode() for x in texts + following])
        own, others = known[: len(texts)], known[len(texts) :]
    else:
        own, others = known[:-1], known[1:]
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    raw = [x.encode() for x in changed]
    out = []
    for text, data, mine, new, other in zip(texts, raw, own, chunks(raw), others, strict=True):
        out.append((len(text), hashlib.sha256(data).hexdigest(), written(mine), written(new), containment(mine, new), containment(mine, other)))
    return out


def columns(rows: list[tuple], fields) -> list[pa.Array]:
    from pyspark.sql.pandas.types import to_arrow_type

    turned = list(zip(*rows, strict=True)) or [()] * len(fields)
    return [pa.array(list(v), to_arrow_type(t)) for v, (_, t) in zip(turned, fields, strict=True)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents follow each other by descending doc_id (null last, rows of one id by a hash of their text), after the
    last the first. The edited text ends in a part of the next document, see ``edited``. near_edited and near_next
    are containments (0 to 1) of the fingerprint in the edited text's and the next document's. Null texts are empty;
    an empty text has the empty fingerprint; an only document follows itself. Columns other than doc_id and text are
    not read.

    Texts are shuffled once, by range. Only the first and last text of each partition is kept, for the one pair
    of documents that two partitions share.
    """
    kind = docs.schema["doc_id"].dataType
    fields = (("doc_id", kind), *FIELDS, *EDGES)
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    order = [F.col("doc_id").desc_nulls_last(), F.col("_row").desc()]
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        part, held, held_set, first = TaskContext.get().partitionId(), None, None, True
        for batch in batches:
            at = 0
            for piece in slices(batch.column(1)):
                texts = piece.to_pylist()
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                sets = chunks([x.encode() for x in texts])
                if held is not None:
                    texts, sets = [held[1], *texts], [held_set, *sets]
                    ids = pa.concat_arrays([held[0], ids])
                done = compared(texts[:-1], texts[1:], sets)
                edge = [(part, first and i == 0, False, texts[0] if first and i == 0 else None) for i in range(len(done))]
                if done:
                    yield pa.RecordBatch.from_arrays([ids[: len(done)], *columns(done, FIELDS), *columns(edge, EDGES)], names=schema.fieldNames())
                    first = False
                held, held_set = (ids[len(done) :], texts[-1]), sets[-1]
        if held is not None:
            blank = [(None,) * len(FIELDS)]
            edge = [(part, first, True, held[1])]
            yield pa.RecordBatch.from_arrays([held[0], *columns(blank, FIELDS), *columns(edge, EDGES)], names=schema.fieldNames())

    table = stored(rows.mapInArrow(run, schema))
    names = ["doc_id", *[n for n, _ in FIELDS]]
    used = sorted(r._part for r in table.filter("_last").select("_part").collect())  # one number per partition
    if not used:
        return table.select(names)
    after = table.sparkSession.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "_own int, _next int")
    begin = table.filter("_first").select(F.col("_part").alias("_next"), F.col("_text").alias("_following"))
    last = table.filter("_last").select("doc_id", "_part", "_text")
    last = last.join(after, F.col("_part") == F.col("_own")).join(begin, "_next").select("doc_id", "_text", "_following")
    result = T.StructType([T.StructField(n, t) for n, t in fields[: len(names)]])

    def close(batches):
        for batch in batches:
            done = compared(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(done, FIELDS)], names=names)

    return table.filter("NOT _last").select(names).unionByName(last.mapInArrow(close, result))

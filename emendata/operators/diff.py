"""What differs between two revisions: paragraphs added, removed, moved and edited, down to words."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from emendata.functions.spread import spread
from emendata.functions.text import fold
from emendata.operators.versioning import revision_pairs

#: Similarity from which a removed and an added paragraph are one that was edited, and the bar for those that take
#: the same place of a gap of equal length on both sides.
EDITED, EDITED_IN_PLACE = 0.5, 1 / 3
#: Items of an index line are joined by plus signs with space around.
INDEX_JOIN = r"\s\++\s"


def myers(a: list, b: list) -> list[tuple[int, int, int, int]]:
    """Gaps (a from, a to, b from, b to) between equal stretches, by the greedy O(ND) algorithm.

    Items that the other side has not are in a gap whatever the rest does, so only the others are compared: two texts
    without a word in common cost nothing. A step keeps as many numbers as it has diagonals.
    """
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    both = set(a[head : n - tail]) & set(b[head : m - tail])
    rows = [i for i in range(head, n - tail) if a[i] in both]
    columns = [j for j in range(head, m - tail) if b[j] in both]
    pairs = _matches([a[i] for i in rows], [b[j] for j in columns])
    gaps, i, j = [], head, head
    for x, y in [*((rows[x], columns[y]) for x, y in pairs), (n - tail, m - tail)]:
        if x > i or y > j:
            gaps.append((i, x, j, y))
        i, j = x + 1, y + 1
    return gaps


def _matches(x: list, y: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: furthest reaches by number of edits, walked back from the end."""
    n, m = len(x), len(y)
    reach, trace = [0] * (2 * (n + m) + 3), []  # by diagonal k = i - j, from -(n + m) - 1
    zero = n + m + 1
    for d in range(n + m + 1):
        trace.append(array("i", reach[zero - d - 1 : zero + d + 2]))
        for k in range(-d, d + 1, 2):
            at = zero + k
            i = reach[at + 1] if k == -d or (k != d and reach[at - 1] < reach[at + 1]) else reach[at - 1] + 1
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            reach[at] = i
            if i >= n and i - k >= m:
                return _walked_back(trace, n, m)
    return []


def _walked_back(trace: list[array], i: int, j: int) -> list[tuple[int, int]]:
    pairs = []
    for d in range(len(trace) - 1, -1, -1):
        reach, k, mid = trace[d], i - j, d + 1
        if d == 0:
            p = q = 0
        else:
            down = k == -d or (k != d and reach[mid + k - 1] < reach[mid + k + 1])
            before = k + 1 if down else k - 1
            p = reach[mid + before]
            q = p - before
        # Equal items after the edit of this step, back to where the edit has led.
        low = p if d == 0 else (p if down else p + 1)
        while i > low:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        i, j = p, q
    return pairs[::-1]


def word_changes(a: list[str], b: list[str], fa: list[str], fb: list[str]) -> list[dict]:
    """ADDED, REMOVED and CHANGED stretches of words; compared folded, reported as written."""
    out = []
    for i, i2, j, j2 in myers(fa, fb):
        kind = "ADDED" if i == i2 else "REMOVED" if j == j2 else "CHANGED"
        out.append({"kind": kind, "from_index": i, "to_index": j, "from_words": a[i:i2], "to_words": b[j:j2]})
    return out


def similarity(fa: list[str], fb: list[str]) -> float:
    """Twice the words that stay over all words; 0 if a side is empty."""
    if not fa or not fb:
        return 0.0
    gone = sum(i2 - i for i, i2, _, _ in myers(fa, fb))
    return 2.0 * (len(fa) - gone) / (len(fa) + len(fb))


def diff(before: dict, after: dict) -> dict:
    """Title change and ordered paragraph changes between two sides.

    A side has title, folded_title, title_words (folded) and paragraphs: text, folded and words (folded, one for each
    word of the text). Paragraphs that fold to nothing are left out, but places are those of the stored list.
    """
    title = None
    if before["folded_title"] != after["folded_title"]:
        a, b = before["title"] or "", after["title"] or ""
        words = word_changes(a.split(), b.split(), before["title_words"], after["title_words"])
        title = {"from_title": a, "to_title": b, "words": words}
    olds = [(i, p) for i, p in enumerate(before["paragraphs"]) if p["folded"]]
    news = [(i, p) for i, p in enumerate(after["paragraphs"]) if p["folded"]]
    gone, come = [], []  # (place in its list, where it stands on the other side, gap, offset, gap of equal length)
    for g, (i, i2, j, j2) in enumerate(myers([p["folded"] for _, p in olds], [p["folded"] for _, p in news])):
        level = i2 - i == j2 - j
        gone += [(i + k, j, g, k, level) for k in range(i2 - i)]
        come += [(j + k, i, g, k, level) for k in range(j2 - j)]
    free_old, free_new = dict.fromkeys(range(len(gone))), dict.fromkeys(range(len(come)))
    found = []

    def change(kind: str, rank: int, r: int | None, c: int | None, words: list | None = None) -> None:
        old = olds[gone[r][0]] if r is not None else None
        new = news[come[c][0]] if c is not None else None
        place = (come[c][0] if c is not None else gone[r][1], gone[r][0] if r is not None else come[c][1], rank)
        body = {
            "kind": kind,
            "from_index": old[0] if old else None,
            "to_index": new[0] if new else None,
            "from_text": old[1]["text"] if old and kind != "MOVED" else None,
            "to_text": new[1]["text"] if new else None,
            "words": words or [],
        }
        found.append((place, body))
        free_old.pop(r, None)
        free_new.pop(c, None)

    waiting: dict[str, list[int]] = {}
    for c in reversed(free_new):
        waiting.setdefault(news[come[c][0]][1]["folded"], []).append(c)
    for r in list(free_old):
        if same := waiting.get(olds[gone[r][0]][1]["folded"]):
            change("MOVED", 2, r, same.pop())
    for r in list(free_old):
        old = olds[gone[r][0]][1]
        best, most = None, 0.0
        for c in free_new:
            slot = gone[r][2:] == come[c][2:] and gone[r][4]
            bar = EDITED_IN_PLACE if slot else EDITED
            new = news[come[c][0]][1]
            # What the lengths alone rule out needs no comparison.
            if 2.0 * min(len(old["words"]), len(new["words"])) < max(bar, most) * (len(old["words"]) + len(new["words"])):
                continue
            alike = similarity(old["words"], new["words"])
            if alike > most and alike >= bar:
                best, most = c, alike
        if best is not None:
            new = news[come[best][0]][1]
            change("CHANGED", 1, r, best, word_changes(old["text"].split(), new["text"].split(), old["words"], new["words"]))
    for r in list(free_old):
        change("REMOVED", 0, r, None)
    for c in list(free_new):
        change("ADDED", 3, None, c)
    return {"title": title, "paragraphs": [body for _, body in sorted(found, key=lambda x: x[0])]}


def overlap(a: str, b: str) -> float:
    """Twice the words two folded items share, counted, over all their words."""
    x, y = Counter(a.split()), Counter(b.split())
    return 2.0 * (x & y).total() / max(1, x.total() + y.total())


def is_index_rewrite(before: list[str], after: list[str]) -> bool:
    """Whether two lines of folded items are one index whose entries came and went.

    At least two items on a side and one kept, and no item that went like one that came.
    """
    if max(len(before), len(after)) < 2 or before == after:
        return False
    kept = Counter(before) & Counter(after)
    dropped, arrived = (Counter(before) - kept).elements(), list((Counter(after) - kept).elements())
    return kept.total() > 0 and not any(overlap(d, a) >= 0.5 for d in dropped for a in arrived)


def content_changes(changes: list[dict], items) -> list[dict]:
    """Changes without those that only rewrite an index; ``items`` gives the folded items of a text."""
    rewritten = lambda a, b: is_index_rewrite(items(a), items(b))
    left = [c for c in changes if not (c["kind"] == "CHANGED" and rewritten(c["from_text"], c["to_text"]))]
    for old in [c for c in left if c["kind"] == "REMOVED"]:
        new = next((c for c in left if c["kind"] == "ADDED" and rewritten(old["from_text"], c["to_text"])), None)
        if new is not None:
            left = [c for c in left if c is not old and c is not new]
    return left


def rewrites_existing(found: dict, items) -> bool:
    """Whether text that was there is not there as it was: another title, or any change that is not an addition."""
    return found["title"] is not None or any(c["kind"] != "ADDED" for c in content_changes(found["paragraphs"], items))


def segments(text: str | None, marks: list[tuple[int, int]]) -> list[dict]:
    """The words of a text in stretches that are marked or not; marks are (place, length), cut to what there is."""
    words, out = (text or "").split(), []
    marked = [False] * len(words)
    for at, n in marks:
        low = min(max(at, 0), len(words))
        marked[low : max(low, min(at + n, len(words)))] = [True] * (max(low, min(at + n, len(words))) - low)
    for word, flag in zip(words, marked, strict=True):
        if out and out[-1]["marked"] == flag:
            out[-1]["text"] += " " + word
        else:
            out.append({"text": word, "marked": flag})
    return out


def marked_sides(before: str | None, after: str | None, words: list[dict]) -> tuple[list[dict], list[dict]]:
    """Both spellings with what went and what came marked."""
    went = [(w["from_index"], len(w["from_words"])) for w in words if w["kind"] != "ADDED"]
    came = [(w["to_index"], len(w["to_words"])) for w in words if w["kind"] != "REMOVED"]
    return segments(before, went), segments(after, came)


WORDS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("from_index", T.IntegerType()),
            T.StructField("to_index", T.IntegerType()),
            T.StructField("from_words", T.ArrayType(T.StringType())),
            T.StructField("to_words", T.ArrayType(T.StringType())),
        ]
    )
)
TITLE = T.StructType([T.StructField("from_title", T.StringType()), T.StructField("to_title", T.StringType()), T.StructField("words", WORDS)])
CHANGE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("from_index", T.IntegerType()),
        T.StructField("to_index", T.IntegerType()),
        T.StructField("from_text", T.StringType()),
        T.StructField("to_text", T.StringType()),
        T.StructField("words", WORDS),
    ]
)
DIFF = T.StructType([T.StructField("title", TITLE), T.StructField("paragraphs", T.ArrayType(CHANGE)), T.StructField("rewrites", T.BooleanType())])


def side(title: Column, paragraphs: Column, compose: bool = True) -> Column:
    """A side of a diff, folded by Catalyst: the Arrow function that compares needs no rule of folding.

    Folded items of index lines come along, so that those rules need none either. A paragraph that is its own folded
    text has null for folded, words and items, which ``filled`` makes of the text. Text is composed first, as hashes
    do; ``compose`` false takes it as composed already.
    """
    from emendata.functions.text import nfc, nfc_all, suspect

    plain = lambda x: fold(x, compose=False)
    title, paragraphs = (nfc(title), nfc_all(paragraphs)) if compose else (title, paragraphs)
    split = lambda x: F.filter(F.split(F.regexp_replace(F.coalesce(x, F.lit("")), r"^[\s]+|[\s]+$", ""), r"\s+"), lambda w: w != "")
    words = lambda x: F.transform(split(x), plain)
    items = lambda x: F.filter(F.transform(F.split(x, INDEX_JOIN), plain), lambda i: i != "")
    made = lambda p: F.struct(p.alias("text"), plain(p).alias("folded"), words(p).alias("words"), items(p).alias("items"))
    own = lambda p: F.struct(p.alias("text"), F.lit(None).cast("string").alias("folded"), *[F.lit(None).cast("array<string>").alias(x) for x in ("words", "items")])
    block = lambda p: F.when(suspect(F.coalesce(p, F.lit(""))), made(p)).otherwise(own(p))
    none = F.array().cast("array<string>")
    return F.struct(
        title.alias("title"),
        plain(title).alias("folded_title"),
        words(title).alias("title_words"),
        F.transform(F.coalesce(paragraphs, none), block).alias("paragraphs"),
    )


def filled(one: dict) -> dict:
    """A side with what its paragraphs leave out."""
    for p in one["paragraphs"]:
        if p["folded"] is None:
            p["folded"] = text = p["text"] or ""
            p["words"], p["items"] = text.split(), [i for i in re.split(INDEX_JOIN, text) if i]
    return one


def _lists(column) -> list:
    """Lists of a list array, null where it is null: its values become Python objects all at once."""
    values = column.flatten()
    values = _structs(values) if str(values.type).startswith("struct") else values.to_pylist()
    out, at = [], 0
    for n in column.value_lengths().to_pylist():
        out.append(None if n is None else values[at : at + n])
        at += n or 0
    return out


def _structs(column) -> list:
    """Dicts of a struct array, null where it is null."""
    names = [f.name for f in column.type]
    fields = [_lists(c) if str(c.type).startswith("list") else c.to_pylist() for c in column.flatten()]
    rows = (dict(zip(names, x, strict=True)) for x in zip(*fields, strict=True))
    return [x if there else None for x, there in zip(rows, column.is_valid().to_pylist(), strict=True)]


#: Pairs that are Python objects at a time: what a worker holds besides its batch.
PAIRS_AT_ONCE = 64


def compared(before: Column, after: Column) -> Column:
    """DIFF of two sides, by one Arrow function per batch of pairs; null if a side is null."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(DIFF)

    @F.arrow_udf(DIFF)
    def run(olds, news):
        out = []
        for at in range(0, len(olds), PAIRS_AT_ONCE):
            rows = []
            for old, new in zip(_structs(olds.slice(at, PAIRS_AT_ONCE)), _structs(news.slice(at, PAIRS_AT_ONCE)), strict=True):
                if old is None or new is None:
                    rows.append(None)
                    continue
                old, new = filled(old), filled(new)
                known = {p["text"]: p["items"] for p in (*old["paragraphs"], *new["paragraphs"])}
                found = diff(old, new)
                rows.append(found | {"rewrites": rewrites_existing(found, known.__getitem__)})
            out.append(pa.array(rows, kind))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return run(before, after)


SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("marked", T.BooleanType())]))
SIDES = T.StructType([T.StructField("before", SEGMENTS), T.StructField("after", SEGMENTS)])


def word_markup(from_text: Column, to_text: Column, words: Column) -> Column:
    """Struct (before, after) of marked segments for the two spellings of a changed text."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(SIDES)

    @F.arrow_udf(SIDES)
    def run(olds, news, changes):
        rows = []
        for a, b, w in zip(olds, news, changes, strict=True):
            before, after = marked_sides(a.as_py(), b.as_py(), w.as_py() or [])
            rows.append({"before": before, "after": after})
        return pa.array(rows, kind)

    return run(from_text, to_text, words)


def is_empty(found: Column) -> Column:
    return found["title"].isNull() & (F.size(found["paragraphs"]) == 0)


def revision_diffs(pairs: DataFrame, title: str, paragraphs: str) -> DataFrame:
    """``pairs`` (from_ and to_ columns of adjacent revisions) with diff."""
    old, new = side(F.col(f"from_{title}"), F.col(f"from_{paragraphs}")), side(F.col(f"to_{title}"), F.col(f"to_{paragraphs}"))
    return pairs.withColumn("_a", old).withColumn("_b", new).withColumn("diff", compared(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def diffs_of_revisions(revisions: DataFrame, doc: str, title: str, paragraphs: str) -> DataFrame:
    """The diff of each revision with the one before it: every revision is folded once, and carried to the next.

    Revisions are dealt out before they are folded: a table of short rows may be read by one task.
    """
    folded = spread(revisions, doc, "version_number").withColumn("_side", side(F.col(title), F.col(paragraphs)))
    pairs = revision_pairs(folded, doc, [title, paragraphs, "_side"])
    return pairs.withColumn("diff", compared(F.col("from__side"), F.col("to__side"))).drop("from__side", "to__side")


def rewritten_listing(listing: DataFrame, diffs: DataFrame, doc: str, version: str) -> DataFrame:
    """``rewritten_only`` with hidden: how many rows of the listing are left out, the same in every row.

    The listing is limited before, so the sum over it is one over a few rows; with all rows hidden nothing is left.
    """
    flags = diffs.select(F.col(doc).alias("_d"), F.col("to_version").alias("_v"), F.col("diff.rewrites").alias("_w"))
    joined = listing.join(flags, (F.col(doc) == F.col("_d")) & (F.col(version) == F.col("_v")), "left")
    joined = joined.withColumn("_w", F.coalesce("_w", F.lit(True)))
    hidden = F.sum(F.when(F.col("_w"), 0).otherwise(1)).over(Window.partitionBy(F.lit(1)))
    return joined.withColumn("hidden", hidden.cast("long")).filter("_w").drop("_d", "_v", "_w")


def rewritten_only(listing: DataFrame, diffs: DataFrame, doc: str, version: str) -> DataFrame:
    """Rows of a limited listing whose newest change rewrites text that was there; without a predecessor a row stays."""
    flags = diffs.select(F.col(doc).alias("_d"), F.col("to_version").alias("_v"), F.col("diff.rewrites").alias("_w"))
    joined = listing.join(flags, (F.col(doc) == F.col("_d")) & (F.col(version) == F.col("_v")), "left")
    return joined.filter(F.coalesce("_w", F.lit(True))).drop("_d", "_v", "_w")


class Unavailable(Enum):
    UNKNOWN_DOCUMENT = "there is no such document"
    UNKNOWN_REVISION = "the document has no such revision"
    NO_REVISION_PAIR = "there is no pair of revisions to compare"


class DiffUnavailable(LookupError):
    def __init__(self, reason: Unavailable):
        super().__init__(reason.value)
        self.reason = reason


def diff_request(revisions: DataFrame, doc: str, key, title: str, paragraphs: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """One row: the diff between two revisions of a document, by default the newest and the one before it."""
    own = revisions.filter(F.col(doc) == F.lit(key)).select("version_number", title, paragraphs)
    newest = own.agg(F.max("version_number")).first()[0]
    if newest is None:
        raise DiffUnavailable(Unavailable.UNKNOWN_DOCUMENT)
    to = newest if last is None else last
    start = to - 1 if first is None else first
    if to < 1 or start < 1:
        raise DiffUnavailable(Unavailable.NO_REVISION_PAIR)
    for number in (to, start):
        if own.filter(F.col("version_number") == number).isEmpty():
            raise DiffUnavailable(Unavailable.UNKNOWN_REVISION)
    a = own.filter(F.col("version_number") == start).select(F.col("version_number").alias("from_version"), F.col(title).alias(f"from_{title}"), F.col(paragraphs).alias(f"from_{paragraphs}"))
    b = own.filter(F.col("version_number") == to).select(F.col("version_number").alias("to_version"), F.col(title).alias(f"to_{title}"), F.col(paragraphs).alias(f"to_{paragraphs}"))
    return revision_diffs(a.withColumn("_j", F.lit(1)).join(b.withColumn("_j", F.lit(1)), "_j").drop("_j"), title, paragraphs)

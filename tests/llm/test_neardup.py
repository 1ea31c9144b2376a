import random
import re

import numpy as np
import pyarrow as pa

from emendata.llm import neardup
from emendata.llm.neardup import bands_for, joining_links, near_duplicates, one_of_each
from emendata.llm.shingles import shingle_sets, word_numbers
from helpers import AWKWARD, corpus, frame, strange


def brute(texts, percent=85):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    low = list(range(len(texts)))
    for _ in low:
        moved = False
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(a & sets[j])
                if a and low[i] != low[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    low[i] = low[j] = min(low[i], low[j])
                    moved = True
        if not moved:
            break
    return sets, low


def check(spark, texts):
    sets, low = brute(texts)
    out = near_duplicates(frame(spark, texts)).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), low[r.doc_id], low[r.doc_id] == r.doc_id)


def test_real_and_awkward(spark):
    check(spark, [r["text"] for r in corpus(120)] + AWKWARD + ["A b c d e f", "a B c d e f", "one two", "ONE two", "É x", "é x"])


def test_chains_and_groups(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(10_000)}" for _ in range(200)]
    texts = []
    for step in range(30):  # a chain: each is like its neighbours, the ends are not alike
        base = base[3:] + [f"w{r.randrange(10_000)}" for _ in range(3)]
        texts.append(" ".join(base))
    group = [f"v{r.randrange(10_000)}" for _ in range(150)]
    for _ in range(40):  # a group around one text
        edited = list(group)
        edited[r.randrange(150)] = f"e{r.randrange(10_000)}"
        texts.append(" ".join(edited))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{r.randrange(10_000)}" for _ in range(40)) for _ in range(40)]
    r.shuffle(texts)
    check(spark, texts)


def test_null_ids_repeated_rows_and_columns(spark):
    docs = frame(spark, ["a b c d e f g", "a b c d e f g", None, None]).unionByName(frame(spark, ["a b c d e f g"]))
    docs = docs.selectExpr("nullif(doc_id, 3) AS doc_id", "text", "lang", "source", "n_chars", "1 AS node", "2 AS kept")
    out = near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in out if r.doc_id is not None) == [
        (False, 0, 0, True), (False, 0, 0, True), (False, 1, 0, False), (False, 2, 2, True)
    ]
    assert one_of_each(docs).columns == docs.columns and one_of_each(docs).count() == 3
    assert near_duplicates(docs.limit(0)).count() == 0


def test_threshold_of_the_stage(spark):
    r = random.Random(6)
    texts = []
    for changed in (9, 10, 11):  # of 96 shingles: similarities of 0.829, 0.811, 0.794
        base = [f"b{r.randrange(10**6)}" for _ in range(100)]
        texts += [" ".join(base), " ".join(base[:-changed] + [f"c{i}" for i in range(changed)])]
    docs = frame(spark, texts)
    assert sorted(x.doc_id for x in one_of_each(docs).collect()) == [0, 2, 4, 5]
    assert near_duplicates(docs, percent=85).filter("kept").count() == 6


def test_bands_follow_the_threshold():
    assert [bands_for(p) for p in (85, 80)] == [12, 17]


def unlike(r, n, words=120):
    """Texts around one text, each with a fifth to nothing of its words replaced: similarities of 0.2 to 1."""
    base = [f"g{i}" for i in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for at in r.sample(range(words), r.randrange(0, 8)):
            text[at] = f"n{r.randrange(40)}"
        out.append(" ".join(text) + (f" t{i}" if i % 3 else ""))
    return out


def brute_components(sets, percent):
    low = list(range(len(sets)))

    def top(i):
        while low[i] != i:
            low[i] = low[low[i]]
            i = low[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                low[y] = x
    return [top(i) for i in range(len(sets))]


def test_large_group_of_unlike_texts(spark):
    texts = unlike(random.Random(9), 2100)
    sets = []
    for t in texts:
        w = t.split()
        sets.append({hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)})
    want = brute_components(sets, 85)
    assert 50 < len(set(want)) < 2000
    found = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, texts), percent=85).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_blocks_of_a_star(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 20_000)  # about 20 sets
    texts = unlike(random.Random(10), 250)
    sets = [{hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    found = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, texts), percent=85).collect()}
    assert [found[i] for i in range(len(texts))] == brute_components(sets, 85)


def test_joining_links():
    r = random.Random(3)
    for trial in range(60):
        k, percent = r.randrange(2, 40), r.choice([50, 80, 85, 100])
        base = r.sample(range(10**6), 30)
        plain = [{x if r.random() < 0.93 else r.randrange(60) for x in base[: r.randrange(1, 31)]} for _ in range(k)]
        arrays = [np.array(sorted(s), np.uint64) for s in plain]
        got = joining_links(arrays, np.arange(k), np.zeros(k, int), percent)
        low = brute_components(plain, percent)
        assert all(low[a] == low[b] for a, b in got) and len(got) == k - len(set(low))
        side = np.array([r.randrange(2) for _ in range(k)])
        for a, b in joining_links(arrays, np.arange(k), side, percent):
            both = len(plain[a] & plain[b])
            assert (side[a] != side[b] or len(set(side.tolist())) == 1) and 100 * both >= percent * len(plain[a] | plain[b])


def test_shingles_are_those_of_the_words():
    texts = [*strange(), *[t or "" for t in AWKWARD], "x\x1cy\x85z \u2003a", "A\x0bB\x0cC\rD", ""]
    # A slice that begins inside its buffers, as the batches of a worker are.
    numbers, bounds = word_numbers(pa.array(["Šx " * 50, *texts, None]).slice(1))
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
        own = numbers[bounds[i] : bounds[i + 1]].tolist()
        assert len(own) == len(words) and len(set(own)) == len(set(words))
    assert bounds[-1] == bounds[-2]
    thue = [0]
    for _ in range(11):
        thue += [1 - x for x in thue]
    a, b = ("".join("ab"[x ^ flip] for x in thue) for flip in (0, 1))
    one, two = shingle_sets(pa.array([a, b]), 5)
    assert one.tolist() != two.tolist()

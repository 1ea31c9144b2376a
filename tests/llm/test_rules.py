import re
from collections import Counter

from emendata.llm.rules import judge
from helpers import AWKWARD, corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measures(spark):
    texts = [r["text"] for r in corpus()] + AWKWARD + ["a b c d e a b c d e f", "l\nl\nl \n\n", "one # two ** |<>&%$"]
    docs = frame(spark, texts).selectExpr("*", "'x' AS kept", "'y' AS N_Words")
    for r in judge(docs).collect():
        n, chars, symbols, dups, repeated = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeated)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (r.base_failed and r.kept)


def test_empty_table(spark):
    assert judge(frame(spark, ["a"]).limit(0)).count() == 0

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emendata.operators import diff as D


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_gaps_are_a_shortest_edit(a, b):
    gaps = D.myers(a, b)
    out, at = [], 0
    for i, i2, j, j2 in gaps:
        out += a[at:i] + b[j:j2]
        at = i2
    assert out + a[at:] == b
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert sum(i2 - i + j2 - j for i, i2, j, j2 in gaps) == len(a) + len(b) - 2 * table[-1][-1]


BASE = ["The council met on Monday to talk about the new bridge.", "Costs have risen to four million since the spring.", "A vote is planned for the end of the month.", "Critics say that the plan comes far too late."]


def compared(spark, old, new, titles=("Head", "Head")):
    df = spark.createDataFrame([(titles[0], old, titles[1], new)], "t string, p array<string>, t2 string, p2 array<string>")
    return df.select(D.compared(D.side(F.col("t"), F.col("p")), D.side(F.col("t2"), F.col("p2"))).alias("d")).first().d


def kinds(found):
    return [(c.kind, c.from_index, c.to_index) for c in found.paragraphs]


def test_paragraph_changes(spark):
    edited = [*BASE[:1], "Costs have risen to five million since the spring.", *BASE[2:]]
    found = compared(spark, BASE, edited)
    assert kinds(found) == [("CHANGED", 1, 1)] and found.title is None and found.rewrites
    assert [(w.kind, w.from_index, w.from_words, w.to_words) for w in found.paragraphs[0].words] == [("CHANGED", 4, ["four"], ["five"])]
    assert kinds(compared(spark, BASE, [*BASE, "And a new paragraph."])) == [("ADDED", None, 4)]
    assert not compared(spark, BASE, [*BASE, "And a new paragraph."]).rewrites
    assert kinds(compared(spark, BASE, BASE[:1] + BASE[2:])) == [("REMOVED", 1, None)]
    moved = compared(spark, BASE, BASE[1:] + BASE[:1])
    assert kinds(moved) == [("MOVED", 0, 3)] and moved.paragraphs[0].to_text == BASE[0]
    assert kinds(compared(spark, BASE, [*BASE[:3], "Something else entirely, with no word in common."])) == [("REMOVED", 3, None), ("ADDED", None, 3)]
    same = compared(spark, BASE, [BASE[0].replace(" ", "  "), "", *BASE[1:]])
    assert kinds(same) == [] and not same.rewrites
    assert kinds(compared(spark, ["", *BASE], [*BASE, "x"]))[0] == ("ADDED", None, 4)


def test_title_changes(spark):
    found = compared(spark, BASE, BASE, ("Old head here", "New head here"))
    assert (found.title.from_title, found.title.to_title, len(found.title.words), found.rewrites) == ("Old head here", "New head here", 1, True)
    assert compared(spark, BASE, BASE, ("A  b", "A b")).title is None
    assert compared(spark, BASE, BASE, (None, "A")).title.from_title == ""
    assert compared(spark, None, None, (None, None)).paragraphs == []


def test_index_lines(spark):
    old = "Fire in the harbour ++ Vote in the council ++ Rain until Friday"
    new = "Strike at the airport ++ Fire in the harbour ++ Vote in the council"
    assert not compared(spark, [old, *BASE], [new, *BASE]).rewrites
    corrected = "Fire in the old harbour ++ Vote in the council ++ Rain until Friday"
    assert compared(spark, [old, *BASE], [corrected, *BASE]).rewrites
    assert not D.is_index_rewrite(["a"], ["b"]) and not D.is_index_rewrite(["a", "b"], ["a", "b"]) and not D.is_index_rewrite(["a", "b"], ["c", "d"])
    assert D.is_index_rewrite(["a", "a", "b"], ["a", "c"])
    assert D.overlap("a b c", "a b d") == pytest.approx(2 / 3) and D.overlap("", "") == 0


def test_markup(spark):
    found = compared(spark, BASE, [*BASE[:1], "Costs may have risen to five million in the spring.", *BASE[2:]]).paragraphs[0]
    words = [w.asDict() for w in found.words]
    before, after = D.marked_sides(found.from_text, found.to_text, words)
    assert " ".join(s["text"] for s in before) == found.from_text and " ".join(s["text"] for s in after) == found.to_text
    assert [s["text"] for s in after if s["marked"]] == ["may", "five", "in"]
    assert D.segments("a b", [(1, 9), (-3, 1)]) == [{"text": "a", "marked": False}, {"text": "b", "marked": True}] and D.segments(None, []) == []


def test_requests(spark):
    rows = [(1, 1, "t", ["a b c"]), (1, 2, "t", ["a b d"]), (2, 1, "t", ["x"])]
    df = spark.createDataFrame(rows, "doc long, version_number long, title string, paragraphs array<string>")
    ask = lambda *a, **k: D.diff_request(df, "doc", *a, "title", "paragraphs", **k)
    one = ask(1).first()
    assert (one.from_version, one.to_version, one.diff.paragraphs[0].kind) == (1, 2, "CHANGED")
    assert ask(1, first=2, last=2).first().diff.paragraphs == []
    for args, reason in (((9,), "UNKNOWN_DOCUMENT"), ((2,), "NO_REVISION_PAIR")):
        with pytest.raises(D.DiffUnavailable) as e:
            ask(*args)
        assert e.value.reason.name == reason
    with pytest.raises(D.DiffUnavailable) as e:
        ask(1, first=1, last=7)
    assert e.value.reason.name == "UNKNOWN_REVISION"


def test_deterministic(spark):
    r = random.Random(2)
    old = [" ".join(r.choice("abcdefg") for _ in range(r.randrange(1, 9))) for _ in range(30)]
    new = old[:]
    r.shuffle(new)
    assert compared(spark, old, new[:25]) == compared(spark, old, new[:25])


def test_edit_scripts_are_shortest_and_leave_equal_stretches():
    r = random.Random(11)
    for _ in range(300):
        a = [r.choice("abcdx") for _ in range(r.randrange(0, 14))]
        b = [r.choice("abcdy") for _ in range(r.randrange(0, 14))]
        gaps, i, j, kept = D.myers(a, b), 0, 0, 0
        for g, g2, h, h2 in [*gaps, (len(a), len(a), len(b), len(b))]:
            assert g - i == h - j >= 0 and a[i:g] == b[j:h]
            kept, i, j = kept + g - i, g2, h2
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for p, q in enumerate(a):
            for s, t in enumerate(b):
                table[p + 1][s + 1] = table[p][s] + 1 if q == t else max(table[p][s + 1], table[p + 1][s])
        assert kept == table[-1][-1]


def test_texts_without_a_common_word_cost_nothing():
    a, b = [f"a{i}" for i in range(20_000)], [f"b{i}" for i in range(20_000)]
    assert D.myers(a, b) == [(0, 20_000, 0, 20_000)]


def test_spelling_by_composition_is_no_change(spark):
    rows = spark.createDataFrame([(1, 1, "t", ["caf\u00e9 one"]), (1, 2, "t", ["cafe\u0301 one"]), (1, 3, "t", ["tea one"])], "doc int, version_number int, title string, paragraphs array<string>")
    found = {r.to_version: r.diff for r in D.diffs_of_revisions(rows, "doc", "title", "paragraphs").collect()}
    assert found[2].paragraphs == [] and len(found[3].paragraphs) == 1


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_revisions_are_dealt_out_before_they_are_folded(spark):
    rows = spark.createDataFrame([(1, 1, "t", ["a b"]), (1, 2, "t", ["a c"])], "doc int, version_number int, title string, paragraphs array<string>")
    plan = planned(D.diffs_of_revisions(rows.coalesce(1), "doc", "title", "paragraphs"))
    assert "REPARTITION_BY_NUM" in plan and plan.index("Window") < plan.index("ArrowEvalPython", plan.index("Window")) < plan.index("REPARTITION_BY_NUM")


def test_paragraphs_that_are_their_own_folded_text(spark):
    texts = ["one two + three", "", None, "a  b", "x = y1", "vor 3 Tagen", "café abcdef", "abcdefab", "+ a + b + + c", "it`s", "1 2 abc-def-ghi-jkl"]
    df = spark.createDataFrame([("t", texts)], "t string, p array<string>")
    side = df.select(D.side(F.col("t"), F.col("p")).alias("s")).first().s.asDict(recursive=True)
    assert [p["folded"] is None for p in side["paragraphs"]] == [True, True, True, False, False, False, True, False, True, False, False]
    from emendata.functions import text as T

    plain = lambda x: T._folded(F.coalesce(x, F.lit("")))
    words = F.transform("p", lambda p: F.transform(F.filter(F.split(F.trim(F.coalesce(p, F.lit(""))), r"\s+"), lambda w: w != ""), plain))
    items = F.transform("p", lambda p: F.filter(F.transform(F.split(F.coalesce(p, F.lit("")), D.INDEX_JOIN), plain), lambda i: i != ""))
    want = df.select(F.transform("p", plain).alias("f"), words.alias("w"), items.alias("i")).first()
    got = D.filled(side)["paragraphs"]
    assert [p["folded"] for p in got] == want.f and [p["words"] for p in got] == want.w and [p["items"] for p in got] == want.i


def test_batches_longer_than_a_slice(spark):
    n = 2 * D.PAIRS_AT_ONCE + 3
    rows = [(i, v, "t", None if i % 9 == 0 else [f"start {i}"] + ["more"] * (v == 2)) for i in range(n) for v in (1, 2)]
    df = spark.createDataFrame(rows, "doc int, version_number int, title string, paragraphs array<string>").coalesce(1)
    found = D.diffs_of_revisions(df, "doc", "title", "paragraphs").collect()
    assert {r.doc: [c.to_text for c in r["diff"].paragraphs] for r in found} == {i: [] if i % 9 == 0 else ["more"] for i in range(n)}

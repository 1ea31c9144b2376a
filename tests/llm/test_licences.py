from pathlib import Path

import pytest

from emendata.llm import licences
from emendata.llm.licences import BSD_2, BSD_END, CATALOGUE, MIT, catalogue, scan
from helpers import AWKWARD, frame

FOLDER = Path("/usr/share/common-licenses")


def test_equivalent_forms(spark):
    texts = [
        MIT,
        "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + MIT.upper().replace(",", " ;"),
        "© 1999 A B\n" + MIT.replace("\n", " "),
        BSD_2 + BSD_END.replace("copyright holder", "copyright owner"),
        MIT + "\nOne more word",
        "Some words.\nLICENCED under the Apache License, version 2.0\nReleased under the MIT License.\nmore",
        "Released under the MIT Licence",
        *AWKWARD,
    ]
    docs = frame(spark, texts).selectExpr("*", "1 AS digest", "2 AS _known")
    out = {r.doc_id: (r.license_id, list(r.notice_ids)) for r in scan(docs).collect()}
    assert out[0][0] == out[1][0] == out[2][0] == "MIT" and out[3][0] == "BSD-2-Clause"
    assert out[4] == (None, []) and out[5] == (None, ["Apache-2.0", "MIT"]) and out[6] == ("MIT", ["MIT"])
    assert len(out) == len(texts) and all(out[i] == (None, []) for i in range(7, len(texts)))


def test_repeated_null_and_empty(spark):
    notice = CATALOGUE[-1][1]
    docs = frame(spark, [notice, "x"]).unionByName(frame(spark, [notice])).selectExpr("CAST(NULL AS long) AS doc_id", "text")
    out = sorted((list(r.notice_ids), r.license_id) for r in scan(docs).collect() if r.notice_ids) + [r for r in scan(docs).collect() if not r.notice_ids]
    assert out[:2] == [(["CC0-1.0"], "CC0-1.0")] * 2 and len(out) == 3 and out[2].license_id is None
    assert scan(docs.limit(0)).count() == 0


def test_catalogue_as_a_table(spark, monkeypatch):
    known = catalogue(spark, (("B-1", "Same words"), ("A-1", "same, WORDS!"), ("C-1", "non-commercial use"), ("D-1", "...")), ())
    assert {(r.license_id, r.form) for r in known.collect()} == {("A-1", "same  words"), ("C-1", "noncommercial  use")}
    texts = ["Same\nwords", "first\nsame words\nnon commercial use", "non\ncommercial use", "noncommercial\nuse"]
    out = {r.doc_id: (r.license_id, list(r.notice_ids)) for r in scan(frame(spark, texts), known).collect()}
    assert out == {0: ("A-1", []), 1: (None, ["A-1", "C-1"]), 2: ("C-1", []), 3: ("C-1", [])}
    monkeypatch.setattr(licences, "MOST_LICENCES", 1)
    with pytest.raises(ValueError):
        scan(frame(spark, texts), known)


@pytest.mark.skipif(not FOLDER.is_dir(), reason="the texts are not on this machine")
def test_long_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2-only": "GFDL-1.2", "GFDL-1.3-only": "GFDL-1.3", "GPL-1.0-only": "GPL-1", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "LGPL-2.0-only": "LGPL-2", "LGPL-2.1-only": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    names, texts = [], []
    for name, file in files.items():
        text = (FOLDER / file).read_text()
        short = text.partition(licences.TERMS_END)
        for form in [text, *([short[0] + short[1]] if short[2].strip() else [])]:
            names.append(name)
            texts.append("Copyright (C) 2001 Someone Else\n" + " ".join(form.split("  ")).replace(" license ", " licence "))
    out = {r.doc_id: r.license_id for r in scan(frame(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == names

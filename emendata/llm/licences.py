"""License scans: canonical digests of whole texts looked up among digests of known licences.

A text is put in canonical form - case, punctuation, copyright lines and equivalent spellings do not count - and the
digest of that form is hash-joined to the digests of the catalogue, a table. Every document is looked up as a whole,
and so is every line of it, each as a text of its own, for the short notices that stand in front of other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emendata.llm.common import let

#: The catalogue is broadcast; it may hold so many texts.
MOST_LICENCES = 10_000

# Spellings that licence comparison takes as equal, left side replaced by the right.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("owner", "holder"),
    ("owners", "holders"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# Equivalent spellings of two words.
SPLIT_SPELLINGS = (("non", "commercial", "noncommercial"), ("per", "cent", "percent"), ("sub", "license", "sublicense"))

COPYRIGHT_LINE = (
    r"(?m)^[ \t>*#/;-]*(?:(?:copyright[ \t]*)?(?:\(c\)|©)|copyright[ \t]+(?:[0-9<\[{]|by[ \t]))[^\n]*$"
    r"|^[ \t>*#/;-]*all rights reserved[.]?[ \t]*$"
)

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""

ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""

BSD_3RD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""

BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution."""

#: (identifier, text): full texts and the notices that stand for a licence.
CATALOGUE = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_END),
    ("0BSD", ISC_GRANT + ".\n\n" + ISC_END),
    ("BSD-2-Clause", BSD_2 + BSD_END),
    ("BSD-3-Clause", BSD_2 + BSD_3RD + BSD_END),
    ("Zlib", ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


# SHA-256 of the canonical forms of long texts, which are too long to stand here. Sources are the texts
# that Debian ships in /usr/share/common-licenses, whole and, where there is an appendix on how to apply the licence,
# also up to "END OF TERMS AND CONDITIONS".
LONG_TEXTS = (
    ("Apache-2.0", "896f9993984750bb9fb12b172c4ed8f37698342a78f3344c7df4848ce2a0d75c"),
    ("Apache-2.0", "e97973b7a4bdae4f3b94e6bc09a524b24f0605f2e4cd36879d21d383f34af88d"),
    ("Artistic-1.0-Perl", "68b9dd49ed1b1348e977ccc2468570a603d8075ede45354e352319821ca5469a"),
    ("CC0-1.0", "bd8c9d5398111ad21b365723f851cd7e4b311729745344d8639b16e236284c77"),
    ("GFDL-1.2-only", "e91eb5f9d5d9856213578f733f5ae52f5692c9fc3cc1b05d048aff37a05aaeea"),
    ("GFDL-1.3-only", "5e719d42b044f5a2be4336c9e91d4860266cc46522216361f4c9ccbb621b3657"),
    ("GPL-1.0-only", "869d156f07824e4287a2959e638586941efcb3774b5e407be30ff180ac13548b"),
    ("GPL-1.0-only", "4df52f82f55fe33275276afc0459cf01ebfd5161d3b0d9b7db6c601db846a26f"),
    ("GPL-2.0-only", "64a86f1d3531a8b5c1d2f564c01882c63b58c93fbfb517279bfaa9a261cb1796"),
    ("GPL-2.0-only", "b6d9bbc37df0f1f9eeaf989865222e8e8149d2661426763e656d1b7b18a8d9da"),
    ("GPL-3.0-only", "fbf4c7854913caaf09c170805455959454d9447e36e4d6495f74d232da3fc175"),
    ("GPL-3.0-only", "0146dac78c87756d210fd3b26508bf1a3c85bb775a7a1fd6d471f4201103d236"),
    ("LGPL-2.0-only", "4921f4e1e5e73369d202e5c7683c965b4d275ba35f23c50d389e92705d9cc84e"),
    ("LGPL-2.0-only", "03ca45506c971dd01b208250c6e0bc95609f638cdcd2c2d4754eefb600c4fead"),
    ("LGPL-2.1-only", "a65b75d251fb56c535ec7079440f5d167ec95725dd20f1d16677176defe487a3"),
    ("LGPL-2.1-only", "339c532790f41cf12c6ece26e4795bfd4801040813ec5ea72943336590b67788"),
    ("LGPL-3.0-only", "572947626844a56d29ace510237040204d4085696621f319533ca366aa897913"),
    ("MPL-1.1", "eb8279736f175d8e43c9688a02b2c0d9c9d5abfdc2b997dbcb3e197a1565ff33"),
    ("MPL-2.0", "1f9b7661552309dc69cee928f7d32ed3280cbc918bfeced108b8b7d3f68f5452"),
)

TERMS_END = "END OF TERMS AND CONDITIONS"

#: Whether any spelling is there to be replaced; one look spares most texts all the replacements.
ANY_SPELLING = " (?:" + "|".join([a for a, _ in SPELLINGS] + ["non  commercial", "per  cent", "sub  licen[cs]e"]) + ") "


def respelled(x: Column) -> Column:
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {a} "), F.lit(f" {b} "))
    return joined_spellings(x)


def joined_spellings(x: Column) -> Column:
    for a, b, c in SPLIT_SPELLINGS:
        x = F.replace(x, F.lit(f" {a}  {b} "), F.lit(f" {c} "))
    return x


def lines_in_form(text: Column) -> Column:
    """The text without what does not count, lines apart: words between two spaces each, new lines among them."""
    x = F.lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, COPYRIGHT_LINE, " ")
    x = F.replace(x, F.lit("https://"), F.lit("http://"))
    # Two spaces between words, so that each word has its own on either side.
    x = F.regexp_replace(x, r"[^\p{L}\p{N}\n]+", "  ")
    x = F.concat(F.lit("  "), F.replace(x, F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    return let(x, lambda v: F.when(v.rlike(ANY_SPELLING.replace("  ", "[ \\n]+")), respelled(v)).otherwise(v))


def joined_lines(x: Column) -> Column:
    """The canonical form of the whole text: new lines stand between words as any other space."""
    whole = F.regexp_replace(x, " *\n[ \n]*", "  ")
    return F.trim(let(whole, lambda v: F.when(v.rlike("non  commercial|per  cent|sub  license"), joined_spellings(v)).otherwise(v)))


def canonical(text: Column) -> Column:
    """The text without what does not count: lower case, words one after the other, spellings made equal."""
    return joined_lines(lines_in_form(text))


def digest_of(form: Column) -> Column:
    """SHA-256 of a canonical form as lowercase hex; null where no word is left."""
    return let(form, lambda x: F.when(x != "", F.sha2(x, 256)))


def digest(text: Column) -> Column:
    return digest_of(canonical(text))


def catalogue(spark: SparkSession, texts: tuple[tuple[str, str], ...] = CATALOGUE, digests: tuple[tuple[str, str], ...] = LONG_TEXTS) -> DataFrame:
    """license_id, digest, form (null for those known by their digest only), one row per digest.

    Of licences with one canonical form the first by identifier counts; texts without words are left out.
    """
    known = spark.createDataFrame(list(texts), "license_id string, text string") if texts else spark.createDataFrame([], "license_id string, text string")
    forms = known.select("license_id", canonical(F.col("text")).alias("form")).select("license_id", digest_of(F.col("form")).alias("digest"), "form")
    long_ = spark.createDataFrame(list(digests), "license_id string, digest string") if digests else spark.createDataFrame([], "license_id string, digest string")
    every = forms.unionByName(long_.withColumn("form", F.lit(None).cast("string"))).filter("digest IS NOT NULL")
    return every.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.max("form").alias("form"))


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, license_id (of the whole text, else null), notice_ids (array).

    ``known`` is a catalogue as ``catalogue`` makes it, of MOST_LICENCES rows at most, by default the one of this
    module. notice_ids are the licences that single lines of the row's text amount to, sorted, empty if none. Null,
    empty and wordless texts have a null digest and match nothing. Rows that repeat, or share an id, are judged each by
    its own text; columns other than the two named are not read.

    Each text is put in form once. Nothing is shuffled: the whole text meets the catalogue in a broadcast hash join,
    its lines meet the forms of the catalogue's texts in the row, after a look at their length.
    """
    spark = docs.sparkSession
    known = catalogue(spark) if known is None else known
    listed = known.limit(MOST_LICENCES + 1).collect()
    if len(listed) > MOST_LICENCES:
        raise ValueError(f"more than {MOST_LICENCES} licences")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), lines_in_form(F.col(f"`{text}`")).alias("_form"))
    rows = rows.select("doc_id", digest_of(joined_lines(F.col("_form"))).alias("digest"), notices(F.col("_form"), listed).alias("notice_ids"))
    side = F.broadcast(known.select(F.col("digest").alias("_known"), "license_id"))
    return rows.join(side, F.col("digest") == F.col("_known"), "left").select("doc_id", "digest", "license_id", "notice_ids")


def notices(form: Column, listed: list) -> Column:
    """Identifiers of the listed texts that single lines amount to, sorted."""
    forms = sorted((r.form, r.license_id) for r in listed if r.form is not None)
    none = F.array().cast("array<string>")
    if not forms:
        return none
    lengths = F.array(*[F.lit(n) for n in sorted({len(f) for f, _ in forms})])
    ids = F.create_map(*[F.lit(x) for pair in forms for x in pair])
    lines = F.transform(F.split(form, "\n", -1), lambda x: F.trim(x))
    hits = F.transform(F.filter(lines, lambda x: F.array_contains(lengths, F.length(x))), lambda x: F.element_at(ids, x))
    return F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())))

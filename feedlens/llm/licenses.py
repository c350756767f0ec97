"""License scans: canonical texts hashed and joined to the digests of known licences; built-in functions only."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.common import WHITE, ascii_lower, whole

#: Spellings taken as one (all lower case, after punctuation became spaces).
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("noncommercial", "non commercial"), ("organisation", "organization"),
    ("owner", "holder"), ("owners", "holders"), ("per cent", "percent"), ("programme", "program"), ("redistribution s", "redistributions"), ("whilst", "while"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Full texts as files of this folder, each named by its identifier; those above are kept with their paragraphs unwrapped.
TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: Identifier, then titles. A notice is a title, or a title after one of LEADS, or the SPDX tag.
TITLES = (
    ("MIT", "MIT License", "The MIT License (MIT)"), ("ISC", "ISC License"), ("Zlib", "zlib License", "zlib/libpng License"),
    ("0BSD", "BSD Zero Clause License", "Zero-Clause BSD License"), ("BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0"), ("Unlicense", "The Unlicense"),
    ("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"),
    ("BSD-2-Clause", "2-Clause BSD License", "BSD 2-Clause License", "Simplified BSD License"), ("BSD-3-Clause", "3-Clause BSD License", "BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    ("MPL-1.1", "Mozilla Public License 1.1", "Mozilla Public License, version 1.1"), ("MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"),
    ("EPL-1.0", "Eclipse Public License 1.0", "Eclipse Public License, version 1.0"), ("EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    ("Artistic-2.0", "Artistic License 2.0", "Artistic License, version 2.0"), ("OFL-1.1", "SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"),
    *((f"{x}GPL-{v}", f"{x}GPL-{v}", f"{x}GPLv{v.removesuffix('.0')}", *(f"GNU {name} {before}{w}" for w in dict.fromkeys((v, v.removesuffix(".0"))) for before in ("", "v", "version ")))
      for x, name, versions in (("", "General Public License", ("1.0", "2.0", "3.0")), ("L", "Lesser General Public License", ("2.1", "3.0")), ("L", "Library General Public License", ("2.0",)), ("A", "Affero General Public License", ("3.0",)))
      for v in versions),
    *((f"GFDL-{v}", f"GNU Free Documentation License {v}", f"GNU Free Documentation License, Version {v}") for v in ("1.1", "1.2", "1.3")),
    *((f"CC-{x}-{v}", f"CC {x} {v}", f"Creative Commons {name} {v} {port}", f"Creative Commons {name} {v} {port} License", f"Creative Commons {name} {v} License", f"Creative Commons {name} {v}")
      for x, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
      for v, port in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))),
    ("CC0-1.0", "CC0 1.0 Universal", "CC0 1.0", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"),
)
LEADS = tuple(
    f"{x} {y} ".lstrip()
    for x in ("", "This work is", "This software is", "This project is", "This program is")
    for y in ("licensed under", "released under", "distributed under", "available under", "licensed under the terms of")
) + ("This work is marked with ",)


def _terms(text: str) -> str:
    """The terms between their heading and their end, without preamble and appendix."""
    end = text.index("END OF TERMS AND CONDITIONS")
    return text[text.rindex("TERMS AND CONDITIONS", 0, end) : end]


def _part(name: str, start: str, end: str) -> str:
    """The part of a full text, from start through end: the notice that files are to carry."""
    text = TEXTS[name]
    at = text.rindex(start)
    return text[at : text.index(end, at) + len(end)]


def _known() -> Iterator[tuple[str, str]]:
    bsd3 = TEXTS["BSD-3-Clause"]
    for old, new in (("the University", "the copyright holder"), ("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND"), ("THE REGENTS OR", "THE COPYRIGHT HOLDER OR")):
        bsd3 = bsd3.replace(old, new)
    names = {t[0]: t[1:] for t in TITLES}
    for name, text in (("MIT", _MIT), ("ISC", _ISC), ("Zlib", _ZLIB), ("BSD-3-Clause", bsd3), *TEXTS.items()):
        for body in dict.fromkeys((text, text.replace("http:", "https:"), text.replace("https:", "http:"))):
            rest = body.partition("\n\n")[2].strip()
            bodies = (body, rest) if len(rest) > 0.9 * len(body) else (body,)
            yield from ((name, b) for b in bodies)
            if len(body) < 5000:
                yield from ((name, f"{the}{title}\n\n{b}") for title in names.get(name, ()) for the in ("", "The ") for b in bodies)
            elif "END OF TERMS AND CONDITIONS" in body:
                yield name, _terms(body)
                yield name, body[: body.index("END OF TERMS AND CONDITIONS") + 27]
                yield name, body[: body.index("END OF TERMS AND CONDITIONS")]
    yield "Apache-2.0", _part("Apache-2.0", "Licensed under the Apache License", "limitations under the License.")
    yield "MPL-2.0", _part("MPL-2.0", "This Source Code Form is subject", "MPL/2.0/.")
    yield "MPL-2.0", _part("MPL-2.0", "This Source Code Form is subject", "MPL/2.0/.").replace("http:", "https:")
    lesser = _part("LGPL-2.1", "This library is free software", "for more details.")
    general = _part("GPL-3.0", "This program is free software", "for more details.")
    yield from (("LGPL-2.1", lesser), ("LGPL-3.0", lesser.replace("version 2.1", "version 3")), ("LGPL-3.0", general.replace("General Public License", "Lesser General Public License")))
    yield from (("GPL-3.0", general), ("AGPL-3.0", general.replace("General Public License", "Affero General Public License")))
    yield from (("GPL-2.0", _part("GPL-2.0", "This program is free software", "for more details.")), ("LGPL-2.0", _part("LGPL-2.0", "This library is free software", "for more details.")))
    for name, *titles in TITLES:
        tags = [name] + [name + x for x in ("-only", "-or-later", "+") if "GPL" in name or "GFDL" in name]
        yield from ((name, f"SPDX-License-Identifier: {t}") for t in tags)
        yield from ((name, t) for t in titles)
        yield from ((name, lead + the + t) for lead in LEADS for t in titles for the in (("a ", "the ") if t.startswith("Creative") else ("",) if t.startswith("CC") else ("", "the ")))


#: Known licences by identifier, whole texts and the notices that stand for them.
KNOWN = tuple(dict.fromkeys(_known()))
#: A line that is a copyright notice: a sign, a placeholder or a year tells it from licence text that is wrapped before
#: the word "copyright" or begins with the item "(c)".
COPYRIGHT_LINE = (
    "(?<![^\\n])[^\\n\\p{Alnum}©]*(?:(?:portions )?(?:spdx-filecopyrighttext:|copyright(?![a-z]|[^\\n\\p{Alnum}]+(?:notices?|holders?|owners?|treaty|law|license)\\b)"
    "(?:[\\x20\\t:]*(?:\\(c\\)|©|[0-9\\[<{])|[\\x20\\t]+by[\\x20\\t]|[^\\n]*\\b(?:19|20)[0-9]{2}\\b))|\\(c\\)[^\\n]*\\b(?:19|20)[0-9]{2}\\b|©|all rights reserved[^\\n\\p{Alnum}]*(?=\\n|$))[^\\n]*"
)


def canonical(text: Column) -> Column:
    """Lower case A-Z, no copyright lines, runs of punctuation and white space as one space, one spelling of each word."""
    low = ascii_lower(text)
    marked = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©")) | F.contains(low, F.lit("all rights reserved"))
    out = F.concat(F.lit(" "), F.regexp_replace(F.when(marked, F.regexp_replace(low, COPYRIGHT_LINE, "")).otherwise(low), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "), F.lit(" "))
    spelled = out
    for x, y in SPELLINGS * 2:  # twice, because neighbours share a blank
        spelled = F.replace(spelled, F.lit(f" {x} "), F.lit(f" {y} "))
    other = " (?:" + "|".join(x for x, _ in SPELLINGS) + ") "
    return F.btrim(F.when(out.rlike(other), spelled).otherwise(out))


def digest(text: Column) -> Column:
    """Never null, so that a join doesn't evaluate it once more for a null check."""
    return F.coalesce(F.sha2(canonical(text), 256), F.lit(""))


#: A known text of more characters is also looked for within documents. Each holds one of the cues, as any document with it.
LONG = 120
CUES = ("license", "licence", "permission", "permitted", "redistribution")


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(license, digest) of the known texts; as many rows as the table has, so it may be broadcast."""
    return spark.createDataFrame(list(texts), "license string, text string").select("license", digest(F.col("text")).alias("digest")).distinct()


def known_long(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """license, digest, words (how many), anchor and place of the long known texts, but for those that hold another of the same
    licence (one with a title, say): where they stand the other does. A text's anchor is the word that the fewest of these texts
    hold, of those the longest; place is where it first stands among the text's words."""
    long = [(name, text) for name, text in texts if len(text) > LONG]
    long = [(name, text) for name, text in long if not any(n == name and t != text and t in text for n, t in long)]
    if lost := [text for _, text in long if not any(cue in text.lower() for cue in CUES)]:
        raise ValueError(f"no cue is in the known text {lost[0][:60]!r}")
    form = spark.createDataFrame(long, "license string, text string").select("license", canonical(F.col("text")).alias("text")).distinct().collect()
    words = [r.text.split(" ") for r in form]
    held = Counter(w for ws in words for w in set(ws))
    rows = []
    for r, ws in zip(form, words, strict=True):
        anchor = min(ws, key=lambda w: (held[w], -len(w), w))
        rows.append((r.license, hashlib.sha256(r.text.encode()).hexdigest(), len(ws), anchor, ws.index(anchor), ws[0], ws[-1]))
    return spark.createDataFrame(rows, "license string, digest string, words int, anchor string, place int, first string, last string")


def _within(rows: DataFrame, texts: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, tid and license of each long known text that stands in a document, whatever its wrapping and surroundings.

    Where one of the anchors stands in a document, the window of words that its text would take is hashed, if its first and
    last word are the text's; the digests of such windows meet the known ones in a join.
    """
    low = ascii_lower(F.col("text"))
    cued = F.contains(low, F.lit(CUES[0]))
    for cue in CUES[1:]:
        cued = cued | F.contains(low, F.lit(cue))
    table = known_long(rows.sparkSession, texts)
    known_rows = table.collect()  # the fixed table
    of: dict[str, list] = {}
    for r in known_rows:
        of.setdefault(r.anchor, []).append(F.struct(F.lit(r.place).alias("place"), F.lit(r.words).alias("words"), F.lit(r.first).alias("first"), F.lit(r.last).alias("last")))
    anchors = F.create_map(*[x for word, entries in of.items() for x in (F.lit(word), F.array(*entries))])
    listed = F.array(*[F.lit(w) for w in of])

    def windows(words: Column) -> Column:
        def at(i: Column) -> Column:
            inside = lambda e: (i > e["place"]) & (i - e["place"] + e["words"] - 1 <= F.size(words))
            ends = lambda e: (F.get(words, i - e["place"] - 1) == e["first"]) & (F.get(words, i - e["place"] + e["words"] - 2) == e["last"])
            good = F.filter(F.element_at(anchors, F.get(words, i - 1)), lambda e: inside(e) & ends(e))
            return F.transform(good, lambda e: F.sha2(F.array_join(F.slice(words, i - e["place"], e["words"]), " ").cast("binary"), 256))

        places = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_contains(listed, F.get(words, i - 1)))
        return F.array_distinct(F.flatten(F.transform(places, at)))

    # The generator keeps the optimizer from evaluating the canonical form for each use of the words.
    held = rows.where(cued).select("doc_id", "tid", F.explode_outer(F.array(F.split(canonical(F.col("text")), " "))).alias("w")).where(F.arrays_overlap("w", listed))
    found = held.select("doc_id", "tid", F.explode(windows(F.col("w"))).alias("digest"))
    return found.join(F.broadcast(table.select("license", "digest")), "digest").select("doc_id", "tid", "license")


def licenses(docs: DataFrame, texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """doc_id, whole_license (of the entire text), n_notices (lines that are known texts) and licenses (all, sorted).

    The entire text, each paragraph (parted by blank lines) and each line are looked up by digest; the known texts of
    more than LONG characters also wherever they stand in a document. Null text counts as empty and is no licence. Rows
    of equal doc_id and text, a null doc_id included, get the same result; a text known under several identifiers is found under
    the first by name as the whole and under all in the list; a very long text is one row, of which every window of words is looked
    at; an empty table gives no rows; extra columns are left out.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), whole(F.col("text")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("tid"))
    table = F.broadcast(known(docs.sparkSession, texts))
    unit = F.explode_outer(
        F.concat(
            F.array(F.struct(F.lit("whole").alias("unit"), F.col("text").alias("part"))),
            F.transform(F.filter(F.split("text", "\\n[ \\t\\r]*\\n"), lambda x: F.contains(x, F.lit("\n"))), lambda x: F.struct(F.lit("paragraph").alias("unit"), x.alias("part"))),
            F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("line").alias("unit"), x.alias("part"))),
        )
    )
    parts = rows.select("doc_id", "tid", unit.alias("u")).where(F.btrim("u.part", F.lit(WHITE)) != "").select("doc_id", "tid", "u.unit", digest(F.col("u.part")).alias("digest"))
    every = parts.join(table, "digest").select("doc_id", "tid", "unit", "license").unionByName(_within(rows, texts).select("doc_id", "tid", F.lit("within").alias("unit"), "license"))
    found = every.groupBy("doc_id", "tid").agg(
        F.min(F.when(F.col("unit") == "whole", F.col("license"))).alias("whole_license"),
        F.count(F.when(F.col("unit") == "line", True)).alias("n"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("names"),
    )
    at = rows.select("doc_id", "tid").alias("d")
    joined = at.join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.tid = f.tid"), "left")
    return joined.select("d.doc_id", "whole_license", F.coalesce("n", F.lit(0)).alias("n_notices"), F.coalesce("names", F.lit("")).alias("licenses"))

"""License scans by canonical digests.

A text is brought into a canonical form: A-Z in lower case, copyright lines left out,
equivalent spellings replaced, and everything but letters and digits turned into one space.
The digest of the whole form is looked up among the digests of known license texts, and the
digests of its single lines among those of known notices.  The shipped lists are fixed and short,
so they are broadcast and no text is shuffled; digests of further texts are broadcast if a count
proves them few.  A whole text that is not known as it stands is looked up without the titles and
undated copyright lines above it.

Defined results: a null or empty text, and one of copyright lines only, matches nothing; each
row is scanned for itself; a notice on two lines of a text counts twice and is listed once.
Other columns do not matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions.staging import snapshot
from tillcast.llm.common import ascii_lower, held, row_key, small_side

# The published texts of short licenses, without their copyright lines.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so")
_MIT_NOTICE = (
    ", subject to the following conditions:\n\nThe above copyright notice and this permission "
    "notice shall be included in all copies or substantial portions of the Software.\n\n")
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE.")
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
    "without fee is hereby granted")
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.")
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:\n\n1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution.\n\n")
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission.\n\n")
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE.")
TEXTS = {
    "MIT": _MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY,
    "MIT-0": _MIT_GRANT + ".\n\n" + _MIT_WARRANTY,
    "ISC": _ISC_GRANT + (", provided that the above copyright notice and this permission notice "
                         "appear in all copies.\n\n") + _ISC_WARRANTY,
    "0BSD": _ISC_GRANT + ".\n\n" + _ISC_WARRANTY,
    "BSD-2-Clause": _BSD_GRANT + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_GRANT + _BSD_NAME + _BSD_WARRANTY,
}
#: A text may carry the license's title above it.
TITLES = {"MIT": "MIT License", "MIT-0": "MIT No Attribution", "ISC": "ISC License",
          "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License",
          "BSD-3-Clause": "BSD 3-Clause License"}
#: Names under which notices speak of a license.
NAMES = {
    "MIT": ["MIT License"], "ISC": ["ISC License"], "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-2.0": ["GNU General Public License, Version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, Version 3", "GNU General Public License v3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, Version 3"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0", "Creative Commons Zero v1.0 Universal"],
    "Unlicense": ["Unlicense"],
    "MIT-0": ["MIT No Attribution"], "0BSD": ["BSD Zero Clause License"],
    "AGPL-3.0": ["GNU Affero General Public License, Version 3", "AGPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, Version 2.1", "LGPLv2.1"],
    "EPL-1.0": ["Eclipse Public License 1.0"], "EPL-2.0": ["Eclipse Public License 2.0"],
    "BSL-1.0": ["Boost Software License 1.0"], "Zlib": ["zlib License"],
    "Artistic-2.0": ["Artistic License 2.0"], "OFL-1.1": ["SIL Open Font License 1.1"],
    "ODbL-1.0": ["Open Database License 1.0"], "EUPL-1.2": ["European Union Public License 1.2"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "PSF-2.0": ["Python Software Foundation License 2.0"], "WTFPL": ["WTFPL"],
    "NCSA": ["University of Illinois/NCSA Open Source License"], "PostgreSQL": ["PostgreSQL License"],
}
for _key, _names in {"Apache-2.0": ["Apache 2.0"], "GPL-2.0": ["GPLv2", "GPL v2"],
                     "GPL-3.0": ["GPLv3", "GPL v3"], "LGPL-3.0": ["LGPLv3"],
                     "MPL-2.0": ["MPL 2.0"]}.items():
    NAMES[_key] += _names
for _key in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
    NAMES |= {f"{_key}-only": [], f"{_key}-or-later": []}
#: The Creative Commons family: short name -> spellings of the long one.
_CC = {"BY": [""], "BY-SA": ["ShareAlike", "Share Alike"],
       "BY-NC": ["NonCommercial", "Non-Commercial"],
       "BY-ND": ["NoDerivatives", "NoDerivs", "No Derivatives"],
       "BY-NC-SA": ["NonCommercial-ShareAlike", "Non-Commercial-Share Alike"],
       "BY-NC-ND": ["NonCommercial-NoDerivatives", "NonCommercial-NoDerivs",
                    "Non-Commercial-No Derivatives"]}
for _short, _longs in _CC.items():
    for _version, _realms in {"4.0": ["", " International"],
                              "3.0": ["", " Unported", " International"]}.items():
        NAMES.setdefault(f"CC-{_short}-{_version}", []).extend(
            [f"Creative Commons {_short} {_version}",
             *(f"Creative Commons Attribution{'-' * bool(_long)}{_long} {_version}{_realm}"
               for _long in _longs for _realm in _realms)])
VERBS = [f"{verb}{article}" for verb in ("Released under", "Licensed under", "Distributed under",
                                         "This work is licensed under", "Available under")
         for article in (" the", " a", " an", "")]
#: Spellings that count as equal: pattern over lower-case letters -> spelling.
SPELLINGS = {
    r"licence": "license", r"https": "http", r"sub[ -]licens": "sublicens",
    r"merchantibility": "merchantability", r"non[ -]infringement": "noninfringement",
    r"organisation": "organization", r"acknowledgement": "acknowledgment",
    r"copyright owner": "copyright holder", r"per cent": "percent", r"&": " and ",
}
COPYRIGHT_LINE = r"^[^\p{L}\p{N}©]*(copyright|©|\(c\))[^\n]*([0-9]{4}|©|\(c\))|^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
#: In canonical form, above a license: a copyright without a year.
HOLDER_LINE = r"^(portions )?copyright (c )?(?!holder|owner|notice|law|license|statement)."
PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, without copyright lines and empty ones."""
    plain = ascii_lower(F.coalesce(text, F.lit("")))
    for pattern, spelling in SPELLINGS.items():
        plain = F.regexp_replace(plain, pattern, spelling)
    lines = F.filter(F.split(plain, "\n", -1), lambda x: ~x.rlike(COPYRIGHT_LINE))
    return F.filter(
        F.transform(lines, lambda x: F.trim(F.regexp_replace(x, PUNCTUATION, " "))),
        lambda x: x != "")


def notices() -> dict[str, str]:
    """Notice -> license, built from the names, the verbs and the identifier line."""
    found = {f"SPDX-License-Identifier: {key}": key for key in NAMES}
    for key in NAMES:
        for name in names_of(key):
            found |= {f"{verb} {name}": key for verb in VERBS}
    return found


def names_of(key: str) -> list[str]:
    """The names and the identifier of a license, each with and without the word License."""
    names = dict.fromkeys([*NAMES[key], key])
    return [*names, *(f"{n} License" for n in names if not n.lower().endswith("license"))]


def known(spark, texts: dict[str, str]) -> DataFrame:
    """(digest, license) of texts, in a fixed and short list."""
    rows = spark.createDataFrame(list(texts.items()), "text string, license string")
    return rows.select(whole_digest(canonical_lines(F.col("text"))).alias("digest"), "license") \
        .dropDuplicates(["digest"])


def whole_digest(lines: Column) -> Column:
    return F.sha2(F.concat_ws(" ", lines).cast("binary"), 256)


def known_texts() -> dict[str, str]:
    plain = {text: key for key, text in TEXTS.items()}
    return plain | {f"{TITLES[key]}\n\n{text}": key for text, key in plain.items()}


def titles() -> list[str]:
    """Canonical forms of the lines that may stand above a license as its title."""
    found = {f"{the}{name}{short}" for key in NAMES for name in {*names_of(key), TITLES.get(key, key)}
             for the in ("", "the ") for short in ("", f" {key}")}
    return sorted({re.sub("[^a-z0-9]+", " ", t.lower().replace("licence", "license")).strip()
                   for t in found})


def body(lines: Column) -> Column:
    """Canonical lines without the titles and undated copyright lines at the top."""
    head = F.transform(lines, lambda x: x.isin(titles()) | x.rlike(HOLDER_LINE))
    first = F.array_position(head, False)
    return F.when(first > 0, F.slice(lines, first.cast("int"), F.size(lines))).otherwise(
        F.array().cast("array<string>"))


def known_digests(spark, texts: DataFrame | None = None) -> DataFrame:
    """(whole, digest, license): shipped and given texts, as they stand and as bodies.

    A text given for several licenses counts for the least; null and empty ones for none.
    """
    rows = spark.createDataFrame(list(known_texts().items()), "text string, license string")
    if texts is not None:
        rows = rows.unionByName(texts.select("text", "license").where("license IS NOT NULL"))
    lined = held(rows, lines=canonical_lines(F.col("text")))
    lined = held(lined, rest=body(F.col("lines")))
    digests = lined.select("license", F.inline(F.array(*(
        F.struct(F.lit(whole).alias("whole"), whole_digest(F.col(c)).alias("digest"),
                 F.size(c).alias("n"))
        for whole, c in ((True, "lines"), (False, "rest")))))).where("n > 0")
    return digests.groupBy("whole", "digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         texts: DataFrame | None = None) -> DataFrame:
    """Per row: id, ``digest`` of the canonical text, ``license`` of the whole text or null,
    ``n_notices`` lines that are known notices, and ``notices``: their licenses.

    ``texts`` (text, license) are whole licenses to know besides the shipped ones.  A text that
    equals none as it stands is looked up by its body.
    """
    spark = docs.sparkSession
    lined = held(docs.select(F.col(id_column), F.col(text_column).alias("whole text"),
                             row_key(F.col(id_column), F.col(text_column)).alias("row key")),
                 **{"canonical lines": canonical_lines(F.col("whole text"))}).drop("whole text")
    lines = F.col("canonical lines")
    by_line = (lined.select("row key", F.posexplode(lines).alias("at", "line"))
               .withColumn("digest", F.sha2(F.col("line").cast("binary"), 256))
               .join(F.broadcast(known(spark, notices())), "digest")
               .dropDuplicates(["row key", "at"]).groupBy("row key")
               .agg(F.count(F.lit(1)).alias("n_notices"),
                    F.sort_array(F.collect_set("license")).alias("notices")))
    digests = known_digests(spark, texts)
    if texts is not None:
        digests = snapshot(digests, "license_digests")
    side = lambda whole, *names: (F.broadcast if texts is None else small_side)(
        digests.where(F.col("whole") == whole).select(*(
            F.col(c).alias(n) for c, n in zip(("digest", "license"), names, strict=True))))
    whole = (lined.select(F.col(id_column), "row key", whole_digest(lines).alias("digest"),
                          whole_digest(body(lines)).alias("body digest"))
             .join(side(True, "digest", "license"), "digest", "left")
             .join(side(False, "body digest", "body license"), "body digest", "left"))
    return whole.join(by_line, "row key", "left").select(
        id_column, "digest", F.coalesce("license", "body license").alias("license"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
        F.concat_ws(",", F.coalesce("notices", F.array().cast("array<string>"))).alias("notices"))

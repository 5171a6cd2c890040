"""License scans: canonical forms, whole texts and notices."""

import re

from tillcast.llm import licences

LICENCE_LIKE = re.compile(r"licen[cs]e|spdx|creative commons|\bcc[ -]by|rights reserved", re.I)
MIT = licences.TEXTS["MIT"]
TEXTS = [
    MIT, "MIT Licence\n\nCopyright (c) 2020 Someone\n\n" + MIT.upper().replace("\n", "\r\n"),
    MIT.replace("sublicense", "sub-license").replace('"', "“"), "© 2019 X. All rights reserved.\n" + MIT,
    MIT + "\nand more", None, "", "Copyright 2020 me", "text\nReleased under the MIT Licence!\nmore",
    "SPDX-License-Identifier: Apache-2.0\n# licensed under the apache license, version 2.0",
    "Copyright law is a topic of its own", licences.TEXTS["BSD-3-Clause"], licences.TEXTS["BSD-2-Clause"],
    "all rights reserved",
]
WHOLE = {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 11: "BSD-3-Clause", 12: "BSD-2-Clause"}
NOTICES = {8: (1, "MIT"), 9: (2, "Apache-2.0")}


def test_scan(docs):
    rows = {r.doc_id: r for r in licences.scan(docs(TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    assert {i: r.license for i, r in rows.items() if r.license} == WHOLE
    assert {i: (r.n_notices, r.notices) for i, r in rows.items() if r.n_notices} == NOTICES
    assert rows[10].digest != rows[7].digest == rows[6].digest == rows[13].digest


def test_known_texts_are_distinct(spark):
    assert licences.known(spark, licences.known_texts()).count() == len(licences.known_texts())


def test_awkward_rows_and_columns(awkward):
    rows = licences.scan(awkward).collect()
    assert len(rows) == 10 and not any(r.license or r.n_notices for r in rows)
    assert licences.scan(awkward.limit(0)).count() == 0


def test_no_licence_line_of_the_table_is_missed(spark, small, docs):
    frame = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    lines = sorted({x for r in frame.collect() for x in (r.text or "").split("\n")
                    if len(x) < 200 and LICENCE_LIKE.search(x)})
    rows = licences.scan(docs(lines)).collect()
    assert len(lines) > 4
    # This line claims rights without naming a license.
    assert [lines[r.doc_id] for r in rows if not r.n_notices] == ["All rights reserved."]


def test_creative_commons_family(docs):
    texts = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under CC-BY-SA-3.0": "CC-BY-SA-3.0",
             "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives "
             "4.0 International License.": "CC-BY-NC-ND-4.0",
             "Licensed under the Creative Commons Attribution 3.0 Unported License": "CC-BY-3.0",
             "# SPDX-License-Identifier: CC-BY-ND-4.0": "CC-BY-ND-4.0",
             "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
             "Licensed under CC BY-NC": "", "Licensed under GPLv3.": "GPL-3.0"}
    rows = licences.scan(docs(list(texts))).collect()
    assert {list(texts)[r.doc_id]: r.notices for r in rows} == texts


def test_titles_and_holders_above_a_licence(docs):
    apache = "Apache License\nVersion 2.0, January 2004\n\nTERMS AND CONDITIONS"
    heads = ["The MIT License (MIT)\n\n", "Copyright The Foo Authors\n\n", "MIT License\nCopyright (c) Jo\n",
             "Copyright law is fun\n", "More words\n"]
    rows = {r.doc_id: r.license for r in licences.scan(docs([h + MIT for h in heads] + [apache])).collect()}
    assert rows == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: None, 5: None}


def test_given_texts(spark, docs):
    apache = "Apache License\nVersion 2.0, January 2004\n\nTERMS AND CONDITIONS"
    given = spark.createDataFrame(
        [(apache, "Apache-2.0"), (apache, "Apache-2.0"), ("My licence: do as you like.", "Own"),
         (None, "Null"), ("", "Empty"), ("MIT License", "Title"), ("text", None)],
        "text string, license string")
    texts = [apache.upper(), "Copyright 2020 Jo\n" + apache, "Apache License 2.0\n" + apache,
             "my license - do as you like", MIT, "", None, "text", "MIT License"]
    rows = {r.doc_id: r.license for r in licences.scan(docs(texts), texts=given).collect()}
    assert rows == {0: "Apache-2.0", 1: "Apache-2.0", 2: "Apache-2.0", 3: "Own", 4: "MIT",
                    5: None, 6: None, 7: None, 8: "Title"}

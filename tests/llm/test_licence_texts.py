"""The rules of licence scans on the standard texts, wrapped and unwrapped."""

import textwrap

import pytest

from punctuality.llm import licences

MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE.",
]
GPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
]
MPL = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]
APACHE = ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0"]
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."]
TEXTS = {"MIT": (MIT, "8,9,10"), "GPL": (GPL, "13,14,35"), "MPL-2.0": (MPL, "24,30"), "Apache-2.0": (APACHE, "2,3,4"), "BSD": (BSD, "20,21")}


def shapes(parts):
    wrapped = [textwrap.fill(p, 75) for p in parts]
    yield "\n\n".join(parts)
    yield "\n\n".join(wrapped)
    yield "\r\n\r\n".join(w.replace("\n", "\r\n") for w in wrapped)
    yield from ("\n".join(f"{sign} {line}".rstrip() for line in "\n\n".join(wrapped).split("\n")) for sign in ("#", "//", " *"))


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{name} {i}", t) for name, (parts, _) in TEXTS.items() for i, t in enumerate(shapes(parts))]
    rows += [(f"{name} line", " ".join(parts)) for name, (parts, _) in TEXTS.items() if name in ("MIT", "GPL", "BSD", "MPL-2.0")]
    rows += [("own lines", "Some words\nAll rights reserved\nmore words"), ("other", "Is it? No. All rights reserved."), ("none", "Permission is hereby granted to leave.\nThe end")]
    return {r["doc_id"]: (r["licences"], r["sentence_ids"]) for r in licences.licences(spark.createDataFrame(rows, "doc_id string, text string")).collect()}


def test_standard_texts(found):
    for key, got in found.items():
        name = key.rsplit(" ", 1)[0]
        if name in TEXTS:
            assert got == (name, TEXTS[name][1]), key


def test_lines_of_their_own(found):
    assert found["own lines"] == found["other"] == ("Proprietary", "22") and found["none"] == ("", "")


def test_rules_use_sentences_up(spark):
    """The longest rule first, then the order of the rules; what it matched is gone."""
    rules = [("short", (1, 2)), ("long", (1, 2, 3)), ("first", (4,)), ("second", (4,)), ("alone", (3,))]
    cases = {(1, 2, 3): "long", (1, 2): "short", (1, 2, 3, 0, 1, 2): "long,short", (4,): "first", (3, 1, 2, 3): "long,alone", (1, 0, 2): "", (1, 2, 3, 1, 2, 3): "long", (): ""}
    scanner = licences.Scanner(rules=rules)
    assert [",".join(scanner.matched(list(ids))) for ids in cases] == list(cases.values())
    full = "\n".join(licences.SENTENCES[k] + "." for k in (20, 21, 25, 27, 26))
    names = ["This project is licensed under the BSD 3-Clause License.", "Distributed under the terms of the GNU Lesser General Public License v2.1", "Code released under the ISC license", "This work is licensed under CC BY-NC-SA 4.0.", full]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id int, text string")
    assert [r["licences"] for r in licences.licences(docs).orderBy("doc_id").collect()] == ["BSD-3-Clause", "LGPL-2.1", "ISC", "CC-BY-NC-SA-4.0", "BSD-3-Clause"]


SAID = {
    "licensed under the GNU GPL v3 or later": "GPL-3.0-or-later",
    "Licensed under the MIT license and the Apache License, Version 2.0.": "MIT,Apache-2.0",
    "Dual licensed under MIT or Apache-2.0": "MIT,Apache-2.0",
    "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0-only",
    "# SPDX-License-Identifier: (MIT OR Apache-2.0)\n# Copyright someone": "MIT,Apache-2.0",
    "/* SPDX-License-Identifier: LGPL-2.1+ */": "LGPL-2.1-or-later",
    "SPDX-License-Identifier: Apache-2.0 WITH some-exception": "",
    "This file is licensed under the GNU Affero General Public License version 3, or (at your option) any later version.": "AGPL-3.0-or-later",
    "Released under the ISC licence": "ISC",
    "Released under the Foo license and the MIT license": "",
    "Released under the MIT or later": "",
    "Distributed under the terms of the GPLv2 only, and the BSD 3-Clause license": "BSD-3-Clause,GPL-2.0-only",
    "Distributed under the terms of the GPLv2 only and the BSD 3-Clause license": "BSD-3-Clause,GPL-2.0-only",
    "Available under the MIT and Apache 2.0 licenses": "MIT,Apache-2.0",
    "licensed under the": "",
    "unlicensed under the MIT license": "",
}


def test_what_sentences_say(spark, tmp_path):
    """And the SQL says the same."""
    import duckdb

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(SAID)] + [(99, None), (99, "")], "doc_id int, text string")
    found = licences.licences(docs)
    got = {r["doc_id"]: r["licences"] for r in found.collect()}
    want = {i: ",".join(sorted(x.split(","))) for i, x in enumerate(SAID.values())} | {99: ""}
    assert {i: ",".join(sorted(x.split(","))) for i, x in got.items()} == want
    con = duckdb.connect()
    con.execute("create table documents (doc_id int, text varchar)")
    con.executemany("insert into documents values (?, ?)", [[r["doc_id"], r["text"]] for r in docs.collect()])
    assert sorted(con.execute(licences.sql()).fetchall()) == sorted(map(tuple, found.collect()))

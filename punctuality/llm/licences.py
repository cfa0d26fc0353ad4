"""Licence scans by sentence rules: texts are cut into sentences, normalised sentences
become the numbers of known licence sentences, and ordered rules (sequences of such
numbers, next to each other in the text) name the licences. Rules of more sentences go
before shorter ones, equal ones in their order; what a rule has matched is used up, so
that the sentences of a full notice don't also match the rules of a shorter one.

Sentences that say what licence holds ("released under ...", or an SPDX line) are known by
their form: an opening of OPENINGS and the names of one licence or of several, joined by "and" or
"or"; each is a number of its own. Licences of the GPL's kind may be told "only" or "or later".

Sentences run over the line breaks inside a paragraph: a sentence that isn't known as a
whole is looked up line by line, so that a notice that stands on a line of its own is found
as well. Comment signs at the start of a line are no words, and a full stop after an
abbreviation before a number ends nothing.

One narrow stage, no shuffle: texts without any word that a known sentence has as its rarest
(see anchors) can hold none and stay in the JVM; the others are cut and looked up in a dictionary, in Arrow batches.

Defined results: A-Z are lower-cased; a null or empty text has no sentences and no licence; a very long text is
cut whole; a sentence that repeats counts each time; a licence is named once a text, where
its first rule stands in the order; repeated rows get a row each; an empty table gives an
empty result; other columns are never read, whatever they are called.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctuality.llm.shared import ascii_lower

# Known licence sentences, normalised (lower case, ASCII letters and
# digits, single spaces).
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "you may obtain a copy of the license at",
    5: "released under the mit license",
    6: "licensed under the mit license",
    7: "this project is licensed under the mit license",
    8: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    9: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    10: "the software is provided as is without warranty of any kind express or implied",
    11: "this work is licensed under the gnu general public license version 3",
    12: "this work is licensed under the gnu general public license version 2",
    13: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    14: "this program is distributed in the hope that it will be useful but without any warranty",
    15: "licensed under cc by nc 4 0",
    16: "licensed under cc by 4 0",
    17: "licensed under cc by sa 4 0",
    18: "this work is licensed under a creative commons attribution 4 0 international license",
    19: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    20: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    21: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    22: "all rights reserved",
    23: "this work is in the public domain",
    24: "this source code form is subject to the terms of the mozilla public license v 2 0",
}
# More known sentences, of standard notices and licence texts.
SENTENCES |= {
    25: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    26: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    27: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    28: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    29: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    30: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    31: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    32: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    33: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    34: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    35: "see the gnu general public license for more details",
    36: "see the gnu lesser general public license for more details",
    37: "see the gnu affero general public license for more details",
    38: "you should have received a copy of the gnu general public license along with this program",
    39: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    40: "see the license for the specific language governing permissions and limitations under the license",
    41: "this is free and unencumbered software released into the public domain",
    42: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    43: "this software is provided as is without any express or implied warranty",
    44: "in no event will the authors be held liable for any damages arising from the use of this software",
    45: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    46: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    47: "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    48: "you just do what the fuck you want to",
    49: "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",
    50: "you can copy modify distribute and perform the work even for commercial purposes all without asking permission",
    51: "you are free to share copy and redistribute the material in any medium or format",
    52: "you must give appropriate credit provide a link to the license and indicate if changes were made",
    53: "you may not use the material for commercial purposes",
    54: "if you remix transform or build upon the material you must distribute your contributions under the same license as the original",
    55: "if you remix transform or build upon the material you may not distribute the modified material",
    56: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
}
# The names of licences, normalised.
NAMES = {
    "MIT": ("mit", "expat"),
    "Apache-2.0": ("apache 2 0", "apache license 2 0", "apache license version 2 0", "apache software license 2 0"),
    "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd"),
    "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"),
    "BSD": ("bsd",),
    "ISC": ("isc",),
    "Zlib": ("zlib",),
    "BSL-1.0": ("bsl 1 0", "boost software license 1 0", "boost software license version 1 0", "boost software"),
    "GPL-2.0": ("gpl 2 0", "gpl v2", "gplv2", "gnu gpl v2", "gnu general public license v2 0", "gnu general public license version 2"),
    "GPL-3.0": ("gpl 3 0", "gpl v3", "gplv3", "gnu gpl v3", "gnu general public license v3 0", "gnu general public license version 3"),
    "LGPL-2.1": ("lgpl 2 1", "lgpl v2 1", "gnu lesser general public license v2 1", "gnu lesser general public license version 2 1"),
    "LGPL-3.0": ("lgpl 3 0", "lgpl v3", "gnu lesser general public license v3 0", "gnu lesser general public license version 3"),
    "AGPL-3.0": ("agpl 3 0", "agpl v3", "gnu affero general public license v3 0", "gnu affero general public license version 3"),
    "MPL-2.0": ("mpl 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mozilla public license version 2 0"),
    "EPL-2.0": ("epl 2 0", "eclipse public license 2 0", "eclipse public license v 2 0"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0", "creative commons attribution 4 0 international"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0", "creative commons attribution sharealike 4 0 international"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0", "creative commons attribution noncommercial 4 0 international"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0", "creative commons attribution noderivatives 4 0 international"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0", "creative commons attribution noncommercial sharealike 4 0 international"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0", "creative commons attribution noncommercial noderivatives 4 0 international"),
    "CC0-1.0": ("cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal"),
    "Unlicense": ("unlicense",),
    "WTFPL": ("wtfpl",),
    "Artistic-2.0": ("artistic 2 0", "artistic license 2 0"),
}
#: How a sentence opens that says what licence holds.
OPENINGS = (
    "released under", "licensed under", "dual licensed under", "distributed under", "available under", "code released under", "published under",
    "licensed under the terms of", "distributed under the terms of", "released under the terms of", "this project is licensed under", "this project is dual licensed under",
    "this software is licensed under", "this work is licensed under", "this file is licensed under", "this program is licensed under", "spdx license identifier",
)
#: The number of a licence's notices is FIRST_NOTICE and its place in NAMES; of those that say
#: "or later" LATER more, "only" ONLY more.
FIRST_NOTICE, LATER, ONLY = 101, 100, 200
_NOTICE = {name: FIRST_NOTICE + i for i, name in enumerate(NAMES)}
_VERSIONED = [name for name in NAMES if "GPL" in name]
#: Ordered rules: of rules of equal length the earlier goes before.
RULES = [
    ("Apache-2.0", (2, 3, 4, 39, 40)),
    ("Apache-2.0", (2, 3, 4)),
    ("Apache-2.0", (1,)),
    ("Apache-2.0", (2,)),
    ("MIT", (8, 9, 10)),
    ("MIT", (8, 9)),
    ("MIT", (5,)),
    ("MIT", (6,)),
    ("MIT", (7,)),
    ("MIT", (8,)),
    ("GPL-3.0", (11,)),
    ("GPL-2.0", (12,)),
    ("GPL", (13, 14, 35, 38)),
    ("GPL", (13, 14, 35)),
    ("GPL", (13, 14)),
    ("GPL", (13,)),
    ("AGPL-3.0", (34, 14, 37)),
    ("AGPL-3.0", (34, 14)),
    ("AGPL-3.0", (34,)),
    ("LGPL-2.1", (31, 33, 36)),
    ("LGPL-2.1", (31, 33)),
    ("LGPL-2.1", (31,)),
    ("LGPL-3.0", (32, 33, 36)),
    ("LGPL-3.0", (32, 33)),
    ("LGPL-3.0", (32,)),
    ("CC-BY-NC-4.0", (15,)),
    ("CC-BY-NC-4.0", (19,)),
    ("CC-BY-4.0", (16,)),
    ("CC-BY-4.0", (18,)),
    ("CC-BY-SA-4.0", (17,)),
    ("BSD-3-Clause", (20, 21, 25, 27, 26)),
    ("BSD-2-Clause", (20, 21, 25, 26)),
    ("BSD-3-Clause", (20, 21, 25, 27)),
    ("BSD-2-Clause", (20, 21, 25)),
    ("BSD", (20, 21)),
    ("ISC", (28, 29)),
    ("ISC", (28,)),
    ("MPL-2.0", (24, 30)),
    ("MPL-2.0", (24,)),
    ("Unlicense", (41, 42)),
    ("Unlicense", (41,)),
    ("Zlib", (43, 44, 45)),
    ("Zlib", (45,)),
    ("BSL-1.0", (46,)),
    ("WTFPL", (47,)),
    ("WTFPL", (48,)),
    ("CC0-1.0", (49, 50)),
    ("CC0-1.0", (49,)),
    ("EPL-2.0", (56,)),
    *[(name, (k,)) for name, k in _NOTICE.items()],
    *[(f"{name}-or-later", (_NOTICE[name] + LATER,)) for name in _VERSIONED],
    *[(f"{name}-only", (_NOTICE[name] + ONLY,)) for name in _VERSIONED],
    ("Proprietary", (22,)),
    ("Public-Domain", (23,)),
]
#: Wordings of standard notices beside SENTENCES, normalised, with the numbers each counts as.
WORDINGS = {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": (2, 3),
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": (8,),
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": (8, 9),
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": (9,),
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": (10,),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": (13,),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": (13,),
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": (14,),
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": (20, 21),
}
#: Ends of sentences; a blank line ends a paragraph.
BREAK = r"[.!?;]+[ \t\n\f\r]+|[.!?;]+\z|\n[ \t]*\n[ \t\n\f\r]*"
#: What is no word or no end: line ends, comment signs, numbers of list items, stops of
#: abbreviations; and "3.0+". Patterns that both engines read alike; \N is a group.
CLEAN = [
    (r"\r\n?", "\n"),
    (r"(?m)^[ \t]*(?://+|/\*+|\*+/|#+|\*+|--+|>+)[ \t]*", ""),
    (r"(?m)(^[ \t]*|:[ \t]+)[0-9]+\.[ \t]", r"\1 "),
    (r"\b(v|ver|vers|no|vol)\.([ \t\n\f\r]+[0-9])", r"\1 \2"),
    (r"([0-9])\+", r"\1 or later"),
]
#: Of what follows an opening: marks for what is said of versions; the plural after several names;
#: what parts the names.
MARKS = [
    (r" or (?:any later versions?|later versions?|later|at your option any later version)\b", "+"),
    (r" only\b", "!"),
    (r"( (?:and|or) .+) licen[sc]es$", r"\1"),
]
PARTED = r" (?:and|or) "
#: Of a name: articles before it and "license" after it.
BARE = [(r"^(?:the |a |an )+", ""), (r" licen[sc]e([+!]?)$", r"\1")]


#: The longest opening first.
OPENING = f"(?:{'|'.join(sorted(OPENINGS, key=len, reverse=True))}) (.+)"


def counted(sentences: dict[int, str] = SENTENCES) -> dict[str, tuple[int, ...]]:
    """Known wordings and the numbers that each counts as: sentences, and whole notices
    that are more than one."""
    own = {s: (k,) for k, s in sentences.items()}
    return WORDINGS | own if sentences is SENTENCES else own


def numbers_of_names() -> dict[str, int]:
    """Names of licences, with a mark or without, and their numbers."""
    out = {name: _NOTICE[licence] for licence, names in NAMES.items() for name in names}
    for mark, more in (("+", LATER), ("!", ONLY)):
        out |= {name + mark: _NOTICE[licence] + more for licence in _VERSIONED for name in NAMES[licence]}
    return out


def ordered_rules(rules: list[tuple[str, tuple[int, ...]]]) -> list[tuple[str, str]]:
    """(licence, run of marked numbers) in the order in which rules apply."""
    return [(name, "".join(f"<{k}>" for k in seq)) for name, seq in sorted(rules, key=lambda r: -len(r[1]))]


def anchors(texts: list[str] | None = None) -> list[str]:
    """A short list of words such that each known wording has one: the word most of them
    share, then that of those left, and so on."""
    left, out = [set(s.split()) for s in ([*counted(), *OPENINGS] if texts is None else texts)], []
    while left:
        shared: dict[str, int] = {}
        for words in left:
            for w in words:
                if len(w) > 5:
                    shared[w] = shared.get(w, 0) + 1
        best = min(shared, key=lambda w: (-shared[w], w)) if shared else min(left[0], key=lambda w: (-len(w), w))
        out.append(best)
        left = [words for words in left if best not in words]
    return out


class Scanner:
    """Known sentences and rules, ready to be looked up."""

    def __init__(self, sentences: dict[int, str] = SENTENCES, rules: list[tuple[str, tuple[int, ...]]] = RULES):
        self.known, self.rules = counted(sentences), ordered_rules(rules)
        self.names = numbers_of_names() if sentences is SENTENCES else {}
        sub = lambda steps: [(re.compile(p, re.ASCII), to) for p, to in steps]
        self.clean, self.marks, self.bare = sub(CLEAN), sub(MARKS), sub(BARE)
        self.end, self.other = re.compile(BREAK.replace(r"\z", r"\Z")), re.compile("[^a-z0-9]+")
        self.opening = re.compile(OPENING)

    @staticmethod
    def _changed(text: str, steps: list) -> str:
        return functools.reduce(lambda t, step: step[0].sub(step[1], t), steps, text)

    def notice(self, plain: str) -> tuple[int, ...] | None:
        """The licences that a sentence says to hold; None if it is no such sentence."""
        told = self.opening.fullmatch(plain)
        if not told:
            return None
        names = re.split(PARTED, self._changed(told[1], self.marks))
        found = tuple(self.names.get(self._changed(name, self.bare)) for name in names)
        return None if None in found else found

    def look_up(self, sentence: str) -> tuple[int, ...] | None:
        plain = self.other.sub(" ", sentence).strip(" ")
        found = self.known.get(plain)
        return self.notice(plain) if found is None and self.names else found

    def numbers(self, text: str) -> list[int]:
        """The numbers of a text's sentences in order, 0 for one that isn't known."""
        out: list[int] = []
        for sentence in self.end.split(self._changed(ascii_lower(text), self.clean)):
            found = self.look_up(sentence)
            if found is None:
                for line in sentence.split("\n"):
                    out += self.look_up(line) or (0,)
            else:
                out += found
        return out

    def matched(self, numbers: list[int]) -> list[str]:
        """The licences whose rules match the numbers, rule by rule, in the order in which
        rules apply. What a rule matches is used up."""
        run, names = "".join(f"<{k}>" for k in numbers), []
        for name, seq in self.rules:
            if seq in run:
                run = run.replace(seq, "<0>")
                names.append(name)
        return list(dict.fromkeys(names))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[int, str] = SENTENCES, rules: list[tuple[str, tuple[int, ...]]] = RULES) -> DataFrame:
    """Per document: id_col, n_known, sentence_ids (known ones in order, comma-joined),
    licences (in the order of the rules that matched, comma-joined)."""
    text = F.col(text_col).cast("string")
    may = F.lit(False)
    for word in anchors(None if sentences is SENTENCES else list(sentences.values())):
        may = may | F.contains(F.col("low"), F.lit(word))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.lower(text).alias("low")).select("id", F.when(may, F.col("text")).alias("text"))
    scanner = Scanner(sentences, rules)

    def scan(batches):
        for batch in batches:
            n, ids, names = [], [], []
            for text in batch.column(1).to_pylist():
                found = scanner.numbers(text) if text else []
                known = [k for k in found if k]
                n.append(len(known))
                ids.append(",".join(map(str, known)))
                names.append(",".join(scanner.matched(found)) if known else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(names, pa.string())], names=schema.names)

    schema = T.StructType(list(rows.select(F.col("id").alias(id_col)).schema.fields)).add("n_known", "long").add("sentence_ids", "string").add("licences", "string")
    return rows.mapInArrow(scan, schema)


def sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The same in DuckDB's SQL, without the anchors: rules one after the other, each on
    what those before have left."""

    def changed(text: str, steps: list[tuple[str, str]]) -> str:
        for pattern, to in steps:
            into = "chr(10)" if to == "\n" else f"'{to}'"
            text = f"regexp_replace({text}, '{pattern}', {into}, 'g')"
        return text

    pairs = ", ".join(f"'{s}': {list(ids)}" for s, ids in counted().items())
    names = ", ".join(f"'{s}': {k}" for s, k in numbers_of_names().items())
    low = changed(f"translate(coalesce({text_col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", CLEAN)
    plain = lambda s: f"trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'), ' ')"
    # of each sentence itself and its lines, in one list: {plain form, number of the sentence, of the line (0: itself)}
    opened = changed(f"regexp_extract(p, '^{OPENING}$', 1)", MARKS)
    rules = ordered_rules(RULES)
    left = ", ".join(f"replace(r{i}, '{seq}', '<0>') AS r{i + 1}" for i, (_, seq) in enumerate(rules))
    told = ", ".join(f"CASE WHEN contains(r{i}, '{seq}') THEN '{name}' END" for i, (name, seq) in enumerate(rules))
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS r, {id_col}, {text_col} FROM {table}),
known AS MATERIALIZED (SELECT MAP {{{pairs}}} AS known, MAP {{{names}}} AS names),
cut AS (SELECT r, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS s FROM (SELECT r, regexp_split_to_array({low}, '{BREAK}') AS ss FROM doc)),
line AS (SELECT r, i, 0 AS j, s FROM cut UNION ALL SELECT r, i, unnest(range(1, len(ls) + 1)) AS j, unnest(ls) AS s FROM (SELECT r, i, string_split(s, chr(10)) AS ls FROM cut)),
form AS (SELECT r, i, j, {plain("s")} AS p FROM line),
item AS (SELECT r, i, j, p, list_transform(regexp_split_to_array({opened}, '{PARTED}'), lambda x: names[{changed("x", BARE)}]) AS ids, known[p] AS own FROM form, known),
number AS (SELECT r, i, j, CASE WHEN own IS NOT NULL THEN own WHEN len(list_filter(ids, lambda x: x IS NULL)) = 0 THEN ids END AS ids FROM item),
used AS (SELECT r, i, j, ids FROM number WHERE j = 0 AND ids IS NOT NULL
  UNION ALL SELECT n.r, n.i, n.j, coalesce(n.ids, [0]) FROM number n JOIN number w ON w.r = n.r AND w.i = n.i AND w.j = 0 AND w.ids IS NULL WHERE n.j > 0),
run AS (SELECT {id_col}, list_filter(ids, lambda k: k > 0) AS numbers, array_to_string(list_transform(ids, lambda k: '<' || k || '>'), '') AS r0
  FROM doc JOIN (SELECT r, flatten(list(ids ORDER BY i, j)) AS ids FROM used GROUP BY r) USING (r)),
gone AS (SELECT *, {left} FROM run),
named AS (SELECT {id_col}, numbers, list_filter([{told}], lambda n: n IS NOT NULL) AS names FROM gone)
SELECT {id_col}, CAST(len(numbers) AS BIGINT) AS n_known, coalesce(array_to_string(numbers, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(names) + 1), lambda i: list_position(names, names[i]) = i), lambda i: names[i]), ','), '') AS licences
FROM named"""

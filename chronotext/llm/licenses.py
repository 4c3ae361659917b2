"""License scans by sentence rules, in SQL functions alone.

Known sentences are first marked, also where a notice wraps, numbers or punctuates them.  What stands between them is cut into
sentences, each normalised to its lower-case ASCII letters and digits.  Known licence sentences
have identifiers; the identifiers of a document, in order and with a gap mark where other sentences stood between, form a
sequence, against which licence rules (ordered identifier sequences, longest first) are matched.  A matched stretch is
used up, so a full licence text is not also reported as the notice it contains.  Nothing is shuffled: sequence and rules
are arrays of one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.shared import free

#: Known licence sentences, normalised.  Fixed values.
SENTENCES = {
    "released under the mit license": 1,
    "licensed under the mit license": 1,
    "licensed under the apache license version 2 0": 2,
    "licensed under the apache license version 2 0 the license": 2,
    "this work is licensed under the gnu general public license version 3": 3,
    "licensed under the gnu general public license version 3": 3,
    "licensed under cc by nc 4 0": 4,
    "licensed under cc by 4 0": 5,
    "licensed under cc by sa 4 0": 6,
    "all rights reserved": 7,
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": 8,
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": 9,
    "you may not use this file except in compliance with the license": 10,
    "you may obtain a copy of the license at": 11,
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": 12,
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": 13,
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": 14,
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": 15,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": 16,
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": 17,
    "see the gnu general public license for more details": 18,
    "this source code form is subject to the terms of the mozilla public license v 2 0": 19,
    "this is free and unencumbered software released into the public domain": 20,
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": 21,
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": 22,
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": 23,
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": 24,
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": 25,
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": 26,
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": 27,
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": 28,
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": 29,
    "see the license for the specific language governing permissions and limitations under the license": 30,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": 31,
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": 32,
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": 33,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": 34,
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": 35,
    "see the gnu lesser general public license for more details": 36,
    "see the gnu affero general public license for more details": 37,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": 38,
    "if a copy of the mpl was not distributed with this file you can obtain one at": 39,
    "distributed under the boost software license version 1 0": 40,
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": 41,
    "this software is provided as is without any express or implied warranty": 42,
    "in no event will the authors be held liable for any damages arising from the use of this software": 43,
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": 44,
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": 45,
    "this work is licensed under a creative commons attribution 4 0 international license": 46,
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": 47,
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": 48,
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": 49,
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": 50,
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": 51,
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": 52,
    "licensed under the bsd 3 clause license": 53,
    "licensed under the bsd 2 clause license": 54,
    "licensed under the isc license": 55,
    "licensed under the mozilla public license version 2 0": 56,
    "licensed under the gnu lesser general public license version 3": 57,
    "licensed under the gnu affero general public license version 3": 58,
    "licensed under the eclipse public license version 2 0": 59,
    "licensed under the gnu general public license version 2": 60,
}
#: Names that an SPDX line may give.  Fixed values.
SPDX = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC 0BSD GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 BSL-1.0 Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()
SPDX_LINES = {"spdx license identifier " + re.sub("[^a-z0-9]+", " ", n.lower()): (k, n.lower()) for k, n in enumerate(SPDX, 100)}
#: What stands between two sentences where a rule allows others there.
GAP = 0
#: Licence rules: (name, identifiers).  Longer rules go first, then in this order.  Fixed values.
RULES = [
    ("bsd-3-clause", (12, 13, 14, 15)),
    ("gpl-3.0-or-later", (16, 17, 18)),
    ("apache-2.0", (2, 10, 11)),
    ("bsd-2-clause", (12, 13, 14)),
    ("mit", (8, 9)),
    ("apache-2.0", (2, 10)),
    ("gpl-3.0-or-later", (16, 17)),
    ("mit", (1,)),
    ("apache-2.0", (2,)),
    ("gpl-3.0", (3,)),
    ("gpl-3.0-or-later", (16,)),
    ("cc-by-nc-4.0", (4,)),
    ("cc-by-4.0", (5,)),
    ("cc-by-sa-4.0", (6,)),
    ("mpl-2.0", (19,)),
    ("unlicense", (20,)),
    ("mit", (8,)),
    ("all-rights-reserved", (7,)),
    ("mit", (8, 9, 21, 22)),
    ("mit", (8, 9, 21)),
    ("bsd-3-clause", (12, 13, 14, 15, 23, 24)),
    ("bsd-2-clause", (12, 13, 14, 23, 24)),
    ("apache-2.0", (2, 10, 11, GAP, 29, 30)),
    ("isc", (25, 26, 27)),
    ("isc", (25,)),
    ("0bsd", (28, 26, 27)),
    ("0bsd", (28,)),
    ("gpl-2.0-or-later", (31, 17, 18)),
    ("gpl-2.0-or-later", (31,)),
    ("gpl-2.0-only", (38, 17, 18)),
    ("gpl-2.0-only", (38,)),
    ("lgpl-2.1-or-later", (32, 35, 36)),
    ("lgpl-2.1-or-later", (32,)),
    ("lgpl-3.0-or-later", (33, 35, 36)),
    ("lgpl-3.0-or-later", (33,)),
    ("agpl-3.0-or-later", (34, 17, 37)),
    ("agpl-3.0-or-later", (34,)),
    ("mpl-2.0", (19, 39)),
    ("bsl-1.0", (40,)),
    ("bsl-1.0", (41,)),
    ("zlib", (42, 43, 44)),
    ("unlicense", (20, 45)),
    ("cc-by-4.0", (46,)),
    ("cc-by-sa-4.0", (47,)),
    ("cc-by-nc-4.0", (48,)),
    ("cc-by-nc-sa-4.0", (49,)),
    ("cc-by-nd-4.0", (50,)),
    ("cc-by-nc-nd-4.0", (51,)),
    ("cc0-1.0", (52,)),
    ("bsd-3-clause", (53,)),
    ("bsd-2-clause", (54,)),
    ("isc", (55,)),
    ("mpl-2.0", (56,)),
    ("lgpl-3.0", (57,)),
    ("agpl-3.0", (58,)),
    ("epl-2.0", (59,)),
    ("gpl-2.0", (60,)),
    *((name, (k,)) for k, name in SPDX_LINES.values()),
]
KNOWN = SENTENCES | {line: k for line, (k, _) in SPDX_LINES.items()}


def telling(sentences) -> list[str]:
    """A few long words of which every sentence has one: a text without any of them holds no known sentence."""
    left, found = {frozenset(w for w in s.split() if len(w) >= 6) or frozenset(s.split()) for s in sentences}, []
    while left:
        words = sorted({w for s in left for w in s})
        found.append(max(words, key=lambda w: (sum(w in s for s in left), len(w))))
        left = {s for s in left if not any(found[-1] in w for w in s)}
    return found


#: Texts without any of these words need no marking.
HINT = "(?i)" + "|".join(telling(KNOWN))
#: How sentences on a licence begin, before the part that is known.
OPENING = r"(?:(?:this|the)\W+(?:project|software|work|code|file|program|library|package|document|content|repository)\W+is\W+)?"
#: Stands around known sentences; where a text has it, it counts as a blank.
MARK = "\x01"
#: A list number or bullet in front of a clause.
ITEM = r"(?:\(?[0-9a-z]{1,2}[.)][ \t]+)?"


#: A line that names a licence by its SPDX name, alone or in a comment.
SPDX_LINE = r"(?i)(^|[\n;])[^A-Za-z0-9\n;]*SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]*[A-Za-z0-9])(?=[^A-Za-z0-9\n]*(?:\n|$))"


def pattern(ids: tuple[int, ...]) -> str:
    """How a rule's identifiers look in a sequence: each between commas of its own, and a mark where other sentences stand."""
    return "".join("#" if i == GAP else f",{i}," for i in ids)


def _words(sentence: str) -> str:
    """A known sentence as notices print it: any case, wrapped, quoted, and with the marks at which the cut would part it."""
    return "[^A-Za-z0-9]++".join(sentence.split()) + (r"(?=\s+https?://|" if sentence.endswith(" at") else "(?=") + END + ")"


#: What stands between a known sentence and its end.
END = r"[^A-Za-z0-9\n;.!?:]*(?:$|[\n;]|[.!?:](?:\s|$))"


def verbatim() -> str:
    """A regular expression for all known sentences, longest first: group 1 is what stands before one, a later group its words.

    A sentence begins where one may, behind an opening or a list number that its kind allows, and ends where one may.
    """
    kinds: dict[str, list[str]] = {}
    for s in sorted(SENTENCES, key=len, reverse=True):
        kinds.setdefault(OPENING if s.startswith(("released under", "licensed under")) else ITEM if SENTENCES[s] >= 8 else "", []).append(_words(s))
    return rf"(?i)(^|[\n;]|[.!?:][ \t\r]+)[^A-Za-z0-9\n;]*(?:{'|'.join(f'{first}({chr(124).join(known)})' for first, known in kinds.items())})"


def pieces(text: Column) -> Column:
    """``text`` cut at what is known: at even places what stands between known sentences, at odd places these.

    One pass marks all of them, so the cost does not grow with their number times the text.
    """
    plain = F.translate(text, MARK, " ")
    lines = F.regexp_replace(plain, SPDX_LINE, f"$1{MARK}spdx license identifier $2{MARK}")
    whole = F.regexp_replace(lines, verbatim(), f"$1{MARK}$2$3$4{MARK}")
    return F.split(F.when(text.rlike(HINT), whole).otherwise(plain), MARK)


def sequence(text: Column) -> Column:
    """The licence sentences of a text as a string like ``,2,,10,#,7,``: identifiers in order, # where other sentences stand between."""
    known = F.create_map(*(F.lit(x) for k, v in KNOWN.items() for x in (k, f",{v},")))
    cut = lambda p: F.split(F.regexp_replace(p, r"([.!?:;])[ \t\r]+", "$1\n"), r"[\n;]+")
    sentences = F.flatten(F.transform(pieces(F.coalesce(text, F.lit(""))), lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(cut(p))))
    plain = F.transform(sentences, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    marks = F.transform(F.filter(plain, lambda s: s != ""), lambda s: F.coalesce(F.element_at(known, s), F.lit("#")))
    return F.regexp_replace(F.array_join(marks, ""), "#+", "#")


def scan(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with license_sequence, licenses (sorted names, comma-separated, empty if none) and n_notices (matches in all).

    Null and empty texts have no licences; columns of those names are replaced, all others kept; every row stays a row.
    """
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(pattern(ids)).alias("p")) for name, ids in sorted(RULES, key=lambda r: -len(r[1]))))
    start = F.struct(F.col("license_sequence").alias("rest"), F.array().cast("array<string>").alias("names"), F.lit(0).alias("n"))

    def step(state, rule):
        cut = F.replace(state["rest"], rule["p"], F.lit("#"))
        hits = ((F.length(state["rest"]) - F.length(cut)) / (F.length(rule["p"]) - 1)).cast("int")
        return F.struct(cut.alias("rest"), F.when(hits > 0, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"), (state["n"] + hits).alias("n"))

    (found,) = free(df.columns, "_found")
    out = df.withColumn("license_sequence", sequence(F.col(column)))
    out = out.withColumn(found, F.aggregate(rules, start, step))
    return out.withColumn("licenses", F.array_join(F.array_sort(F.array_distinct(f"{found}.names")), ",")).withColumn("n_notices", F.col(f"{found}.n")).drop(found)


def oracle() -> str:
    """The scan in DuckDB's SQL over ``documents``, without :func:`pieces`: it agrees where each known sentence stands unwrapped between cuts."""
    case = " ".join(f"WHEN s = '{k}' THEN ',{v},'" for k, v in KNOWN.items())
    seq = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), " + rf"s0 AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?:;])[ \t\r]+', '\1' || chr(10), 'g'), '[\n;]+'), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> ''), lambda s: CASE {case} ELSE '#' END), ''), '#+', '#', 'g') AS license_sequence FROM d)"
    steps, k = [], 0
    for k, (name, ids) in enumerate(sorted(RULES, key=lambda r: -len(r[1]))):
        before = "license_sequence AS rest, license_sequence, '' AS names, 0 AS n" if not k else "rest, license_sequence, names, n"
        p = pattern(ids)
        steps.append(f"s{k + 1} AS (SELECT doc_id, license_sequence, replace(rest, '{p}', '#') AS rest, names || CASE WHEN contains(rest, '{p}') THEN '{name},' ELSE '' END AS names, n + (length(rest) - length(replace(rest, '{p}', '#'))) // {len(p) - 1} AS n FROM (SELECT doc_id, {before} FROM s{k}))")
    return f"WITH {seq}, {', '.join(steps)} SELECT doc_id, license_sequence, array_to_string(list_sort(list_distinct(list_filter(string_split(names, ','), lambda x: x <> ''))), ',') AS licenses, n::INT AS n_notices FROM s{k + 1}"

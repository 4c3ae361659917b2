"""Every licence rule on its notice as it is published: unwrapped, wrapped, in a comment and with list numbers."""

import textwrap

from chronotext.llm import licenses

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT2 = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GPL2 = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
GPL3 = "See the GNU General Public License for more details."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");'
APACHE2, APACHE3 = "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
NOTICES = [
    ("bsd-3-clause", ",12,,13,,14,,15,", [BSD, BSD1, BSD2, BSD3]),
    ("gpl-3.0-or-later", ",16,,17,,18,", [GPL, f"{GPL2} {GPL3}"]),
    ("apache-2.0", ",2,,10,,11,#", [f"{APACHE} {APACHE2} {APACHE3}"]),
    ("bsd-2-clause", ",12,,13,,14,", [BSD, BSD1, BSD2]),
    ("mit", ",8,,9,", [MIT, MIT2]),
    ("apache-2.0", ",2,,10,", [f"{APACHE} {APACHE2}"]),
    ("gpl-3.0-or-later", ",16,,17,", [GPL, GPL2]),
    ("mit", ",1,", ["This project is licensed under the MIT License."]),
    ("apache-2.0", ",2,", ["This software is licensed under the Apache License, Version 2.0."]),
    ("gpl-3.0", ",3,", ["This work is licensed under the GNU General Public License, version 3."]),
    ("gpl-3.0-or-later", ",16,", [GPL]),
    ("cc-by-nc-4.0", ",4,", ["This work is licensed under CC BY-NC 4.0."]),
    ("cc-by-4.0", ",5,", ["Licensed under CC BY 4.0."]),
    ("cc-by-sa-4.0", ",6,", ["Licensed under CC BY-SA 4.0."]),
    ("mpl-2.0", ",19,", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."]),
    ("unlicense", ",20,", ["This is free and unencumbered software released into the public domain."]),
    ("mit", ",8,", [MIT]),
    ("all-rights-reserved", ",7,", ["All rights reserved."]),
]


def test_every_rule_on_its_notice(spark):
    assert [n for n, _, _ in NOTICES] == [n for n, _ in licenses.RULES[: len(NOTICES)]]
    forms = [lambda p: "\n".join(p), lambda p: " ".join(p), *(lambda p, w=w: "\n\n".join(textwrap.fill(x, w, break_on_hyphens=False) for x in p) for w in (30, 72, 80)), lambda p: "\n *\n".join(textwrap.indent(textwrap.fill(x, 70), " * ") for x in p)]
    cases = [(name, ids, f"A text.\n\n{form(parts)}\n\nMore.") for name, ids, parts in NOTICES for form in forms]
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, (name, ids, text) in enumerate(cases):
        assert (got[i].license_sequence, got[i].licenses, got[i].n_notices) == (f"#{ids.rstrip('#')}#", name, 1), text
    # The other rules on their sentences, one a paragraph; then lines with SPDX names in comments.
    said = {v: k for k, v in licenses.SENTENCES.items()}
    more = [(name, licenses.pattern(ids).replace("#", ""), ["http://x.org/licence" if i == licenses.GAP else said[i].capitalize() + ("" if said[i].endswith(" at") else ".") for i in ids]) for name, ids in licenses.RULES[len(NOTICES) :] if ids[0] < 100]
    assert len(more) > 30
    wide = [lambda p: "\n".join(p), lambda p: "\n\n".join(textwrap.fill(x, 50) for x in p)]
    cases = [(name, f"A text.\n\n{form(parts)}\n\nMore.") for name, _, parts in more for form in wide]
    cases += [(n.lower(), text.format(n)) for n in licenses.SPDX for text in ("// SPDX-License-Identifier: {}\nint x;", "/* SPDX-License-Identifier: {} */", "a\n# SPDX-License-Identifier:{}")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, (name, text) in enumerate(cases):
        assert (got[i].licenses, got[i].n_notices) == (name, 1), (text, got[i].license_sequence)
    assert licenses.scan(spark.createDataFrame([(1, "SPDX-License-Identifier: MIT OR Apache-2.0")], "doc_id long, text string")).first().licenses == ""
    # Part of a longer sentence is no notice.
    none = spark.createDataFrame([(1, "They said it was released under the MIT License of old."), (2, "Not all rights reserved.")], "doc_id long, text string")
    assert {r.licenses for r in licenses.scan(none).collect()} == {""}

from kpiforge.llm import licenses
from tests.llm.fixtures import EDGE, documents, edge, empty, python_nodes

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
       "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
       "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
       "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
       "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, "
       "fitness for a particular purpose and noninfringement.")
BSD3 = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n")
ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


def test_sequences_and_rule_order(spark):
    rows = [(1, "Intro text.\n" + MIT), (2, BSD3 + ENDORSE), (3, BSD3), (4, "Released under the MIT License. Licensed under the Apache License, Version 2.0."),
            (5, "RELEASED!! UNDER!! THE!! MIT!! LICENSE."), (6, "The license of this software is unclear."), (7, ENDORSE), (8, BSD3 + BSD3 + ENDORSE),
            (9, "Licensed under CC BY-NC 4.0."), (10, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert [got[i].licences for i in range(1, 11)] == ["MIT", "BSD-3-Clause", "BSD-2-Clause", "MIT,Apache-2.0", "MIT", "", "", "BSD-3-Clause,BSD-2-Clause", "CC-BY-NC-4.0", "GPL-3.0"]
    assert got[7].unmatched == "BSD-NO-ENDORSE" and got[1].sentence_ids == "MIT-GRANT MIT-NOTICE AS-IS"


MIT_FILE = """The MIT License (MIT)

Copyright (c) 2019 A. N. Other

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL_FILE = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
MPL_FILE = """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
APACHE_FILE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
ISC_FILE = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
BSD_FILE = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_notices_as_they_stand_in_files(spark):
    """Wrapped, behind comment signs, with line ends of both kinds."""
    files = [(MIT_FILE, "MIT"), (GPL_FILE, "GPL-3.0-or-later"), (GPL_FILE.replace("software:", "software;").replace("version 3", "version 2"), "GPL-2.0-or-later"),
             (MPL_FILE, "MPL-2.0"), (APACHE_FILE, "Apache-2.0"), (ISC_FILE, "ISC"), (BSD_FILE, "BSD-3-Clause")]
    dress = [lambda t: t, lambda t: t.replace("\n", "\r\n"), *[lambda t, p=p: "".join(p + line + "\n" for line in t.split("\n")) for p in ("# ", " * ", "//  ", "-- ")],
             lambda t: "import os\n" + t + "x = 1\n"]
    rows, want = [], []
    for t, name in files:
        for d in dress:
            rows.append((len(rows), d(t)))
            want.append(name)
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert [got[i].licences for i in range(len(rows))] == want
    assert all(got[i].unmatched == "" for i in range(len(rows)))
    assert got[0].sentence_ids == "MIT-GRANT MIT-NOTICE AS-IS NO-LIABILITY"


def test_every_known_sentence_is_found(spark):
    """Alone, wrapped after every fourth word, and not inside a longer one."""
    wrap = lambda s: "\n".join(" ".join(s.split()[i:i + 4]) for i in range(0, len(s.split()), 4))
    rows = [(i, t) for i, t in enumerate(f(s) for _, s in licenses.SENTENCES for f in (str, wrap, lambda s: "so " + s + " only.", lambda s: s[:len(s) // 2] + "\n\n" + s[len(s) // 2:]))]
    got = {r.doc_id: r.sentence_ids for r in licenses.scan(documents(spark, rows)).collect()}
    for n, (i, _) in enumerate(licenses.SENTENCES):
        assert got[4 * n] == got[4 * n + 1] == i
        assert i not in got[4 * n + 2].split() + got[4 * n + 3].split()


def test_long_runs(spark):
    """A million signs of one kind take no quadratic time."""
    rows = [(i, "MIT License" + c * 1_000_000 + "license") for i, c in enumerate(" \n.:*a")]
    got = {r.doc_id: r.licences for r in licenses.scan(documents(spark, rows)).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "", 4: "", 5: ""}


def test_native_and_edges(spark):
    assert python_nodes(licenses.scan(edge(spark))) == []
    got = licenses.scan(edge(spark)).collect()
    assert len(got) == len(EDGE) and all(r.n_licences == 0 for r in got)
    assert licenses.scan(empty(spark)).count() == 0

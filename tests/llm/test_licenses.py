"""Licence scans against the SQL version and on hand-made texts."""

import duckdb

from tallyscope.llm import licenses as L

DATA = "/root/testdata/sf0.01"


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, hit0 int")
    return {r.doc_id: (r.n_sentences, r.sentence_ids, r.n_matches, r.licenses) for r in L.scan(df).collect()}


GPL = (
    "This program is free software: you can redistribute it and/or modify\tit under the terms of the GNU General Public License as published by"
    " the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope"
    " that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    " You should have received a copy of the GNU General Public License along with this program."
)

ROWS = [
    (1, None),
    (2, ""),
    (3, "Prose. Released under the MIT License.\nMore prose."),
    (4, "Licensed under the Apache License, Version 2.0. LICENSED under the apache license, version 2.0!\nreleased under the mit license"),
    (5, "not licensed under the apache license version 2.0 but otherwise"),
    (6, GPL),
    (7, "You should have received a copy of the GNU General Public License along with this program. All rights reserved."),
    (8, "Licensed under CC BY-NC 4.0. " * 3000),
    (9, "This work is licensed under the GNU General Public License, version 3.\n\n\nx"),
    (10, "no such word at all. " * 2000),
]


def test_sentences_and_rules(spark):
    got = run(spark, ROWS)
    assert got[1] == got[2] == got[5] == got[10] == (0, "", 0, "")
    assert got[3] == (1, "mit-notice", 1, "MIT")
    assert got[4] == (3, "apache-grant,apache-grant,mit-notice", 3, "Apache-2.0,MIT")
    assert got[6] == (3, "gpl-3-grant,gpl-warranty,gpl-copy", 1, "GPL-3.0-or-later")
    assert got[7] == (2, "gpl-copy,all-rights", 1, "proprietary")
    assert got[8][0] == got[8][2] == 3000 and got[8][3] == "CC-BY-NC-4.0"
    assert got[9] == (1, "gpl-3-notice", 1, "GPL-3.0-only")
    assert run(spark, []) == {}


def sql(source):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS {source}")
    return {r[0]: tuple(r[1:]) for r in con.execute(L.oracle()).fetchall()}


def test_equals_sql(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).write.parquet(path)
    assert run(spark, ROWS) == sql(f"SELECT * FROM read_parquet('{path}/*.parquet')")
    got = {r[0]: tuple(r)[1:] for r in L.op7_licenses(spark, DATA).collect()}
    assert got == sql(f"SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    assert sum(n for n, *_ in got.values()) > 5


def test_every_known_sentence_has_a_needed_word_and_a_normal_form():
    for s in L.SENTENCES:
        assert any(w in s for w in L.NEEDED) and s == " ".join(s.split())
    assert set(L.SENTENCES.values()) >= {x for _, seq in L.RULES for x in seq}


APACHE = """/*
 * Copyright 2020 The Authors
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */"""

MIT = """MIT License

Copyright (c) 2020 Somebody

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

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""

GPL_WRAPPED = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_wrapped_texts_as_the_licences_have_them(spark):
    clauses = BSD.split("3. ")
    texts = [
        APACHE,
        MIT.replace("\n", "\r\n"),
        BSD,
        clauses[0] + clauses[1][clauses[1].index("THIS SOFTWARE"):],
        GPL_WRAPPED,
        "Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/\n",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + GPL_WRAPPED.replace("# ", ""),
        MIT[MIT.index("The above"):MIT.index("THE SOFTWARE IS")],
        "You may not use this file except in compliance with the License.",
        "released under\n\nthe MIT license",
    ]
    got = run(spark, list(enumerate(texts)))
    names = ["Apache-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause", "GPL-3.0-or-later", "Apache-2.0", "GPL-3.0-only", "MIT", "", ""]
    assert [got[i][3] for i in range(len(texts))] == names
    assert [got[i][2] for i in range(7)] == [1] * 7, got

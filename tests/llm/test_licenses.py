import re
import textwrap

import duckdb

from braidwork.llm import licenses as m

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."


def rows(df):
    return sorted((r.doc_id, r.family, r.license, r.kind, r.n_sentences) for r in m.recognise(df).collect())


def oracle(table):
    con = duckdb.connect()
    con.register("documents", table)
    return sorted(con.sql(m.oracle()).fetchall())


def test_matches_sql(documents):
    got = rows(documents)
    assert got == oracle(documents.toArrow()) and got


def test_ordered_rules(spark):
    texts = [MIT, "Intro.\n" + MIT + " All rights reserved.", ".\n".join(reversed(MIT.split(".\n\n"))), "Released under the MIT License. Licensed under the Apache License, Version 2.0.",
             "not Licensed under the Apache License, Version 2.0.", "LICENSED UNDER CC BY-NC 4.0!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(df) == [(0, "mit", "MIT", "text", 2), (1, "mit", "MIT", "text", 3), (1, "reserved", "All-Rights-Reserved", "notice", 3),
                        (3, "apache", "Apache-2.0", "notice", 2), (3, "mit", "MIT", "notice", 2), (5, "cc", "CC-BY-NC-4.0", "notice", 1)]
    assert rows(df) == oracle(df.toArrow())


def test_catalogue_is_normalised_and_used(spark):
    df = spark.createDataFrame([(i, s.replace("*", "Jo Doe and Sons")) for i, s in m.SENTENCES], "doc_id long, text string")
    ids = {r.doc_id: r.ids for r in df.select("doc_id", m.sentence_ids(df.text).alias("ids")).collect()}
    assert ids == {i: f"|{i}|" for i, _ in m.SENTENCES}
    assert {i for *_, rule in m.RULES for i in rule} <= set(ids)


def test_odd_rows(odd, empty):
    assert rows(odd) == [] and rows(empty) == []


def test_plan_has_no_python_and_no_shuffle(documents):
    plan = m.recognise(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def wrapped(text, width, prefix=""):
    return "\n\n".join("\n".join(prefix + line for line in textwrap.wrap(part, width)) for part in text.split("\n\n"))


def test_wrapped_texts(spark):
    by = dict(m.SENTENCES)
    bsd = by[401] + ":\n\n" + "\n\n".join(f"{k}. {by[i]}." for k, i in enumerate((402, 403, 404), 1))
    gpl = f"{by[303]}.\n\n{by[305]}. {by[306].capitalize()}."
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in\n# compliance with the License.\n# You may obtain a copy of the\n# License at\n#\n#  http://x\n#\n# See the License for the specific language governing permissions and\n# limitations under the License."
    cases = [(MIT, "mit", "MIT", "text", 2), (bsd, "bsd", "BSD-3-Clause", "text", 4), (by[701] + ".", "isc", "ISC", "text", 1), (gpl, "gpl", "GPL-3.0-or-later", "header", 3)]
    texts, want = ["# " + apache, "Licensed under the Apache License.\n\nVersion 2.0"], [(0, "apache", "Apache-2.0", "header", 4)]
    for text, *row in cases:
        for width, prefix in ((72, ""), (40, " * "), (79, "// "), (60, "# ")):
            want.append((len(texts), *row))
            texts.append(wrapped(text, width, prefix) + "\n\nint main() {}")
    texts.append(wrapped(MIT, 72).replace("\n", "\r\n"))
    want.append((len(texts) - 1, "mit", "MIT", "text", 2))
    assert rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")) == want


def test_marks_with_other_separators(spark):
    texts = ["All Rights\tReserved.", "This is free and unencumbered software released into the public-domain.", "all rights\n * reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(df) == [(0, "reserved", "All-Rights-Reserved", "notice", 1), (1, "unlicense", "Unlicense", "notice", 1), (2, "reserved", "All-Rights-Reserved", "notice", 1)]


PUBLISHED = {
    ("mit", "MIT", "text"): """Copyright (c) 2019 Jo Doe

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
SOFTWARE.""",
    ("bsd", "BSD-2-Clause", "text"): """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.""",
    ("bsd", "BSD-3-Clause", "text"): """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met: 1. Redistributions
   of source code must retain the above copyright notice, this list of conditions and the
   following disclaimer.
    * Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
    * Neither the name of Some Company Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""",
    ("gpl", "GPL-3.0-or-later", "header"): """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    ("gpl", "GPL-2.0-or-later", "header"): """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    ("lgpl", "LGPL-2.1-or-later", "header"): """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
    ("agpl", "AGPL-3.0-or-later", "header"): """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.""",
    ("mpl", "MPL-2.0", "header"): """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ("apache", "Apache-2.0", "header"): """Licensed under the Apache License, Version 2.0 (the "License"); you may
not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    ("isc", "ISC", "text"): """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.""",
    ("0bsd", "0BSD", "text"): """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.""",
    ("zlib", "Zlib", "text"): """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ("gpl", "GPL-3.0", "text"): """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.""",
    ("apache", "Apache-2.0", "text"): """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.""",
    ("cc0", "CC0-1.0", "text"): "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM",
    ("bsl", "BSL-1.0", "text"): "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge,",
    ("epl", "EPL-2.0", "notice"): "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS",
}


def test_published_texts(spark):
    texts, want = [], []
    for (family, name, kind), text in PUBLISHED.items():
        for prefix, open_, close in (("", "", ""), ("# ", "#!/bin/sh\n", "\n\nset -e"), (" * ", "/*\n", "\n */\nint x;"), ("// ", "", "\ncode();"), (";; ", "", "")):
            want.append((len(texts), family, name, kind))
            texts.append(open_ + "\n".join((prefix + line).rstrip() if prefix != " * " else prefix + line for line in text.split("\n")) + close)
        want.append((len(texts), family, name, kind))
        texts.append(text.replace("\n", "\r\n"))
    got = rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r[:4] for r in got] == want


def test_every_rule_has_a_marked_sentence():
    by = dict(m.SENTENCES)
    assert all(any(re.search(m.MARKS, by[i]) for i in ids) for *_, ids in m.RULES)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, MIT)], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as found", "'x' as family", "3 as license")
    assert rows(df) == [(1, "mit", "MIT", "text", 2)]


def test_small_letters_after_a_full_stop(spark):
    """A sentence may begin or end there, and may go on over it."""
    texts = ["some words. licensed under the mit license", "Released under the MIT License. and more", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "by 1999. All rights reserved. 12 more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r[:3] for r in rows(df)] == [(0, "mit", "MIT"), (1, "mit", "MIT"), (2, "mpl", "MPL-2.0"), (3, "reserved", "All-Rights-Reserved")]
    assert rows(df) == oracle(df.toArrow())

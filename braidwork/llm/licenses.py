"""License recognition by sentence rules, with SQL functions only.

A text is normalised (A-Z lower-cased, all but letters, digits and sentence
ends become single spaces) and split at line ends, after . ! ? before anything
but a small letter or a digit, and at the marks of list items.  What is a known
licence sentence, on a line of its own or over neighbouring lines, becomes its
identifier; the rest vanishes.  Other . ! ? before a space count as line ends.  Blank lines, list marks and sentence ends are
never joined over, and comment signs at the start of a line do not count.  A
sentence may leave room for the name of an organisation.  Each licence is an ordered rule: a list of
identifiers that must follow one another in that sequence, with other known
sentences allowed between.  Rules of the same family are ordered from specific
to general, and the first that matches stands for its family.

The catalogue is a constant of this module, so nothing is broadcast that grows
with the data, and a document is handled alone: no shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Sentences of public licences and of their usual notices, normalised.
SENTENCES: tuple[tuple[int, str], ...] = (
    (101, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    (102, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (103, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    (108, "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    (109, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    (110, "the mit license"),
    (111, "the mit license mit"),
    (112, "spdx license identifier mit"),
    (104, "released under the mit license"),
    (105, "licensed under the mit license"),
    (106, "this project is licensed under the mit license"),
    (107, "mit license"),
    (201, "licensed under the apache license version 2 0"),
    (202, "licensed under the apache license version 2 0 the license"),
    (203, "you may not use this file except in compliance with the license"),
    (204, "you may obtain a copy of the license at"),
    (205, "see the license for the specific language governing permissions and limitations under the license"),
    (206, "spdx license identifier apache 2 0"),
    (207, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    (208, "apache license version 2 0 january 2004"),
    (209, "terms and conditions for use reproduction and distribution"),
    (210, "apache license version 2 0"),
    (301, "this work is licensed under the gnu general public license version 3"),
    (302, "this work is licensed under the gnu general public license version 2"),
    (303, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (304, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    (305, "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    (306, "see the gnu general public license for more details"),
    (307, "gnu general public license version 3 29 june 2007"),
    (308, "gnu general public license version 2 june 1991"),
    (309, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    (310, "you should have received a copy of the gnu general public license along with this program"),
    (311, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    (312, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license"),
    (313, "spdx license identifier gpl 3 0 or later"),
    (314, "spdx license identifier gpl 2 0 or later"),
    (315, "spdx license identifier gpl 3 0 only"),
    (316, "spdx license identifier gpl 2 0 only"),
    (321, "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    (322, "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (323, "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (324, "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    (325, "see the gnu lesser general public license for more details"),
    (326, "gnu lesser general public license version 2 1 february 1999"),
    (327, "gnu lesser general public license version 3 29 june 2007"),
    (328, "spdx license identifier lgpl 2 1 or later"),
    (329, "spdx license identifier lgpl 3 0 or later"),
    (331, "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (332, "see the gnu affero general public license for more details"),
    (333, "gnu affero general public license version 3 19 november 2007"),
    (334, "spdx license identifier agpl 3 0 or later"),
    (401, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (402, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (403, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    (404, "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (405, "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (406, "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission"),
    (407, "neither the name of * nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (408, "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    (409, "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    (410, "spdx license identifier bsd 2 clause"),
    (411, "spdx license identifier bsd 3 clause"),
    (412, "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    (501, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (502, "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    (503, "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    (504, "mozilla public license version 2 0"),
    (505, "spdx license identifier mpl 2 0"),
    (511, "eclipse public license v 2 0"),
    (512, "eclipse public license v 1 0"),
    (513, "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    (514, "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html"),
    (515, "spdx license identifier epl 2 0"),
    (521, "boost software license version 1 0 august 17th 2003"),
    (522, "distributed under the boost software license version 1 0"),
    (523, "spdx license identifier bsl 1 0"),
    (531, "this software is provided as is without any express or implied warranty"),
    (532, "in no event will the authors be held liable for any damages arising from the use of this software"),
    (533, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    (534, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (535, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (536, "this notice may not be removed or altered from any source distribution"),
    (537, "spdx license identifier zlib"),
    (607, "this work is licensed under the creative commons attribution 4 0 international license"),
    (608, "this work is licensed under the creative commons attribution sharealike 4 0 international license"),
    (609, "this work is licensed under the creative commons attribution noncommercial 4 0 international license"),
    (611, "cc0 1 0 universal"),
    (612, "creative commons legal code"),
    (613, "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    (614, "you should have received a copy of the cc0 public domain dedication along with this software"),
    (615, "spdx license identifier cc0 1 0"),
    (601, "licensed under cc by nc 4 0"),
    (602, "licensed under cc by 4 0"),
    (603, "licensed under cc by sa 4 0"),
    (604, "this work is licensed under a creative commons attribution 4 0 international license"),
    (605, "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    (606, "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    (701, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (702, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (703, "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    (704, "spdx license identifier isc"),
    (705, "spdx license identifier 0bsd"),
    (706, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (801, "this is free and unencumbered software released into the public domain"),
    (901, "all rights reserved"),
)
#: (family, rank in it, licence, kind, identifiers in order)
RULES: tuple[tuple[str, int, str, str, tuple[int, ...]], ...] = (
    ("mit", 1, "MIT", "text", (101, 102, 103)),
    ("mit", 2, "MIT", "text", (101, 102)),
    ("mit", 7, "MIT", "notice", (110,)),
    ("mit", 8, "MIT", "notice", (111,)),
    ("mit", 9, "MIT", "notice", (112,)),
    ("mit0", 1, "MIT-0", "text", (109, 103)),
    ("mit", 3, "MIT", "notice", (104,)),
    ("mit", 4, "MIT", "notice", (105,)),
    ("mit", 5, "MIT", "notice", (106,)),
    ("mit", 6, "MIT", "notice", (107,)),
    ("apache", 1, "Apache-2.0", "header", (202, 203, 204, 205)),
    ("apache", 2, "Apache-2.0", "header", (202, 203)),
    ("apache", 3, "Apache-2.0", "notice", (201,)),
    ("apache", 4, "Apache-2.0", "notice", (206,)),
    ("apache", 5, "Apache-2.0", "text", (208, 209)),
    ("apache", 6, "Apache-2.0", "notice", (208,)),
    ("apache", 7, "Apache-2.0", "notice", (210,)),
    ("gpl", 7, "GPL-3.0", "text", (307, 309)),
    ("gpl", 8, "GPL-2.0", "text", (308, 309)),
    ("gpl", 9, "GPL-2.0-only", "header", (311,)),
    ("gpl", 10, "GPL-3.0-only", "header", (312,)),
    ("gpl", 11, "GPL-3.0-or-later", "notice", (313,)),
    ("gpl", 12, "GPL-2.0-or-later", "notice", (314,)),
    ("gpl", 13, "GPL-3.0-only", "notice", (315,)),
    ("gpl", 14, "GPL-2.0-only", "notice", (316,)),
    ("lgpl", 1, "LGPL-2.1-or-later", "header", (321, 324, 325)),
    ("lgpl", 2, "LGPL-3.0-or-later", "header", (322, 324, 325)),
    ("lgpl", 3, "LGPL-3.0-or-later", "header", (323, 305, 325)),
    ("lgpl", 4, "LGPL-2.1-or-later", "notice", (321,)),
    ("lgpl", 5, "LGPL-3.0-or-later", "notice", (322,)),
    ("lgpl", 6, "LGPL-3.0-or-later", "notice", (323,)),
    ("lgpl", 7, "LGPL-2.1", "text", (326, 309)),
    ("lgpl", 8, "LGPL-3.0", "text", (327, 309)),
    ("lgpl", 9, "LGPL-2.1-or-later", "notice", (328,)),
    ("lgpl", 10, "LGPL-3.0-or-later", "notice", (329,)),
    ("agpl", 1, "AGPL-3.0-or-later", "header", (331, 305, 332)),
    ("agpl", 2, "AGPL-3.0-or-later", "notice", (331,)),
    ("agpl", 3, "AGPL-3.0", "text", (333, 309)),
    ("agpl", 4, "AGPL-3.0-or-later", "notice", (334,)),
    ("gpl", 1, "GPL-3.0-or-later", "header", (303, 305, 306)),
    ("gpl", 2, "GPL-2.0-or-later", "header", (304, 305, 306)),
    ("gpl", 3, "GPL-3.0-or-later", "notice", (303,)),
    ("gpl", 4, "GPL-2.0-or-later", "notice", (304,)),
    ("gpl", 5, "GPL-3.0-only", "notice", (301,)),
    ("gpl", 6, "GPL-2.0-only", "notice", (302,)),
    ("bsd", 1, "BSD-4-Clause", "text", (401, 402, 403, 412)),
    ("bsd", 2, "BSD-3-Clause", "text", (401, 402, 403, 404)),
    ("bsd", 3, "BSD-3-Clause", "text", (401, 402, 403, 405)),
    ("bsd", 4, "BSD-3-Clause", "text", (401, 402, 403, 406)),
    ("bsd", 5, "BSD-3-Clause", "text", (401, 402, 403, 407)),
    ("bsd", 6, "BSD-2-Clause", "text", (401, 402, 403)),
    ("bsd", 7, "BSD-3-Clause", "notice", (411,)),
    ("bsd", 8, "BSD-2-Clause", "notice", (410,)),
    ("mpl", 1, "MPL-2.0", "header", (501, 502)),
    ("mpl", 2, "MPL-2.0", "header", (501, 503)),
    ("mpl", 3, "MPL-2.0", "notice", (501,)),
    ("mpl", 4, "MPL-2.0", "notice", (504,)),
    ("mpl", 5, "MPL-2.0", "notice", (505,)),
    ("epl", 1, "EPL-2.0", "header", (513,)),
    ("epl", 2, "EPL-1.0", "header", (514,)),
    ("epl", 3, "EPL-2.0", "notice", (511,)),
    ("epl", 4, "EPL-1.0", "notice", (512,)),
    ("epl", 5, "EPL-2.0", "notice", (515,)),
    ("bsl", 1, "BSL-1.0", "text", (521,)),
    ("bsl", 2, "BSL-1.0", "notice", (522,)),
    ("bsl", 3, "BSL-1.0", "notice", (523,)),
    ("zlib", 1, "Zlib", "text", (531, 532, 533, 534, 535, 536)),
    ("zlib", 2, "Zlib", "notice", (533,)),
    ("zlib", 3, "Zlib", "notice", (537,)),
    ("cc0", 1, "CC0-1.0", "text", (612, 611)),
    ("cc0", 2, "CC0-1.0", "notice", (613,)),
    ("cc0", 3, "CC0-1.0", "notice", (614,)),
    ("cc0", 4, "CC0-1.0", "notice", (611,)),
    ("cc0", 5, "CC0-1.0", "notice", (615,)),
    ("cc", 1, "CC-BY-NC-4.0", "notice", (601,)),
    ("cc", 2, "CC-BY-NC-4.0", "notice", (605,)),
    ("cc", 3, "CC-BY-SA-4.0", "notice", (603,)),
    ("cc", 4, "CC-BY-SA-4.0", "notice", (606,)),
    ("cc", 5, "CC-BY-NC-4.0", "notice", (609,)),
    ("cc", 6, "CC-BY-SA-4.0", "notice", (608,)),
    ("cc", 7, "CC-BY-4.0", "notice", (602,)),
    ("cc", 8, "CC-BY-4.0", "notice", (604,)),
    ("cc", 9, "CC-BY-4.0", "notice", (607,)),
    ("isc", 1, "ISC", "text", (701,)),
    ("isc", 2, "ISC", "text", (706,)),
    ("isc", 3, "ISC", "notice", (704,)),
    ("0bsd", 1, "0BSD", "text", (702, 703)),
    ("0bsd", 2, "0BSD", "notice", (702,)),
    ("0bsd", 3, "0BSD", "notice", (705,)),
    ("unlicense", 1, "Unlicense", "notice", (801,)),
    ("reserved", 1, "All-Rights-Reserved", "notice", (901,)),
)
#: What every rule has in one of its sentences; texts without any are not split.
MARKS = "licen[cs]e|permission|warrant|copyright|redistribut|public[^a-z0-9]+domain|rights[^a-z0-9]+reserved|gnu[^a-z0-9]+(?:lesser|affero)?[^a-z0-9]*general|without[^a-z0-9]+any[^a-z0-9]+express|cc0|spdx"
#: A part of each of these marks, looked for first, as plain strings are found faster than patterns.
PARTS = ("licen", "permission", "warrant", "copyright", "redistribut", "domain", "reserved", "general", "express", "cc0", "spdx")


#: What stands for the name of an organisation, which sentences have as *.
NAME = "(?:[a-z0-9]+[ \n]){0,11}?[a-z0-9]+"


def _pattern(sentence: str) -> str:
    return sentence.replace(" ", "[ \n]").replace("*", NAME)


def _alternatives() -> str:
    """All sentences, the longest first where they begin with the same word, so that a text is held against few of them."""
    by: dict[str, list[str]] = {}
    for _, x in SENTENCES:
        by.setdefault(x.split(" ")[0], []).append(x)
    return "|".join(f"{word}(?:{'|'.join(_pattern(x[len(word):]) for x in sorted(own, key=len, reverse=True))})" for word, own in by.items())


#: A known sentence from the start of a line to the end of one; its words may be on several lines.
KNOWN = rf"(?<![^\n])(?:{_alternatives()})(?![^\n])"
#: Marks of list items: at the start of a line, or before a capital.
_MARK = r"(?:\([0-9a-z]{1,2}\)|[0-9]{1,2}[.)]|[a-z]\))[ \t]+"
ITEM = rf"(?m:^)[ \t*#/;!-]{{0,20}}{_MARK}|(?<![^\s*#/;!-]){_MARK}(?=[A-Z])"


def pieces(text: Column) -> Column:
    """The normalised lines of a text, with an empty line where a sentence ends."""
    listed = F.regexp_replace(text, ITEM, "\n\n")
    lines = F.regexp_replace(listed, r"([.!?])[ \t\r\n]+(?![ \t\r\na-z0-9])", "$1\n\n")
    lines = F.regexp_replace(lines, r'([.!?]|"\);)[ \t]+', "$1\n")  # a line may end there, as in v. 2.0
    plain = F.regexp_replace(F.translate(lines, UPPER, LOWER), r"[^a-z0-9\n]+", " ")
    return F.trim(F.regexp_replace(plain, " ?\n ?", "\n"))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order, as '|101|102|'; '|' if there are none."""
    known = F.array(*(F.lit(x) for _, x in SENTENCES))
    ids = F.array(*(F.lit(str(i)) for i, _ in SENTENCES))

    def identify(found: Column) -> Column:
        line = F.translate(found, "\n", " ")
        at = F.array_position(known, line).cast("int")
        out = F.when(at > 0, F.get(ids, at - 1))
        for i, x in SENTENCES:
            if "*" in x:
                out = out.when(line.rlike(f"^{x.replace('*', '.*')}$"), F.lit(str(i)))
        return out

    found = F.transform(F.regexp_extract_all(pieces(text), F.lit(KNOWN), F.lit(0)), identify)
    return F.when(F.size(found) > 0, F.concat(F.lit("|"), F.array_join(found, "|"), F.lit("|"))).otherwise(F.lit("|"))


def _follows(sequence: Column, ids: tuple[int, ...]) -> Column:
    return sequence.like("%" + "".join(f"|{i}|%" if k == 0 else f"{i}|%" for k, i in enumerate(ids))) if len(ids) == 1 else sequence.rlike(r"\|" + r"\|(?:[0-9]+\|)*".join(map(str, ids)) + r"\|")


def _has_mark(text: Column) -> Column:
    some = text.contains(PARTS[0])
    for part in PARTS[1:]:
        some |= text.contains(part)
    return F.coalesce(some & text.rlike(MARKS), F.lit(False))


def recognise(docs: DataFrame) -> DataFrame:
    """doc_id, family, license, kind, n_sentences: a row for each licence family found in each row of docs.

    n_sentences counts the known sentences of the text.  Null and empty texts
    have none.  Repeated rows give repeated results; other columns are ignored.
    """
    # in an array of one, so that the text is put in small letters once
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.exists(F.array(F.translate("text", UPPER, LOWER)), _has_mark))
    sequenced = marked.select("doc_id", sentence_ids(F.col("text")).alias("ids")).where("ids <> '|'")
    families: dict[str, Column] = {}
    for family, _, name, kind, ids in sorted(RULES, key=lambda r: -r[1]):  # the first rule of a family wins
        hit = F.struct(F.lit(family).alias("family"), F.lit(name).alias("license"), F.lit(kind).alias("kind"))
        families[family] = F.when(_follows(F.col("ids"), ids), hit).otherwise(families.get(family, F.lit(None)))
    found = F.filter(F.array(*(families[f] for f in sorted(families))), lambda x: x.isNotNull())
    count = (F.length("ids") - F.length(F.replace("ids", F.lit("|"))) - 1).cast("int")
    return sequenced.withColumn("found", F.explode(found)).select("doc_id", "found.family", "found.license", "found.kind", count.alias("n_sentences"))


def oracle() -> str:
    """The same in DuckDB SQL over `documents`, for sentences on one line each: lines are joined to the catalogue instead of searched for it."""
    values = ", ".join(f"({i}, '{x}')" for i, x in SENTENCES)
    rules = ", ".join(f"('{f}', {r}, '{n}', '{k}', '|{'|%|'.join(map(str, ids))}|', [{', '.join(map(str, ids))}])" for f, r, n, k, ids in RULES)
    return f"""
WITH RECURSIVE known(id, sentence) AS (VALUES {values}),
rules(family, rnk, license, kind, pattern, needs) AS (VALUES {rules}),
rows_ AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
split AS (SELECT rid, doc_id, string_split(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([vV])[.] ([0-9])', '\\1 \\2', 'g'), '(^|\\n)([ \\t*#/;!-]*)(\\([0-9a-z]{{1,2}}\\)|[0-9]{{1,2}}[.)]|[a-z]\\))[ \\t]+', '\\1\\2' || chr(10), 'g'),
  '(^|[\\s*#/;!-])(\\([0-9a-z]{{1,2}}\\)|[0-9]{{1,2}}[.)]|[a-z]\\))[ \\t]+([A-Z])', '\\1' || chr(10) || '\\3', 'g'), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS ls FROM rows_),
lines AS (SELECT rid, doc_id, trim(unnest(ls), ' ') AS line, generate_subscripts(ls, 1) AS pos FROM split),
met AS (SELECT rid, doc_id, pos, id FROM lines JOIN known ON line = sentence
  UNION ALL SELECT rid, doc_id, pos, id FROM lines JOIN known ON contains(sentence, '*') AND line LIKE replace(sentence, '*', '%') AND line NOT IN (SELECT sentence FROM known)
    AND len(string_split(line, ' ')) - len(string_split(sentence, ' ')) BETWEEN 0 AND 11),
sequences AS (SELECT rid, any_value(doc_id) AS doc_id, list(id ORDER BY pos) AS ids, count(*) AS n FROM (SELECT rid, any_value(doc_id) AS doc_id, pos, min(id) AS id FROM met GROUP BY rid, pos) GROUP BY rid),
steps(rid, doc_id, n, family, rnk, license, kind, needs, rest) AS (
  SELECT rid, doc_id, n, family, rnk, license, kind, needs, ids FROM sequences, rules WHERE list_has_all(ids, needs)
  UNION ALL SELECT rid, doc_id, n, family, rnk, license, kind, needs[2:], rest[list_position(rest, needs[1]) + 1:] FROM steps WHERE len(needs) > 0 AND list_contains(rest, needs[1])),
hits AS (SELECT *, row_number() OVER (PARTITION BY rid, family ORDER BY rnk) AS k FROM steps WHERE len(needs) = 0)
SELECT doc_id, family, license, kind, CAST(n AS INTEGER) AS n_sentences FROM hits WHERE k = 1"""

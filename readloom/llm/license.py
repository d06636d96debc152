"""Licence recognition by sentence rules.

A text is cut into lines and sentences, which are normalised; a known sentence of a licence notice
is found where its words begin at such a cut and end at one, whatever cuts are between them (line
ends of a hard-wrapped notice, a colon, a blank line before an address).  What comes out is the
sequence of identifiers, and a rule recognises a licence where its own sequence stands in it, in
order, with at most ``GAP`` other sentences between neighbours.  A rule whose sequence another one
holds stands only where no match of the other begins at the same sentence, so that the notice of
BSD-3-Clause isn't one of BSD-2-Clause as well.  Sentences that name a holder are patterns, and an
SPDX tag is a sentence that names its licences itself.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import common

GAP = 2

# Sentences of public licence notices, normalised, by identifier.
SENTENCES: dict[str, list[str]] = {
    "apache-by": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license 2.0"],
    "apache-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-by": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied"],
    "gpl3-by": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "cc-by-nc-by": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "bsd-redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "all-rights": ["all rights reserved"],
}

# The same notices as published, where they go on or are spelt otherwise.
PUBLISHED: dict[str, list[str]] = {
    "apache-copy": ["you may obtain a copy of the license at http www.apache.org licenses license 2.0", "you may obtain a copy of the license at https www.apache.org licenses license 2.0"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
}

# Sentences of further notices, as published.
NOTICES: dict[str, list[str]] = {
    "gpl2-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl2-only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."],
    "gpl3-only": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."],
    "lgpl21-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "library-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "mpl2-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "zero-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "isc-disclaim": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "boost-grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "boost-by": ["Distributed under the Boost Software License, Version 1.0."],
    "unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc0-dedicated": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "cc0-warranty": ["This software is distributed without any warranty."],
    "cc-by-sa-by": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nd-by": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."],
    "cc-by-nc-sa-by": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "cc-by-3-by": ["This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "This work is licensed under the Creative Commons Attribution 3.0 Unported License."],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-granted": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "wtfpl-everyone": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "epl2-available": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "postgres-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "ofl-by": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "mit0-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'],
}

# Headings of full licence texts, as published.
HEADINGS: dict[str, list[str]] = {
    "gpl3-text": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-text": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "lgpl3-text": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-text": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "agpl3-text": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "apache-text": ["Apache License Version 2.0, January 2004"],
    "mpl2-text": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "epl2-text": ["Eclipse Public License - v 2.0"],
    "boost-text": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "cc0-text": ["Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal"],
    "ofl-text": ["SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"],
    "wtfpl-text": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"],
    "cc-by-text": ["Creative Commons Attribution 4.0 International Public License"],
    "cc-by-sa-text": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "cc-by-nd-text": ["Creative Commons Attribution-NoDerivatives 4.0 International Public License"],
    "cc-by-nc-text": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "cc-by-nc-sa-text": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License"],
}

# Sentences with a name in them, as published; * stands for a name of at most ``NAME`` words (none: a name in other letters, which normal forms lack).
NAMED: dict[str, list[str]] = {
    "bsd-endorse": [
        "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of * nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of * nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "The name of * may not be used to endorse or promote products derived from this software without specific prior written permission.",
        "The names of * may not be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsd-advertise": [
        "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by *.",
        "All advertising materials mentioning features or use of this software must display the following acknowledgment: This product includes software developed by *.",
    ],
}
NAME = 16

# Licences and the sequences that stand for them; each sequence is a rule of its own.
RULES: list[tuple[str, list[str]]] = [
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-3.0-only", ["gpl3-only"]),
    ("LGPL-2.1-or-later", ["lgpl21-later", "library-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-later", "gpl-hope"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("ISC", ["isc-grant", "isc-disclaim"]),
    ("0BSD", ["zero-grant", "isc-disclaim"]),
    ("BSL-1.0", ["boost-by"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("CC0-1.0", ["cc0-dedicated", "cc0-warranty"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-by"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-by"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-by"]),
    ("CC-BY-3.0", ["cc-by-3-by"]),
    ("Zlib", ["zlib-as-is", "zlib-granted"]),
    ("WTFPL", ["wtfpl-everyone"]),
    ("EPL-2.0", ["epl2-available"]),
    ("PostgreSQL", ["postgres-grant"]),
    ("OFL-1.1", ["ofl-by"]),
    ("MIT-0", ["mit0-grant", "as-is"]),
    ("Apache-2.0", ["apache-by"]),
    ("Apache-2.0", ["apache-comply", "apache-copy"]),
    ("MIT", ["mit-by"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("GPL-3.0", ["gpl3-by"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-by"]),
    ("CC-BY-4.0", ["cc-by-by"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-4-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse"]),
    ("GPL-3.0", ["gpl3-text"]),
    ("GPL-2.0", ["gpl2-text"]),
    ("LGPL-3.0", ["lgpl3-text"]),
    ("LGPL-2.1", ["lgpl21-text"]),
    ("AGPL-3.0", ["agpl3-text"]),
    ("Apache-2.0", ["apache-text"]),
    ("MPL-2.0", ["mpl2-text"]),
    ("EPL-2.0", ["epl2-text"]),
    ("BSL-1.0", ["boost-text"]),
    ("CC0-1.0", ["cc0-text"]),
    ("OFL-1.1", ["ofl-text"]),
    ("WTFPL", ["wtfpl-text"]),
    ("CC-BY-4.0", ["cc-by-text"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-text"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-text"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-text"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-text"]),
]

# Licences that only a tag names here, and tags whose licence has another name above.
TAGS = ["LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "Artistic-2.0", "CC-BY-SA-3.0", "CDDL-1.0", "EPL-1.0", "GPL-1.0-or-later", "MPL-1.1", "NCSA", "Python-2.0", "BSD-1-Clause"]

_DROP = r"[^0-9a-z.]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(sentence: str) -> str:
    """A sentence as the words that ``tidied`` leaves of it."""
    return re.sub(r"[^0-9a-z.]+", " ", re.sub(r"[.;:!?]+(?=\s|$)", " ", sentence.lower())).strip(" .")


_KNOWN = {plain(x): name for table in (SENTENCES, PUBLISHED, NOTICES, HEADINGS) for name, texts in table.items() for x in texts}
_TAG = "spdx license identifier"
_LICENCES = {plain(x): x for x in sorted({name for name, _ in RULES} | set(TAGS))}


def _loose(words: str) -> str:
    """A pattern of these words with any cut between them, a name for *."""
    return words.replace(".", "[.]").replace(" ", "[ |_]").replace("[ |_]*", f"(?:[ |_][^ |_]++){{0,{NAME}}}?")


# sentences with names, as patterns; plain() would drop the star
_NAMED = {_loose(" * ".join(plain(part) for part in x.split("*")).strip(" .")): name for name, texts in NAMED.items() for x in texts}
# a tag up to its line's end; then a longer sentence before its own beginning; between words may be any cut
_FIND = "(?<=[|_])(?:" + "|".join([_loose(_TAG) + "[ |_]++[0-9a-z. ]++", *_NAMED, *[_loose(x) for x in sorted(_KNOWN, key=len, reverse=True)]]) + ")(?=[|_])"
# a longer licence before its own beginning: gpl 2.0 or later, gpl 2.0
_LICENCE = r"(?<![0-9a-z.])(?:" + "|".join(x.replace(".", "[.]") for x in sorted(_LICENCES, key=len, reverse=True)) + r")(?![0-9a-z.])"


def _holds(longer: list[str], shorter: list[str]) -> bool:
    """Whether a rule's sequence has a shorter one in it, in order and from the same first sentence."""
    rest = iter(longer)
    return len(longer) > len(shorter) and longer[0] == shorter[0] and all(x in rest for x in shorter)


def tidied(text):
    """Normal forms in a row, | before, between and after sentences, _ for a line's end inside one.

    A-Z are lower-cased; what is neither a letter, a digit nor a dot becomes one space; none at the
    ends.  A full stop inside a word (4.0) doesn't end a sentence, so dots stay, but none at an end.
    The lookbehinds keep long runs of dots from being tried again from each of their dots.
    """
    text = F.translate(F.coalesce(text, F.lit("")), _UPPER + "|", _LOWER + "/")
    text = F.regexp_replace(text, r"(?<![.;:!?])[.;:!?]+(?=\s|$)", "|")
    text = F.regexp_replace(F.concat(F.lit("|"), text, F.lit("|")), r"[^0-9a-z.\n|]+", " ")
    text = F.regexp_replace(text, r"(?<=[0-9a-z]) ?\n ?(?=[0-9a-z])", "_")
    return F.regexp_replace(text, r"(?<![. \n|])[. \n|]*[\n|] *", "|")


def sequences(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids): one row a row of ``df``; ids holds (at, sentence, id) of each known sentence.

    Sentences end at . ; : ! ? before white space or the end, or at a blank line; ``sentence`` counts
    them from 0, ``at`` also counts the lines in them, a known sentence once.  Those without a letter
    or digit aren't counted.  Known sentences are found from the left, the longest first, and don't
    overlap; the id of a tag is ``spdx:`` and its words.  A null text has none.
    """
    known = F.create_map(*[F.lit(x) for pair in _KNOWN.items() for x in pair])
    # a plus would be lost with other signs: GPL-2.0+
    tags = F.when(F.contains(text, F.lit("SPDX-License-Identifier")), F.regexp_replace(text, r"(?<=[A-Za-z]-[0-9][.][0-9])[+]", "-or-later")).otherwise(F.col(text))
    marked = F.regexp_replace(tidied(tags), _FIND, "#$0#")  # every second part is a known sentence then

    def name(x):
        words = F.translate(x, "|_", "  ")
        tag = F.when(F.startswith(words, F.lit(_TAG)), F.concat(F.lit("spdx:"), F.substring(words, len(_TAG) + 2, 1 << 20)))
        return F.coalesce(tag, F.try_element_at(known, words), *[F.when(F.rlike(x, F.lit(f"^(?:{pattern})$")), F.lit(of)) for pattern, of in _NAMED.items()])

    named = F.transform(F.split("marked", "#", -1), lambda x, i: F.when(i % 2 == 0, x).otherwise(F.concat(F.lit("="), name(x))))
    lines = F.transform(F.split(F.btrim(F.array_join(named, ""), F.lit("|")), "[|]", -1), lambda s, k: F.transform(F.split(s, "_", -1), lambda x: F.struct(k.cast("int").alias("sentence"), x.alias("x"))))
    counted = F.transform(F.flatten(lines), lambda y, i: F.struct(i.cast("int").alias("at"), y["sentence"].alias("sentence"), F.when(F.startswith(y["x"], F.lit("=")), F.substring(y["x"], 2, 1 << 20)).alias("id")))
    rows = df.select(F.col(doc_id).alias("doc_id"), marked.alias("marked"))
    none = F.array().cast("array<struct<at:int,sentence:int,id:string>>")
    return rows.select("doc_id", F.when(F.contains("marked", F.lit("#")), F.filter(counted, lambda x: x["id"].isNotNull())).otherwise(none).alias("ids"))


def _starts(ids, rule: list[str]):
    """The first sentences (of ``ids``) of the rule's matches: its identifiers in order, neighbours at most GAP sentences or lines apart."""
    places = lambda name: F.filter(ids, lambda x: x["id"] == name)

    def before(later, name: str):
        near = lambda p, q: (q["at"] <= p["at"] + GAP + 1) | (q["sentence"] <= p["sentence"] + GAP + 1)
        return F.filter(places(name), lambda p: F.exists(later, lambda q: (p["at"] < q["at"]) & near(p, q)))

    return reduce(before, rule[-2::-1], places(rule[-1]))


def _matched(ids, rule: list[str]):
    """Whether the rule has a match that isn't the beginning of one of a rule that holds it."""
    longer = [_starts(ids, other) for _, other in RULES if _holds(other, rule)]
    return F.size(reduce(F.array_except, longer, _starts(ids, rule))) > 0


def licences(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids, licences): the known sentences of each whole text, and the licences that a rule recognises or a tag names, sorted.

    Of a tag's expression all licences known here are given, whether AND or OR joins them.
    Rows repeat as in ``df``; a null doc_id stays null; null and empty texts have no licence; other
    columns are not read.
    """
    found = sequences(df, text, doc_id)
    names = [F.when(_matched(F.col("ids"), rule), F.lit(name)) for name, rule in RULES]
    known = F.create_map(*[F.lit(x) for pair in _LICENCES.items() for x in pair])
    tags = F.filter("ids", lambda x: F.startswith(x["id"], F.lit("spdx:")))
    tagged = F.transform(F.flatten(F.transform(tags, lambda x: F.regexp_extract_all(F.substring(x["id"], 6, 1 << 20), F.lit(_LICENCE), F.lit(0)))), lambda x: F.element_at(known, x))
    return found.withColumn("licences", F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*names)), tagged))))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences(common.documents(spark, sf_dir))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join(F.transform("ids", lambda x: x["id"]), ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licenses"))


def _sql_rule(number: int, rule: list[str]) -> str:
    joins = "".join(f" JOIN marked m{k} ON m{k}.row_no = m0.row_no AND m{k}.id = '{x}' AND m{k}.at_ > m{k - 1}.at_ AND m{k}.at_ <= m{k - 1}.at_ + {GAP + 1}" for k, x in enumerate(rule) if k)
    return f"SELECT DISTINCT m0.row_no, m0.at_ AS start, {number} AS rule FROM marked m0{joins} WHERE m0.id = '{rule[0]}'"


OP6_SQL = rf"""
WITH known(sentence, id) AS (VALUES {", ".join(f"('{s}', '{name}')" for s, name in _KNOWN.items())}),
licence(rule, licence) AS (VALUES {", ".join(f"({k}, '{name}')" for k, (name, _) in enumerate(RULES))}),
holds(longer, shorter) AS (VALUES {", ".join(f"({i}, {j})" for i, (_, x) in enumerate(RULES) for j, (_, y) in enumerate(RULES) if _holds(x, y))}),
docs AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT row_no, unnest(parts) AS s, unnest(range(len(parts))) AS k
  FROM (SELECT row_no, string_split_regex(regexp_replace(text, '[.;:!?]+(\s|$)', chr(10), 'g'), '\n') AS parts FROM docs)
), tidy AS (
  SELECT row_no, k, regexp_replace(trim(regexp_replace(translate(s, '{_UPPER}', '{_LOWER}'), '{_DROP}', ' ', 'g'), ' '), '[. ]+$', '') AS s FROM cut
), numbered AS (SELECT row_no, s, row_number() OVER (PARTITION BY row_no ORDER BY k) - 1 AS at_ FROM tidy WHERE s <> ''),
marked AS (SELECT row_no, at_, id FROM numbered JOIN known ON s = sentence),
matches AS ({" UNION ALL ".join(_sql_rule(k, rule) for k, (_, rule) in enumerate(RULES))}),
rules AS (
  SELECT row_no, licence FROM matches m JOIN licence USING (rule)
  WHERE NOT EXISTS (SELECT 1 FROM matches n JOIN holds h ON h.longer = n.rule WHERE h.shorter = m.rule AND n.row_no = m.row_no AND n.start = m.start)
),
by_doc AS (SELECT row_no, count(*) AS n, string_agg(id, ',' ORDER BY at_) AS ids FROM marked GROUP BY row_no),
named AS (SELECT row_no, string_agg(licence, ',' ORDER BY licence) AS licences FROM (SELECT DISTINCT * FROM rules) GROUP BY row_no)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licenses
FROM docs LEFT JOIN by_doc USING (row_no) LEFT JOIN named USING (row_no)
"""

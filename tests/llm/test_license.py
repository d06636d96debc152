import re
import textwrap

import duckdb

from readloom.llm.license import OP6_SQL, licences


def run(spark, texts):
    rows = [(i, t, "z") for i, t in enumerate(texts)]
    return {r.doc_id: ([(x.at, x.id) for x in r.ids], list(r.licences)) for r in licences(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()}


def test_single_sentences_and_ordered_rules(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    as_is = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
    got = run(spark, [
        "Some words. Licensed under CC BY-NC 4.0.\nMore",
        f"{grant}.\n\n{notice}\n{as_is}",
        f"{notice} {grant}. {as_is}",
        f"{grant}. One. Two. {notice} {as_is}",
        f"{grant}. One. Two. Three. {notice} {as_is}",
        "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.",
        "All rights reserved",
        None, "", "...", "word " * 50000 + ". Released under the MIT License.",
    ])
    assert got[0] == ([(1, "cc-by-nc-by")], ["CC-BY-NC-4.0"])
    assert [got[k][1] for k in (1, 2, 3, 4)] == [["MIT"], [], ["MIT"], []]
    assert got[5][1] == ["Apache-2.0", "MIT"]
    assert got[6] == ([(0, "all-rights")], [])
    assert [got[k] for k in (7, 8, 9)] == [([], [])] * 3
    assert got[10][1] == ["MIT"]


def test_empty_table(spark):
    assert licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


MIT = '''MIT License

Copyright (c) 2024 Someone

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
LIABILITY.
'''
GPL = '''    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
'''
APACHE = '''   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
'''
BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''


def test_published_notices_as_they_are_wrapped(spark):
    comment = "\n".join(f" * {line}".rstrip() for line in GPL.split("\n"))
    got = run(spark, [MIT, GPL, APACHE, BSD, comment, MIT.replace("\n", "\r\n"), "\n".join(" ".join(x.split()) for x in MIT.split("\n\n")), "a line\n" + APACHE + "another\n" * 9])
    assert [[x for _, x in got[k][0]] for k in range(4)] == [
        ["mit-grant", "mit-notice", "as-is"],
        ["gpl-free", "gpl-hope"],
        ["apache-comply", "apache-copy", "apache-basis"],
        ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"],
    ]
    assert [got[k][1] for k in range(8)] == [["MIT"], ["GPL-3.0-or-later"], ["Apache-2.0"], ["BSD-3-Clause"], ["GPL-3.0-or-later"], ["MIT"], ["MIT"], ["Apache-2.0"]]


def test_a_line_without_stops_around_it_and_a_sentence_inside_another(spark):
    got = run(spark, ["words\nLicensed under CC BY 4.0\nmore words", "we are not licensed under CC BY 4.0.", "This project is\nlicensed under the MIT License.", "." * 200000 + "x", ".net\n\n. .\n.x | _ # = All rights reserved\nAll rights\n\nreserved"])
    assert got[0] == ([(1, "cc-by-by")], ["CC-BY-4.0"])
    assert got[1] == ([], [])
    assert got[2] == ([(0, "mit-by")], ["MIT"])
    assert got[3] == ([], [])
    assert got[4] == ([(2, "all-rights")], [])


HOPE = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
DISCLAIM = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""
MORE = {
    "GPL-2.0-or-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", HOPE],
    "GPL-2.0-only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", HOPE],
    "GPL-3.0-only": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.", HOPE],
    "LGPL-2.1-or-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", HOPE.replace("This program", "This library")],
    "LGPL-3.0-or-later": [FREE.format("Lesser"), HOPE],
    "AGPL-3.0-or-later": [FREE.format("Affero"), HOPE],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": [PERMIT + ", provided that the above copyright notice and this permission notice appear in all copies.", DISCLAIM],
    "0BSD": [PERMIT + ".", DISCLAIM],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-3.0": ["This work is licensed under the Creative Commons Attribution 3.0 Unported License."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "MIT-0": [MIT.split("\n\n")[2].replace(", subject to the following conditions:", "."), MIT.split("\n\n")[4]],
}


def test_published_notices_of_further_licences(spark):
    """Each in one line a paragraph, wrapped at 72 columns, and as a comment; a sentence short of the notice gives another licence or none."""
    names, texts = list(MORE), []
    for name in names:
        wrapped = "\n\n".join("\n".join(textwrap.wrap(x, 72)) for x in MORE[name])
        texts += ["\n\n".join(MORE[name]), f"Copyright (c) 2024 Someone\n\n{wrapped}\n", "\n".join(f"# {x}".rstrip() for x in wrapped.split("\n"))]
    got = run(spark, [*texts, HOPE, "This software is distributed without any warranty.", PERMIT + "."])
    assert [got[k][1] for k in range(len(texts))] == [[name] for name in names for _ in range(3)]
    assert [got[len(texts) + k][1] for k in range(3)] == [[], [], []]


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "All rights reserved"), (1, "Licensed under CC BY 4.0."), (1, "Licensed under CC BY 4.0.")]
    got = licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), list(r.licences)) for r in got) == [("1", ["CC-BY-4.0"]), ("1", ["CC-BY-4.0"]), ("None", [])]


def test_a_rule_inside_another_counts_only_by_itself(spark):
    two = BSD[: BSD.index("3. Neither")]
    named = BSD.replace("the copyright holder", "{}")
    four = BSD.replace("3. Neither", """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement: This product includes
   software developed by the Widget Company, Inc. and its contributors.

4. Neither""")
    author = two + "3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n"
    filler = "Words.\n\n" * 5
    texts = [two, BSD, named.format("Widget Inc."), named.format("the University of Somewhere, Sub-Department of Widgets"), named.format("Ünïversity"), named.format("株式会社"), author, four]
    texts += [two + filler + BSD, BSD + filler + two, two + filler + two, named.format("a " * 15 + "b"), named.format("a " * 16 + "b"), two + filler + BSD[BSD.index("3. Neither") :]]
    got = [x[1] for _, x in sorted(run(spark, texts).items())]
    both = ["BSD-2-Clause", "BSD-3-Clause"]
    assert got[:8] == [["BSD-2-Clause"], *[["BSD-3-Clause"]] * 6, ["BSD-4-Clause"]]
    assert got[8:] == [both, both, ["BSD-2-Clause"], ["BSD-3-Clause"], ["BSD-2-Clause"], ["BSD-2-Clause"]]


def test_headings_of_full_texts(spark):
    texts = ["                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"]
    texts += ["Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "see the GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"]
    assert [x[1] for _, x in sorted(run(spark, texts).items())] == [["GPL-3.0"], ["Apache-2.0"], ["MPL-2.0"], ["CC0-1.0"], ["LGPL-2.1"], []]


def test_tags(spark):
    tag = "SPDX-License-Identifier:"
    texts = [f"// {tag} MIT\nint main() {{}}", f"/* {tag} (MIT OR Apache-2.0) */", f"{tag}GPL-2.0+", f"# {tag} GPL-2.0-only WITH Classpath-exception-2.0", f"{tag} GPL-2.0 WITH Linux-syscall-note\n\nwords", f"{tag} NoSuch-1.0 AND BSD-3-Clause", f"{tag} NoSuch-1.0", f"{tag} mit", f"{tag}", f"we wrote {tag} MIT", f"words\n{tag} MIT\n" + BSD, f"{tag} MIT " + "and mit " * 20000]
    got = run(spark, texts)
    assert [got[k][1] for k in range(len(texts))] == [["MIT"], ["Apache-2.0", "MIT"], ["GPL-2.0-or-later"], ["GPL-2.0-only"], ["GPL-2.0"], ["BSD-3-Clause"], [], ["MIT"], [], [], ["BSD-3-Clause", "MIT"], ["MIT"]]
    assert got[0][0] == [(0, "spdx:mit")] and got[6][0] == [(0, "spdx:nosuch 1.0")] and got[8][0] == []


def test_the_sql_agrees_where_each_sentence_has_a_line(spark):
    """SQL cuts at every stop and line's end, so stops inside sentences are commas here; it has no sentences with names."""
    line = lambda x: re.sub(r"[;:] |(?<=v)[.] ", ", ", " ".join(x.split()))
    texts = [*["\n".join(line(y) for y in x.split("\n\n")) for x in (MIT, GPL, BSD[: BSD.index("3. Neither")])], *["\n".join(line(y) for y in MORE[name]) for name in MORE], None, "", "nothing"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (len(r.ids), ",".join(x.id for x in r.ids), ",".join(r.licences)) for r in licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == {r[0]: r[1:] for r in db.execute(OP6_SQL).fetchall()}
    assert [got[k][2] for k in range(2)] == ["MIT", "GPL-3.0-or-later"]

from granary.llm import licenses as L

from .helpers import ODD, clashing, documents


def test_every_sentence_holds_a_hint():
    assert all(any(h in s for h in L.HINTS) for s in L.SENTENCES) or [s for s in L.SENTENCES if not any(h in s for h in L.HINTS)] == []


def test_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    texts = [*ODD, "Text. \nReleased under the MIT License.", mit, "x.\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "the mit license is good"]
    rows = sorted(L.scan(clashing(documents(spark, texts))).collect())
    assert all((r.n_sentences, r.sentence_ids, r.licenses, r.license) == (0, "", "", None) for r in rows[: len(ODD)])
    assert [(r.licenses, r.license) for r in rows[len(ODD) :]] == [("MIT", "MIT"), ("MIT", "MIT"), ("GPL-3.0-only,CC-BY-NC-4.0", "GPL-3.0-only"), ("", None)]


def test_empty_table(spark):
    assert L.scan(documents(spark, [])).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2")
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


BSD3 = BSD + """

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
AGPL = GPL3.replace("GNU General", "GNU Affero General", 1)
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy."
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/

SPDX-License-Identifier: EPL-2.0"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:"""
STANDARD = {
    "MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD3, "ISC": ISC, "MPL-2.0": MPL, "LGPL-2.1-or-later": LGPL,
    "LGPL-3.0-or-later": LGPL.replace("2.1", "3"), "AGPL-3.0-or-later": AGPL, "Zlib": ZLIB, "Unlicense": UNLICENSE, "EPL-2.0": EPL, "BSL-1.0": BOOST,
}


def by_sql(texts):
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    return sorted(c.execute(L.ORACLE_SQL).fetchall())


def test_wrapped_texts(spark):
    standard = STANDARD
    layouts = [lambda t: t, lambda t: "x\r\n\r\n" + t.replace("\n", "\r\n") + "\r\n\r\ny"] + [lambda t, m=m: "\n".join(m + line for line in t.split("\n")) for m in ("# ", "// ", " * ")]
    cases = [(name, lay(t)) for name, t in standard.items() for lay in layouts]
    cases += [(None, "the\n\nmit license is good"), (None, "a license\n" * 3), (None, "license" + "\n" * 50_000 + ":" * 50_000)]
    cases += [("BSD-3-Clause", BSD3 + "\n\n" + BSD), (None, BSD.replace("Redistributions in", "Copies in")), (None, "MIT"), ("Zlib", "// SPDX-License-Identifier: Zlib\n"), (None, "SPDX-License-Identifier: Zlibx")]
    rows = sorted(L.scan(documents(spark, [t for _, t in cases])).collect())
    assert [r.license for r in rows] == [name for name, _ in cases]
    assert rows[-5].licenses == "BSD-3-Clause,BSD-2-Clause" and all("," not in r.licenses for r in rows[:-5])
    assert [tuple(r) for r in rows] == by_sql([t for _, t in cases])


def test_repeats_and_long_texts(spark):
    texts = [None, "", MIT, MIT, "word " * 200_000 + "\n\n" + MIT, ISC + "\n\n" + ISC]
    docs = documents(spark, texts)
    rows = sorted(L.scan(docs.union(docs)).collect())
    assert [r.license for r in rows] == [x for x in (None, None, "MIT", "MIT", "MIT", "ISC") for _ in (0, 1)]
    assert rows[-1].n_sentences == 2 and rows[-1].licenses == "ISC"
    assert [tuple(r) for r in sorted(L.scan(docs).collect())] == by_sql(texts)


def test_every_rule_is_reached(spark):
    texts = ["\n\n".join(" ".join(w[:2]) + "\n" + " ".join(w[2:]) for w in (L.SENTENCES[i - 1].split() for i in ids)) for _, ids in L.RULES]
    rows = sorted(L.scan(documents(spark, texts)).collect())
    assert [(r.sentence_ids, r.license) for r in rows] == [(",".join(map(str, ids)), name) for name, ids in L.RULES]


def found(spark, texts):
    """The licences of each text, which the SQL must agree about."""
    import duckdb

    rows = {r.doc_id: tuple(r) for r in L.scan(documents(spark, texts)).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert {r[0]: r for r in c.execute(L.ORACLE_SQL).fetchall()} == rows
    return [rows[i][3] for i in range(len(texts))]


def test_any_organisation_in_the_third_clause(spark):
    third = "Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
    old = "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission."
    names = ["the copyright holder", "Google Inc.", "the University of Example", "Foo & Bar, Ltd. (Köln)", "the\n   Regents of the University"]
    texts = [f"{BSD}\n\n3. {x.format(n)}" for n in names for x in (third, old)]
    assert found(spark, [*texts, BSD, third.format("X")]) == ["BSD-3-Clause"] * len(texts) + ["BSD-2-Clause", ""]


def test_identifier_expressions(spark):
    lines = {
        "MIT OR Apache-2.0": "MIT,Apache-2.0", "(MIT AND BSD-3-Clause) OR ISC": "MIT,BSD-3-Clause,ISC", "LGPL-2.1-only": "LGPL-2.1-only", "AGPL-3.0-only": "AGPL-3.0-only", "CC0-1.0": "CC0-1.0",
        "GPL-2.0-or-later OR MIT": "MIT,GPL-2.0-or-later", "GPL-2.0+": "GPL-2.0-or-later", "GPL-2.0": "GPL-2.0-only", "GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0-only", "Nothing-1.0": "",
        "MIT OR Nothing-1.0": "MIT", "0BSD OR Zlib OR ISC OR MIT OR NCSA OR WTFPL OR OFL-1.1": "MIT,0BSD,ISC,Zlib,NCSA,OFL-1.1,WTFPL",
    }
    got = found(spark, [f"// SPDX-License-Identifier: {x}\nint main() {{ this or that; }}" for x in lines] + ["MIT or Apache-2.0", "license of mit or isc"])
    assert got == [*lines.values(), "", ""]

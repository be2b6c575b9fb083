"""Licence scan by sentence rules: sentences become identifiers, identifier sequences match ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences that licence texts and notices consist of (fixed values of the licences themselves); an
#: identifier is the place in this table, from 1.
SENTENCES = (
    "released under the mit license",
    "licensed under the mit license",
    "the mit license",
    "mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license",
    "apache license version 2 0",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "this work is licensed under the gnu general public license version 3",
    "this work is licensed under the gnu general public license version 2",
    "gnu general public license version 3",
    "gnu general public license version 2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "released under the bsd license",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "this is free and unencumbered software released into the public domain",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
)
#: Licences that a line may name by their short identifier; several may be joined by OR and AND.
TAGGED = (
    "MIT", "MIT-0", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "CDDL-1.0",
    "Artistic-2.0", "Unlicense", "Zlib", "BSL-1.0", "NCSA", "OFL-1.1", "PostgreSQL", "WTFPL", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
#: Identifiers no longer in use, and what they stand for.
OLD_TAGS = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.0": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
TAG_LINE = "spdx license identifier "


def _tag(name: str) -> str:
    return TAG_LINE + name.lower().replace("-", " ").replace(".", " ")


SENTENCES += tuple(_tag(t) for t in (*TAGGED, *OLD_TAGS))
#: Every sentence above holds one of these words, so that texts without any need no splitting.
HINTS = ("license", "permission", "warranty", "redistribution", "copyright", "public domain")

_ID = {s: i + 1 for i, s in enumerate(SENTENCES)}


def _rule(name: str, *starts: str) -> tuple[str, tuple[int, ...]]:
    """A rule from the openings of its sentences."""
    return name, tuple(next(i for s, i in _ID.items() if s.startswith(x)) for x in starts)


#: Ordered rules: a licence, and the identifiers that must follow one another among the recognised sentences.  The
#: first rule that matches names the document's main licence.  Sentences that an earlier, longer rule has matched
#: don't count for a rule whose sentences are a part of its.
RULES = (
    _rule("MIT", "permission is hereby granted free of charge to any person obtaining", "the above copyright notice and this"),
    _rule("Apache-2.0", "licensed under the apache license version 2 0 the license", "you may not use", "you may obtain", "unless required"),
    _rule("GPL-3.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", "this program is distributed"),
    _rule("GPL-2.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2", "this program is distributed"),
    _rule("AGPL-3.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero"),
    _rule("LGPL-2.1-or-later", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    _rule("LGPL-3.0-or-later", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3"),
    _rule("BSD-3-Clause", "redistribution and use", "redistributions of source", "redistributions in binary", "neither the name"),
    _rule("BSD-3-Clause", "redistribution and use", "redistributions of source", "redistributions in binary", "the name of the author may not"),
    _rule("BSD-2-Clause", "redistribution and use", "redistributions of source", "redistributions in binary"),
    _rule("ISC", "permission to use copy modify and or distribute"),
    _rule("MPL-2.0", "this source code form"),
    _rule("EPL-2.0", "this program and the accompanying materials"),
    _rule("CC0-1.0", "to the extent possible under law"),
    _rule("BSL-1.0", "permission is hereby granted free of charge to any person or organization"),
    _rule("Zlib", "permission is granted to anyone"),
    _rule("Unlicense", "this is free and unencumbered"),
    _rule("GPL-3.0-only", "this work is licensed under the gnu general public license version 3"),
    _rule("GPL-3.0-only", "gnu general public license version 3"),
    _rule("GPL-2.0-only", "this work is licensed under the gnu general public license version 2"),
    _rule("GPL-2.0-only", "gnu general public license version 2"),
    _rule("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    _rule("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution noncommercial"),
    _rule("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    _rule("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution sharealike"),
    _rule("CC-BY-4.0", "licensed under cc by 4 0"),
    _rule("CC-BY-4.0", "this work is licensed under a creative commons attribution 4"),
    _rule("Apache-2.0", "licensed under the apache license version 2 0"),
    _rule("Apache-2.0", "licensed under the apache license version 2 0 the license"),
    _rule("Apache-2.0", "apache license version 2 0"),
    _rule("MIT", "released under the mit"),
    _rule("MIT", "licensed under the mit"),
    _rule("MIT", "the mit license"),
    _rule("MIT", "mit license"),
    _rule("BSD", "released under the bsd"),
    *((t, (_ID[_tag(t)],)) for t in TAGGED),
    *((t, (_ID[_tag(old)],)) for old, t in OLD_TAGS.items()),
)


def _sequence(ids: tuple[int, ...]) -> str:
    return "".join(f",{i}," for i in ids)


#: For each rule, the earlier rules that its sentences are a part of.
HOLDERS = [[j for j in range(k) if _sequence(ids) in _sequence(RULES[j][1]) and RULES[j][0] != name] for k, (name, ids) in enumerate(RULES)]
#: Marks put into a text, in this order: ``#`` where a sentence ends (lines without a letter or digit, such as blank
#: comment lines; full stops, but not that of "v. 2.0"), ``|`` where one may end or go on (line ends, colons,
#: semicolons).  Comment marks are no letters and fall out with other punctuation.
MARKS = (
    (r"([0-9])\+", "$1 or later "),
    (r"(?>\r\n|\r|\n)[^A-Za-z0-9\r\n]*+[\r\n][^A-Za-z0-9]*+", " # "),
    (r"(?<![A-Za-z0-9])([Vv])\.[\x20\x09-\x0D]+(?=[0-9])", "$1 | "),
    (r"(?<![.!?:;])[:;]*+[.!?][.!?:;]*+[\x20\x09-\x0D]+", " # "),
    (r"(?<![:;])[:;]++[\x20\x09-\x0D]+|[\r\n]+", " | "),
    ("[^A-Za-z0-9|#]+", " "),
)
_GAP = " (?:[|] )*"
#: Rewritten in the marked text: whoever a licence names becomes "the copyright holder" or "the author"; what stands
#: before an identifier takes no mark.
NAMES = tuple(
    (re.sub(" ", lambda _: _GAP, pattern), name)
    for pattern, name in (
        ("neither the names? of (?:[a-z0-9|#]+ ){1,30}?nor the names? of (?:its|their|other|any) contributors", "neither the name of the copyright holder nor the names of its contributors"),
        ("the names? of (?:[a-z0-9|#]+ ){1,30}?may not be used to endorse", "the name of the author may not be used to endorse"),
        (TAG_LINE, TAG_LINE),
        ("to the extent possible under law (?:[a-z0-9|#]+ ){1,30}?has waived all", "to the extent possible under law the author has waived all"),
    )
)
#: A known sentence between two marks, the longest first; it may run over ``|`` marks.
_LONGEST = sorted(SENTENCES, key=lambda s: -len(s.split()))
KNOWN = "(?<=[|#] )(?:" + "|".join(s.replace(" ", r" (?:[|] )*+") for s in _LONGEST) + ")(?= [|#])"


def _tags_apart(line: Column) -> Column:
    """A line that names several licences by identifiers becomes a sentence for each of them; exceptions fall out."""
    for pattern, text in ((" or later", " orlater"), (" with [a-z0-9 ]+? exception(?: [0-9] [0-9])?", ""), (" (?:or|and) ", f" # {TAG_LINE}"), (" orlater", " or later")):
        line = F.when(F.contains(line, F.lit(TAG_LINE)), F.regexp_replace(line, pattern, text)).otherwise(line)
    return line


def sentence_ids(text: Column) -> Column:
    """Identifiers of the recognised sentences, in order; sentences may be wrapped over lines and comment marks."""
    known = F.array(*[F.lit(s) for s in SENTENCES])
    marked = F.translate(text, "|#", "--")
    for pattern, mark in MARKS:
        marked = F.regexp_replace(marked, pattern, mark)
    marked = F.concat(F.lit("# "), F.lower(F.trim(marked)), F.lit(" #"))
    for pattern, name in NAMES:
        marked = F.regexp_replace(marked, pattern, name)
    marked = F.array_join(F.transform(F.split(F.regexp_replace(marked, "([|#]) ", "\n$1 "), "\n"), _tags_apart), "")
    found = F.regexp_extract_all(marked, F.lit(KNOWN), F.lit(0))
    return F.transform(found, lambda s: F.array_position(known, F.regexp_replace(s, "[|] ", "")).cast("int"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_sentences, sentence_ids, licenses, license``.

    ``sentence_ids`` joins the recognised identifiers, ``licenses`` the matched rules' licences (each once, in rule
    order) by commas; ``license`` is the first of them, or null.  Null, empty and other texts without a known sentence
    get zero and empty strings.  Rows are judged one by one: repeats get equal rows, an empty table gives none, a null
    doc_id stays null, other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lowered = F.lower(F.col("text"))
    hinted = lowered.rlike("|".join(HINTS))
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .withColumn("ids", F.when(hinted, sentence_ids(F.col("text"))).otherwise(F.expr("CAST(array() AS array<int>)")))
        .withColumn("sequence", F.array_join(F.transform("ids", lambda i: F.concat(F.lit(","), i.cast("string"), F.lit(","))), ""))
    )

    def times(k):
        pattern = _sequence(RULES[k][1])
        return (F.length("sequence") - F.length(F.replace("sequence", F.lit(pattern), F.lit("")))) / len(pattern)

    rules = [F.when(times(k) > sum((times(j) for j in HOLDERS[k]), F.lit(0)), F.lit(name)) for k, (name, _) in enumerate(RULES)]
    return (
        found.withColumn("names", F.array_distinct(F.array_compact(F.array(*rules))))
        .withColumn("n_sentences", F.size("ids").cast("long"))
        .select("doc_id", "n_sentences", F.array_join("ids", ",").alias("sentence_ids"), F.array_join("names", ",").alias("licenses"), F.get("names", F.lit(0)).alias("license"))
    )


_KNOWN = ", ".join(f"'{s}'" for s in SENTENCES)
_TIMES = [f"(length(seq) - length(replace(seq, '{_sequence(ids)}', ''))) / {len(_sequence(ids))}" for _, ids in RULES]
_MATCHES = ", ".join(f"CASE WHEN {_TIMES[k]} > {' + '.join(_TIMES[j] for j in HOLDERS[k]) or 0} THEN '{name}' END" for k, (name, _) in enumerate(RULES))
#: MARKS without looking around: line ends are made one character first, and every mark stands twice, so that a
#: sentence may take one on either side.
_MARKED = "regexp_replace(translate(coalesce(text, ''), '|#', '--'), '\\r\\n', chr(10), 'g')"
for _pattern, _mark in (
    (r"([0-9])\+", r"\1 or later "),
    (r"[\n\r][^A-Za-z0-9\r\n]*[\r\n][^A-Za-z0-9]*", " # "),
    (r"(^|[^A-Za-z0-9])([Vv])\.[\x20\x09-\x0D]+([0-9])", r"\1\2 | \3"),
    (r"[.!?:;]*[.!?][.!?:;]*[\x20\x09-\x0D]+", " # "),
    (r"[:;]+[\x20\x09-\x0D]+|[\r\n]+", " | "),
    ("[^A-Za-z0-9|#]+", " "),
    (r"([|#])", r"\1 \1"),
):
    _MARKED = f"regexp_replace({_MARKED}, '{_pattern}', '{_mark}', 'g')"
_NAMED = f"'# # ' || lower(trim({_MARKED})) || ' # #'"
for _pattern, _name in NAMES:
    _NAMED = f"regexp_replace({_NAMED}, '{_pattern}', '{_name}', 'g')"
_SPLIT = f"string_split(regexp_replace({_NAMED}, '([|#] [|#]) ', chr(10) || '\\1 ', 'g'), chr(10))"
_APART = "x"
for _pattern, _mark in ((" or later", " orlater"), (" with [a-z0-9 ]+? exception(?: [0-9] [0-9])?", ""), (" (?:or|and) ", f" # # {TAG_LINE}"), (" orlater", " or later")):
    _APART = f"regexp_replace({_APART}, '{_pattern}', '{_mark}', 'g')"
_LINES = f"array_to_string(list_transform({_SPLIT}, lambda x: CASE WHEN contains(x, '{TAG_LINE}') THEN {_APART} ELSE x END), '')"
_ANY = "[|#] (" + "|".join(s.replace(" ", " (?:[|] )*") for s in _LONGEST) + ") [|#]"
_HINTED = " OR ".join(f"contains(lower(text), '{h}')" for h in HINTS)
ORACLE_SQL = rf"""
WITH p AS (
  SELECT doc_id, list_transform(regexp_extract_all(CASE WHEN {_HINTED} THEN {_LINES} ELSE '' END, '{_ANY}', 1),
           lambda s: list_position([{_KNOWN}], regexp_replace(s, '[|] ', '', 'g'))) AS ids
  FROM documents),
q AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda i: ',' || i || ','), '') AS seq FROM p),
r AS (SELECT doc_id, ids, list_filter([{_MATCHES}], lambda x: x IS NOT NULL) AS hits FROM q),
u AS (SELECT doc_id, ids, list_filter(hits, lambda x, i: list_position(hits, x) = i) AS names FROM r)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(names, ',') AS licenses, names[1] AS license
FROM u"""

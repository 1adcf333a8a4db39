"""Licence scans by sentence rules.

A text is cut into lines, comment marks and list marks at their ends are dropped, and the lines of a paragraph are joined, as licences stand hard-wrapped; an empty line, and
a line that is a known sentence by itself (a title), end a sentence, as do . ! ? ; : before a blank (not after "v"). A sentence is normalised to lower-case
letters and digits with single blanks. Known licence sentences have identifiers; the identifiers found, in text order, are
matched against ordered rules, each a sequence of identifiers in which marked ones may be missing. Rules are tried in
order, and a rule claims its run of identifiers, so a longer rule is not also reported as the shorter one it contains.

DataFrame functions only, row by row: no shuffle. The table of sentences and rules is a constant of this module. A
sentence is looked at closely only if it holds one of TRIGGERS; a check at import shows that every known sentence does.

NULL and empty texts have no sentences and no licence; NULL and repeated doc_ids are kept; an empty table
gives an empty result; other columns are ignored. A very long text is one array of its sentences.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_column

_GNU_TERMS = "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation either version {} of the license or at your option any later version"
#: Identifier to normalised sentences, as the licences and the notices that they recommend say them (fixed values).
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-released": ("released under the mit license", "licensed under the mit license", "distributed under the mit license", "this project is licensed under the mit license", "license mit"),
    "mit-title": ("mit license", "the mit license", "the mit license mit"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-warranty": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit-liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "apache-title": ("apache license",),
    "apache-version": ("version 2 0 january 2004",),
    "apache-terms": ("terms and conditions for use reproduction and distribution",),
    "apache-header": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "this project is licensed under the apache license version 2 0"),
    "apache-use": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    "apache-warranty": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache-see": ("see the license for the specific language governing permissions and limitations under the license",),
    "gpl3-work": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"),
    "gpl3-title": ("gnu general public license version 3", "gnu general public license version 3 29 june 2007"),
    "gpl2-title": ("gnu general public license version 2", "gnu general public license version 2 june 1991", "licensed under the gnu general public license version 2"),
    "gpl-name": ("gnu general public license",),
    "lgpl-name": ("gnu lesser general public license",),
    "agpl-name": ("gnu affero general public license",),
    "version-3": ("version 3 29 june 2007",),
    "version-3-affero": ("version 3 19 november 2007",),
    "version-2": ("version 2 june 1991",),
    "version-2-1": ("version 2 1 february 1999",),
    "gpl3-terms": (_GNU_TERMS.format("", "3"),),
    "gpl2-terms": (_GNU_TERMS.format("", "2"),),
    "lgpl3-terms": (_GNU_TERMS.format("lesser ", "3"),),
    "lgpl21-terms": (_GNU_TERMS.format("lesser ", "2 1"),),
    "agpl3-terms": (_GNU_TERMS.format("affero ", "3"),),
    "gpl-hope": tuple(f"this {x} is distributed in the hope that it will be useful but without any warranty" for x in ("program", "library", "software")),
    "gpl-fitness": ("without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gpl-copy": tuple(f"you should have received a copy of the gnu {x}general public license along with this {y}" for x in ("", "lesser ", "affero ") for y in ("program", "library", "software")),
    "gpl-see": tuple(f"see the gnu {x}general public license for more details" for x in ("", "lesser ", "affero ")),
    "lgpl3-work": ("this work is licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 3"),
    "agpl3-work": ("this work is licensed under the gnu affero general public license version 3", "licensed under the gnu affero general public license version 3"),
    "mpl2-form": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "mpl2-title": ("mozilla public license version 2 0",),
    "bsd-use": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd-warranty": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "bsd3-released": ("released under the bsd 3 clause license", "licensed under the bsd 3 clause license"),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "zero-bsd-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "zlib-warranty": ("this software is provided as is without any express or implied warranty",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "boost-title": ("boost software license version 1 0", "boost software license version 1 0 august 17th 2003", "distributed under the boost software license version 1 0"),
    "unlicense-grant": ("this is free and unencumbered software released into the public domain",),
    "cc-by-nc-4": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-sa-4": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc-by-4": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc0": ("licensed under cc0 1 0", "this work is dedicated to the public domain under cc0 1 0"),
    "reserved": ("all rights reserved",),
}
_GNU_TAIL = ("gpl-hope?", "gpl-fitness?", "gpl-see?", "gpl-copy?")
#: Ordered: name, then identifiers; one that ends in ? may be missing.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-title?", "reserved?", "mit-grant", "mit-notice?", "mit-warranty?", "mit-liability?")),
    ("BSD-3-Clause", ("reserved?", "bsd-use", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty?")),
    ("BSD-2-Clause", ("reserved?", "bsd-use", "bsd-source", "bsd-binary?", "bsd-warranty?")),
    ("Apache-2.0", ("apache-title", "apache-version", "apache-terms?")),
    ("Apache-2.0", ("apache-header", "apache-use?", "apache-copy?", "apache-warranty?", "apache-see?")),
    ("GPL-3.0-or-later", ("gpl3-terms", *_GNU_TAIL)),
    ("GPL-2.0-or-later", ("gpl2-terms", *_GNU_TAIL)),
    ("LGPL-3.0-or-later", ("lgpl3-terms", *_GNU_TAIL)),
    ("LGPL-2.1-or-later", ("lgpl21-terms", *_GNU_TAIL)),
    ("AGPL-3.0-or-later", ("agpl3-terms", *_GNU_TAIL)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-title",)),
    ("GPL-3.0-only", ("gpl-name", "version-3")),
    ("GPL-2.0-only", ("gpl2-title",)),
    ("GPL-2.0-only", ("gpl-name", "version-2")),
    ("LGPL-3.0-only", ("lgpl3-work",)),
    ("LGPL-3.0-only", ("lgpl-name", "version-3")),
    ("LGPL-2.1-only", ("lgpl-name", "version-2-1")),
    ("AGPL-3.0-only", ("agpl3-work",)),
    ("AGPL-3.0-only", ("agpl-name", "version-3-affero")),
    ("MPL-2.0", ("mpl2-form",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("zero-bsd-grant",)),
    ("Zlib", ("zlib-warranty?", "zlib-grant")),
    ("BSL-1.0", ("boost-title",)),
    ("Unlicense", ("unlicense-grant",)),
    ("BSD-3-Clause", ("bsd3-released",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-title", "mit-warranty")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC0-1.0", ("cc0",)),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
)
TRIGGERS = "licens|permi|warrant|redistribut|neither the name|free software|unencumbered|cc0|rights reserved|january 2004|implied|june 2007|november 2007|june 1991|february 1999|liable|terms and conditions"


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"[A-Z]", lambda m: m[0].lower(), sentence)).strip(" ")


# Each licence's own tag is a sentence too.
for _name in dict.fromkeys(name for name, _ in RULES if not name.startswith("LicenseRef")):
    SENTENCES[f"spdx-{_name.lower()}"] = (f"spdx license identifier {normalised(_name)}",)
    RULES += ((_name, (f"spdx-{_name.lower()}",)),)
for _identifier, _known in SENTENCES.items():
    for _sentence in _known:
        if not re.search(TRIGGERS.replace(" ", "[^a-z0-9]+"), _sentence) or normalised(_sentence) != _sentence:
            raise ValueError(f"{_identifier}: {_sentence}")


def pattern(rule: tuple[str, ...]) -> str:
    """Over identifiers joined as |a||b|."""
    return "".join(f"(?:\\|{x[:-1]}\\|)?" if x.endswith("?") else f"\\|{x}\\|" for x in rule)


#: Marks before and after a line's text: of comments and lists.
LEAD = r"\A[ \t]*(?:(?://+|/\*+|\*+/?|#+|;+|--+|%+|>+|<!--|rem |dnl )[ \t]*)*(?:(?:[0-9]{1,2}[.)]|\([a-z0-9]\)|[-+])[ \t]+)?"
TRAIL = r"[ \t]*(?:\*+/|-->)?[ \t]*\z"
LINES, STOP, SMALL_V, TAG = r"\r\n|[\r\n]", r"([.!?;:])[ \t]+", r"\bv\. ", r"license-identifier: *"


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))


def _triggered(text: Column) -> Column:
    return text.rlike(TRIGGERS.replace(" ", "[^a-z0-9]+"))


def sentences(text: Column, table: Column) -> Column:
    """Normalised sentences that hold a trigger."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = F.transform(F.split(lower, LINES), lambda x: F.regexp_replace(F.regexp_replace(x, LEAD, ""), TRAIL, ""))
    known = lambda x: F.when(_triggered(x), table[_normal(x)]).isNotNull()
    marked = F.transform(lines, lambda x: F.when(x == "", F.lit("\n")).when(known(x), F.concat(F.lit("\n"), x, F.lit("\n"))).otherwise(F.concat(x, F.lit(" "))))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(marked, ""), SMALL_V, "v "), TAG, "license-identifier ")
    cut = F.split(F.regexp_replace(joined, STOP, "$1\n"), "\n+")
    return F.when(lower.rlike("|".join(t.split()[0] for t in TRIGGERS.split("|"))), F.transform(F.filter(cut, _triggered), _normal)).otherwise(F.expr("cast(array() as array<string>)"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (comma-joined in rule order), license (the first, or NULL), sentence_ids, n_sentences (known ones)."""
    text = text_column(F.col("text"))
    known = {s: i for i, every in SENTENCES.items() for s in every}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(F.transform(sentences(text, table), lambda s: table[s]), lambda s: s.isNotNull()).alias("ids"))
    # A claimed run becomes '#', so that no later rule sees it or joins what stood on either side of it.
    left = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("|"), i, F.lit("|"))), "")
    step = found.withColumn("rest", left).withColumn("names", F.expr("cast(array() as array<string>)"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(pattern(rule)).alias("pattern")) for name, rule in RULES))
    matched = F.aggregate(
        rules,
        F.struct(F.col("rest").alias("rest"), F.col("names").alias("names")),
        lambda s, r: F.when(
            F.rlike(s["rest"], r["pattern"]),
            F.struct(F.regexp_replace(s["rest"], r["pattern"], F.lit("#")).alias("rest"), F.concat(s["names"], F.array(r["name"])).alias("names")),
        ).otherwise(F.struct(s["rest"].alias("rest"), s["names"].alias("names"))),
        lambda s: F.array_distinct(s["names"]),
    )
    named = F.when(F.size("ids") == 0, F.expr("cast(array() as array<string>)")).otherwise(matched)
    return step.withColumn("names", named).select("doc_id", F.array_join("names", ",").alias("licenses"), F.try_element_at("names", F.lit(1)).alias("license"), F.array_join("ids", ",").alias("sentence_ids"), F.size("ids").cast("long").alias("n_sentences"))


def oracle_sql() -> str:
    """The same scan for DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = ", ".join(f"({quoted(s)}, {quoted(i)})" for i, every in SENTENCES.items() for s in every)
    steps, last = [], "joined"
    for k, (name, rule) in enumerate(RULES):
        steps.append(f"r{k} AS (SELECT doc_id, ids, CASE WHEN regexp_matches(rest, {quoted(pattern(rule))}) THEN list_append(names, {quoted(name)}) ELSE names END AS names, regexp_replace(rest, {quoted(pattern(rule))}, '#', 'g') AS rest FROM {last})")
        last = f"r{k}"
    return f"""
WITH known(s, id) AS (VALUES {pairs}),
numbered AS (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {quoted(LINES)}) AS lines, row_number() OVER () AS r FROM documents),
line AS (SELECT r, unnest(lines) AS raw, unnest(range(len(lines))) AS n FROM numbered),
bare AS (SELECT r, n, regexp_replace(regexp_replace(raw, {quoted(LEAD)}, ''), {quoted(TRAIL)}, '') AS x FROM line),
marked AS (SELECT r, n, CASE WHEN x = '' THEN chr(10) WHEN known.id IS NOT NULL THEN chr(10) || x || chr(10) ELSE x || ' ' END AS part FROM bare LEFT JOIN known ON known.s = trim(regexp_replace(bare.x, '[^a-z0-9]+', ' ', 'g'))),
whole AS (SELECT r, regexp_replace(regexp_replace(string_agg(part, '' ORDER BY n), {quoted(SMALL_V)}, 'v ', 'g'), {quoted(TAG)}, 'license-identifier ', 'g') AS text FROM marked GROUP BY r),
cut AS (SELECT r, string_split_regex(regexp_replace(text, {quoted(STOP)}, '\\1' || chr(10), 'g'), '\\n+') AS parts FROM whole),
each AS (SELECT r, unnest(parts) AS s, unnest(range(len(parts))) AS n FROM cut),
hit AS (SELECT r, n, id FROM each JOIN known ON known.s = trim(regexp_replace(each.s, '[^a-z0-9]+', ' ', 'g'))),
listed AS (SELECT r, list(id ORDER BY n) AS ids FROM hit GROUP BY r),
joined AS (SELECT doc_id, coalesce(ids, []) AS ids, CAST([] AS VARCHAR[]) AS names, coalesce(list_reduce(list_transform(ids, lambda i: '|' || i || '|'), lambda a, b: a || b), '') AS rest FROM numbered LEFT JOIN listed USING (r)),
{", ".join(steps)},
last AS (SELECT doc_id, ids, list_filter(names, lambda x, i: list_position(names, x) = i) AS names FROM {last})
SELECT doc_id, coalesce(array_to_string(names, ','), '') AS licenses, names[1] AS license, coalesce(array_to_string(ids, ','), '') AS sentence_ids, CAST(len(ids) AS BIGINT) AS n_sentences FROM last
"""

"""Licence recognition by sentence rules, as SQL expressions in one pass without a shuffle.

A text's sentences are normalised (lower case, letters and digits only) and mapped to identifiers of
known licence sentences: sentences of licence texts by a table, notices ("released under the X") and tags
("SPDX-License-Identifier: X") by a pattern around a table of licence names. The identifiers of a text,
in order, are then held against ordered licence rules: a licence text is recognised by its sentences in their
order, with others between them or not; a notice or tag by itself. Sentences are looked for line by line and,
as licence texts are wrapped, in the text with single line ends taken as spaces.

Defined results: a null, empty or unlicensed text has no licence ('' and 0); equal rows get equal results; a text of
any length is scanned whole, in memory of a few times its own size (patterns have no repeated groups, and rules are a fold
over the identifiers, so neither long texts nor many notices deepen the stack); a text without any of `WORDS`, of
which every known sentence and every notice has one, is passed over at once, which changes no result; licences
come in the alphabetical order of their identifiers; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.rules import let

#: SPDX identifiers of licences and the names that notices give them (normalised).
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache software license version 2 0", "apache 2 0"],
    "MIT": ["mit license", "mit licence", "mit"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "bsd license", "bsd 3 clause"],
    "ISC": ["isc license", "isc"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal", "creative commons zero"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0 unported license"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0 unported license"],
}
#: Sentences of licence texts (normalised), with their identifiers.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "unlicense-grant": "this is free and unencumbered software released into the public domain",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
#: The GNU licences by the name and version of their grants, and the date of their texts.
GNU = {
    "GPL-2.0": ("general public license", "2", "june 1991"),
    "GPL-3.0": ("general public license", "3", "29 june 2007"),
    "LGPL-2.1": ("lesser general public license", "2 1", "february 1999"),
    "LGPL-3.0": ("lesser general public license", "3", "29 june 2007"),
    "AGPL-3.0": ("affero general public license", "3", "19 november 2007"),
}
#: How a grant or a notice says that later versions, or no others, will do.
LATER = ["or later", "or any later version", "or at your option any later version", "or newer"]
_GRANT = "this {thing} is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation {version}"
_VERBATIM = "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"
_CONDITIONS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_HOLDER = "neither the name of the copyright {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_CC = {"CC-BY": "by", "CC-BY-SA": "by sa", "CC-BY-NC": "by nc", "CC-BY-ND": "by nd", "CC-BY-NC-SA": "by nc sa", "CC-BY-NC-ND": "by nc nd"}


def _more() -> dict[str, str]:
    """Further sentences (normalised), by rule, with their identifiers; two identifiers where a line end hides the cut."""
    out = {
        _CONDITIONS: "bsd-grant",
        f"{_CONDITIONS} 1": "bsd-grant",  # as unwrapped, with the number of the first condition
        f"{_CONDITIONS} {_SOURCE}": "bsd-grant bsd-source",  # and with a bullet
        _SOURCE: "bsd-source",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
        **{_HOLDER.format(holder=x): "bsd-endorse" for x in ("holder", "holders", "owner")},
        "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
        **{x + _VERBATIM: "gnu-verbatim" for x in ("", "http fsf org ", "https fsf org ", "http www fsf org ")},
        **{f"apache license version 2 0 january 2004{x}": "apache-title" for x in ("", " http www apache org licenses", " https www apache org licenses")},
        **{f"to the extent possible under law {who} waived all copyright and related or neighboring rights to this work": "cc0-waiver" for who in ("the author has", "the authors have", "the person who associated cc0 with this work has", "the creator has")},
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "cc0-waiver",
    }
    for licence, (name, number, date) in GNU.items():
        for thing in ("program", "library", "software", "file"):
            for version, end in (*((f"either version {number} of the license {x}", "-or-later") for x in LATER), (f"version {number} of the license", ""), (f"version {number}", ""), (f"version {number} only", "-only"), (f"version {number} of the license only", "-only")):
                out[_GRANT.format(thing=thing, name=name, version=version)] = f"grant:{licence}{end}"
        for x in ("", "the "):
            out[f"{x}gnu {name} version {number} {date}"] = f"title:{licence}"
    for site in ("http", "https"):
        for version in ("4 0", "3 0"):
            for licence, path in _CC.items():
                out[f"to view a copy of this license visit {site} creativecommons org licenses {path} {version}"] = f"visit:{licence}-{version.replace(' ', '.')}"
        out[f"to view a copy of this license visit {site} creativecommons org publicdomain zero 1 0"] = "visit:CC0-1.0"
    return out


MORE = _more()
_BSD = ["bsd-grant", "bsd-endorse", "bsd-advert"]
#: Ordered rules: a licence, the sentences that must follow each other, and those that may not stand between them; any others may.
RULES: list[tuple[str, list[str], list[str]]] = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"], []),
    ("MIT", ["mit-notice", "mit-warranty", "mit-liability"], []),
    ("Apache-2.0", ["apache-notice"], []),
    ("Apache-2.0", ["apache-title"], []),
    ("Apache-2.0", ["apache-copy", "apache-basis"], []),
    ("ISC", ["isc-grant"], []),
    ("Unlicense", ["unlicense-grant"], []),
    ("MPL-2.0", ["mpl-notice"], []),
    ("CC0-1.0", ["cc0-waiver"], []),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"], _BSD),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"], _BSD),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-warranty"], _BSD),
    *((x, [f"title:{x}", "gnu-verbatim"], [f"title:{y}" for y in GNU]) for x in GNU),
    # a grant or a visited address says its licence by itself; a grant that is followed by the lack of warranty all the more
    *((x.partition(":")[2], [x], []) for x in sorted({*MORE.values()}) if x.startswith(("grant:", "visit:"))),
    *((x.partition(":")[2], [x, "gpl-hope"], []) for x in sorted({*MORE.values()}) if x.startswith("grant:")),
]
#: Every sentence above has one of these words, and so has all that NOTICE matches: single words, as white space between two may be any.
WORDS = r"licen[cs]e|under|software|warranty|redistribution"
#: What stands around a licence's name in a notice or tag (normalised sentence).
NOTICE = r"^(?:spdx license identifier|license is the|license|licence|(?:(?:this|the) (?:work|software|project|program|file|document|package|library|code|dataset|material|text|content|page|site)(?: is)? )?(?:also |dual )?(?:licensed|licenced|released|distributed|published|available|made available|provided|shared) under(?: the terms of)?(?: the| a| an)?|under(?: the terms of)? the|for license see the) "
_LATER = f" (?:{'|'.join(LATER)})$"
AFTER = rf"(?: license| licence| of the license)?(?:{_LATER[:-1]}| only| international| unported)?$"


def _names() -> dict[str, str]:
    """Licences by the names of notices; those of GNU licences by rule."""
    names = {name: licence for licence, names in NAMES.items() for name in [*names, licence.lower().replace("-", " ").replace(".", " ")]}
    for licence, (name, number, _) in GNU.items():
        short = licence.partition("-")[0].lower()
        for base in (short, f"gnu {short}", name, f"gnu {name}"):
            for version in (number, f"{number} 0", f"v{number}", f"v {number}", f"version {number}", f"version {number} 0"):
                names[f"{base} {version}"] = licence
        names[f"{short}v{number}"] = names[f"gnu {short}v{number}"] = licence
    return names


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _sentences(text: Column) -> Column:
    """Normalised sentences: cut at line ends and behind . ! ? before white space."""
    cut = F.split(F.regexp_replace(text, r"([.!?])[ \t\r]+", "$1\n"), "\n")
    return F.filter(F.transform(cut, _normal), lambda x: x != "")


def identifier(sentence: Column) -> Column:
    """Identifier of a normalised sentence: that of the table, or notice:LICENCE; null if unknown."""
    known = F.create_map(*(F.lit(y) for text, name in [*((t, n) for n, t in SENTENCES.items()), *MORE.items()] for y in (text, name)))
    names = F.create_map(*(F.lit(y) for item in _names().items() for y in item))
    own = F.regexp_replace(F.regexp_replace(sentence, NOTICE, ""), AFTER, "")
    # the name with and without the word that AFTER may have taken
    named = F.coalesce(F.try_element_at(names, F.regexp_replace(sentence, NOTICE, "")), F.try_element_at(names, own))
    versions = lambda x: F.when(~x.isin(*GNU), "").when(sentence.rlike(_LATER), "-or-later").when(sentence.endswith(" only"), "-only").otherwise("")
    return F.coalesce(F.try_element_at(known, sentence), F.when(sentence.rlike(NOTICE), let(named, lambda x: F.concat(F.lit("notice:"), x, versions(x)))))


def _unwrapped(text: Column) -> Column:
    """The text with single line ends taken as spaces; blank lines stay line ends."""
    marked = F.regexp_replace(text, r"\n[ \t\r\n]*\n", "\x01")
    return F.translate(marked, "\n\x01", " \n")


def _sequence(sentences: Column) -> Column:
    return F.flatten(F.transform(F.filter(F.transform(sentences, identifier), lambda x: x.isNotNull()), lambda x: F.split(x, " ")))


def _meets(ids: Column, rule: Column) -> Column:
    """The identifiers have those of the rule in their order; one that may not stand between them begins the rule anew."""
    wanted, stops = rule["ids"], rule["stops"]

    def step(done: Column, x: Column) -> Column:
        anew = F.when(x == F.get(wanted, F.lit(0)), F.lit(1)).otherwise(F.lit(0))
        return F.when(done == F.size(wanted), done).when(x == F.get(wanted, done), done + 1).when((done > 0) & F.array_contains(stops, x), anew).otherwise(done)

    return F.aggregate(ids, F.lit(0), step) == F.size(wanted)


def _licences(ids: Column) -> Column:
    """Licences whose rule the sequence of identifiers meets, and those of notices."""
    texts = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    rules = F.array(*(F.struct(F.lit(licence).alias("licence"), texts(own).alias("ids"), texts(stops).alias("stops")) for licence, own, stops in RULES))
    by_rule = F.transform(F.filter(rules, lambda rule: _meets(ids, rule)), lambda rule: rule["licence"])
    notices = F.transform(F.filter(ids, lambda x: x.startswith("notice:")), lambda x: F.substring(x, len("notice:") + 1, 100))
    return F.when(F.size(ids) > 0, F.concat(by_rule, notices)).otherwise(F.array().cast("array<string>"))


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: str = WORDS) -> DataFrame:
    """id, licences (identifiers joined by a comma), n_sentences (known ones, in lines or unwrapped, whichever has more) and has_licence of every row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    none = F.struct(F.lit("").alias("licences"), F.lit(0).cast("bigint").alias("n_sentences"))

    def found(lines: Column) -> Column:
        return let(_sequence(_sentences(_unwrapped(text))), lambda joined: F.struct(
            F.array_join(F.array_sort(F.array_distinct(F.concat(_licences(lines), _licences(joined)))), ",").alias("licences"),
            F.greatest(F.size(lines), F.size(joined)).cast("bigint").alias("n_sentences"),
        ))

    scanned = F.when(F.lower(text).rlike(words), let(_sequence(_sentences(text)), found)).otherwise(none)
    return docs.select(F.col(f"`{id_col}`"), scanned.alias("_s")).select(f"`{id_col}`", "_s.licences", "_s.n_sentences", (F.col("_s.licences") != "").alias("has_licence"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _pairs(items) -> str:
    return ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in items)


def _rule_sql(ids: list[str], stops: list[str]) -> str:
    """The rule as a pattern over the joined identifiers: between two, only identifiers that may stand there."""
    every = {*SENTENCES, *(y for x in MORE.values() for y in x.split(" "))}
    gap = "(?:(?:" + "|".join([*(re.escape(x) for x in sorted(every - {*stops})), r"notice:\S+"]) + ") )*" if stops else r"(?:\S+ )*"
    return f" (?:{f' {gap}'.join(re.escape(x) for x in ids)}) "


_RULES_SQL = "\n        UNION ALL ".join(f"SELECT r, {_quoted(licence)} AS licence FROM seqs WHERE regexp_matches(joined, {_quoted(_rule_sql(ids, stops))})" for licence, ids, stops in RULES)
#: Every text is scanned, without looking for WORDS first.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
known(sentence, id) AS (VALUES {_pairs([*((t, n) for n, t in SENTENCES.items()), *MORE.items()])}),
names(name, licence) AS (VALUES {_pairs(_names().items())}),
c AS (SELECT r, 1 AS way, text FROM d
      UNION ALL SELECT r, 2, translate(regexp_replace(text, '\\n[ \\t\\r\\n]*\\n', chr(1), 'g'), chr(10) || chr(1), ' ' || chr(10)) FROM d),
s AS (SELECT r, way, string_split(regexp_replace(text, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM c),
u AS (SELECT r, way, unnest(range(len(parts))) AS pos, parts FROM s),
n AS (SELECT r, way, pos, trim(regexp_replace(lower(parts[pos + 1]), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM u),
i AS (SELECT n.r, n.way, n.pos, coalesce(known.id, CASE WHEN regexp_matches(sentence, {_quoted(NOTICE)}) THEN 'notice:' || coalesce(a.licence, b.licence) || CASE WHEN coalesce(a.licence, b.licence) NOT IN ({", ".join(map(_quoted, GNU))}) THEN '' WHEN regexp_matches(sentence, {_quoted(_LATER)}) THEN '-or-later' WHEN sentence LIKE '% only' THEN '-only' ELSE '' END END) AS id
      FROM n LEFT JOIN known USING (sentence)
      LEFT JOIN names a ON a.name = regexp_replace(sentence, {_quoted(NOTICE)}, '')
      LEFT JOIN names b ON b.name = regexp_replace(regexp_replace(sentence, {_quoted(NOTICE)}, ''), {_quoted(AFTER)}, '') WHERE sentence <> ''),
seqs AS (SELECT r, way, ' ' || string_agg(id, ' ' ORDER BY pos) || ' ' AS joined, sum(len(string_split(id, ' '))) AS n FROM i WHERE id IS NOT NULL GROUP BY r, way),
l AS (SELECT r, substr(id, 8) AS licence FROM i WHERE id LIKE 'notice:%'
        UNION ALL {_RULES_SQL}),
g AS (SELECT r, string_agg(licence, ',' ORDER BY licence) AS licences FROM (SELECT DISTINCT r, licence FROM l) GROUP BY r),
m AS (SELECT r, max(n) AS n FROM seqs GROUP BY r)
SELECT doc_id, coalesce(licences, '') AS licences, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, licences IS NOT NULL AS has_licence
FROM d LEFT JOIN g USING (r) LEFT JOIN m USING (r)
"""

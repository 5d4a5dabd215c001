"""Licence scans by sentence rules.

A text is cut into sentences after . ! ? with white space or a line end, at blank lines, list items
and colons that end a line. Comment signs at line starts don't count. A sentence is looked up whole, over
wrapped lines, and where it isn't known, line by line; for that it is normalised (lower case, runs of other characters than a-z and 0-9 become one
blank). It has an identifier if it is a known licence sentence; if it begins and ends as one whose middle is free (the name of an organisation);
if it says that something is released under a licence, or is a title, with a known name; and one for each licence of an SPDX line.
The identifiers found, in text order, are matched against rules: a rule holds where its identifiers occur in its order, other known sentences
between them allowed, unless the text fulfils a rule that holds all its identifiers and more (BSD's three clauses
hold the two). That all rights are reserved is a result only where there is no licence. All of it is row-wise Spark SQL, so nothing is shuffled
and a hot licence costs nothing; texts without any of the ``HINTS``, of which every known sentence has one, are passed over.

null and empty texts: no result. Repeated rows: each gives its own. A rule that occurs more
than once in a text is reported once. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FREE = "this program is free software you can redistribute it and or modify it under the terms of the gnu {}general public license"
_FSF = " as published by the free software foundation"
_LATER = " either version {} of the license or at your option any later version"
_NO_NAME = "used to endorse or promote products derived from this software without specific prior written permission"
#: Identifier and normalised sentence of well-known licence texts.
SENTENCES = {
    "apache-name": "licensed under the apache license version 2 0",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-name": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied",
    "gpl3-name": "this work is licensed under the gnu general public license version 3",
    "gpl-free": _FREE.format("") + _FSF,
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "agpl-free": _FREE.format("affero ") + _FSF,
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-names": f"neither the name of the copyright holder nor the names of its contributors may be {_NO_NAME}",
    "cc-by-nc-name": "licensed under cc by nc 4 0",
    "cc-by-name": "licensed under cc by 4 0",
    "cc-by-sa-name": "licensed under cc by sa 4 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license" + _FSF,
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v",  # "v. 2.0" ends a sentence at its first dot
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "reserved": "all rights reserved",
}
#: Known beginning and end of sentences whose middle is free, and their identifier.
SLOTS = [
    ("neither the name", f"may be {_NO_NAME}", "bsd-names"),
    ("nor the names of its contributors", f"may be {_NO_NAME}", "bsd-names"),  # after a name that ends with a dot
    ("the name", f"may not be {_NO_NAME}", "bsd-names"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "subject to the following", "boost-grant"),
    ("all advertising materials mentioning features or use of this software must display the following acknowledgement", "", "bsd-advert"),
]
_GRANT = ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_PLAIN = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
_FIT = " without even the implied warranty of merchantability or fitness for a particular purpose"
#: Whole sentences of the licences where SENTENCES has their beginnings or parts, and the identifiers that they stand for.
WHOLE = {
    SENTENCES["apache-name"] + " the license " + SENTENCES["apache-may-not"]: ["apache-name", "apache-may-not"],
    SENTENCES["apache-name"] + " the license": ["apache-name"],
    SENTENCES["apache-copy"].replace("http", "https"): ["apache-copy"],
    SENTENCES["mit-grant"] + " " + _PLAIN(_GRANT): ["mit-grant"],
    SENTENCES["mit-as-is"] + " " + _PLAIN("including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"): ["mit-as-is"],
    **{SENTENCES["gpl-free"] + _LATER.format(v): ["gpl-free", f"gpl-{v}-later"] for v in (2, 3)},
    **{SENTENCES["gpl-free"] + tail: ["gpl-free", f"gpl-{v}-only"] for v in (2, 3) for tail in (f" version {v} of the license", f" version {v}")},
    **{_FREE.format("") + f" version {v}" + _FSF: ["gpl-free", f"gpl-{v}-only"] for v in (2, 3)},
    SENTENCES["agpl-free"] + _LATER.format(3): ["agpl-free", "agpl-3-later"],
    SENTENCES["agpl-free"] + " version 3 of the license": ["agpl-free", "agpl-3-only"],
    SENTENCES["gpl-hope"] + _FIT: ["gpl-hope"],
    **{SENTENCES["lgpl-free"] + _LATER.format(_PLAIN(v)): ["lgpl-free", f"lgpl-{v}-later"] for v in ("2", "2.1", "3")},
    SENTENCES["lgpl-hope"] + _FIT: ["lgpl-hope"],
    SENTENCES["isc-grant"].replace("and or", "and"): ["isc-grant"],
    **{SENTENCES["mpl-terms"] + tail: ["mpl-terms"] for tail in (" 2 0",)},
    **{"apache license version 2 0 january 2004" + tail: ["apache-2.0-named"] for tail in ("", " http www apache org licenses", " https www apache org licenses")},
    "gnu general public license version 2 june 1991": ["gpl-2.0-named"],
    **{f"gnu {x}general public license version 3 29 june 2007": [f"{k}-3.0-named"] for x, k in (("", "gpl"), ("lesser ", "lgpl"))},
    "gnu affero general public license version 3 19 november 2007": ["agpl-3.0-named"],
    "the mit license mit": ["mit-name"],
}
#: Names by which texts say their licence, normalised.
NAMES = {
    "mit": ["mit license", "mit licence", "mit"],
    "apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0", "apache 2 0"],
    "bsd-2-clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "bsd-3-clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "isc": ["isc license"],
    **{f"gpl-{v}.0": [f"gnu general public license version {v}", f"gnu general public license v{v}", f"gnu general public license v{v} 0", f"gnu gpl version {v}", f"gnu gpl v{v}", f"gpl version {v}", f"gpl v{v}", f"gplv{v}"] for v in (2, 3)},
    **{f"lgpl-{v}": [f"gnu lesser general public license version {_PLAIN(v)}", f"gnu lesser general public license v{_PLAIN(v)}", f"gnu lgpl version {_PLAIN(v)}", f"lgpl v{_PLAIN(v)}", f"lgplv{_PLAIN(v)}"] for v in ("2.1", "3.0")},
    "agpl-3.0": ["gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl version 3", "agpl v3", "agplv3"],
    "mpl-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0"],
    "epl-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0"],
    "bsl-1.0": ["boost software license version 1 0", "boost software license"],
    "unlicense": ["unlicense"],
    "zlib": ["zlib license"],
    "cc0-1.0": ["cc0 1 0", "cc0 1 0 universal", "cc0 license"],
    **{f"cc-by{k}-4.0": [f"cc by{_PLAIN(k) and ' ' + _PLAIN(k)} 4 0", f"creative commons attribution{more} 4 0 international license", f"creative commons attribution{more} 4 0 license"] for k, more in (("", ""), ("-sa", " sharealike"), ("-nc", " noncommercial"))},
}
#: SPDX identifiers whose own licence goes by another name here; those of NAMES stand for themselves.
SPDX = {f"{f}-{v}{tail}": f"{f}-{v}{'-or-later' * (tail == '-or-later')}" for f, vs in (("gpl", ("2.0", "3.0")), ("lgpl", ("2.1", "3.0")), ("agpl", ("3.0",))) for v in vs for tail in ("-only", "-or-later")}
SPDX |= {x: x for x in (*NAMES, "0bsd", "artistic-2.0", "bsd-4-clause", "cc-by-nc-sa-4.0", "cc-by-nd-4.0", "epl-1.0", "eupl-1.2", "lgpl-2.0", "mpl-1.1", "ms-pl", "ofl-1.1", "postgresql", "psf-2.0", "python-2.0", "wtfpl")}
#: Rule name, licence, identifiers in order.
RULES = [
    ("apache-2.0-name", "apache-2.0", ["apache-name"]),
    ("apache-2.0-header", "apache-2.0", ["apache-name", "apache-may-not", "apache-copy", "apache-basis"]),
    ("mit-name", "mit", ["mit-name"]),
    ("mit-text", "mit", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("gpl-3.0-name", "gpl-3.0", ["gpl3-name"]),
    ("gpl-notice", "gpl", ["gpl-free", "gpl-hope"]),
    *((f"gpl-{v}.0-notice{name}", f"gpl-{v}.0{name}", ["gpl-free", f"gpl-{v}-{kind}"]) for v in (2, 3) for kind, name in (("only", ""), ("later", "-or-later"))),
    *((f"agpl-3.0-notice{name}", f"agpl-3.0{name}", ["agpl-free", f"agpl-3-{kind}"]) for kind, name in (("only", ""), ("later", "-or-later"))),
    ("bsd-2-text", "bsd-2-clause", ["bsd-source", "bsd-binary"]),
    ("bsd-3-text", "bsd-3-clause", ["bsd-source", "bsd-binary", "bsd-names"]),
    ("bsd-4-text", "bsd-4-clause", ["bsd-source", "bsd-binary", "bsd-advert", "bsd-names"]),
    ("bsl-1.0-text", "bsl-1.0", ["boost-grant"]),
    ("cc-by-nc-name", "cc-by-nc-4.0", ["cc-by-nc-name"]),
    ("cc-by-name", "cc-by-4.0", ["cc-by-name"]),
    ("cc-by-sa-name", "cc-by-sa-4.0", ["cc-by-sa-name"]),
    ("isc-text", "isc", ["isc-grant"]),
    ("lgpl-notice", "lgpl", ["lgpl-free", "lgpl-hope"]),
    *((f"lgpl-{v}-notice", f"lgpl-{v}{'.0' * ('.' not in v)}-or-later", ["lgpl-free", f"lgpl-{v}-later"]) for v in ("2", "2.1", "3")),
    ("mpl-2.0-header", "mpl-2.0", ["mpl-terms"]),
    ("unlicense-text", "unlicense", ["unlicense-free"]),
    ("zlib-text", "zlib", ["zlib-as-is", "zlib-grant"]),
    *((f"{x}-named", x, [f"{x}-named"]) for x in NAMES if x != "mit"),
    *((f"{x}-spdx", lic, [f"{x}-spdx"]) for x, lic in SPDX.items()),
    ("reserved", "proprietary", ["reserved"]),
]
#: Rules that give way to every other one; notices of a version do to a rule with their identifiers and more.
LAST = ("reserved",)
GIVES_WAY = {"gpl-notice": ("gpl-2.0-notice", "gpl-3.0-notice", "gpl-2.0-notice-or-later", "gpl-3.0-notice-or-later"), "lgpl-notice": ("lgpl-2-notice", "lgpl-2.1-notice", "lgpl-3-notice")}
#: Words of which every known sentence has one.
HINTS = ("licen", "redistribut", "warrant", "copyright", "permission", "reserved", "spdx", "unencumbered", "endorse", "gpl", "cc by", "cc-by", "cc0", "mpl 2", "advertis", "apache", "under the mit", "under mit")
#: Says that something is released under what follows.
SAYS = "^(?:(?:[a-z0-9]+ ){0,8}(?:is|are) )?(?:dual |made )?(?:licensed|licenced|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:conditions of (?:the )?)?(.+)$"
SPDX_LINE = "spdx license identifier "
#: Where a sentence ends.
CUT = "[.!?]+[ \\t\\r]+|[.!?]*\\n+"
#: Stands for a line end within a sentence.
WRAP = "\x01"
#: What is found and put, in this order, so that line ends are those of sentences; ``WRAP`` for the others. No pattern looks around.
UNWRAP = [
    ("\\r\\n", "\n"),
    ("(?m)^[ \\t]*(?:<!--|-->|/\\*+|\\*+/|\\*+|//+|#+|;+|--+|%+|(?:dnl|rem|REM)(?:[ \\t]|$))?[ \\t]*", ""),
    ("\\n\\n+(https?://)", WRAP + "{1}"),  # an address set apart belongs to its sentence
    ("(?m)^(?:[-•*]|\\(?[0-9]{1,2}[.)]|\\(?[a-z][.)])[ \\t]+", "\n\n"),
    (":[ \\t]*\\n", "\n\n"),
    ("\\n\\n+", "\x02"),
    ("([.!?])\\n", "{1}\x02"),
    ("\\n", WRAP),
    ("\x02", "\n"),
]


def pattern(ids: list[str]) -> str:
    return "%" + "%".join(f"|{i}|" for i in ids) + "%"


def longer(name: str, ids: list[str], rules: list[tuple[str, str, list[str]]]) -> list[str]:
    """Patterns of the rules that this one gives way to: those that hold all of ``ids`` in this order and more, and those it is said to."""

    def holds(more: list[str]) -> bool:
        rest = iter(more)
        return len(more) > len(ids) and all(i in rest for i in ids)

    return [pattern(more) for other, _, more in rules if holds(more) or other in GIVES_WAY.get(name, ()) or (name in LAST and other not in LAST)]


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def unwrapped(text: Column) -> Column:
    for find, put in UNWRAP:
        text = F.regexp_replace(text, find, put.replace("{1}", "$1"))
    return text


def known_names() -> dict[str, str]:
    return {n: "|mit-name|" if x == "mit" else f"|{x}-named|" for x, names in NAMES.items() for n in names}


def titles() -> dict[str, str]:
    """Names that stand as a sentence of their own."""
    return {t: i for n, i in known_names().items() if "license" in n for t in (n, f"the {n}")}


def known_spdx() -> dict[str, str]:
    return {_PLAIN(x).replace(" or later", "-later"): f"|{x}-spdx|" for x in SPDX}


def known_sentences(sentences: dict[str, str], whole: dict[str, list[str]]) -> dict[str, str]:
    return titles() | {s: f"|{i}|" for i, s in sentences.items()} | {s: "".join(f"|{i}|" for i in ids) for s, ids in whole.items()}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES, whole: dict[str, list[str]] = WHOLE) -> Column:
    """The known identifiers of a text in order, each between bars."""
    table = known_sentences(sentences, whole)
    low = min(map(len, table))
    known, names, spdx = _map(table), _map(known_names()), _map(known_spdx())

    def found(n: Column) -> Column:
        ids = F.transform(F.split(F.replace(F.substring(n, len(SPDX_LINE) + 1, 1000), F.lit(" or later"), F.lit("-later")), " (?:or|and|with) "), lambda x: F.coalesce(F.try_element_at(spdx, F.trim(x)), F.lit("")))
        said = F.when(n.contains(" under "), F.try_element_at(names, F.regexp_extract(n, SAYS, 1)))
        slots = [F.when(n.startswith(a) & n.endswith(b), F.lit(f"|{i}|")) for a, b, i in SLOTS]
        return F.coalesce(F.try_element_at(known, n), *slots, said, F.when(n.startswith(SPDX_LINE), F.nullif(F.array_join(ids, ""), F.lit(""))))

    # a lambda binds the normalised sentence, so that it is worked out once
    look = lambda s: F.when(F.length(s) >= low, F.element_at(F.transform(F.array(normalised(s)), found), 1))
    parts = F.filter(F.split(unwrapped(F.coalesce(text, F.lit(""))), CUT), lambda s: F.length(s) >= low)
    return F.array_join(F.transform(parts, lambda s: F.coalesce(look(s), F.when(s.contains(WRAP), F.array_join(F.transform(F.split(s, WRAP), look), "")))), "")


def hinted(text: Column) -> Column:
    """Whether a text may hold a known sentence."""
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, (low.contains(h) for h in HINTS)), F.lit(False))


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str, list[str]]] = RULES, whole: dict[str, list[str]] = WHOLE) -> DataFrame:
    """(doc_id, rule, license, sentences) of every rule that a text fulfils."""
    table = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(lic).alias("license"), F.lit(pattern(ids)).alias("pattern"), F.array(*map(F.lit, longer(n, ids, rules))).cast("array<string>").alias("longer")) for n, lic, ids in rules))
    seq = docs.filter(hinted(F.col("text"))).select("doc_id", identifiers(F.col("text"), sentences, whole).alias("sentences")).filter(F.col("sentences") != "")
    hit = seq.select("doc_id", "sentences", F.explode(table).alias("r"))
    return hit.filter(F.expr("sentences like r.pattern and not exists(r.longer, p -> sentences like p)")).select("doc_id", "r.rule", "r.license", "sentences")


def scan_sql(sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str, list[str]]] = RULES, whole: dict[str, list[str]] = WHOLE) -> str:
    """The same in DuckDB's SQL, over all texts."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = lambda pairs: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs.items())
    table = known_sentences(sentences, whole)
    low = min(map(len, table))
    text = "coalesce(text, '')"
    for find, put in UNWRAP:
        text = f"regexp_replace({text}, {quoted(find)}, {quoted(put.replace('{1}', chr(92) + '1'))}, 'g')"
    plain = lambda s: f"trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))"
    slots = " ".join(f"WHEN starts_with(n, {quoted(a)}) AND ends_with(n, {quoted(b)}) THEN '|{i}|'" for a, b, i in SLOTS)
    spdx = f"nullif((SELECT string_agg(coalesce(z.id, ''), '' ORDER BY o) FROM (SELECT unnest(p) AS x, generate_subscripts(p, 1) AS o FROM (SELECT string_split_regex(replace(n[{len(SPDX_LINE) + 1}:], ' or later', '-later'), ' (?:or|and|with) ') AS p)) e LEFT JOIN spdx z ON z.s = trim(x)), '')"
    found = f"""SELECT d.*, coalesce(k.id, CASE {slots} END, m.id, CASE WHEN starts_with(n, '{SPDX_LINE}') THEN {spdx} END) AS id FROM @ d LEFT JOIN known k ON k.s = n LEFT JOIN names m ON m.s = nullif(regexp_extract(n, '{SAYS}', 1), '')"""
    rows = ", ".join(f"('{n}', '{lic}', '{pattern(ids)}', {longer(n, ids, rules)}::varchar[])" for n, lic, ids in rules)
    return rf"""
    WITH known(s, id) AS (VALUES {values(table)}), names(s, id) AS (VALUES {values(known_names())}), spdx(s, id) AS (VALUES {values(known_spdx())}), rules(rule, license, pattern, longer) AS (VALUES {rows}),
    doc AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex({text}, {quoted(CUT)}) AS p FROM documents), part AS (SELECT r, doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS k FROM doc),
    norm AS (SELECT r, doc_id, k, s, {plain('s')} AS n FROM part WHERE length(s) >= {low}), whole AS ({found.replace('@', 'norm')}),
    line AS (SELECT r, doc_id, k, s, generate_subscripts(l, 1) AS j, unnest(l) AS t FROM (SELECT *, string_split(s, '{WRAP}') AS l FROM whole WHERE id IS NULL AND contains(s, '{WRAP}'))),
    lines AS (SELECT r, doc_id, k, j, {plain('t')} AS n FROM line WHERE length(t) >= {low}), each AS ({found.replace('@', 'lines')}),
    ids AS (SELECT r, doc_id, k, 0 AS j, id FROM whole WHERE id IS NOT NULL UNION ALL SELECT r, doc_id, k, j, id FROM each WHERE id IS NOT NULL),
    seq AS (SELECT doc_id, string_agg(id, '' ORDER BY k, j) AS sentences FROM ids GROUP BY r, doc_id)
    SELECT doc_id, rule, license, sentences FROM seq JOIN rules ON sentences LIKE pattern AND len([p FOR p IN longer IF sentences LIKE p]) = 0
    """

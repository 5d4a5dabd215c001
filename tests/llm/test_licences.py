"""Licence texts with names, versions, SPDX lines and wraps, each by its true licence, here and in the twin."""

import duckdb
import pytest

from shoal.llm import licenses

BSD = """Copyright (c) 2009, {holder}. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
{more}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""
NAMES = """   * Neither the name of {holder} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
ADVERT = """   * All advertising materials mentioning features or use of this software
must display the following acknowledgement: This product includes software.
"""
FREE = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation{}.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the license."
CASES = [
    (BSD.format(holder="the University", more=NAMES.format(holder="the University")), {"bsd-3-clause"}),
    (BSD.format(holder="Google Inc", more=NAMES.format(holder="Google Inc.")), {"bsd-3-clause"}),
    (BSD.format(holder="X", more=ADVERT + NAMES.format(holder="X")), {"bsd-4-clause"}),
    (BSD.format(holder="X", more=""), {"bsd-2-clause"}),
    ("\n".join("// " + x for x in BSD.format(holder="X", more=NAMES.format(holder="X")).split("\n")), {"bsd-3-clause"}),
    ("Copyright (c) 2020 X. All rights reserved.", {"proprietary"}),
    ("SPDX-License-Identifier: MIT", {"mit"}),
    ("# SPDX-License-Identifier: Apache-2.0\nimport os", {"apache-2.0"}),
    ("/* SPDX-License-Identifier: GPL-2.0-only */", {"gpl-2.0"}),
    ("<!-- SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause -->", {"mit", "apache-2.0", "bsd-3-clause"}),
    ("SPDX-License-Identifier: LGPL-2.1-or-later WITH some-exception", {"lgpl-2.1-or-later"}),
    ("SPDX-License-Identifier: Nothing-1.0", set()),
    ("Licensed under the MIT license.", {"mit"}),
    ("This library is made available under the terms of the Mozilla Public License, Version 2.0", {"mpl-2.0"}),
    ("The whole of this work is distributed under the BSD 3-Clause License!", {"bsd-3-clause"}),
    ("We met under the bridge.", set()),
    (FREE.format("General Public License", "; either version 2 of the License, or\n(at your option) any later version"), {"gpl-2.0-or-later"}),
    (FREE.format("General Public License", "; version 2 of the License"), {"gpl-2.0"}),
    (FREE.format("General Public License version 2", ""), {"gpl-2.0"}),
    (FREE.format("General Public License", ""), {"gpl"}),
    (FREE.format("Affero General Public License", ", either version 3 of the\nLicense, or (at your option) any later version"), {"agpl-3.0-or-later"}),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", {"apache-2.0"}),
    ("Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", {"isc"}),
    ("The MIT License (MIT)\n\nCopyright (c) X", {"mit"}),
    ("MIT License", {"mit"}),
    ("This work is licensed under the GNU General Public License, version 3", {"gpl-3.0"}),
    ("Released under CC BY-SA 4.0. All rights reserved.", {"cc-by-sa-4.0"}),
    ("Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\") to use it, all subject to the following:", {"bsl-1.0"}),
    ("", set()),
    (None, set()),
    ("no words of law " * 20_000 + ". Licensed under the ISC license.", {"isc"}),
]


def found(rows):
    out = {}
    for k, lic in rows:
        out.setdefault(k, set()).add(lic)
    return [out.get(k, set()) for k in range(len(CASES))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(CASES)], "doc_id long, text string, license string")


def test_true_licences(spark, docs):
    got = found((r.doc_id, r.license) for r in licenses.scan(docs).collect())
    assert [(k, g) for k, g in enumerate(got)] == [(k, want) for k, (_, want) in enumerate(CASES)]


def test_the_twin_unwraps_too(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    sql = con.execute(licenses.scan_sql()).fetchall()
    got = licenses.scan(docs).select("doc_id", "rule", "license", "sentences").collect()
    assert sorted(sql) == sorted(tuple(r) for r in got)


def test_every_known_sentence_has_a_hint():
    known = licenses.known_sentences(licenses.SENTENCES, licenses.WHOLE)
    assert [s for s in known if not any(h in s for h in licenses.HINTS)] == []
    for a, b, _ in licenses.SLOTS:
        assert any(h in f"{a} {b}" for h in licenses.HINTS)
    made = {i for ids in licenses.known_sentences({}, licenses.WHOLE).values() for i in ids.strip("|").split("||")} | set(licenses.SENTENCES) | {i for *_, i in licenses.SLOTS} | {i.strip("|") for i in licenses.known_names().values()} | {i.strip("|") for i in licenses.known_spdx().values()}
    assert [i for _, _, ids in licenses.RULES for i in ids if i not in made] == []
    names = [n for n, _, _ in licenses.RULES]
    assert len(names) == len(set(names))

import hashlib
import re

from loam.llm import licenses, queries, secrets

DOCS = "doc_id long, text string, source string, spans string, owner string"


def base_spans(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(
        [
            ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
            ("hex", r"([0-9a-f]+)", 1, 24),
        ]
    ):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [x[2] for x in sorted(found)]


TEXTS = [
    None, "", "nothing", "é PassWord = 'abcdef' token:xyz api_key=\"k3y-v4lue\"", "AKIAAKIA" + "Z" * 12 + " AKIA" + "A" * 16, "password:token:abcdefg secret:abc",
    "f" * 23 + " " + "0a" * 12 + "Z" + "ab" * 30, "𝒳 token = abcdefgh " * 3, "apikey=" + "x" * 5000, "ghp_" + "a" * 36 + " eyJabcdefgh12.abcdefgh12.abcdefgh12", "-----BEGIN RSA PRIVATE KEY-----",
    "x " * 60_000 + "secret: abcdef",
]


def test_base_spans_equal_a_plain_scan(spark):
    docs = spark.createDataFrame([(i, t, f"s{i % 3}", "x", None) for i, t in enumerate(TEXTS)], DOCS)
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        own = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x.startswith(k) for x in own) for k in ("assign", "access", "hex")]
        assert set(own) <= set(got[i]["spans"].split(","))
    assert "github:0:40" in got[9]["spans"] and "jwt:" in got[9]["spans"] and got[10]["spans"] == "pem:0:31"


def test_very_many_matches_in_one_text(spark):
    """Time grows with the matches, not with their square."""
    import time

    text = "".join(f"é token = v{i:07d} \n" for i in range(200_000)) + "f" * 24
    docs = spark.createDataFrame([(1, text, "s", None, None)], DOCS)
    began = time.perf_counter()
    got = secrets.digest(secrets.scan(docs)).first()
    assert time.perf_counter() - began < 60
    own = base_spans(text)
    assert got["n_assign"] == 200_000 and got["n_hex"] == 1 and got["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest()


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 7, 8, 9, 26):
        df = spark.createDataFrame([(list(range(n)),)], "x array<long>")
        assert df.select(secrets.running(secrets.F.col("x"), 3)).first()[0] == [sum(range(i + 1)) for i in range(n)]


def test_owners_part_copied_from_live_values(spark):
    rows = [(i, "token = sharedvalue1", f"owner{i}", None, None) for i in range(5)] + [(10, "token = onlymine123", "owner1", None, None), (10, "token = onlymine123", "owner1", None, None), (11, "token = twoowners1", "a", None, None), (12, "token = twoowners1", None, None, None)]
    got = {(r["doc_id"], r["n_live"], r["n_shared"], r["n_copied"], r["most_repositories"]) for r in secrets.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {*((i, 0, 0, 1, 5) for i in range(5)), (10, 1, 0, 0, 1), (11, 0, 1, 0, 2), (12, 0, 1, 0, 2)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert secrets.digest(secrets.scan(empty)).count() == 0 and licenses.scan(empty).count() == 0


def test_licences(spark):
    mit = "The MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."
    mit += " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    texts = {
        1: "Some text. Licensed under the Apache License, Version 2.0.", 2: "x\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.", 3: mit,
        4: None, 5: "", 6: "He has a license to drive.", 7: "w " * 100_000 + "\nLicensed under CC BY-NC 4.0.", 8: "Released under the MIT License.\nReleased under the MIT License.",
    }
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOCS)).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["MIT", "GPL-3.0"], 3: ["MIT"], 4: [], 5: [], 6: [], 7: ["CC-BY-NC-4.0"], 8: ["MIT", "MIT"]}


def test_every_known_sentence_holds_a_hint():
    assert all(re.search(licenses.HINT, s) for s in licenses.SENTENCES)
    assert all(re.search(licenses.HINT, words.replace("~", "")) for words, _ in licenses.LONG)
    found = set(licenses.SENTENCES.values()) | {i for _, ids in licenses.LONG for i in ids}
    assert {i for _, ids in licenses.RULES for i in ids} <= found | {"..."}


def test_plans_hold_no_python(spark, sf_dir):
    for q in (queries.op4_license_scan, queries.op7_secret_scan):
        plan = q(spark, sf_dir)._jdf.queryExecution().toString()
        assert not re.search("EvalPython|InPandas|InArrow|PythonUDF|pythonUDF|PythonMap", plan)  # a licence is named Python


MIT = """MIT License

Copyright (c) 2020 A. Person

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
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n"


def test_unmodified_licence_texts(spark):
    texts = {"MIT": MIT, "BSD-2-Clause": BSD.format(""), "BSD-3-Clause": BSD.format(ENDORSE), "GPL-3.0-or-later": GPL, "GPL-2.0-or-later": GPL.replace("software:", "software;").replace("version 3", "version 2"), "Apache-2.0": APACHE, "MPL-2.0": MPL}
    longest = {"MIT": 4, "BSD-2-Clause": 4, "BSD-3-Clause": 5, "GPL-3.0-or-later": 3, "GPL-2.0-or-later": 3, "Apache-2.0": 4, "MPL-2.0": 1}
    shapes = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: " ".join(t.split()) if "MIT" not in t[:4] else t, *(lambda t, c=c: "".join(f"{c} {x}\n" for x in t.splitlines()) for c in ("#", "//", " *", "--"))]
    rows = [(k, name, shape(text)) for k, shape in enumerate(shapes) for name, text in texts.items()]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, (_, _, t) in enumerate(rows)], DOCS)
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, (k, name, _) in enumerate(rows):
        if k == 2 and name == "Apache-2.0":  # its address ends no sentence on one line
            assert set(got[i]["licenses"]) == {name}
            continue
        assert got[i]["licenses"] == [name] and got[i]["rules"][0].count("<") == longest[name], (k, name, got[i])


ISC = """ISC License

Copyright (c) 2020, A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
CC = "This work is licensed under a Creative Commons Attribution-{} 4.0\nInternational License.\n"


def test_more_unmodified_licence_texts(spark):
    texts = {
        "ISC": ISC, "LGPL-2.1-or-later": LGPL, "LGPL-3.0-or-later": LGPL.replace("version 2.1", "version 3"), "AGPL-3.0-or-later": AGPL, "EPL-2.0": EPL, "Unlicense": UNLICENSE,
        "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n", "CC-BY-SA-4.0": CC.format("ShareAlike"), "CC-BY-ND-4.0": CC.format("NoDerivatives"),
        "CC-BY-NC-SA-4.0": CC.format("NonCommercial-ShareAlike"), "CC-BY-NC-4.0": CC.format("NonCommercial"), "CC-BY-4.0": CC.format("X").replace("-X", ""),
    }
    shapes = [lambda t: t, lambda t: t.replace("\n", "\r\n"), *(lambda t, c=c: "".join(f"{c} {x}\n" for x in t.splitlines()) for c in ("#", "//", " *"))]
    rows = [(k, name, shape(text)) for k, shape in enumerate(shapes) for name, text in texts.items()]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, (_, _, t) in enumerate(rows)], DOCS)
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    for i, (k, name, _) in enumerate(rows):
        assert got[i] == [name], (k, name, got[i])


def test_web_tokens_are_those_of_the_pattern(spark):
    """Random runs of short parts against the pattern itself, and against the SQL."""
    import random
    import re

    rng = random.Random(8)
    pattern = re.compile(dict((k[0], k[1]) for k in secrets.ADDED)["jwt"])
    pieces = ["eyJ", "eyJeyJ", "abcdefgh", "abcdefg", ".", ".", ".", "..", "A1_-", " ", "é", "eyJabcdefgh", "12345678", "eyJ1234567"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(400)] + ["eyJabcdefgh.abcdefgh.abcdefgh" * 3, "x.eyJabcdefgh.abcdefgh.abcdefgh.eyJabcdefgh.abcdefgh.eyJabcdefgh", "😀eyJabcdefgh.abcdefgh.abcdefgh"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    n = secrets.KINDS.index("jwt")
    got = {r["doc_id"]: [(s["start"], s["stop"], s["value"]) for s in r["spans"] if s["kind"] == n] for r in secrets.scan(docs).collect()}
    assert got == {i: [(m.start(), m.end(), m.group(1)) for m in pattern.finditer(t)] for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 15


def test_long_runs_take_linear_time(spark):
    """Five million characters that almost are of each added kind."""
    import time

    runs = {"jwt": "eyJ" * 1_700_000, "github": "ghp_" * 1_250_000, "slack": "xoxb-" * 1_000_000, "pem": "-----BEGIN " + "A " * 2_500_000, "words": "abJ" * 1_700_000}
    for kind, text in runs.items():
        docs = spark.createDataFrame([(1, text, None, None, None)], DOCS)
        began = time.perf_counter()
        secrets.scan(docs).collect()
        assert time.perf_counter() - began < 60, kind


def licences_of(spark, texts: list[str]) -> list[list[str]]:
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    return [r["licenses"] for r in licenses.scan(docs).orderBy("doc_id").collect()]


def test_full_texts_of_this_machine(spark):
    """The licences a Debian system has; a text that is not there is passed over."""
    import os

    here = "/usr/share/common-licenses"
    want = {
        "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
        "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
    }
    there = {f: n for f, n in want.items() if os.path.exists(f"{here}/{f}")}
    texts = [open(f"{here}/{f}", encoding="utf-8").read() for f in there]
    for shape in (lambda t: t, lambda t: "".join(f" * {x}\n" for x in t.splitlines())):
        got = licences_of(spark, [shape(t) for t in texts])
        assert {f: set(g) for f, g in zip(there, got, strict=True)} == {f: {n} for f, n in there.items()}


def test_notices_within_sentences(spark):
    texts = {
        "This code is available under the MIT License, see file LICENSE.": ["MIT"], "It is released\n# under the terms of the GNU General Public License,\n# version 3 only.": ["GPL-3.0"],
        "Licensed under the GNU GPL version 2 or later": ["GPL-2.0-or-later"], "distributed under the Boost Software License, Version 1.0. (See accompanying file)": ["BSL-1.0"],
        "you can redistribute it": [], "This work is licensed under a Creative Commons\n Attribution-NonCommercial-NoDerivatives 4.0 International License.": ["CC-BY-NC-ND-4.0"],
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.": ["0BSD"],
        "This software is provided 'as-is', without any express or implied\nwarranty. Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely": ["Zlib"],
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2.": ["GPL-2.0-only"],
        "lcnsntnc3 lcnsntnc4\nlcnsntnc5": [], "licensed under the mit license; licensed under the isc license": ["MIT", "ISC"],
    }
    assert dict(zip(texts, licences_of(spark, list(texts)), strict=True)) == texts
    docs = spark.createDataFrame([(1, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nx\nSPDX-License-Identifier:GPL-2.0-only WITH Classpath-exception-2.0 */", None, None, None), (2, None, None, None, None)], DOCS)
    assert [r["spdx"] for r in licenses.scan(docs).orderBy("doc_id").collect()] == [["(MIT OR Apache-2.0) AND BSD-3-Clause", "GPL-2.0-only WITH Classpath-exception-2.0"], []]


def test_wrapped_licences_equal_the_sql(spark):
    import duckdb
    import pyarrow as pa

    texts = [MIT, BSD.format(ENDORSE), GPL, APACHE, MPL, ISC, LGPL, AGPL, EPL, UNLICENSE, CC.format("ShareAlike"), "x", "", None, "Released under the MIT License. And licensed\n under the\n* Apache License, Version 2.0, too", "SPDX-License-Identifier: MIT"]
    texts += ["".join(f"# {x}\n" for x in t.splitlines()) for t in texts if t] + [a + "\n" + b for a, b in zip(texts, texts[3:], strict=False) if a and b]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))
    want = sorted(con.execute(licenses.ORACLE).fetchall(), key=str)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = licenses.scan(docs)
    from pyspark.sql import functions as F

    got = got.withColumns({c: F.array_join(c, ";") for c in ("licenses", "rules", "spdx")})
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and sum(bool(r[1]) for r in want) > 30
    assert len({name for name, _ in licenses.RULES}) >= 50

import math
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses as L

FILES = [
    ("a/LICENSE", "Released under the MIT License."),
    ("a/x.txt", "nothing here"),
    ("a/b/c/y.txt", None),
    ("a/b/LICENSE.md", "Licensed under the Apache License, Version 2.0"),
    ("a/b/c/z.txt", "code\nSPDX-License-Identifier: GPL-3.0-or-later\nmore"),
    ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("q/x.txt", "my licence is far from any template, as you can read in this sentence of words"),
    ("q/LICENSE", ""),
    ("LICENSE", "Licensed under CC BY-NC 4.0."),
    ("root.txt", "x"),
    (None, "Released under the MIT License."),
    ("a/x.txt", "nothing here"),
    ("r/deep/er/f.txt", "word " * 5000 + "\nLicensed under CC BY 4.0. " + "word " * 5000),
]


def test_scan(spark):
    df = spark.createDataFrame(FILES, "path string, text string").withColumn("license", F.lit("x")).withColumn("dir", F.lit("x"))
    out = L.scan_licenses(df).collect()
    got = {r.path: (r.own_license, r.license, r.inherited_from) for r in out}
    assert len(out) == len(FILES)
    assert got["a/LICENSE"] == ("MIT", "MIT", None)
    assert got["a/x.txt"] == (None, "MIT", "a")
    assert got["a/b/c/y.txt"][1:] == ("Apache-2.0", "a/b")
    assert got["a/b/c/z.txt"] == ("GPL-3.0", "GPL-3.0", None)
    assert got["q/x.txt"] == (None, "CC-BY-NC-4.0", "") and got["q/LICENSE"] == (None, "CC-BY-NC-4.0", "")
    assert got["root.txt"][1:] == ("CC-BY-NC-4.0", "") and got[None] == (None, None, None)
    assert got["r/deep/er/f.txt"][:2] == ("CC-BY-4.0", "CC-BY-4.0")


def test_cosine_against_plain(spark, monkeypatch):
    import re

    bags = [Counter(w for w in re.split(L.WORD, t.lower()) if w) for _, t in L.TEMPLATES]
    seen = Counter(w for b in bags for w in b)
    idf = lambda w: math.log((1 + len(bags)) / (1 + seen[w])) + 1
    text = "this file is licensed under the apache license, version 2.0, see licence"
    v = Counter(w for w in re.split(L.WORD, text) if w)
    size = lambda b: math.sqrt(sum((n * idf(w)) ** 2 for w, n in b.items()))
    best = max((sum(v[w] * n * idf(w) ** 2 for w, n in b.items()) / size(b) / size(v), L.TEMPLATES[i][0]) for i, b in enumerate(bags))
    r = L.own_licenses(spark.createDataFrame([("p", text)], "path string, text string"), threshold=0.1).first()
    assert r.license == best[1] and abs(r.score - best[0]) < 1e-6
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    test_scan(spark)


TEXT = {n: t for n, t in L.TEMPLATES}
WRAP = lambda text, mark="", width=60: "\n".join(mark + line for line in textwrap.wrap(text, width))
GPL = [t for n, t in L.TEMPLATES if n == "GPL-3.0"][1]
CASES = [
    ("LICENSE", "BSD 3-Clause License\n\nCopyright (c) 2020, A. Person\nAll rights reserved.\n\n" + WRAP([t for n, t in L.TEMPLATES if n == "BSD-3-Clause"][0]), "BSD-3-Clause"),
    ("LICENSE", "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n" + WRAP(TEXT["BSD-2-Clause"]), "BSD-2-Clause"),
    ("x.go", "// Copyright 2009 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\npackage x", "BSD-3-Clause"),
    ("x.c", "/* SPDX-License-Identifier: AGPL-3.0 */", "AGPL-3.0"),
    ("x.java", "// SPDX-License-Identifier: EPL-2.0\n// all rights reserved", "EPL-2.0"),
    ("x.c", "# SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
    ("x.c", "-- SPDX-License-Identifier: (GPL-2.0-or-later OR MIT)", "GPL-2.0"),
    ("x.java", " * " + "Licensed under the Eclipse Public License", "EPL-2.0"),
    ("LICENSE", "Copyright (c) 2021 A\n\n" + WRAP([t for n, t in L.TEMPLATES if n == "MIT"][2]), "MIT"),
    ("x.py", WRAP(GPL, "# ") + "\nimport os", "GPL-3.0"),
    ("x.c", "/*\n" + WRAP([t for n, t in L.TEMPLATES if n == "GPL-2.0"][1], " * ") + "\n */\nint x;", "GPL-2.0"),
    ("x.js", "/*!\n" + WRAP([t for n, t in L.TEMPLATES if n == "Apache-2.0"][1], " * ") + "\n */", "Apache-2.0"),
    ("x.txt", "Copyright 2020. All rights reserved.", "proprietary"),
    ("x.txt", "a driving licence is not what this is about, as its reader knows", None),
]


def test_usual_headers_and_texts(spark):
    rows = [(f"d{i}/{name}", text) for i, (name, text, _) in enumerate(CASES)]
    got = {r.path: r.own_license for r in L.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[p] for p, _ in rows] == [want for _, _, want in CASES]


def test_empty(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert L.scan_licenses(none).count() == 0
    with pytest.raises(ValueError):
        L.scan_licenses(none.drop("text"))

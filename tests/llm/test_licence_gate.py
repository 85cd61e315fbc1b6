"""Op9 on real headers and licence files, and its gate against every unit's cosine."""

import math
import random

import pytest
from pyspark.sql import functions as F

from harborlight.llm import licences as L
from harborlight.llm import licence_texts as T


def vector(words, weight, other):
    v = {w: (1 + math.log(words.count(w))) * weight.get(w, other) for w in words}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {w: x / norm for w, x in v.items()}


def best(text, weight, other):
    """(name, score) by plain loops over all units and templates."""
    units = vectors = None
    found = []
    blocks, held = [], []
    for line in (text or "").split("\n"):
        if line.strip(" \t\r"):
            held.append(line)
        else:
            blocks.append("\n".join(held))
            held = []
    blocks.append("\n".join(held))
    units = {*(text or "").split("\n"), *blocks, text or ""}
    vectors = [(n, f, vector(L.terms(t), weight, other)) for n, f, t in L.TEMPLATES]
    for u in units:
        if L.terms(u):
            own = vector(L.terms(u), weight, other)
            for name, floor, v in vectors:
                score = round(sum(x * v.get(w, 0.0) for w, x in own.items()), 6)
                if score >= floor:
                    found.append((name == L.RESERVED, -score, name))
    return (min(found)[2], -min(found)[1]) if found else None


C = "Copyright (c) 2019 Jane Roe\nAll rights reserved.\n\n"
STARS = "/*\n * " + T.APACHE.replace("\n", "\n * ") + "\n */\nint main() { return 0; }\n"
PROSE = "the of to is this by all under version work terms subject general public library and in for with not or any software is provided".split()
FILES = {
    "mit": ("MIT License\n\n" + C + T.MIT, "MIT"), "bsd3": (C + "\n".join([T.BSD_TERMS, T.BSD_ENDORSE, T.BSD_END]), "BSD-3-Clause"), "bsd2": (C + T.BSD_TERMS + "\n" + T.BSD_END, "BSD-2-Clause"),
    "short bsd3": (C + T.BSD_TERMS + "\n" + T.BSD_ENDORSE, "BSD-3-Clause"), "isc": ("ISC License\n\n" + C + T.ISC, "ISC"), "isc start": (T.ISC.split("\n")[0], "ISC"),
    "gpl2 title": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.", "GPL-2.0"),
    "gpl3 title": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007", "GPL-3.0"), "agpl title": ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n", "AGPL-3.0"),
    "gpl2 notice": ("# " + T.gnu("program", "General Public License", "2").replace("\n", "\n# ") + "\n\nimport os\n", "GPL-2.0"), "gpl3 notice": (T.gnu("program", "General Public License", "3"), "GPL-3.0"),
    "agpl notice": (T.gnu("program", "Affero General Public License", "3"), "AGPL-3.0"), "lgpl": (T.gnu("library", "Lesser General Public License", "2.1"), "LGPL-2.1"),
    "apache": (STARS, "Apache-2.0"), "mpl": ("// " + T.MPL + "\n\nfn main() {}", "MPL-2.0"),
    "spdx mit": ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), "spdx apache": ("# SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0"), "spdx gpl": ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
    "spdx unknown": ("SPDX-License-Identifier: Foo-1.0", None), "reserved": ("All rights reserved.", "Proprietary"), "cc": ("Creative Commons CC BY 4.0", "CC-BY-4.0"),
    "prose": (" ".join(PROSE * 40), None), "none": ("no licence of any kind is meant in this example of words", None), "empty": ("", None), "null": (None, None),
}


@pytest.fixture(scope="module")
def files(spark):
    rnd, prose = random.Random(1), []
    for i in range(60):  # what else a tree holds
        prose.append((f"p{i}", " ".join(rnd.choice(PROSE + [f"word{k}" for k in range(200)]) for _ in range(120))))
    return spark.createDataFrame([(n, t) for n, (t, _) in FILES.items()] + prose, "path string, text string")


def test_real_headers_and_files(files):
    weight, other = L.idf(files)
    got = {r.path: r.own and (r.own.name, r.own.score) for r in L.scan(files).collect()}
    for name, (text, want) in FILES.items():
        plain = best(text, weight, other)
        assert (got[name] and got[name][0]) == (plain and plain[0]) == want, name
        assert got[name] is None or abs(got[name][1] - plain[1]) < 2e-6
    assert all(got[p] is None for p in got if p not in FILES)


def test_weights_count_all_files(files):
    weight, other = L.idf(files)
    texts = [r.text or "" for r in files.collect()]
    assert other == math.log(1 + len(texts)) + 1
    for w in ("the", "software", "affero", "spdx", "2"):
        assert weight[w] == math.log((1 + len(texts)) / (1 + sum(w in L.terms(t) for t in texts))) + 1


def test_gate_loses_no_unit(files):
    weight, other = L.idf(files)
    units = L.vectors(weight)
    asked, rnd, held = set(L.telling(units, weight)), random.Random(4), 0
    for (_, floor, text), unit in zip(L.TEMPLATES, units):
        own = L.terms(text)
        for _ in range(300):
            some = rnd.sample(own, rnd.randint(1, len(own))) + rnd.sample(PROSE, rnd.randint(0, 3))
            v = vector(some, weight, other)
            if round(sum(x * unit.get(w, 0.0) for w, x in v.items()), 6) >= floor:
                held += 1
                assert asked & set(some)
    assert held > 2000 and not asked & {"the", "of", "to", "all"}


def test_clashing_columns_ties_and_long_texts(spark):
    rows = [("a/LICENSE", "Released under the MIT License.\nReleased under the ISC License.", 1, "x", "y"), ("a/b", "word " * 60000 + "\nReleased under the MIT License.", 2, "x", "y"), ("a/c", None, 3, "x", "y"), ("a/c", None, 3, "x", "y"), (None, "q", 4, "x", "y")]
    files = spark.createDataFrame(rows, "path string, text string, dir int, own string, mentions string")
    scanned = L.scan(files)
    assert scanned.columns == ["path", "dir", "mentions", "first_line", "own"]
    out = L.inherit(scanned, F.col("path").endswith("LICENSE"))
    assert out.columns == [*scanned.columns, *L.MADE]
    got = sorted(((r.path or "", r.dir, r.licence, r.origin) for r in out.collect()), key=str)
    assert [g for g in got if g[1] != 1] == [("", 4, None, "none"), ("a/b", 2, "MIT", "own"), ("a/c", 3, got[-1][2], "directory"), ("a/c", 3, got[-1][2], "directory")]
    assert got[-1][2] in ("MIT", "ISC") and L.inherit(L.scan(files.limit(0)), F.lit(True)).count() == 0

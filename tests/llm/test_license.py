import math
import re
from collections import Counter

from tidemark.llm import license_scan
from tidemark.llm.license_scan import SIGNS, TEMPLATES, licence_scan

SCHEMA = "doc_id long, path string, text string"
ROWS = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/x.py", "print(1)\nnothing"),
    (3, "a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    (4, "a/b/c/d/y.py", "code"),
    (5, "a/b/c/z.py", "code\nmore\nLicensed under the Apache License, Version 2.0.\nend"),
    (6, "q/w.py", "We talk of the license of the poet at length, and of much else, in this long line of prose."),
    (7, "top.py", None),
    (8, None, "Licensed under CC BY-NC 4.0."),
    (9, "a/b/NOTICE", "nothing of the kind"),
    (10, "a/z/LICENSE-2", "Licensed under CC BY 4.0."),
    (11, "a/z/LICENSE", "Copyright 2020. All rights reserved."),
    (12, "a/z/k", ""),
    (12, "a/z/k", ""),
    (None, "a/n", "SPDX-License-Identifier: MIT"),
    (13, "a/long", "word " * 5000 + "\nReleased under the MIT License.\n" + "word " * 5000),
]


def brute(rows, threshold=0.8):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    n = len(rows)
    vocabulary = {w for _, t in TEMPLATES for w in words(t)}
    df = Counter(w for _, _, t in rows for w in set(words(t)) & vocabulary)
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1

    def cosine(a, b):
        x, y = ({w: k * idf(w) for w, k in Counter(words(t)).items()} for t in (a, b))
        d = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(w, 0) for w, v in x.items()) / d if d else 0.0

    own, grants = {}, set()
    for k, (_, p, t) in enumerate(rows):
        units = [u for u in (t or "").split("\n") if set(words(u)) & set(SIGNS)]
        if p and re.search(r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.-][^/]*)?$", p):
            grants.add(k)
            units.append(t or "")
        best = min(((-round(cosine(u, s), 9), name) for u in units for name, s in TEMPLATES), default=(0, None))
        if -best[0] >= threshold:
            own[k] = best[1], -best[0]
    out = []
    for k, (i, p, _) in enumerate(rows):
        licence, score = own.get(k, (None, None))
        source = None
        if licence is None and p:
            folder = p.rpartition("/")[0]
            while True:
                source = min((rows[g][1] for g in grants if g in own and rows[g][1].rpartition("/")[0] == folder), default=None)
                if source or not folder:
                    break
                folder = folder.rpartition("/")[0]
        if source:
            licence = next(own[g][0] for g in grants if rows[g][1] == source)
        out.append((i, p, licence, score, bool(source), source))
    return out


def test_scan_and_inheritance(spark):
    got = sorted(map(tuple, licence_scan(spark.createDataFrame(ROWS, SCHEMA)).collect()), key=repr)
    want = sorted(brute(ROWS), key=repr)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(g[3] is w[3] is None or abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want, strict=True))
    by = {g[0]: g for g in got}
    assert by[2][2:] == ("MIT", None, True, "a/LICENSE")
    assert by[4][2] == "GPL-3.0"
    assert by[5][2] == "Apache-2.0"
    assert by[6][2] is None
    assert by[12][5] == "a/z/LICENSE"


def test_rows_that_share_id_and_path(spark):
    rows = [(1, "a/x.py", "Released under the MIT License."), (1, "a/x.py", "print(1)"), (1, "a/x.py", None), (2, "b/x.py", "code"), (2, "b/x.py", "code"), (None, None, "Licensed under CC BY 4.0."), (None, None, "x")]
    got = sorted(map(tuple, licence_scan(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "path", "licence").collect()), key=repr)
    assert got == sorted([(1, "a/x.py", "MIT"), (1, "a/x.py", None), (1, "a/x.py", None), (2, "b/x.py", None), (2, "b/x.py", None), (None, None, "CC-BY-4.0"), (None, None, None)], key=repr)


def test_main_path_is_native(spark):
    plan = licence_scan(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty(spark):
    assert licence_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_without_licence_words_are_scored(spark, monkeypatch):
    """All lines count, whichever words they hold: the brute force without signs."""
    prose = ["the rose is the work of this garden", "von hier mit dir", "to be subject to the version of all", "public 2 work"]
    says = ["CC BY 4.0", "CC BY-NC 4.0", "Under CC BY-SA 4.0", "Released under MIT", "Released under the BSD 3-Clause.", "This work is under the GNU General Public, version 3.", "Apache 2.0", "GPL-3.0"]
    rows = [(k, f"p{k}/x", "\n".join([prose[k % 4], says[k] if k < len(says) else "nothing", prose[k % 3]])) for k in range(200)]
    rows += [(200 + k, f"p{k}/LICENSE", t) for k, t in enumerate(says)] + [(300 + k, f"p{k}/y", "code") for k in range(len(says))]
    monkeypatch.setitem(brute.__globals__, "SIGNS", {w for _, _, t in rows for w in re.findall("[a-z0-9]+", t.lower())})
    got, want = (sorted(map(tuple, x), key=repr) for x in (licence_scan(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows)))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(g[3] is w[3] is None or abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want, strict=True))
    assert any(g[2] is not None and g[0] < 200 for g in got)


def test_real_texts_and_headers(spark):
    mit, apache, gpl = (open(f"{license_scan.__file__.rpartition('/')[0]}/licences/{n}.txt").read() for n in ("MIT", "Apache-2.0", "GPL-3.0"))
    gnu = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    rows = [
        (1, "m/LICENSE", mit.replace("MIT License\n", "MIT License\n\nCopyright (c) 2026 Some Body\n", 1)),
        (2, "m/x.py", "code"),
        (3, "a/LICENSE.txt", apache),
        (4, "g/COPYING", gpl),
        (5, "h/a.py", "".join(f"# {x}\n" for x in gnu.split("\n")) + "import os\nprint(1)"),
        (6, "h/b.c", "/* " + gnu.replace("\n", "\n * ") + "\n */\nint x;"),
        (7, "h/c.rs", "// SPDX-License-Identifier: BSD-3-Clause\nfn main() {}"),
        (8, "h/d.py", "".join(f"# {x}\n" for x in mit.split("\n")) + "import os"),
        (9, "h/e.py", "import os\nprint(1)"),
    ]
    got = {r.doc_id: r.licence for r in licence_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "GPL-3.0", 5: "GPL-3.0", 6: "GPL-3.0", 7: "BSD-3-Clause", 8: "MIT", 9: None}

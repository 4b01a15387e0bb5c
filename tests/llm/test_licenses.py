import math
from collections import Counter

from tidemark.llm import licenses as L


def brute(texts: dict) -> dict:
    """Best licence, score and how of each text, and the score with which it speaks."""
    n = sum(t is not None for t in texts.values())
    seen = Counter(w for t in texts.values() if t for w in set(L._words(t)))
    idf = lambda w: math.log((n + 1) / (seen[w] + 1 if w in L.VOCABULARY else 1)) + 1
    vector = lambda ws: {w: c * idf(w) for w, c in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for k, t in texts.items():
        found = []
        for i, (kind, s) in enumerate([("file", t), *((("first" if j == 0 else "line"), x) for j, x in enumerate((t or "").split("\n")))] if t else []):
            v = vector(L._words(s))
            for j, (name, text) in enumerate(L.TEMPLATES):
                x = vector(L._words(text))
                c = round(sum(a * v.get(w, 0) for w, a in x.items()) / norm(x) / (norm(v) or 1), 6)
                if c >= L.LEAST:
                    found.append((c, kind == "file", kind == "first", -j, name, kind))
        if found:
            best = max(found)
            out[k] = (best[4], best[0], "file" if best[5] == "file" else "header", max((f[0] for f in found if f[5] != "line"), default=None))
    return out


def test_against_brute_force(spark):
    texts = {
        1: "Licensed under CC BY-NC 4.0.\nsome prose follows here", 2: "prose\nReleased under the MIT License.", 3: "no notice", 4: "This work is licensed under the GNU General Public License, version 3.",
        5: None, 6: "", 7: "licensed under the apache license version 2.0\n\nmore", 8: "the license of the work is public under version 9", 9: "Permission is hereby granted, free of charge, to any person obtaining a copy", 10: "x " * 3000 + "MIT", 1203: "nothing",
    }
    docs = spark.createDataFrame([(i, t, "b" if i == 4 else "a", "p") for i, t in texts.items()] + [(None, None, None, "p"), (3, "no notice", "a", "p")], "doc_id long, text string, source string, path string")
    got = {r.doc_id: r for r in L.digest(docs).collect()}
    want = brute({**texts, "again": "no notice"})
    assert len(got) == 12
    for i in texts:
        if i in want:
            assert (got[i].licence, round(got[i].score, 5), got[i].how) == (want[i][0], round(want[i][1], 5), want[i][2]), i
        else:
            assert got[i].how in (None, "inherited")
    # nearest directory: a/0/0 speaks by its surest; a/1/2 has none above but the root of nothing
    sure = max((want[i][3], want[i][0]) for i in want if want[i][3] and i != 4)
    assert got[3].how == "inherited" and got[3].directory == "a/0/0" and round(got[3].score, 5) == round(sure[0], 5)
    assert got[1203].licence is None and got[None].licence is None
    assert L.digest(docs.where("doc_id < 0")).count() == 0


def test_nearest_directory_wins(spark):
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, "a/LICENSE", "Licensed under CC BY 4.0."), (3, "a/b/x", "none"), (4, "c/d", "none"), (5, None, None), (6, "a", "none")]
    got = {r.row: (r.licence, r.directory) for r in L.scan(spark.createDataFrame(rows, "row long, path string, text string")).collect()}
    assert got[3] == ("CC-BY-4.0", "a") and got[4] == ("MIT", "") and got[5] == ("MIT", "") and got[6] == ("MIT", "")


def test_notices_anywhere_and_whole_texts_speak(spark):
    full = dict(L.TEMPLATES[L._NOTICES :])
    wrapped = "# Permission is hereby granted, free of charge,\n# to any person obtaining a copy of this software\n# and associated documentation files\ncode follows\n"
    rows = [(1, "a/x", "prose\nReleased under the MIT License."), (2, "a/y", "none"), (3, "b/x", "import os\n\n" + wrapped + "x = 1\n" * 50), (4, "b/y", "none"), (5, "c/x", full["GPL-3.0"]), (6, "c/y", "none"), (7, "d/x", "Copyright (c) 2020 A. B.\n\n" + full["MIT"])]
    got = {r.row: (r.licence, r.how) for r in L.scan(spark.createDataFrame(rows, "row long, path string, text string")).collect()}
    assert got == {1: ("MIT", "header"), 2: ("MIT", "inherited"), 3: ("MIT", "header"), 4: ("MIT", "inherited"), 5: ("GPL-3.0", "file"), 6: ("GPL-3.0", "inherited"), 7: ("MIT", "file")}

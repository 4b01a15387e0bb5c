import random

import corpus_pipeline as P

from tidemark.llm import simhash_dedup as S
from tidemark.llm import suffix_dedup as D


def documents(spark):
    r = random.Random(9)
    word = lambda k: "".join(r.choices("abcdefghij" if k else "klmnopqrst", k=r.randint(3, 8)))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    shared = text(1, 60)
    rows = [(i, text(i % 2, 150), "de" if i % 2 else "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[2 * i][1], None, "s1", 1) for i in range(5)]
    rows += [(200 + i, text(1, 40) + " " + shared + " " + text(1, 40), "de", None, 1) for i in range(4)]
    rows += [(250 + i, rows[30 + i][1].replace(" " + rows[30 + i][1].split()[70] + " ", " kopf ", 1), None, "s2", 1) for i in range(4)]
    rows += [(300, "12 34 !!", "en", "s0", 1), (301, None, "en", "s0", 1), (302, "", None, "s0", 1), (7, rows[7][1], "de", "s1", 1)]
    return shared, rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    shared, rows, docs = documents(spark)
    for name, stage in P.STAGES:
        made = stage(spark, docs, "")
        before, docs = docs, spark.createDataFrame(made.collect(), made.schema)
        got = docs.collect()
        if name == "language_id":
            assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows if r[0] < 300)
        if name == "simhash_dedup":
            words = {r.doc_id: r.text.lower().split() for r in before.collect()}
            parts = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
            alike = lambda a, b: len(parts[a] & parts[b]) >= 0.8 * len(parts[a] | parts[b])
            ids = sorted(parts)
            assert [r.doc_id for r in sorted(got)] == [d for d in ids if not any(alike(d, x) for x in ids if x < d)]
            assert not {r.doc_id for r in got} & {250, 251, 252, 253}
        if name == "suffix_dedup":
            texts = [r.text for r in before.collect()]
            want = D.brute_force([t.encode() for t in texts], P.PASSAGE)
            assert sorted(r.text for r in got) == sorted(w.decode() for w in want if w)
            assert not any(shared in r.text for r in got) and len(got) == len(texts)
        if name == "mixing":
            ids = [r.doc_id for r in before.collect()]
            assert all(r in before.collect() for r in got) and max(sum(r.doc_id == i for r in got) for i in ids) <= 2
        if name == "packing":
            assert {r.doc_id for r in got} == {r.doc_id for r in before.collect()}
            assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)


def test_names():
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_dedup", "suffix_dedup", "mixing", "packing"]


def test_no_documents(spark):
    docs = documents(spark)[2].where("doc_id < 0")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0

"""Licence scans: TF-IDF cosine of headers and files to templates, and inheritance by directory.

All of it is DataFrame operations. A segment is a line of a text, a block of lines as long as a notice may be, or
the whole text. Its words are runs of a-z and 0-9, lower-cased, weighted by times * idf; idf comes from all documents. Lines
and blocks are compared with notices, whole texts with notices and whole licences. A segment whose
cosine to a template is ``LEAST`` or more has its licence. Only segments with a word without which no template can
reach that are weighed (a prefix filter, which loses none). A text with a licence of its own speaks for its
directory. A text without one has that of the nearest directory above which some text speaks for.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 0.7
# Notices of well-known licences, as they are commonly written.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
# Whole licence texts, by the names of their files.
_NOTICES = len(TEMPLATES)
TEMPLATES += [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


#: Words of a block of lines at most: twice those of the longest notice.
BLOCK_WORDS = 2 * max(len(_words(t)) for _, t in TEMPLATES[:_NOTICES])
VOCABULARY = sorted({w for _, t in TEMPLATES for w in _words(t)})
NOTICE_WORDS = sorted({w for _, t in TEMPLATES[:_NOTICES] for w in _words(t)})


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def has_any(words: Column, of: list[str]) -> Column:
    """Whether one of an array of words is in of, which Spark looks up as a set."""
    return F.exists(words, lambda w: w.isin(of))


def inverse_frequencies(docs: DataFrame) -> tuple[dict[str, float], float]:
    """idf of the templates' words, and that of a word no document has: ln((documents + 1) / (documents with it + 1)) + 1."""
    known = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(VOCABULARY)))
    # each document also has the empty word, which counts documents in the same pass
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), known)).alias("w")).groupBy("w").count().collect()  # a row a word of the templates
    count = {r.w: r["count"] for r in found}
    n = count.get("", 0)
    return {w: math.log((n + 1) / (count.get(w, 0) + 1)) + 1 for w in VOCABULARY}, math.log(n + 1) + 1


def template_weights(idf: dict[str, float]) -> list[dict[str, float]]:
    out = []
    for _, t in TEMPLATES:
        v = {w: n * idf[w] for w, n in Counter(_words(t)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({w: x / norm for w, x in v.items()})
    return out


def needed(weights: list[dict[str, float]], idf: dict[str, float], least: float = LEAST) -> list[str]:
    """Words of which a segment must have one to reach least: without them, the rest of each template is too short. Common words are left to the rest."""
    out = set()
    for v in weights:
        rest = 0.0
        for w, x in sorted(v.items(), key=lambda i: (idf[i[0]], -i[1], i[0])):
            if rest + x * x < (least - 1e-6) ** 2:
                rest += x * x
            else:
                out.add(w)
    return sorted(out)


def segments(docs: DataFrame, in_notice: list[str], in_whole: list[str]) -> DataFrame:
    """row, kind (first, line, which blocks are too, or file) and key, words of each segment that has one of in_notice, or is a file and has one of in_whole. docs: row, text.

    Of blocks, those that begin and end in a line with a word of a notice; others are beaten by the part of them that does.
    """
    files = docs.where(has_any(words_of(F.col("text")), sorted({*in_notice, *in_whole}))).select("row", F.transform(F.split("text", "\n"), words_of).alias("lines"))
    files = common.cut_lineage(files)  # asked three times
    whole = files.select("row", F.lit("file").alias("kind"), F.flatten("lines").alias("words"))
    lines = files.select("row", F.posexplode("lines").alias("n", "words")).select("row", F.when(F.col("n") == 0, "first").otherwise("line").alias("kind"), "words")
    # what follows each line, as far as a block can reach
    marked = F.transform(F.filter("lines", lambda x: F.size(x) > 0), lambda x: F.struct(x.alias("words"), has_any(x, NOTICE_WORDS).alias("may"), has_any(x, in_notice).alias("must")))
    full = files.where(F.exists("lines", lambda x: has_any(x, in_notice))).select("row", marked.alias("lines"))
    starts = full.select("row", "lines", F.posexplode("lines").alias("n", "x")).where("x.may")
    starts = starts.select("row", F.slice("lines", F.col("n") + 1, BLOCK_WORDS).alias("lines")).where((F.size("lines") > 1) & F.exists("lines", lambda x: x["must"]))
    ends = starts.select("row", "lines", F.explode(F.sequence(F.lit(2), F.size("lines"))).alias("k")).where(F.expr("element_at(lines, k).may"))
    blocks = ends.select("row", F.lit("line").alias("kind"), F.flatten(F.transform(F.slice("lines", 1, F.col("k")), lambda x: x["words"])).alias("words")).where(F.size("words") <= BLOCK_WORDS)
    asked = F.when(F.col("kind") == "file", has_any(F.col("words"), sorted({*in_notice, *in_whole}))).otherwise(has_any(F.col("words"), in_notice))
    joined = F.array_join("words", " ")
    key = F.struct(F.xxhash64(joined).alias("a"), F.hash(joined).alias("b"), (F.col("kind") == "file").alias("whole"))
    return lines.union(blocks).union(whole).where(asked).select("row", "kind", key.alias("key"), "words")


def scores(found: DataFrame, idf: dict[str, float], unseen: float, weights: list[dict[str, float]]) -> DataFrame:
    """key, licence, score of each distinct segment that reaches LEAST; at ties the template that comes first."""
    spark = found.sparkSession
    once = found.groupBy("key").agg(F.first("words").alias("words")).select("key", F.explode("words").alias("w")).groupBy("key", "w").agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(w, x, [v.get(w, 0.0) for v in weights]) for w, x in idf.items()], "w string, idf double, in array<double>")
    own = once.join(F.broadcast(known), "w", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(unseen)))
    sums = own.groupBy("key").agg(F.sum(F.col("x") * F.col("x")).alias("norm"), *(F.sum(F.coalesce(F.col("x") * F.col("in")[i], F.lit(0.0))).alias(f"t{i}") for i in range(len(weights))))
    cosine = lambda i: F.round(F.round(F.col(f"t{i}") / F.sqrt("norm"), 12), 6)
    may = lambda i: F.lit(True) if i < _NOTICES else F.col("key.whole")
    best = F.greatest(*(F.when(may(i), F.struct(cosine(i).alias("score"), F.lit(-i).alias("i"), F.lit(name).alias("licence"))) for i, (name, _) in enumerate(TEMPLATES)))
    return sums.select("key", best.alias("b")).select("key", "b.licence", "b.score").where(F.col("score") >= LEAST)


def directories(path: Column) -> Column:
    """Directories that a path is in, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scan(docs: DataFrame) -> DataFrame:
    """row, path, licence, how (header, file, inherited, null), score, directory (that speaks, if inherited) of every row.

    docs: row (any type that names a row), path, text. Null texts have no licence of their own; a null path is in the
    root. Rows with the same row value have one text; each has a row in the result. No rows: no rows.
    """
    texts = docs.where("text is not null")
    idf, unseen = inverse_frequencies(texts)
    weights = template_weights(idf)
    found = common.cut_lineage(segments(texts.select("row", "text"), needed(weights[:_NOTICES], idf), needed(weights, idf)))
    hits = found.select("row", "kind", "key").join(scores(found, idf, unseen, weights), "key")
    # the surest segment; at ties the file, then the first line, then the template that sorts first
    rank = F.struct("score", (F.col("kind") == "file").alias("f"), (F.col("kind") == "first").alias("s"))
    best = hits.distinct().groupBy("row").agg(F.max_by(F.struct("licence", "score", "kind"), F.struct(rank, F.expr("transform(split(licence, ''), c -> -ascii(c))"))).alias("b"), F.max("score").alias("speaks"))
    own = docs.select("row", F.coalesce("path", F.lit("")).alias("path")).withColumn("dirs", directories(F.col("path"))).withColumn("dir", F.element_at("dirs", -1))
    own = own.join(best, "row", "left")
    speaking = own.where("speaks is not null").groupBy("dir").agg(F.max_by("b.licence", F.struct("speaks", F.expr("transform(split(b.licence, ''), c -> -ascii(c))"))).alias("of"), F.max("speaks").alias("sure"))
    above = own.select("dir", "dirs").distinct().select("dir", F.posexplode("dirs").alias("depth", "up"))
    above = above.join(speaking.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("of", "sure", "up"), "depth").alias("i"))
    own = own.join(above, "dir", "left")
    has = F.col("b").isNotNull()
    how = F.when(has, F.when(F.col("b.kind") == "file", "file").otherwise("header")).when(F.col("i").isNotNull(), "inherited")
    return own.select("row", "path", F.when(has, F.col("b.licence")).otherwise(F.col("i.of")).alias("licence"), how.alias("how"), F.when(has, F.col("b.score")).otherwise(F.col("i.sure")).alias("score"), F.when(~has, F.col("i.up")).alias("directory"))


def digest(docs: DataFrame) -> DataFrame:
    """documents lie in source/thousands/hundreds of doc_id, with none for what is null. Each row has a row."""
    d = F.col("doc_id").cast("long")
    thousand, hundred = F.floor(d / 1000).cast("string"), F.pmod(F.floor(d / 100), F.lit(10)).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce(thousand, F.lit("none")), F.coalesce(hundred, F.lit("none")), F.coalesce(d.cast("string"), F.lit("none")))
    own = docs.select(F.struct(d.alias("doc_id"), F.xxhash64("text").alias("h")).alias("row"), path.alias("path"), "text")
    return scan(own).select("row.doc_id", "path", "licence", "how", "score", "directory")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SQL_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
#: The same in DuckDB, without filters by words: all lines, blocks and files against all of their templates.
ORACLE = f"""with recursive te(i, licence, text) as (values {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))}),
tw as (select i, w, count(*) as c from (select i, unnest({_SQL_WORDS.format("text")}) as w from te) group by all),
d as (select row_number() over () as r, doc_id, text, coalesce(source, 'none') || '/' || coalesce(cast(floor(doc_id / 1000) as bigint)::varchar, 'none') || '/' || coalesce((((cast(floor(doc_id / 100) as bigint) % 10) + 10) % 10)::varchar, 'none') || '/' || coalesce(doc_id::varchar, 'none') as path from documents),
n as (select count(*) as n from d where text is not null),
df as (select w, count(*) as c from (select distinct r, unnest({_SQL_WORDS.format("text")}) as w from d where text is not null) group by 1),
idf as (select w, ln((n + 1.0::double) / (coalesce(df.c, 0) + 1)) + 1 as idf from (select distinct w from tw) left join df using (w), n),
tv as (select i, w, c * idf as x from tw join idf using (w)), tn as (select i, sqrt(sum(x * x)) as norm from tv group by 1),
li as (select r, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as k from d where text is not null),
lw as (select r, k, {_SQL_WORDS.format("s")} as ws from li),
nl as (select r, row_number() over (partition by r order by k) as k, ws, sum(len(ws)) over (partition by r order by k) as upto from lw where len(ws) > 0),
sg as (select r, case k when 1 then 'first' else 'line' end as kind, ws from lw where len(ws) > 0 union all select r, 'file', {_SQL_WORDS.format("text")} from d where text is not null
  union all select a.r, 'line', (select flatten(list(m.ws order by m.k)) from nl m where m.r = a.r and m.k between a.k and b.k) from nl a join nl b on a.r = b.r and b.k > a.k and b.k < a.k + {BLOCK_WORDS} and b.upto - a.upto + len(a.ws) <= {BLOCK_WORDS}
    where list_has_any(a.ws, [{", ".join(map(_quoted, NOTICE_WORDS))}]) and list_has_any(b.ws, [{", ".join(map(_quoted, NOTICE_WORDS))}])),
se as (select row_number() over () as s, r, kind, ws from sg where len(ws) > 0),
sw as (select s, w, count(*) as c from (select s, unnest(ws) as w from se) group by all),
sx as (select s, w, c * coalesce(idf, ln(n + 1.0::double) + 1) as x from sw left join idf using (w), n),
sn as (select s, sqrt(sum(x * x)) as norm from sx group by 1),
co as (select s, i, round(round(sum(sx.x * tv.x) / any_value(tn.norm) / any_value(sn.norm), 12), 6) as score from sx join tv using (w) join tn using (i) join sn using (s) group by all),
hi as (select r, kind, score, licence, row_number() over (partition by s order by score desc, i) as k from co join se using (s) join te using (i) where score >= {LEAST} and (kind = 'file' or i < {_NOTICES})),
be as (select r, licence, score, kind from (select *, row_number() over (partition by r order by score desc, kind = 'file' desc, kind = 'first' desc, licence) as b from hi where k = 1) where b = 1),
ow as (select r, doc_id, path, string_split(path, '/') as p, licence, score, kind from d left join be using (r)),
sp as (select dir, licence, score from (select *, array_to_string(p[:-2], '/') as dir, row_number() over (partition by p[:-2] order by score desc, licence) as k from ow where licence is not null) where k = 1),
up as (select r, sp.*, row_number() over (partition by r order by length(dir) desc) as k from ow join sp on starts_with(array_to_string(p[:-2], '/') || '/', dir || '/') or dir = '')
select doc_id, path, case kind when 'file' then 'file' when 'first' then 'header' when 'line' then 'header' else case when dir is not null then 'inherited' end end as how,
  coalesce(ow.licence, up.licence) as licence, coalesce(ow.score, up.score) as score, case when ow.licence is null then dir end as directory from ow left join up on up.r = ow.r and up.k = 1"""

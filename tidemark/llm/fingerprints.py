"""Document fingerprints: SimHash over weighted word pairs, and search within a Hamming radius.

The terms of a text are its pairs of neighbouring words (A-Z lower-cased); one word is a term
itself. A term's 128-bit hash votes on each bit with weight 1 + ln(times it occurs). The
search files each fingerprint under every choice of two of radius + 2 blocks of bits, which is
the same as sorted tables of permuted blocks: fingerprints within radius agree on two blocks.
The query of the operator searches with the documents whose id is divisible by 20, against all.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 128
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)]
_UNPACKED = 2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") - 1


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def term_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each term of the text, in order, repeats included."""
    if not text:
        return np.empty(0, np.uint64)
    b = np.frombuffer(text.translate(_LOWER), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    up, down = _powers(1 << max(16, int(len(b)).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[b] * up[: len(b)], dtype=np.uint64)])
    words = _mix((total[last] - total[first]) * down[first])
    if len(words) < 2:
        return words
    return _mix(words[:-1] * np.uint64(3) + (words[1:] ^ (words[1:] >> np.uint64(7))))


def simhash(text: bytes) -> np.ndarray:
    """The fingerprint as 16 bytes. Without words: zeros. A bit without a majority is 0."""
    terms = term_hashes(text)
    if not len(terms):
        return np.zeros(16, np.uint8)
    terms, count = np.unique(terms, return_counts=True)
    weight = 1 + np.log(count)
    h = np.stack([terms, _mix(terms + np.uint64(_BASE))], axis=1).view(np.uint8)
    votes = np.bincount((h + np.arange(16) * 256).ravel(), np.repeat(weight, 16), 4096).reshape(16, 256) @ _UNPACKED
    return np.packbits(votes.ravel() > 1e-9, bitorder="little")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of term vectors that the share of equal bits tells, 0 at least. a, b: rows of 16 bytes."""
    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return np.maximum(0.0, np.cos(np.pi * apart / BITS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hi, lo (longs) of every row. Null text is empty."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = np.array([simhash(t) for t in common.text_bytes(b["text"])], np.uint8).reshape(-1, 16).view(np.int64)
            yield {"doc_id": b["doc_id"], "hi": x[:, 0], "lo": x[:, 1]}

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, hi long, lo long")


def within(queries: DataFrame, every: DataFrame, radius: int = 3) -> DataFrame:
    """q_hi, q_lo, hi, lo, distance: all distinct fingerprints within radius of each distinct query (both hi, lo).

    Membership of rows is a join on hi, lo away; copies are not made into pairs here.
    """
    blocks = radius + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def block(i: int):
        parts = []
        for name, base in (("hi", 0), ("lo", 64)):
            a, b = max(edges[i], base) - base, min(edges[i + 1], base + 64) - base
            if a < b:
                mask = ((1 << (b - a)) - 1) << a
                parts.append(F.col(name).bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask).cast("long")))
        return parts

    def filed(df: DataFrame) -> DataFrame:
        tables = [F.struct(F.lit(n).alias("t"), F.xxhash64(*block(i), *block(j)).alias("entry")) for n, (i, j) in enumerate(combinations(range(blocks), 2))]
        return df.select("hi", "lo").distinct().select("hi", "lo", F.explode(F.array(*tables)).alias("x")).select("hi", "lo", "x.t", "x.entry")

    q = filed(queries).withColumnsRenamed({"hi": "q_hi", "lo": "q_lo"})
    apart = F.bit_count(F.col("hi").bitwiseXOR(F.col("q_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("q_lo")))
    return q.join(filed(every), ["t", "entry"]).select("q_hi", "q_lo", "hi", "lo", apart.alias("distance")).where(F.col("distance") <= radius).distinct()


def place(ids: np.ndarray, h: np.ndarray, cuts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Range of each row, from 0 for the greatest ids on. cuts: ids in ascending order, times: how often each was a quantile.

    An id that was more than one has as many ranges for itself, by its rows' hashes (which are spread evenly).
    """
    own, below, k = np.zeros(len(cuts), np.int64), np.zeros(len(cuts), np.int64), 1
    for i in range(len(cuts) - 1, -1, -1):
        own[i] = k
        k += int(times[i]) if times[i] > 1 else 0
        below[i] = k
        k += 1
    at = np.searchsorted(cuts, ids, "left")
    inside = np.minimum(at, len(cuts) - 1)
    share = ((h.astype(np.float64) / 2**64 + 0.5) * times[inside]).astype(np.int64) if len(cuts) else ids
    equal = np.where(times[inside] > 1, own[inside] + np.clip(share, 0, times[inside] - 1), below[inside]) if len(cuts) else ids
    return np.where(at == len(cuts), 0, np.where(cuts[inside] == ids, equal, below[inside])) if len(cuts) else np.zeros(len(ids), np.int64)


def beside_next(docs: DataFrame) -> DataFrame:
    """bucket, ghost, id, doc_id, text: rows dealt so that, in order of bucket, ghost, descending id and text's hash, each row
    that isn't a ghost is followed by the next row in descending order of doc_id over all (null last; after the last, the first).

    Ids are cut into ranges of like counts, and an id with many rows by the hash of the text; the first row of a range is copied to the end of the one before, as a ghost.
    """
    n = common.partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("id", F.coalesce("doc_id", F.lit(common.NULL_ID))).withColumn("h", F.xxhash64("text"))
    found = rows.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    cuts, times = np.unique(np.array([int(x) for x in found], np.int64), return_counts=True)

    @F.pandas_udf("long")
    def bucket(x: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(place(x.to_numpy(), h.to_numpy(), cuts, times))

    # ids descend: their complement ascends
    least = F.min(F.struct(F.bitwise_not("id").alias("a"), "h")).alias("m")
    first = {r.k: (~r.m.a, r.m.h) for r in rows.groupBy(bucket("id", "h").alias("k")).agg(least).collect()}  # a row a range
    order = sorted(first)
    before = {k: order[i - 1] for i, k in enumerate(order)}

    @F.pandas_udf("array<long>")
    def places(x: pd.Series, h: pd.Series) -> pd.Series:
        """The range, and for a range's first rows minus the range before and 1."""
        own = place(x.to_numpy(), h.to_numpy(), cuts, times)
        return pd.Series([[k, -before[k] - 1] if (i, g) == first[k] else [k] for i, g, k in zip(x.tolist(), h.tolist(), own.tolist(), strict=True)])

    dealt = rows.select("*", F.explode(places("id", "h")).alias("p"))
    dealt = dealt.select(F.when(F.col("p") < 0, -F.col("p") - 1).otherwise(F.col("p")).alias("bucket"), (F.col("p") < 0).cast("int").alias("ghost"), "id", "h", "doc_id", "text")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "ghost", F.desc("id"), "h", "text")


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, sha, fp, edited (binary: of the edited text, of the text, of the edited text), hi, lo (fp again), near_edited, near_next of every row."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        held = None  # a row that waits for the next: bucket, doc_id, text

        def work(rows: list[tuple]) -> dict:
            """rows: doc_id, text, next text."""
            edited = [(t[: len(t) - len(t) // 2] + x[: len(t) // 2]).encode() for _, t, x in rows]
            a, e, x = (np.array([simhash(t) for t in ts], np.uint8).reshape(-1, 16) for ts in ([r[1].encode() for r in rows], edited, [r[2].encode() for r in rows]))
            both = a.view(np.int64)
            return {
                "doc_id": [r[0] for r in rows], "n_chars": [len(r[1]) for r in rows], "sha": [hashlib.sha256(t).digest() for t in edited],
                "fp": [v.tobytes() for v in a], "edited": [v.tobytes() for v in e], "hi": both[:, 0], "lo": both[:, 1], "near_edited": likeness(a, e), "near_next": likeness(a, x),
            }

        for b in batches:
            rows = []
            for k, g, d, t in zip(b["bucket"].to_pylist(), b["ghost"].to_pylist(), b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                t = t or ""
                if held is not None:
                    rows.append((held[1], held[2], t))
                held = None if g else (k, d, t)
                if len(rows) >= 200:
                    yield work(rows)
                    rows = []
            if rows:
                yield work(rows)

    return common.map_batches(beside_next(docs), run, "doc_id long, n_chars long, sha binary, fp binary, edited binary, hi long, lo long, near_edited double, near_next double")


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprint of every row, of its edited text, and likeness to that and to the next row's; n_within: of a row whose
    doc_id is divisible by 20, how many other distinct fingerprints are within 3 bits, else null.

    Rows of one doc_id (null ids are one) follow in order of a hash of the text. Null text is empty; rows that repeat each have a row. No rows: no rows.
    """
    own = common.cut_lineage(with_edits(docs))
    hexed = [F.lower(F.hex(c)).alias(n) for c, n in (("sha", "edited_sha256"), ("fp", "fingerprint"), ("edited", "edited_fingerprint"))]
    shown = ["doc_id", "n_chars", *hexed, "near_edited", "near_next"]
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    found = within(own.where(asked), own).where((F.col("hi") != F.col("q_hi")) | (F.col("lo") != F.col("q_lo"))).groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n"))
    searched = own.where(asked).join(found, ["hi", "lo"], "left").select(*shown, F.coalesce("n", F.lit(0)).cast("long").alias("n_within"))
    return searched.union(own.where(~asked).select(*shown, F.lit(None).cast("long").alias("n_within")))

"""Near copies by SimHash: deletion-variant signatures, joined by equality and verified.

Fingerprints that differ in ``radius`` bits at most have, cut into radius // 2 + 1 parts, one
part that differs in one bit at most. For each part, each fingerprint is filed under the
part with each of its bits in turn replaced by a wildcard: 64 entries for 64 bits. Two
fingerprints meet under some entry if and only if a part differs in one bit at most; the
whole is compared then. Only distinct fingerprints are filed.

A fingerprint of 64 bits and radius 3 finds texts that are almost equal. For texts that
share 0.8 of their five-word shingles (Jaccard), ``one_of_each`` takes 128 bits on which
distinct shingles vote; 19 of them differ at 0.8 on the average, with a deviation of 4. They are cut into
``SEGMENTS`` parts under the same wildcards, which finds all within 2 * SEGMENTS - 1 bits and
most of those up to ``APART``. What links within ``APART`` join, in whatever entries, is a family; it holds all
candidates. In a family all texts are compared by the least ``SKETCH`` hashes of both texts'
shingles, which give the Jaccard index itself where there are no more shingles, else an estimate
with a deviation of 0.035. Only what that links is near copies: a family may have many groups or none.

A large group must not cost its square. So blocks of a family are compared within themselves first, then the
least texts of the groups found, until they fit one block. What that joins is one group and compared no more, but
every text is compared with all in other groups. Links are told of groups, each to the least that it is joined to, so
there are about as many as texts.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Parts of a wide fingerprint, bits that may differ in a candidate, words of a shingle, Jaccard index of near copies, hashes in a sketch.
SEGMENTS, APART, WORDS, JACCARD, SKETCH = 8, 28, 5, 0.8, 128
#: Rows that are compared at once, and the largest entry that is compared row by row.
ROWS, SMALL = 16_384, 64
#: A family is dealt out in pairs of blocks of so many texts, while it is not cut in more than CUTS; larger blocks have LARGEST at most.
BLOCK, CUTS, LARGEST = 128, 64, 4096
#: Entries with more fingerprints than this are cut again by the rest of the fingerprint.
DIRECT = 256
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_OFFSETS = np.arange(8) * 256
_MIX = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)]
_UNPACKED = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words are one shingle, none are none."""
    words = text.translate(_LOWER).split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def _majority(h: np.ndarray) -> np.uint64:
    # how often each byte value stands at each of 8 places, then each bit from that
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    return np.packbits((seen @ _UNPACKED).ravel() * 2 > len(h), bitorder="little").view(np.uint64)[0]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is in over half of the shingles' XXH64. 0 without words."""
    return int(_majority(hashes(text, shingle)))


def wide_fingerprint(text: bytes, shingle: int = WORDS) -> tuple[np.uint64, np.uint64, bytes]:
    """The same by distinct shingles and 128 bits: a shingle's XXH64, and that mixed. Then the sketch: upper halves of the least hashes, one beyond SKETCH if there are more."""
    h = np.unique(hashes(text, shingle))
    more = h + _MIX[2]
    more = (more ^ (more >> np.uint64(33))) * _MIX[0]
    more = (more ^ (more >> np.uint64(29))) * _MIX[1]
    return _majority(h), _majority(more ^ (more >> np.uint64(32))), np.unique(h >> np.uint64(32))[: SKETCH + 1].astype("<u4").tobytes()


def sketch_rows(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows, filled up with what no hash is, and their sizes."""
    size = np.array([len(x) // 4 for x in sketches], np.int64)
    out = np.full((len(sketches), max(1, size.max(initial=0))), 2**32, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(sketches), "<u4")
    return out, size


def likenesses(x: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The Jaccard index that a sketch and each of rows tell. 1 if both are empty."""
    below = np.searchsorted(x, rows)
    both = np.append(x, -1)[below] == rows
    # place among the hashes of either
    place = np.arange(rows.shape[1]) + below - np.cumsum(both, axis=1) + both
    # a sketch of more than SKETCH may not be all of its text; else all hashes of both are at hand
    known = np.where((len(x) > SKETCH) | (size > SKETCH), SKETCH, len(x) + size - both.sum(axis=1))
    return np.where(known > 0, (both & (place < known[:, None])).sum(axis=1) / np.maximum(known, 1), 1.0)


def likeness(x: bytes, y: bytes) -> float:
    """The Jaccard index that two sketches tell. 1 if both are empty."""
    return float(likenesses(np.frombuffer(x, "<u4").astype(np.int64), *sketch_rows([y]))[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, kt (common.document_key), fp (a signed long) of every row. Null text: no words, 0."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in common.text_bytes(b["text"])], np.uint64)
            yield {"doc_id": b["doc_id"], "kt": b["kt"], "fp": fp.view(np.int64)}

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text", common.document_key(docs)[1]), run, "doc_id long, kt long, fp long")


def parts_of(radius: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Lowest bit and width of each part; the fewest parts of which one differs by a bit at most."""
    n = radius // 2 + 1
    edges = [bits * i // n for i in range(n + 1)]
    return list(zip(edges, np.diff(edges).tolist(), strict=False))


def _variants(radius: int):
    masks = [(i, j, ((1 << w) - 1) << a, 1 << (a + j)) for i, (a, w) in enumerate(parts_of(radius)) for j in range(w)]

    def run(batches):
        for b in batches:
            fp = common.longs(b["fp"]).view(np.uint64)
            for n, (_, _, part, bit) in enumerate(masks):
                # the entry: the part without the bit, then which part and bit, mixed
                x = (fp & np.uint64(part & ~bit)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0x632BE59BD9B4E019 % 2**64)
                yield {"entry": (x ^ (x >> np.uint64(31))).view(np.int64), "fp": fp.view(np.int64)}

    return run


def _union(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of links among 0..n-1: the least node that each reaches, and as many links as join the same nodes."""
    up, out = list(range(n)), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(i), root(j)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((i, j))
    return np.array([root(i) for i in range(n)], np.int64), out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The latter only."""
    return _union(n, a, b)[1]


def star(a: np.ndarray, b: np.ndarray) -> dict:
    """Links that join what a and b do: of each name but the least, to the least that it reaches."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    least = _union(len(names), at[: len(a)], at[len(a) :])[0]
    other = np.flatnonzero(least != np.arange(len(names)))
    return {"a": names[least[other]], "b": names[other]}


def links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same distinct fingerprints as all pairs within radius do. No list of all pairs is made."""
    n = len(fp)
    if n <= DIRECT:
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        pairs = _forest(n, i[near], j[near])
    else:
        # radius + 1 pieces, of which one is equal in fingerprints within radius. A piece is cut finer while many share it.
        pairs = []
        edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = (fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1], [True]]))
            for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                own = order[x:y]
                for k in range(0, len(own), 512):  # one block against those behind it
                    a = own[k : k + 512]
                    for m in range(k, len(own), 65536):
                        c = own[m : m + 65536]
                        p, q = np.nonzero(np.bitwise_count(fp[a][:, None] ^ fp[c][None, :]) <= radius)
                        keep = a[p] < c[q]
                        if keep.any():
                            i, j = a[p[keep]], c[q[keep]]
                            names, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                            pairs += [(int(names[u]), int(names[v])) for u, v in _forest(len(names), at[: len(i)], at[len(i) :])]
        if pairs:
            x = np.array(pairs)
            pairs = _forest(n, x[:, 0], x[:, 1])
    x = np.array(pairs, np.int64).reshape(-1, 2)
    return fp[x[:, 0]], fp[x[:, 1]]


def _verified(radius: int):
    """Rows in order of entry: links within each entry."""

    def run(batches):
        held_e, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def solve(e, f):
            cuts = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1], [True]]))
            size = np.diff(cuts)
            out_a, out_b = [], []
            two = cuts[:-1][size == 2]  # most of the entries that have more than one
            x, y = f[two].view(np.uint64), f[two + 1].view(np.uint64)
            near = np.bitwise_count(x ^ y) <= radius
            out_a.append(x[near])
            out_b.append(y[near])
            for k in np.flatnonzero(size > 2).tolist():
                a, b = links(f[cuts[k] : cuts[k + 1]].view(np.uint64), radius)
                out_a.append(a)
                out_b.append(b)
            return {"a": np.concatenate(out_a).view(np.int64), "b": np.concatenate(out_b).view(np.int64)}

        for b in batches:
            e, f = np.concatenate([held_e, common.longs(b["entry"])]), np.concatenate([held_f, common.longs(b["fp"])])
            if not len(e):
                continue
            cut = int(np.searchsorted(e, e[-1]))  # the last entry may go on
            held_e, held_f = e[cut:], f[cut:]
            if cut:
                yield solve(e[:cut], f[:cut])
        if len(held_e):
            yield solve(held_e, held_f)

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links that join the same fingerprints as all pairs within radius do. distinct: fp, each once."""
    n = common.partitions(distinct.sparkSession)
    # few rows grow to many: they are dealt out before
    filed = common.map_batches(distinct.select("fp").repartition(n, "fp"), _variants(radius), "entry long, fp long")
    return common.map_batches(filed.repartition(n, "entry").sortWithinPartitions("entry"), _verified(radius), "a long, b long").distinct()


def wide_fingerprints(docs: DataFrame, shingle: int = WORDS) -> DataFrame:
    """doc_id, kt, hi, lo (the fingerprint), fp (a name of it and the sketch), sketch of every row. Null text: no words, zeros."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            made = [wide_fingerprint(t, shingle) for t in common.text_bytes(b["text"])]
            x = np.array([m[:2] for m in made], np.uint64).reshape(-1, 2).view(np.int64)
            name = np.array([xxhash.xxh64_intdigest(m[0].tobytes() + m[1].tobytes() + m[2], SEED) for m in made], np.uint64).view(np.int64)
            yield {"doc_id": b["doc_id"], "kt": b["kt"], "fp": name, "hi": x[:, 0], "lo": x[:, 1], "sketch": [m[2] for m in made]}

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text", common.document_key(docs)[1]), run, "doc_id long, kt long, fp long, hi long, lo long, sketch binary")


def _wide_variants(segments: int):
    """Entries of 128-bit fingerprints: which part and bit, and the part without the bit."""
    per, width = segments // 2, 128 // segments

    def run(batches):
        for b in batches:
            name, both = common.longs(b["fp"]), [common.longs(b[n]) for n in ("hi", "lo")]
            for i in range(segments):
                part = (both[i // per].view(np.uint64) >> np.uint64(i % per * width)) & np.uint64((1 << width) - 1)
                for j in range(width):
                    entry = (part & np.uint64(~(1 << j) & (1 << width) - 1)) | np.uint64(i * width + j << width)
                    yield {"entry": entry.view(np.int64), "fp": name, "hi": both[0], "lo": both[1]}

    return run


def wide_forest(entry: np.ndarray, f: np.ndarray, apart: int) -> list[tuple[int, int]]:
    """Of rows in order of entry (f: two words each), as many links as join what all links within apart join in each entry. Which ones is the same to families."""
    cuts = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1], [True]]))
    size = np.diff(cuts)
    end = np.repeat(cuts[1:], size)
    own, found = np.flatnonzero(np.repeat(size <= SMALL, size)), [np.empty((0, 2), np.int64)]
    for lag in range(1, SMALL):
        own = own[own + lag < end[own]]
        if not len(own):
            break
        d = np.bitwise_count(f[own] ^ f[own + lag]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(d <= apart)
        found.append(np.stack([own[near], own[near] + lag], axis=1))
    names, at = np.unique(np.concatenate(found), return_inverse=True)
    at = at.reshape(-1, 2)
    out = [(int(names[i]), int(names[j])) for i, j in _forest(len(names), at[:, 0], at[:, 1])]
    for k in np.flatnonzero(size > SMALL).tolist():
        left, queue = np.arange(cuts[k], cuts[k + 1]), np.empty(0, np.int64)
        while len(left):
            if not len(queue):  # a component begins; what it reaches leaves the rest, so a dense group costs little
                queue, left = left[:1], left[1:]
            now, queue = queue[:32], queue[32:]
            d = np.bitwise_count(f[now][:, None] ^ f[left][None]).sum(axis=2, dtype=np.int64)
            hit = d.min(axis=0) <= apart
            out += zip(now[d.argmin(axis=0)[hit]].tolist(), left[hit].tolist(), strict=True)
            queue, left = np.concatenate([queue, left[hit]]), left[~hit]
    return out


def _wide_candidates(apart: int):
    """Rows in order of entry: links within each entry, by name."""

    def solve(held):
        e, name, f = (np.concatenate([h[i] for h in held]) for i in range(3))
        x = np.array(wide_forest(e, f, apart), np.int64).reshape(-1, 2)
        a, b = name[x[:, 0]], name[x[:, 1]]
        return {"a": np.minimum(a, b), "b": np.maximum(a, b)}

    def run(batches):
        held, n = [], 0
        for b in batches:
            e = common.longs(b["entry"])
            if not len(e):
                continue
            held.append((e, common.longs(b["fp"]), np.stack([common.longs(b["hi"]), common.longs(b["lo"])], axis=1).view(np.uint64)))
            n += len(e)
            if n < ROWS or e[-1] == held[0][0][0]:
                continue
            cut = int(np.searchsorted(e, e[-1]))  # the last entry may go on
            if cut:
                last = tuple(x[cut:] for x in held[-1])
                held[-1] = tuple(x[:cut] for x in held[-1])
                yield solve(held)
                held, n = [last], len(last[0])
        if held:
            yield solve(held)

    return run


def alike_forest(rows: np.ndarray, size: np.ndarray, block: np.ndarray, least: float, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Of sketches, as many links as join what all links of likeness least or more join. Where there are two blocks: what links between them join. Rows of one group are joined already."""
    out, left, queue, two = [], np.arange(len(rows)), [], len(np.unique(block)) > 1
    group = left if group is None else group
    while len(left):
        if not queue:  # a component begins; what it reaches leaves the rest, so a dense group costs little
            own = group[left] == group[left[0]]
            queue, left = left[own].tolist(), left[~own]
        now = queue.pop()
        asked = left[block[left] != block[now]] if two else left
        hit = asked[likenesses(rows[now, : size[now]], rows[asked], size[asked]) >= least - 1e-9]
        reached, first = np.unique(group[hit], return_index=True)
        out += [(now, i) for i in hit[first].tolist()]
        own = np.isin(group[left], reached)
        queue += left[own].tolist()
        left = left[~own]
    return out


def _alike(least: float):
    """Rows in order of label, i and j: names of groups, each with the least that verified links within each family's pair of blocks join it to."""

    def solve(held):
        group, block = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        x = np.array(alike_forest(*sketch_rows([x[2] for x in held]), block, least, group), np.int64).reshape(-1, 2)
        return star(group[x[:, 0]], group[x[:, 1]])

    def run(batches):
        held, key = [], None
        for b in batches:
            for *k, group, block, sketch in zip(*(b[c].to_pylist() for c in ("label", "i", "j", "g", "block", "sketch")), strict=True):
                if k != key and held:
                    if len(held) > 1:
                        yield solve(held)
                    held = []
                key = k
                held.append((group, block, sketch))
        if len(held) > 1:
            yield solve(held)

    return run


def within_blocks(own: DataFrame) -> DataFrame:
    """Rows of _alike that compare each text with about BLOCK of its family: each row of own (label, fp, sketch) once. n: the texts of its family there."""
    size = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    block = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / BLOCK).cast("long"))
    return own.join(size, "label").select("label", block.alias("i"), block.alias("j"), F.col("fp").alias("g"), block.alias("block"), "sketch", "n")


def between_groups(own: DataFrame) -> DataFrame:
    """Rows of _alike that compare each text with all that are in other groups of its family. own: label, g, fp, sketch.

    The largest group is dealt out in blocks that meet the blocks of all others only; a family that is one group isn't dealt out.
    """
    size = own.groupBy("label", "g").agg(F.count(F.lit(1)).alias("n"))
    size = size.groupBy("label").agg(F.max(F.struct("n", "g")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    cuts = lambda n: F.greatest(F.ceil(n / LARGEST), F.least(F.ceil(n / BLOCK), F.lit(CUTS))).cast("long")
    size = size.select("label", F.col("top.g").alias("top"), cuts(F.col("n") - F.col("top.n")).alias("rest"), cuts(F.col("top.n")).alias("most"))
    in_top, hashed = F.col("g") == F.col("top"), F.xxhash64("fp")
    own = own.join(size, "label").withColumn("block", F.when(in_top, F.col("rest") + F.pmod(hashed, F.col("most"))).otherwise(F.pmod(hashed, F.col("rest"))))
    met = F.sequence(F.lit(0).cast("long"), F.col("rest") - 1 + F.when(in_top, 0).otherwise(F.col("most")))
    pair = F.explode(F.transform(met, lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))).alias("p")
    return own.select("label", "g", "block", "sketch", pair).select("label", "p.i", "p.j", "g", "block", "sketch")


def alike_links(family: DataFrame, distinct: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """a, b: links of names, which join what all alike pairs in each family join. family: node (a name) and label."""
    n = common.partitions(distinct.sparkSession)

    def found(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("label", "i", "j", "g", "block", "sketch").repartition(n, "label", "i", "j").sortWithinPartitions("label", "i", "j")
        return common.map_batches(dealt, _alike(jaccard), "a long, b long")

    own = common.cut_lineage(family.withColumnRenamed("node", "fp").join(distinct.select("fp", "sketch"), "fp").select("label", "fp", "sketch"))
    # families of one block are done at once; of the others the least of each group found goes on, half of the texts at most
    dealt = within_blocks(own)
    made = common.cut_lineage(found(dealt))
    out, large = made, dealt.where(F.col("n") > BLOCK).select("label", F.col("g").alias("fp"), "sketch")
    grouped, left = large.withColumn("g", F.col("fp")), large
    while True:
        to = made.select(F.col("b").alias("g"), F.col("a").alias("to"))
        grouped = grouped.join(to, "g", "left").select("label", "fp", "sketch", F.coalesce("to", "g").alias("g"))
        left = common.cut_lineage(left.join(made.select(F.col("a").alias("fp")).distinct(), "fp", "left_semi").select("label", "fp", "sketch"))
        if left.isEmpty():
            break
        dealt = within_blocks(left)
        made = common.cut_lineage(found(dealt))
        out = out.union(made)
        left = dealt.where(F.col("n") > BLOCK).select("label", F.col("g").alias("fp"), "sketch")
    return out.union(found(between_groups(common.cut_lineage(grouped))).distinct())


def wide_links(distinct: DataFrame, apart: int = APART, segments: int = SEGMENTS, jaccard: float = JACCARD) -> DataFrame:
    """a, b: verified links of names. distinct: fp (the name), hi, lo, sketch, each once."""
    n = common.partitions(distinct.sparkSession)
    filed = common.map_batches(distinct.select("fp", "hi", "lo").repartition(n, "fp"), _wide_variants(segments), "entry long, fp long, hi long, lo long")
    found = common.map_batches(filed.repartition(n, "entry").sortWithinPartitions("entry"), _wide_candidates(apart), "a long, b long").distinct()
    return alike_links(components(found), distinct, jaccard)


def _labelled(fps: DataFrame, least: DataFrame, near: DataFrame) -> DataFrame:
    """doc_id, kt, fp, label, component_id of every row of fps. least: fp, least (the smallest doc_id). near: links of fp."""
    label = F.coalesce("label", "fp")
    own = least.join(components(near).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", label.alias("label"))
    of = own.groupBy("label").agg(F.min("least").alias("component_id"))
    return fps.join(own.join(of, "label").select("fp", "label", "component_id"), "fp").select("doc_id", "kt", "fp", "label", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, kt, fp, label, component_id of every row; label is the same in a component only, component_id is the smallest doc_id reachable over links of fingerprints within radius.

    Null and empty texts have fingerprint 0 and are linked like any others. Rows that repeat
    repeat in the result. A null doc_id is the smallest only of a component without another.
    """
    fps = common.cut_lineage(fingerprints(docs, shingle))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    return _labelled(fps, least, near_links(least, radius))


def wide_duplicates(docs: DataFrame, apart: int = APART, segments: int = SEGMENTS, shingle: int = WORDS, jaccard: float = JACCARD) -> DataFrame:
    """As near_duplicates, of texts whose shingles have a Jaccard index of jaccard or more. fp names a fingerprint and sketch. Texts without words are alike."""
    fps = common.cut_lineage(wide_fingerprints(docs, shingle))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("hi", "lo", "sketch")))
    return _labelled(fps.drop("hi", "lo", "sketch"), least.select("fp", "least"), wide_links(least, apart, segments, jaccard))


def one_of_each(docs: DataFrame, apart: int = APART, segments: int = SEGMENTS, shingle: int = WORDS, jaccard: float = JACCARD) -> DataFrame:
    """Of each component of wide_duplicates one row: the smallest doc_id's (null last), of its texts the one with the least hash. The columns are docs'."""
    found = wide_duplicates(docs, apart, segments, shingle, jaccard)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("kd"), "kt")).alias("x")
    kept = found.groupBy("label").agg(first).select(F.col("x.kd").alias("kd"), F.col("x.kt").alias("kt"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *common.document_key(docs))
    rows = rows.join(kept, ["kd", "kt"], "left_semi").groupBy("kd", "kt").agg(F.first("row").alias("row"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row, as near_duplicates: null text is as empty, a null doc_id is the smallest only where there is no other, rows that repeat each have a row. No rows: no rows."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

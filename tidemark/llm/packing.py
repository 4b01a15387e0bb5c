"""Packing of documents into sequences by cutting-stock column generation.

Pieces of at most ``capacity`` tokens are counted by length class (``step`` tokens wide).
A linear program chooses how often to use each pattern (how many pieces of each
class share a sequence) at the least number of sequences. Its patterns are found as they are
needed: an unbounded knapsack over the classes, solved by dynamic programming, gives the
pattern with the greatest sum of dual prices. Counts are rounded down; what is left is
packed by the same knapsack, bounded by what there is. Last, the pieces of each class are
ranked, and a rank tells the sequence. Only the histogram and the patterns, whose size the number of
classes bounds, are ever on the driver.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY, STEP, END_ID = 2048, 8, 1
#: Ranks are given in so many parts of each class, side by side.
PARTS = 64
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 600_000
#: The linear program ends when its bound shows that it is within this share of the best.
GAP = 1e-3

_words: dict[str, bytes] = {}
common.KEPT[__name__] = _words
_tokenizer: list = []
#: Controls at which Python splits words and the tokenizer doesn't.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
# White space in the sense of Unicode.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_TO_SPACE = str.maketrans(dict.fromkeys(_SPACE, " "))
#: A mark behind a letter or digit and before white space is a token's border on both sides.
_MARK = re.compile(r"[.,;:!?](?<=[^\W_].)(?=\s|\Z)")


def _split(text: str) -> list[str]:
    try:
        text.encode("latin-1")
        text = text.lower()  # what the tokenizer does, where no letter depends on its neighbours
    except UnicodeEncodeError:
        pass
    if any(c in text for c in _ODD):
        return [w for w in text.translate(_TO_SPACE).split(" ") if w]
    return _MARK.sub(r" \g<0>", text).split()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so ids of a text are those of its
    stretches without white space. A worker keeps those of ``CACHE_WORDS`` stretches.
    """
    from tokenizers import Tokenizer

    if not _tokenizer or _tokenizer[0] != path:
        _tokenizer[:] = [path, Tokenizer.from_file(path)]
        _words.clear()
    out = []
    for first in range(0, len(texts), 100):
        split = [_split(t) for t in texts[first : first + 100]]
        new = set().union(*split).difference(_words)
        _learn(sorted(new), _tokenizer[1])
        out += [b"".join(map(_words.__getitem__, words)) for words in split]
        if len(_words) > CACHE_WORDS:
            _words.clear()
    return out


def _learn(words: list[str], tokenizer) -> None:
    for k in range(0, len(words), 2000):  # many at once; the tokens' places tell them apart
        part = words[k : k + 2000]
        e = tokenizer.encode(" ".join(part), add_special_tokens=False)
        ids, at = np.array(e.ids, "<u4").tobytes(), np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e))[::2]
        cuts = (4 * np.searchsorted(at, np.cumsum([0, *(len(w) + 1 for w in part)]))).tolist()
        _words.update(zip(part, (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each row's ids and end_id, cut every capacity tokens."""
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            ids_of = encode([t or "" for t in b["text"].to_pylist()], path)
            for d, ids in zip(b["doc_id"].to_pylist(), ids_of, strict=True):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    for k, v in zip(out, (d, s, len(part) // 4, zlib.crc32(part), n), strict=True):
                        out[k].append(v)
            yield out

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(price: np.ndarray, size: np.ndarray, capacity: int, limit: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """The greatest sum of prices that fits, and how many of each class have it. size ascends; without limit, each class is endless."""
    count = np.zeros(len(size), np.int64)
    if limit is None:
        value, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
        for c in range(int(size[0]), capacity + 1):
            m = int(np.searchsorted(size, c, "right"))
            v = value[c - size[:m]] + price[:m]
            k = int(v.argmax())
            if v[k] > value[c - 1] + 1e-12:
                value[c], taken[c] = v[k], k
            else:
                value[c] = value[c - 1]
        c = capacity
        while c >= size[0]:
            if taken[c] < 0:
                c -= 1
            else:
                count[taken[c]] += 1
                c -= int(size[taken[c]])
        return float(value[capacity]), count
    # bounded: fill[c] is the class taken last to reach exactly c, from the largest down
    fill, used = np.full(capacity + 1, -1, np.int64), np.zeros(capacity + 1, np.int64)
    reached = np.zeros(capacity + 1, bool)
    reached[0] = True
    for k in range(len(size) - 1, -1, -1):
        s = int(size[k])
        if not limit[k] or s > capacity:
            continue
        used[:] = 0
        new = np.flatnonzero(reached[:-s])
        for _ in range(int(min(limit[k], capacity // s))):
            to = new + s
            ok = (to <= capacity) & ~reached[np.minimum(to, capacity)] & (used[new] < limit[k])
            new = new[ok]
            if not len(new):
                break
            used[new + s] = used[new] + 1
            fill[new + s], reached[new + s] = k, True
            new = new + s
        if reached[capacity]:
            break
    c = int(np.flatnonzero(reached)[-1])
    total = float(c)
    while c:
        count[fill[c]] += 1
        c -= int(size[fill[c]])
    return total, count


def solve(size: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often the linear program uses each."""
    m = len(size)
    per = capacity // size
    basis = np.diag(per).astype(np.int64)  # columns: patterns
    inverse = np.diag(1.0 / per)
    x = demand / per
    for _ in range(40 * m + 100):
        price = inverse.sum(axis=0)
        value, column = best_pattern(np.maximum(price, 0), size, capacity)
        if value <= 1 + gap:  # then the sum divided by value bounds every solution from below
            break
        step = inverse @ column
        up = step > 1e-10
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(x[up], 0) / step[up]
        out = int(ratio.argmin())
        t = ratio[out]
        x -= t * step
        x[out] = t
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out] = column
    return basis.T, np.maximum(x, 0)


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size classes (ascending, in steps), patterns (rows) and how often each is used; it covers counts exactly."""
    unit = -(-lengths // step)
    size, of = np.unique(unit, return_inverse=True)
    demand = np.bincount(of, counts, minlength=len(size)).astype(np.int64)
    room = capacity // step
    patterns, uses = [], []
    left = demand.copy()

    def use(pattern: np.ndarray, n: int) -> None:
        patterns.append(pattern)
        uses.append(n)

    if size[-1] == room:  # full pieces need no program
        use((np.arange(len(size)) == len(size) - 1).astype(np.int64), int(left[-1]))
        left[-1] = 0
    small = np.flatnonzero(left)
    if len(small):
        found, x = solve(size[small], left[small].astype(float), room)
        for k in np.argsort(-x, kind="stable"):
            # the program's >= may take more of a class than there are
            p = np.zeros(len(size), np.int64)
            p[small] = found[k]
            n = int(min([int(x[k] + 1e-9), *(left[p > 0] // p[p > 0])]))
            if n > 0:
                use(p, n)
                left -= n * p
    while left.any():
        _, p = best_pattern(size.astype(float), size, room, left)
        n = int((left[p > 0] // p[p > 0]).min())
        use(p, n)
        left -= n * p
    return size, np.array(patterns), np.array(uses)


def _assignment(size: np.ndarray, patterns: np.ndarray, uses: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each class: first rank, pieces a sequence, first sequence, place in the sequence, of each pattern with that class."""
    base = np.cumsum(uses) - uses
    out = {}
    for k, s in enumerate(size.tolist()):
        own = np.flatnonzero(patterns[:, k])
        per = patterns[own, k]
        total = per * uses[own]
        out[s] = (np.cumsum(total) - total, per, base[own], patterns[own, :k].sum(axis=1))
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """cut and sequence_id, offset (long). cut: length (1 to capacity) and more columns, of which doc_id, start, length order the pieces.

    Pieces that equal each other may swap places; the rows stay the same. No rows: no rows.
    """
    cut = common.cut_lineage(cut)
    histogram = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()  # a row a length at most
    if not histogram:
        return cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    size, patterns, uses = plan(np.array([r.length for r in histogram]), np.array([r.n for r in histogram]), capacity, step)
    places = _assignment(size, patterns, uses)

    ranked = cut.withColumns({"_class": F.ceil(F.col("length") / step).cast("long"), "_part": F.pmod(F.xxhash64("doc_id", "start", "length"), F.lit(PARTS))})
    counts = ranked.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("_n"))
    base = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_class", "_part", F.coalesce(F.sum("_n").over(base), F.lit(0)).alias("_base"))  # capacity / step * PARTS rows at most
    rank = F.row_number().over(Window.partitionBy("_class", "_part").orderBy("doc_id", "start", "length"))
    ranked = ranked.withColumn("_row", rank.cast("long")).join(F.broadcast(bases), ["_class", "_part"])
    ranked = ranked.select("*", (F.col("_base") + F.col("_row") - 1).alias("_rank")).drop("_part", "_n", "_base", "_row")

    def place(batches):
        for b in batches:
            kind, rank = b.column("_class").to_numpy(), b.column("_rank").to_numpy()
            seq, slot = np.empty(len(kind), np.int64), np.empty(len(kind), np.int64)
            for s in np.unique(kind).tolist():
                at = np.flatnonzero(kind == s)
                first, per, base, before = places[s]
                k = np.searchsorted(first, rank[at], "right") - 1
                inside = rank[at] - first[k]
                seq[at], slot[at] = base[k] + inside // per[k], before[k] + inside % per[k]
            names = [n for n in b.schema.names if n not in ("_class", "_rank")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(slot)], [*names, "sequence_id", "_slot"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    placed = ranked.mapInArrow(place, f"{kinds}, sequence_id long, _slot long")
    inside = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*cut.columns, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def digest(docs: DataFrame) -> DataFrame:
    """Null text is empty and has one token, the end. Rows that repeat are packed each."""
    return pack(pieces(docs))

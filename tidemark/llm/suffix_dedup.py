"""Removal of long byte strings that repeat, by a distributed merge sort of suffixes.

A byte goes if it lies in a ``length``-byte string that starts at two places or more.
Four steps find all of those strings and no others:

1. Texts that are equal are taken once, with their number. Every ``length``-byte window has a
   minimizer: the leftmost of its ``gram``-byte strings with the least hash. Equal windows have
   it at the same distance. The minimizers of all windows (about 1 % of the positions) are the
   suffixes to sort. One whose gram occurs once in the corpus can't be in a repeated window and is left out.
2. Each map task sorts its suffixes (from the minimizer to the end of the last window
   that it serves) and codes each run by front: the length of the prefix shared with the
   one before, and the rest. What a run has twice is known to repeat; its spans are told at once, and one
   of the equal suffixes goes on, as a mark. Runs go to the task that owns the gram, so suffixes that share a gram meet.
3. There, a loser tree merges the runs, which are decoded as they are read. It knows how long a prefix each
   contender shares with the last winner and compares bytes only behind it. It returns the sorted
   suffixes and the prefix lengths shared by neighbours; suffixes are held only while they share a gram (and some more).
4. For each distance d of a window to its minimizer, two windows are equal if the suffixes
   share length - d bytes and the bytes before share d. Both are runs in a sorted order
   without a lower shared length. A minimizer serves windows less than ``length`` bytes
   apart, so its first and last repeated window tell all that it covers.

No step holds all rows of a group of copies: copies are one text, and equal suffixes travel once per run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 400
#: Bytes of a text that are hashed at once, and of suffixes that a map task holds before it gives out runs.
CHUNK, RUN_BYTES = 1 << 18, 48 << 20
_M = np.random.default_rng(7).integers(1, 2**63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64)


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string, from hashes of strings of doubled lengths."""
    power, span, done, out = _BYTES[b], 1, 0, None
    level = 0
    while True:
        if k & span:
            if out is None:
                out = power
            else:
                n = min(len(out), len(power) - done)
                out = out[:n] * _M[2 * level] + power[done : done + n]
            done += span
        span, level = span * 2, level + 1
        if span > k:
            break
        half = span // 2
        power = power[:-half] * _M[2 * level + 1] + power[half:]
        power ^= power >> np.uint64(29)
    out = out[: len(b) - k + 1]
    out = (out ^ (out >> np.uint64(32))) * _M[99]
    return out ^ (out >> np.uint64(29)) | np.uint64(1)  # never 0, which marks windows that cross a border


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x, span = f(x[:-span], x[span:]), span * 2
    return f(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def minimizers(b: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the windows of b that cross none of ends: minimizer, least and greatest distance of its windows, hash of its gram."""
    width, n = length - gram + 1, len(b) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    h = gram_hashes(b, gram)
    least = _slide(h, width, np.minimum)
    for e in ends[:-1]:
        least[max(0, e - length + 1) : e] = 0
    at = np.flatnonzero(_slide(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum) == h)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    live = least[first] != 0
    first, last, value = first[live], last[live], least[first[live]]
    kinds, rank = np.unique(h[at], return_inverse=True)
    if not len(first):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    codes = np.sort((rank.astype(np.int64) << 33) | at)
    own = np.searchsorted(kinds, value).astype(np.int64) << 33
    lo, hi = np.searchsorted(codes, own | first), np.searchsorted(codes, own | (last + width - 1), "right")
    count = hi - lo
    run = np.repeat(np.arange(len(first)), count)
    where = codes[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[run]] & ((1 << 33) - 1)
    before = np.concatenate([[-1], where[:-1]])
    before[np.concatenate([[True], run[1:] != run[:-1]])[: len(run)]] = -1
    p_lo, p_hi = np.maximum(first[run], before + 1), np.minimum(last[run], where)
    ok = p_lo <= p_hi
    where, p_lo, p_hi = where[ok], p_lo[ok], p_hi[ok]
    return where, where - p_hi, where - p_lo, h[where]


def tiles(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts side by side in chunks: bytes, index of each text, its offset in the text, its end in the chunk. Long texts overlap."""
    parts, rows, offsets, held = [], [], [], 0
    for i, t in enumerate(texts):
        for o in range(0, max(0, len(t) - length + 1), CHUNK):
            parts.append(t[o : o + CHUNK + length - 1])
            rows.append(i)
            offsets.append(o)
            held += len(parts[-1])
            if held >= CHUNK:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.array(offsets), np.cumsum([len(x) for x in parts])
                parts, rows, offsets, held = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.array(offsets), np.cumsum([len(x) for x in parts])


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which known bytes are known."""
    n = min(len(a), len(b))
    while known < n:
        step = min(64, n - known)
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            return known + step - 1 - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() - 1) // 8
        known += step
    return n


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix with the one before, length, rest."""
    lcp, before = np.zeros(len(strings), np.int32), b""
    for i, s in enumerate(strings):
        lcp[i] = shared(before, s, 0)
        before = s
    return lcp, np.array([len(s) for s in strings], np.int32), b"".join(s[k:] for s, k in zip(strings, lcp.tolist(), strict=True))


def front_decode(lcp: np.ndarray, size: np.ndarray, rest: bytes) -> Iterator[bytes]:
    at, before = 0, b""
    for k, n in zip(lcp.tolist(), size.tolist(), strict=True):
        before = before[:k] + rest[at : at + n - k]
        at += n - k
        yield before


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """Merges sorted runs of strings, each with the prefix that it shares with the one before. One string of a run is held.

    A loser tree: an inner node holds the run that lost there and the prefix that its head shares
    with the winner. Against the last winner, the longer shared prefix is the lesser string; only
    at equal lengths are bytes compared, from there on. Gives the run of each string in
    order, the string, and the prefix that it shares with the one before.
    """
    k = 1
    while k < len(runs):
        k *= 2
    ended = (b"", -1)
    heads = [next(r, ended) for r in runs] + [ended] * (k - len(runs))
    loser, kept = [0] * k, [0] * k  # by inner node

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and its prefix shared with the last winner; loser and its prefix shared with this winner."""
        if la < 0 or lb < 0:  # a run that has ended
            return (b, lb, a, la) if la < 0 else (a, la, b, lb)
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        x, y = heads[a][0], heads[b][0]
        n = shared(x, y, la)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            return a, la, b, n
        return b, lb, a, n

    def start(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, min(0, heads[node - k][1])
        a, la = start(2 * node)
        b, lb = start(2 * node + 1)
        w, lw, loser[node], kept[node] = play(a, la, b, lb)
        return w, lw

    w, lw = start(1)
    while lw >= 0:
        yield w, heads[w][0], lw
        heads[w] = next(runs[w], ended)
        lw = heads[w][1]
        node = (w + k) // 2
        while node:
            w, lw, loser[node], kept[node] = play(w, lw, loser[node], kept[node])
            node //= 2


def repeats(right: np.ndarray, left: list[bytes], lo: np.ndarray, hi: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in order: the least and greatest distance of a repeated window, or 1 and 0.

    right: prefix shared with the one before; left: bytes before the minimizer, last first;
    lo, hi: distances of the windows served; many: the suffix and its left bytes occur twice.
    """
    n = len(right)
    order = sorted(range(n), key=left.__getitem__)
    near = np.zeros(n, np.int64)
    for i in range(1, n):
        near[i] = shared(left[order[i - 1]], left[order[i]], 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    best_r = np.maximum(right, np.append(right[1:], 0))
    best_l = np.maximum(near, np.append(near[1:], 0))[rank]
    down, up = np.maximum(lo, length - best_r), np.minimum(hi, best_l)
    least, most = np.where(many, lo, length + 1), np.where(many, hi, -1)
    live = np.flatnonzero(down <= up)
    by_d = np.argsort(down[live], kind="stable")
    starts = np.searchsorted(down[live][by_d], np.arange(length + 2))
    for d in range(int(down[live].min(initial=length)), int(up[live].max(initial=-1)) + 1):
        at = live[by_d[: starts[d + 1]]]
        at = at[up[at] >= d]
        if len(at) < 2:
            continue
        key = np.cumsum(right < length - d)[at] * (n + 1) + np.cumsum(near < d)[rank[at]]
        turn = np.argsort(key)
        key = key[turn]
        same = key[1:] == key[:-1]
        hit = at[turn[np.append(same, False) | np.insert(same, 0, False)]]
        least[hit], most[hit] = np.minimum(least[hit], d), np.maximum(most[hit], d)
    none = most < 0
    least[none], most[none] = 1, 0
    return least, most


def _anchors(length: int, gram: int):
    def run(batches):
        for b in batches:
            texts, kd, kt, n = common.text_bytes(b["text"]), common.longs(b["kd"]), common.longs(b["kt"]), common.longs(b["n"])
            for chunk, rows, offsets, ends in tiles(texts, length):
                at, lo, hi, g = minimizers(chunk, ends, length, gram)
                part = np.searchsorted(ends, at, "right")
                starts = np.concatenate([[0], ends[:-1]])
                x = {"gram": g.view(np.int64), "kd": kd[rows[part]], "kt": kt[rows[part]], "at": at - starts[part] + offsets[part], "lo": lo, "hi": hi}
                _, back, count = np.unique(g, return_inverse=True, return_counts=True)
                many = np.bincount(back, n[rows[part]], len(count))[back] > 1
                # a gram that is here twice is known to repeat: its rows go anywhere, and one more, a mark, tells the others
                first = np.unique(back[many], return_index=True)[1]
                mark = {k: v[many][first] for k, v in x.items()}
                yield pack_window(x, many.astype(np.int64))
                if len(first):
                    yield pack_window(mark, 2)

    return run


def pack_window(x: dict, state) -> dict:
    """lo, hi and state in one number."""
    return {k: v for k, v in x.items() if k not in ("lo", "hi")} | {"window": ((x["lo"] << 20 | x["hi"]) << 2) | state}


def _frequent(batches):
    """Rows with equal grams side by side: those known to repeat (state 1), and those (0) whose gram has another row or a mark (2). Holds one row."""
    names = ("gram", "kd", "kt", "at", "window")
    held, told = None, False  # the last row, and whether it is known to repeat
    for b in batches:
        x = {n: common.longs(b[n]) for n in names}
        if not len(x["gram"]):
            continue
        if held is not None:
            x = {n: np.insert(x[n], 0, held[n]) for n in names}
        same, state = x["gram"][1:] == x["gram"][:-1], x["window"] & 3
        out = np.append(same, False) | np.insert(same, 0, told) | (state == 1)
        go = out & (state != 2)
        go[0] &= not (held is not None and told)
        held, told = {n: x[n][-1] for n in names}, bool(out[-1])
        yield {n: x[n][go] for n in names[:4]} | {"window": x["window"][go] >> 2}


#: A run's suffixes, or spans that are known already (without the rest).
RUN = "target long, lcp binary, size binary, rest binary, left_lcp binary, left_size binary, left_rest binary, many binary, member binary, spans binary"
_MEMBER = np.dtype([("kd", np.int64), ("kt", np.int64), ("at", np.int64)])
_SPAN = np.dtype([("kd", np.int64), ("kt", np.int64), ("first", np.int64), ("last", np.int64)])
#: Suffixes that are held until all with their gram are there, at least.
GROUPED = 20_000


def joined(spans: np.ndarray) -> np.ndarray:
    """Spans (_SPAN) with those of a text that meet made one."""
    if not len(spans):
        return spans
    x = spans[np.lexsort((spans["first"], spans["kt"], spans["kd"]))]
    new = np.concatenate([[True], (x["kd"][1:] != x["kd"][:-1]) | (x["kt"][1:] != x["kt"][:-1])])
    # the furthest end so far in each text: texts are set apart by more than any end
    far = np.cumsum(new) * (int(x["last"].max()) + 1)
    reach = np.maximum.accumulate(x["last"] + far)
    new[1:] |= x["first"][1:] + far[1:] > reach[:-1]
    at = np.flatnonzero(new)
    out = x[at].copy()
    out["last"] = np.append(reach[at[1:] - 1], reach[-1]) - far[at]
    return out


def _runs(length: int, targets: int, most: int):
    def pack(x: bytes) -> bytes:
        return zstandard.compress(x, 1)

    def code(target: int, found: dict) -> tuple[dict, list]:
        """A run's row, and spans of what it has twice. found: (suffix, bytes before): members, or None and the members' spans."""
        order = sorted(found)
        lcp, size, rest = front_code([r for r, _ in order])
        left_lcp, left_size, left_rest = front_code([x for _, x in order])
        spans = [(kd, kt, at - len(k[1]), at + len(k[0])) for k in order if found[k][0] > 1 for kd, kt, at in found[k][1:]]
        member = np.array([found[k][1] for k in order], _MEMBER)
        many = np.array([found[k][0] > 1 for k in order], np.uint8)
        return {"target": target, "lcp": lcp.tobytes(), "size": size.tobytes(), "rest": pack(rest), "left_lcp": left_lcp.tobytes(), "left_size": left_size.tobytes(), "left_rest": pack(left_rest), "many": many.tobytes(), "member": pack(member.tobytes()), "spans": None}, spans

    def run(batches):
        held, parts, turn = 0, {}, 0

        def out():
            known = []
            for t, found in parts.items():
                row, spans = code(t, found)
                known += spans
                yield {k: [v] for k, v in row.items()}
            if known:
                spans = joined(np.array(known, _SPAN))
                to = int(spans["kt"][0]) + turn  # any task may have them
                yield {k: [None] for k in row} | {"target": [to % targets], "spans": [pack(spans.tobytes())]}

        for b in batches:
            kd, kt, n = common.longs(b["kd"]).tolist(), common.longs(b["kt"]).tolist(), common.longs(b["n"]).tolist()
            for i, text in enumerate(common.text_bytes(b["text"])):
                for x in b["anchors"][i].as_py():
                    at, lo, hi = x["at"], x["window"] >> 20, x["window"] & 0xFFFFF
                    key = text[at : at + length - lo], text[at - hi : at][::-1]
                    found = parts.setdefault(x["gram"] % targets, {})
                    if key not in found:
                        found[key] = [0]
                        held += len(key[0]) + len(key[1]) + 150
                    found[key][0] += n[i]
                    found[key].append((kd[i], kt[i], at))
                    held += 60
                if held >= most:
                    yield from out()
                    held, parts, turn = 0, {}, turn + 1
        yield from out()

    return run


def _covered(length: int, gram: int, grouped: int):
    """Rows in order of target: the spans that repeat."""
    unpack = zstandard.decompress

    def solve(rows: list[dict]) -> Iterator[dict]:
        ints = lambda x: np.frombuffer(x, np.int32)
        lcps, sizes = [ints(r["lcp"]) for r in rows], [ints(r["size"]) for r in rows]
        strings = [zip(front_decode(k, s, unpack(r["rest"])), k.tolist(), strict=True) for r, k, s in zip(rows, lcps, sizes, strict=True)]
        lefts = [front_decode(ints(r["left_lcp"]), ints(r["left_size"]), unpack(r["left_rest"])) for r in rows]
        members, marks = [np.frombuffer(unpack(r["member"]), _MEMBER) for r in rows], [np.frombuffer(r["many"], np.uint8).tolist() for r in rows]
        heads = [0] * len(rows)
        # of the distinct suffixes held: shared prefix, left bytes, distances, times; of all held: run, place in it, which distinct one
        right: list[int] = []
        left: list[bytes] = []
        lo: list[int] = []
        hi: list[int] = []
        times: list[int] = []
        held: list[tuple[int, int, int]] = []

        def done() -> dict:
            least, most = repeats(np.array(right, np.int64), left, np.array(lo, np.int64), np.array(hi, np.int64), np.array(times) > 1, length)
            own = np.array(held, np.int64)
            member = np.empty(len(own), _MEMBER)
            for r in np.unique(own[:, 0]).tolist():
                at = own[:, 0] == r
                member[at] = members[r][own[at, 1]]
            first, last = member["at"] - most[own[:, 2]], member["at"] - least[own[:, 2]] + length
            keep = (own[:, 2] >= 0) & (most[own[:, 2]] >= least[own[:, 2]])
            # those that their run had twice are told already
            keep &= np.array([not marks[r][i] for r, i, _ in held], bool)
            return {"kd": member["kd"][keep], "kt": member["kt"][keep], "first": first[keep], "last": last[keep]}

        same: dict[bytes, int] = {}
        size_before = -1
        for r, string, k in merge(strings):
            if k < gram and len(held) >= grouped:
                yield done()
                for x in (right, left, lo, hi, times, held):
                    x.clear()
                k = 0
            i, x = heads[r], next(lefts[r])
            heads[r] += 1
            if not (k == len(string) == size_before):
                same = {}
            size_before = len(string)
            if x not in same:
                same[x] = len(right)
                right.append(k)
                left.append(x)
                lo.append(length - len(string))
                hi.append(len(x))
                times.append(0)
            times[same[x]] += 1 + marks[r][i]
            held.append((r, i, same[x]))
        if held:
            yield done()

    def run(batches):
        rows: list[dict] = []
        for b in batches:
            for i in range(len(b["target"])):
                row = {k: v[i].as_py() for k, v in b.items()}
                if row["spans"] is not None:
                    x = np.frombuffer(unpack(row["spans"]), _SPAN)
                    yield {n: x[n] for n in _SPAN.names}
                    continue
                if rows and rows[0]["target"] != row["target"]:
                    yield from solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from solve(rows)

    return run


def text_key(docs: DataFrame) -> list:
    """Two columns, kd and kt, that name a text by 128 bits. Null is as the empty text."""
    text = F.coalesce(docs["text"], F.lit(""))
    return [F.xxhash64(F.lit(7), text).alias("kd"), F.xxhash64(text).alias("kt")]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """kd, kt (text_key) and spans (first byte, end) that repeated strings cover; spans may overlap.

    docs: text in UTF-8. Null and short texts have no spans. Texts that are equal share a key, and are each other's copies.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    gram, n = length // 2, common.partitions(spark)
    texts = docs.where(F.octet_length("text") >= length).select(*text_key(docs), "text").groupBy("kd", "kt").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    fields = "gram long, kd long, kt long, at long, window long"
    found = common.map_batches(texts, _anchors(length, gram), fields)
    deal = F.when(F.col("window").bitwiseAND(F.lit(3)) == 1, F.col("kt").bitwiseXOR(F.col("at"))).otherwise(F.col("gram"))
    found = common.map_batches(found.repartition(n, deal).sortWithinPartitions("gram"), _frequent, fields)
    found = found.groupBy("kd", "kt").agg(F.collect_list(F.struct("gram", "at", "window")).alias("anchors"))
    runs = common.map_batches(texts.join(found, ["kd", "kt"]), _runs(length, n, RUN_BYTES), RUN)
    return common.map_batches(runs.repartition(n, "target").sortWithinPartitions("target"), _covered(length, gram, GROUPED), "kd long, kt long, first long, last long")


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal runs removed."""
    kept, at, removed, runs = [], 0, 0, 0
    for a, b in sorted(spans):
        if a > at or not runs:
            kept.append(text[at:a])
            runs += 1
            removed += b - a
            at = b
        elif b > at:
            removed += b - at
            at = b
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def with_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row (all columns of docs), text, and spans, a list of (first, last), null if there are none.

    Spans are gathered by one half of the key and joined by both, so that Spark may split the rows of a text with many copies.
    """
    spans = repeated_spans(docs, length).repartition(common.partitions(docs.sparkSession), "kt").groupBy("kd", "kt").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].alias("text"), *text_key(docs))
    return rows.join(spans, ["kd", "kt"], "left").select("row", "text", "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of docs.

    Null text counts as empty. Rows that repeat are each other's copies. No rows: no rows.
    """

    def run(batches):
        for b in batches:
            texts = common.text_bytes(b["text"])
            cut = [_cut(t, [(x["first"], x["last"]) for x in s or ()]) for t, s in zip(texts, b["spans"].to_pylist(), strict=True)]
            yield {"doc_id": b["doc_id"], "n_bytes": [len(t) for t in texts], "n_removed": [c[1] for c in cut], "n_spans": [c[2] for c in cut], "kept": [c[0] for c in cut]}

    own = with_spans(docs.select(F.col("doc_id").cast("long"), "text"), length).select("row.doc_id", "text", "spans")
    return common.map_batches(own, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with what is left of each text; a character of which a byte went goes too. A row of which nothing is left goes, one that was empty or null stays."""

    @F.pandas_udf("string")
    def kept(text: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(text, first, last, strict=True):
            out.append(_cut(t.encode(), list(zip(a.tolist(), b.tolist(), strict=True)))[0].decode("utf-8", "ignore") if a is not None else t)
        return pd.Series(out)

    own = with_spans(docs, length).withColumn("kept", kept("text", "spans.first", "spans.last"))
    own = own.where("kept <> '' or text = '' or text is null")
    return own.select(*((F.col("kept") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """As remove_repeats, with kept_sha256 for the bytes kept, and text: these as UTF-8, where a character was cut with U+FFFD.

    Null text counts as empty; a null doc_id stays null; rows that repeat each have a row. No rows: no rows.
    """
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text)


def brute_force(texts: list[bytes], length: int) -> list[bytes]:
    """What is left of each text, by a count of all windows. For tests."""
    count: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            w = hashlib.blake2b(t[p : p + length]).digest()
            count[w] = count.get(w, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if count[hashlib.blake2b(t[p : p + length]).digest()] > 1:
                gone[p : p + length] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out

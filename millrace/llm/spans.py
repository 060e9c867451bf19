"""Long exact spans shared between records, found by difference-cover anchors.

A difference cover D of the residues modulo a period v has, for any two positions i and j, an offset d < v with both
i + d and j + d at residues in D. So if only the windows of w characters that start at cover positions are hashed, any
two texts that share v + w - 1 characters share an aligned, hashed window. With w = length + 1 - v every span of the
wanted length is caught, and a perfect cover (every difference once) hashes q + 1 of v = q^2 + q + 1 positions.

Each task hashes its texts by prefix sums and sends the anchors, sorted into buckets by hash and packed (6 bytes of hash,
positions as differences), so the shuffle carries some 8 to 18 bytes an anchor. A bucket is searched for hashes held by
different texts. Aligned anchors of one pair of texts that follow each other at distance v overlap, as w > v, and form a
chain, which is extended at both ends over the texts themselves and compared there character by character.

Three physical ways lead to the same result, whichever the counts choose:
- A pair of texts with an anchor at more than ``often`` positions of either (long runs or periods) is compared by all
  its windows, which takes linear time; windows of one hash are compared by characters.
- An anchor that more than LOCAL texts of a task's stretch hold is not sent to its bucket by that task any more, but for
  a mark, and its places are spread over all tasks; so a bucket gets a bounded number of entries of a hot anchor a task.
- An anchor so marked, or held by more than ``crowd`` texts, is not paired: texts may share it and nothing more. The
  windows of the full length around its places are hashed. Where pairs are wanted, texts that share such a window are
  paired, once per span, a window with very many holders in blocks; where only the shared parts are wanted no pairs are
  made: a window is shared if the first and the last of its holders differ. Windows are told apart by 128 bits, and
  pairs are compared by characters like all others.

The result is put in one form: per text and other text, the maximal stretches of the text that windows shared with the
other cover. Copies of one text are one class throughout; a class has a 63-bit key of the text, and keys that two texts
share by chance are found by a second hash of 128 bits and replaced.

Texts shorter than the length, null texts and null ids share nothing. Characters are code points. Result columns are new,
so columns of the input never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.common import written

BASE = np.uint64(0x9E3779B97F4A7C15)
SECOND = 0xC2B2AE3D27D4EB4F
#: Prime powers q as (prime, exponent) with perfect covers of period q * q + q + 1.
POWERS = [(2, 1), (3, 1), (2, 2), (5, 1), (7, 1), (2, 3), (3, 2), (11, 1), (13, 1)]
#: Characters hashed at once, anchors a bucket is meant to hold.
CHUNK, BUCKET = 1_500_000, 1_500_000
#: Texts of a stretch that may hold an anchor before its places go their own way.
LOCAL = 16
#: Holders of one window that are paired in one task.
BLOCK = 20_000
#: The class of a mark: this anchor is held by many.
MARK = -1


@lru_cache
def perfect_cover(p: int, e: int) -> tuple[int, tuple[int, ...]]:
    """(v, D): a perfect difference set as a union of orbits under multiplication by p, found by search."""
    q = p**e
    v, seen, orbits = q * q + q + 1, set(), []
    for x in range(v):
        if x not in seen:
            orbit, y = [], x
            while y not in orbit:
                orbit.append(y)
                y = y * p % v
            seen.update(orbit)
            orbits.append(orbit)

    def differences(xs: list[int]) -> set[int] | None:
        found = {(a - b) % v for a in xs for b in xs if a != b}
        return found if len(found) == len(xs) * (len(xs) - 1) else None

    def search(at: int, chosen: list[int]) -> list[int] | None:
        if len(chosen) == q + 1:
            return chosen
        for k in range(at, len(orbits)):
            more = chosen + orbits[k]
            if len(more) <= q + 1 and differences(more) is not None and (found := search(k + 1, more)):
                return found
        return None

    found = search(0, [])
    assert found, "no union of orbits"
    return v, tuple(sorted(found))


def cover_for(length: int) -> tuple[int, int, tuple[int, ...]]:
    """(v, w, D) for spans of ``length``: the longest period whose windows still overlap, v <= w."""
    best = max((perfect_cover(p, e) for p, e in POWERS if 2 * ((p**e) ** 2 + p**e + 1) <= length + 1), default=None)
    if best is None:
        raise ValueError("spans shorter than 13 characters are not supported")
    return best[0], length + 1 - best[0], best[1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=2)
def _powers(n: int, base: int = int(BASE)) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(points: np.ndarray, starts: np.ndarray, w: int, base: int = int(BASE)) -> np.ndarray:
    """64-bit hashes of the windows of w characters at ``starts``, by prefix sums of a polynomial hash."""
    size = max(1 << 21, 1 << int(len(points)).bit_length())
    up, down = _powers(size, base)
    with np.errstate(over="ignore"):
        c = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)
        c ^= c >> np.uint64(29)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(c * up[: len(points)], out=sums[1:])
        return _mixed((sums[starts + w] - sums[starts]) * down[starts])


def _pieces(texts: list[str], w: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Groups of (text number, offset, characters) of about CHUNK characters; longer texts in overlapping parts."""
    numbers, offsets, parts, held = [], [], [], 0
    for k, s in enumerate(texts):
        for at in range(0, max(len(s) - w + 1, 0), CHUNK):
            part = s[at : at + CHUNK + w - 1]
            numbers.append(k)
            offsets.append(at)
            parts.append(part)
            held += len(part)
            if held >= CHUNK:
                yield numbers, offsets, parts
                numbers, offsets, parts, held = [], [], [], 0
    if parts:
        yield numbers, offsets, parts


def anchors(texts: list[str], v: int, w: int, cover: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, position, hash) of all windows at cover positions, in order, in groups."""
    residues = np.array(cover, np.int64)
    for numbers, offsets, parts in _pieces(texts, w):
        where, who, pos, base = [], [], [], 0
        for k, off, part in zip(numbers, offsets, parts, strict=True):
            count = len(part) - w + 1
            first = off // v
            at = (np.arange(first, (off + count) // v + 1, dtype=np.int64)[:, None] * v + residues).ravel()
            at = at[(at >= off) & (at < off + count)]
            pos.append(at)
            where.append(at - off + base)
            who.append(np.full(len(at), k, np.int64))
            base += len(part)
        yield np.concatenate(who), np.concatenate(pos), window_hashes(code_points("".join(parts)), np.concatenate(where), w)


BLOCKS = "bucket int, texts int, n int, head binary, hashes binary"


def _packer(v: int, w: int, cover: tuple[int, ...], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        hot, turn = np.empty(0, np.uint64), None

        def packed(bucket: int, keys: np.ndarray, p: np.ndarray, h: np.ndarray | None) -> tuple:
            """A row of anchors in order of text and position; without hashes: places of hot anchors."""
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (p[1:] < p[:-1])])
            step = np.diff(p, prepend=0)
            step[first] = p[first]
            counts = np.diff(np.r_[first, len(p)])
            head = keys[first].tobytes() + counts.astype(np.uint32).tobytes() + step.astype(np.uint32).tobytes()
            hashes = b"" if h is None else np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            return bucket, len(first), len(p), zip_.compress(head), hashes

        for b in batches:
            seen: dict[int, None] = {}
            classes, texts = [], []
            for c, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if c not in seen:
                    seen[c] = None
                    classes.append(c)
                    texts.append(s)
            keys = np.array(classes, np.int64)
            turn = int(keys[0] % buckets) if turn is None and len(keys) else turn
            for who, pos, h in anchors(texts, v, w, cover):
                rows = []
                new = np.setdiff1d(_crowded(h, who), hot)
                hot = np.union1d(hot, new)
                own = keys[who]
                if len(hot):
                    spot = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    many = hot[spot] == h
                    if many.any():
                        turn = (turn + 1) % buckets
                        rows.append(packed(turn, own[many], pos[many], None))
                    # A mark for each anchor that has become hot.
                    own, pos, h = np.r_[own[~many], np.full(len(new), MARK)], np.r_[pos[~many], np.zeros(len(new), np.int64)], np.r_[h[~many], new]
                bucket = ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for k in np.flatnonzero(edges[1:] > edges[:-1]):
                    part = order[edges[k] : edges[k + 1]]
                    rows.append(packed(int(k), own[part], pos[part], h[part]))
                cols = list(zip(*rows, strict=True))
                if rows:
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "texts", "n", "head", "hashes"])

    return run


def _crowded(h: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Hashes that more than LOCAL texts hold."""
    order = np.argsort(h, kind="stable")
    hs, ws = h[order], who[order]
    opens = np.r_[True, hs[1:] != hs[:-1]][: len(hs)]
    start = np.flatnonzero(opens)
    texts = np.add.reduceat(opens | np.r_[True, ws[1:] != ws[:-1]][: len(hs)], start) if len(start) else start
    return hs[start][texts > LOCAL]


def _places(r: dict, unzip: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    head, m, n = unzip.decompress(r["head"]), r["texts"], r["n"]
    keys = np.frombuffer(head, np.int64, m)
    counts = np.frombuffer(head, np.uint32, m, 8 * m).astype(np.int64)
    steps = np.frombuffer(head, np.uint32, n, 12 * m).astype(np.int64)
    total = np.cumsum(steps)
    first = np.cumsum(counts) - counts
    return np.repeat(keys, counts), (total - np.repeat(total[first] - steps[first], counts)).astype(np.int32)


def _unpacked(blocks: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unzip = zstandard.ZstdDecompressor()
    cs, ps, hs = [], [], []
    for r in blocks:
        c, p = _places(r, unzip)
        cs.append(c)
        ps.append(p)
        n = r["n"]
        six = np.zeros((n, 8), np.uint8)
        six[:, :6] = np.frombuffer(r["hashes"], np.uint8).reshape(n, 6)
        hs.append(six.view(np.uint64).ravel())
    return np.concatenate(hs), np.concatenate(cs), np.concatenate(ps)


PAIRS = "a bigint, b bigint, pa int, pb int"


def aligned_pairs(h: np.ndarray, c: np.ndarray, p: np.ndarray, v: int, first_residue: int, often: int, crowd: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, pa, pb) of anchors of one hash in different texts, a < b; pa = pb = -1 for pairs to compare whole, and pb = -2
    for a place of an anchor that is marked or that more than ``crowd`` texts hold (a = b).

    Texts at the same phase (positions equal modulo v) share all cover positions; of these only one residue is kept.
    """
    order = np.argsort(h, kind="stable")
    hs = h[order]
    same = np.r_[False, hs[1:] == hs[:-1]]
    some = order[same | np.r_[same[1:], False]]
    if not len(some):
        return
    h, c, p = h[some], c[some], p[some]
    order = np.lexsort((p, c, h))
    h, c, p = h[order], c[order], p[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1])]
    h, c, p = h[keep], c[keep], p[keep]
    opens = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]  # runs of one hash in one text
    group = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
    crowded = ((np.bincount(group, weights=opens) > crowd) | (np.bincount(group, weights=c == MARK) > 0))[group]
    if crowded.any():
        place = crowded & (c != MARK)
        yield c[place], c[place], p[place], np.full(place.sum(), -2, np.int32)
        h, c, p, opens = h[~crowded], c[~crowded], p[~crowded], opens[~crowded]
        if not len(h):
            return
    start = np.flatnonzero(opens)
    size = np.diff(np.r_[start, len(h)])
    whole = np.repeat(size > often, size)
    keep = ~whole | opens
    h, c, p = h[keep], c[keep], np.where(whole, -1, p)[keep]
    group = np.cumsum(np.r_[True, h[1:] != h[:-1]])
    at = np.arange(len(h))
    for step in range(1, len(h)):
        at = at[at + step < len(h)]
        at = at[group[at + step] == group[at]]
        if not len(at):
            return
        i, j = at, at + step
        pick = c[i] != c[j]
        i, j = i[pick], j[pick]
        either = (p[i] < 0) | (p[j] < 0)
        phase = (p[j].astype(np.int64) - p[i]) % v == 0
        pick = either | ~phase | (p[i] % v == first_residue)
        i, j, either = i[pick], j[pick], either[pick]
        if len(i):
            yield c[i], c[j], np.where(either, -1, p[i]).astype(np.int32), np.where(either, -1, p[j]).astype(np.int32)


def _searcher(v: int, first_residue: int, often: int, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for r in b.to_pylist():
                if r["hashes"]:
                    held.setdefault(r["bucket"], []).append(r)
                    continue
                c, p = _places(r, unzip)
                yield _pair_batch([(c, c, p, np.full(len(c), -2, np.int32))])
        for blocks in held.values():
            whole: set[tuple[int, int]] = set()
            out: list[tuple[np.ndarray, ...]] = []
            for a, b, i, j in aligned_pairs(*_unpacked(blocks), v, first_residue, often, crowd):
                ones = i < 0
                whole.update(zip(a[ones].tolist(), b[ones].tolist(), strict=True))
                out.append((a[~ones], b[~ones], i[~ones], j[~ones]))
                if sum(len(x[0]) for x in out) > 200_000:
                    yield _pair_batch(out)
                    out = []
            if whole:
                a, b = (np.array(x, np.int64) for x in zip(*whole, strict=True))
                out.append((a, b, np.full(len(a), -1, np.int32), np.full(len(a), -1, np.int32)))
            if out:
                yield _pair_batch(out)

    return run


def _pair_batch(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b", "pa", "pb"])


def class_key(text: Column, odd: list[list[int]]) -> Column:
    """A 63-bit key of the text; ``odd``: per round, keys found to be shared by different texts, which get another."""
    key = F.shiftrightunsigned(F.xxhash64(text), 1)
    for at, keys in enumerate(odd):
        key = F.when(key.isin(keys), F.shiftrightunsigned(F.xxhash64(F.md5(text), F.lit(at)), 1)).otherwise(key)
    return key


class Corpus:
    """The documents that have an id and a text: members (doc_id, text_class, n_chars) and representatives
    (text_class, doc_id: the smallest, copies, n_chars), both written once."""

    def __init__(self, docs: DataFrame, ident: str, text: str):
        self.texts = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("_t")).where("doc_id is not null and _t is not null")
        self.odd: list[list[int]] = []
        while True:
            members = written(self.texts.select("doc_id", class_key(F.col("_t"), self.odd).alias("text_class"), F.length("_t").alias("n_chars"), F.unhex(F.md5("_t")).alias("_m")))
            first = written(members.groupBy("text_class").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_chars").alias("n_chars"), (F.min("_m") != F.max("_m")).alias("_odd")))
            odd = [r[0] for r in first.where("_odd").select("text_class").limit(100_000).collect()]  # a few in 10^10 texts
            if not odd:
                break
            self.odd.append(odd)
        self.members, self.first = members.drop("_m"), first.drop("_odd")

    def keyed(self, length: int) -> DataFrame:
        """text_class, _t of the texts of the length, copies included."""
        return self.texts.where(F.length("_t") >= length).select(class_key(F.col("_t"), self.odd).alias("text_class"), "_t")

    def of(self, wanted: DataFrame) -> DataFrame:
        """text_class, _t, one row per class of ``wanted`` (text_class). Spark broadcasts the written ids if they are small."""
        ids = written(self.first.join(wanted, "text_class", "left_semi").select("doc_id", "text_class"))
        return self.texts.withColumn("text_class", class_key(F.col("_t"), self.odd)).join(ids, ["doc_id", "text_class"]).select("text_class", "_t")


def anchor_pairs(corpus: Corpus, length: int, often: int, crowd: int) -> tuple[DataFrame, int, int]:
    """a, b, pa, pb as in ``aligned_pairs``, written; v; w."""
    v, w, cover = cover_for(length)
    total = corpus.members.where(F.col("n_chars") >= length).agg(F.sum("n_chars")).collect()[0][0] or 0
    buckets = int(max(12, -(-total * len(cover) // (v * BUCKET))))
    blocks = corpus.keyed(length).select("text_class", "_t").mapInArrow(_packer(v, w, cover, buckets), BLOCKS).repartitionById(buckets, "bucket")
    return written(blocks.mapInArrow(_searcher(v, cover[0], often, crowd), PAIRS)), v, w


def _chains(pairs: DataFrame, v: int) -> DataFrame:
    """a, b, delta, first, last: chains of aligned anchors; delta null: compare the two texts whole."""
    at = pairs.where("pb >= 0").select("a", "b", (F.col("pb") - F.col("pa")).alias("delta"), "pa")
    o = Window.partitionBy("a", "b", "delta").orderBy("pa")
    at = at.withColumn("opens", F.when(F.col("pa") - F.lag("pa").over(o) == v, 0).otherwise(1))
    at = at.withColumn("chain", F.sum("opens").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    chains = at.groupBy("a", "b", "delta", "chain").agg(F.min("pa").alias("first"), F.max("pa").alias("last")).drop("chain")
    whole = pairs.where("pb = -1").select("a", "b").distinct()
    none = F.lit(None).cast("int")
    return chains.unionByName(whole.select("a", "b", none.alias("delta"), none.alias("first"), none.alias("last")))


WINDOWS = "h bigint, g bigint, c bigint, at int, before int"


def _crowd_hasher(v: int, length: int):
    """The windows of ``length`` that hold a crowded anchor: two hashes, class, start, and the character before (-1: the stretch begins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, text, places in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                points = code_points(text)
                starts = np.unique((np.array(places, np.int64)[:, None] - np.arange(v)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(points) - length)]
                if not len(starts):
                    continue
                h, g = (window_hashes(points, starts, length, base).view(np.int64) for base in (int(BASE), SECOND))
                before = np.where(np.r_[True, np.diff(starts) > 1], -1, points[np.maximum(starts - 1, 0)].astype(np.int64))
                cols = [pa.array(h), pa.array(g), pa.array(np.full(len(h), c, np.int64)), pa.array(starts.astype(np.int32)), pa.array(before.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "g", "c", "at", "before"])

    return run


def _crowd_windows(corpus: Corpus, pairs: DataFrame, v: int, length: int) -> DataFrame | None:
    """The windows around the places of crowded anchors, written; None if there are no such places."""
    places = pairs.where("pb = -2").select(F.col("a").alias("text_class"), F.col("pa").alias("pos"))
    if not places.limit(1).collect():
        return None
    at = places.groupBy("text_class").agg(F.collect_set("pos").alias("places"))  # bounded by the text
    return written(at.join(corpus.of(places.select("text_class").distinct()), "text_class").select("text_class", "_t", "places").mapInArrow(_crowd_hasher(v, length), WINDOWS))


def _window_pairs(windows: DataFrame) -> DataFrame:
    """a, b, pa, pb: pairs of windows of one hash in different texts, save where both have the same character before.

    The holders of one window are paired within and between blocks of about BLOCK of them, each a group of its own.
    """
    counts = windows.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK)
    counts = counts.select("h", F.ceil(F.col("k") / BLOCK).cast("int").alias("parts"))
    x = windows.join(written(counts), "h", "left")
    own = F.pmod(F.xxhash64("c", "at"), F.col("parts")).cast("int")
    x = x.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    x = x.select("h", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "g", "c", "at", "before")
    return x.repartition("h", "p", "q").sortWithinPartitions("h", "p", "q").mapInArrow(_crowd_pairs, PAIRS).distinct()


def _crowd_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of windows within the groups (h, p, q) of sorted batches; of two blocks only those between them."""
    held: list[pa.RecordBatch] = []

    def edges(columns: list[np.ndarray]) -> np.ndarray:
        differ = np.zeros(max(len(columns[0]) - 1, 0), bool)
        for c in columns:
            differ |= c[1:] != c[:-1]
        return differ

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, p, q, own, g, c, at, before = (t[n].to_numpy() for n in ("h", "p", "q", "own", "g", "c", "at", "before"))
        part = np.where(before < 0, -1 - np.arange(len(h)), before.astype(np.int64))  # every beginning is a part of its own
        order = np.lexsort((c, part, g, q, p, h))
        h, p, q, own, g, c, at, part = (x[order] for x in (h, p, q, own, g, c, at, part))
        new = edges([h, p, q, g])
        last = np.r_[new, True]
        end_group = np.flatnonzero(last)[np.cumsum(np.r_[0, last[:-1]])] + 1
        end_part = np.r_[new | (part[1:] != part[:-1]), True]
        end_part = np.flatnonzero(end_part)[np.cumsum(np.r_[0, end_part[:-1]])] + 1
        more = end_group - end_part
        for lo in _spread(more):
            rows = np.arange(*lo)
            i = np.repeat(rows, more[rows])
            j = np.arange(len(i)) - np.repeat(np.cumsum(more[rows]) - more[rows], more[rows]) + np.repeat(end_part[rows], more[rows])
            pick = (c[i] != c[j]) & ((p[i] == q[i]) | (own[i] != own[j]))
            i, j = i[pick], j[pick]
            swap = c[i] > c[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c[i], c[j], at[i], at[j])], names=["a", "b", "pa", "pb"])

    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < 200_000:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.flatnonzero(edges([t[n].to_numpy() for n in ("h", "p", "q")]))
        if len(new):
            cut_at = int(new[-1]) + 1
            yield from pairs(t.slice(0, cut_at))
            held, rows = t.slice(cut_at).to_batches(), rows - cut_at
    if held:
        yield from pairs(pa.Table.from_batches(held).combine_chunks())


def _spread(more: np.ndarray, at_once: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``at_once`` partners together."""
    total = np.cumsum(more)
    lo = 0
    while lo < len(more):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + at_once)) + 1
        yield lo, min(max(hi, lo + 1), len(more))
        lo = min(max(hi, lo + 1), len(more))


def _common(x: str, y: str) -> int:
    n, lo = min(len(x), len(y)), 0
    if x[:n] == y[:n]:
        return n
    while lo < n and x[lo] == y[lo]:
        lo += 1
    return lo


def shared_windows(x: str, y: str, length: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The parts of x covered by windows of ``length`` that occur in y, and the parts of y, as (start, length)."""
    if min(len(x), len(y)) < length:
        return [], []
    points = [code_points(s) for s in (x, y)]
    both = [np.concatenate([window_hashes(p, np.arange(len(p) - length + 1), length, base) for p in points]) for base in (int(BASE), SECOND)]
    order = np.lexsort(both)
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(np.r_[0, (both[0][order][1:] != both[0][order][:-1]) | (both[1][order][1:] != both[1][order][:-1])])
    hashes = np.split(ids, [len(points[0]) - length + 1])

    def runs(own: int) -> list[tuple[int, int]]:
        h, other = hashes[own], hashes[1 - own]
        order = np.argsort(other, kind="stable")
        spot = np.minimum(np.searchsorted(other[order], h), len(other) - 1)
        twin = order[spot]
        at = np.flatnonzero(other[twin] == h)
        kept = []
        for lo in range(0, len(at), 20_000):  # by characters
            some = at[lo : lo + 20_000]
            reach = np.arange(length)
            kept.append(some[(points[own][some[:, None] + reach] == points[1 - own][twin[some][:, None] + reach]).all(axis=1)])
        at = np.concatenate(kept) if kept else at
        if not len(at):
            return []
        first = np.flatnonzero(np.r_[True, np.diff(at) > length])
        last = np.r_[first[1:] - 1, len(at) - 1]
        return [(int(at[i]), int(at[j] - at[i]) + length) for i, j in zip(first, last, strict=True)]

    return runs(0), runs(1)


SIDES = "text_class bigint, other_class bigint, start int, n_chars int"


def _extender(v: int, w: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                (la, ra), (lb, rb) = (r["sa"]["l"], r["sa"]["r"]), (r["sb"]["l"], r["sb"]["r"])
                if r["delta"] is None:
                    xs, ys = shared_windows(la, lb, length)
                    rows += [(r["a"], r["b"], s, n) for s, n in xs] + [(r["b"], r["a"], s, n) for s, n in ys]
                    continue
                w_ = r["w"]  # characters that the hash has matched, on either side of the middle
                if la[-w_:] != lb[-w_:] or ra[:w_] != rb[:w_]:
                    continue
                left, right = _common(la[::-1], lb[::-1]) - w_, _common(ra, rb) - w_
                n = r["last"] - r["first"] + w_ + left + right
                if n >= length:
                    start = r["first"] - left
                    rows += [(r["a"], r["b"], start, n), (r["b"], r["a"], start + r["delta"], n)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["text_class", "other_class", "start", "n_chars"])

    return run


def _extended(corpus: Corpus, chains: DataFrame, v: int, w: int, length: int) -> DataFrame:
    """The spans of ``chains`` (a, b, delta, first, last, w: characters matched at first and at last, far: extend over the
    whole texts, else by v), compared by characters and extended over the texts, from both sides."""
    chains = written(chains.select("a", "b", "delta", "first", "last", "w", "far"))
    ends = F.array(
        F.struct(F.lit("a").alias("side"), F.col("a").alias("text_class"), F.col("first").alias("f"), F.col("last").alias("l")),
        F.struct(F.lit("b").alias("side"), F.col("b").alias("text_class"), (F.col("first") + F.col("delta")).alias("f"), (F.col("last") + F.col("delta")).alias("l")),
    )
    key = ["a", "b", "delta", "first", "last", "w", "far"]
    texts = corpus.of(chains.select(F.explode(F.array("a", "b")).alias("text_class")).distinct())
    got = chains.select(*key, F.inline(ends)).join(texts, "text_class")
    lo = F.when(F.col("far"), F.lit(0)).otherwise(F.greatest(F.col("f") - v, F.lit(0)))
    left = F.when(F.col("delta").isNull(), F.col("_t")).otherwise(F.substring("_t", lo + 1, F.col("f") - lo + F.col("w")))
    right = F.when(F.col("delta").isNull(), F.lit("")).otherwise(F.substring("_t", F.col("l") + 1, F.when(F.col("far"), F.length("_t")).otherwise(F.col("w") + v)))
    got = got.select(*key, "side", F.struct(left.alias("l"), right.alias("r")).alias("s"))
    both = got.groupBy(*key).agg(*[F.max(F.when(F.col("side") == x, F.col("s"))).alias(f"s{x}") for x in "ab"])
    return both.where("sa is not null and sb is not null").mapInArrow(_extender(v, w, length), SIDES)


def _stretches(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, n_chars: the maximal stretches of overlapping or touching spans."""
    o = Window.partitionBy(*keys).orderBy("start")
    x = spans.select(*keys, "start", (F.col("start") + F.col("n_chars")).alias("end")).groupBy(*keys, "start").agg(F.max("end").alias("end"))
    x = x.withColumn("opens", F.when(F.col("start") <= F.max("end").over(o.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    x = x.withColumn("run", F.sum("opens").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("n_chars")).drop("run")


def _window_candidates(pairs: DataFrame, length: int, far: bool) -> DataFrame:
    """Pairs of windows as chains of one anchor that is the whole window."""
    return pairs.select("a", "b", (F.col("pb") - F.col("pa")).alias("delta"), F.col("pa").alias("first"), F.col("pa").alias("last"), F.lit(length).alias("w"), F.lit(far).alias("far"))


def shared_spans(corpus: Corpus, length: int = 200, often: int = 64, crowd: int = 100) -> DataFrame:
    """text_class, other_class, start, n_chars: for two different texts, the maximal stretches of text_class that are
    covered by windows of ``length`` characters which occur in other_class, in characters of text_class."""
    pairs, v, w = anchor_pairs(corpus, length, often, crowd)
    chains = _chains(pairs, v).withColumn("w", F.lit(w)).withColumn("far", F.lit(False))
    windows = _crowd_windows(corpus, pairs, v, length)
    if windows is not None:
        chains = chains.unionByName(_window_candidates(_window_pairs(windows), length, True))
    return _stretches(_extended(corpus, chains, v, w, length), ["text_class", "other_class"])


def linked_texts(corpus: Corpus, length: int = 200, often: int = 64, crowd: int = 100) -> DataFrame:
    """a, b: the pairs of different texts, a < b, that share a span of ``length``, each proven by characters.

    One chain that is long enough in itself, or one window, is compared per pair; only pairs without, or whose
    comparison fails by a chance of the hashes, are extended over all their chains.
    """
    pairs, v, w = anchor_pairs(corpus, length, often, crowd)
    o = Window.partitionBy("a", "b")
    chains = written(_chains(pairs, v).withColumn("long", F.coalesce(F.max(F.col("last") > F.col("first")).over(o), F.lit(False))))
    proofs = chains.where("last > first").select("a", "b", "delta", "first", F.lit(v + w).alias("w"))
    windows = _crowd_windows(corpus, pairs, v, length)
    crowds = None
    if windows is not None:
        crowds = written(_window_pairs(windows))
        proofs = proofs.unionByName(_window_candidates(crowds, length, False).select("a", "b", "delta", "first", "w"))
    one = proofs.groupBy("a", "b").agg(F.min(F.struct("first", "delta", "w")).alias("p")).select("a", "b", "p.delta", "p.first", F.col("p.first").alias("last"), "p.w", F.lit(False).alias("far"))
    rest = chains.where("not long").select("a", "b", "delta", "first", "last", F.lit(w).alias("w"), F.lit(False).alias("far"))
    if crowds is not None:
        rest = rest.join(crowds.select("a", "b").distinct(), ["a", "b"], "left_anti")
    one = written(one)
    links = lambda spans: spans.where("text_class < other_class").select(F.col("text_class").alias("a"), F.col("other_class").alias("b")).distinct()
    found = written(links(_extended(corpus, one.unionByName(rest), v, w, length)))
    failed = one.select("a", "b").join(found, ["a", "b"], "left_anti")
    if not failed.limit(1).collect():
        return found
    again = chains.select("a", "b", "delta", "first", "last", F.lit(w).alias("w"), F.lit(False).alias("far"))
    if crowds is not None:
        again = again.unionByName(_window_candidates(crowds, length, True))
    return found.unionByName(links(_extended(corpus, again.join(failed, ["a", "b"], "left_semi"), v, w, length)))


def shared_parts(corpus: Corpus, length: int = 200, often: int = 64, crowd: int = 100) -> DataFrame:
    """text_class, start, n_chars: the maximal stretches of each text covered by windows that occur in another text.

    Texts under a crowded anchor are not paired: a window of theirs is shared if its holders have more than one class.
    """
    pairs, v, w = anchor_pairs(corpus, length, often, crowd)
    chains = _chains(pairs, v).withColumn("w", F.lit(w)).withColumn("far", F.lit(False))
    spans = _extended(corpus, chains, v, w, length).select("text_class", "start", "n_chars")
    windows = _crowd_windows(corpus, pairs, v, length)
    if windows is not None:
        held = windows.groupBy("h", "g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).where("lo < hi")
        held = written(held.select("h", "g", "k"))
        # Windows with very many holders are few (one in BLOCK at most), and looked up apart.
        hot = written(held.where(F.col("k") > BLOCK).select("h", "g"))
        rest = windows.join(hot, ["h", "g"], "left_anti").join(held.where(F.col("k") <= BLOCK), ["h", "g"], "left_semi")
        for shared in (rest, windows.join(hot, ["h", "g"], "left_semi")):
            spans = spans.unionByName(shared.select(F.col("c").alias("text_class"), F.col("at").alias("start"), F.lit(length).alias("n_chars")))
    return _stretches(spans, ["text_class"])


def document_pairs(links: DataFrame, corpus: Corpus, length: int = 200) -> DataFrame:
    """doc_id_1 < doc_id_2: all pairs of documents that share a span, copies of one text (of the length) included."""
    m = corpus.members.where(F.col("n_chars") >= length).select("doc_id", "text_class")
    m1, m2 = m.select(F.col("doc_id").alias("d1"), F.col("text_class").alias("a")), m.select(F.col("doc_id").alias("d2"), F.col("text_class").alias("b"))
    across = links.join(m1, "a").join(m2, "b").select(F.least("d1", "d2").alias("doc_id_1"), F.greatest("d1", "d2").alias("doc_id_2"))
    twins = m1.join(m2.withColumnRenamed("b", "a"), "a").where("d1 < d2").select(F.col("d1").alias("doc_id_1"), F.col("d2").alias("doc_id_2"))
    return across.unionAll(twins)


def coverage(parts: DataFrame, corpus: Corpus, length: int = 200) -> DataFrame:
    """doc_id, n_chars, shared_chars, shared_share of every document: the part of its text found in another document.

    The text of a copy, if it has the length, is shared as a whole.
    """
    covered = parts.groupBy("text_class").agg(F.sum("n_chars").cast("long").alias("covered"))
    x = corpus.members.join(corpus.first.select("text_class", "copies").join(covered, "text_class", "left"), "text_class")
    twin = (F.col("copies") > 1) & (F.col("n_chars") >= length)
    part = F.when(twin, F.col("n_chars").cast("long")).otherwise(F.coalesce("covered", F.lit(0)))
    return x.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), part.alias("shared_chars"), F.round(F.when(F.col("n_chars") > 0, part / F.col("n_chars")).otherwise(0.0), 6).alias("shared_share"))

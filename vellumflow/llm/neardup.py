"""Near-duplicate texts by an exact set-similarity join: universe partition and pigeonhole.

Each text is the set of its word shingles. Two sets of sizes ``r >= s`` reach the similarity ``t`` iff their symmetric
difference is at most ``H = (r + s) * (1 - t) / (1 + t)``. The hashed universe of shingles is partitioned into segments,
their number set by size band. A set *indexes* every segment it occupies and each segment's one-deletion
neighbourhood. The larger set of a pair *probes*: it allots budgets of 0, 1 (the segment must differ) or 2 (it must
differ by two) to its segments until they add up to more than ``H``; a pair within ``H`` then agrees with a probe on
some segment, exactly or up to one deletion. The allocation is by cost, from counts of all shingles in a hashed table
of fixed size: cheap (rare) segments are probed, common phrases are not. Candidates are pruned by parity sketches
(the sketches of two sets differ in no more bits than the sets differ in elements, so nothing is lost) and verified on
the texts themselves.

What travels. Sets lie in blocks of some thousand texts, in a table bucketed by block, and stay there. A first pass sends
the bare signatures of each block, sorted and delta-coded, to their ranges; what comes back is one bit a signature: does
another set's signature meet it there? A second pass makes the signatures of each block again and sends the few that are
met, with their texts' sketches, to be paired. A signature that nobody meets never carries a sketch, so the bytes of a
text depend on what it meets and hardly on the number of ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bucketed, saved, shuffle_width

U = np.uint64
CELLS = 1 << 18
BASE_SIZE = 8
SEGMENTS_PER_SIZE = 0.85
BLOCK = 8192
RARE = 1 << 22
_WORD = re.compile(r"[^\W_]+")
#: What a signature is: one that others may meet, one that looks for others, one with a shingle deleted.
INDEXED, PROBED, DELETION = 1, 2, 4


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (multiply and xor-shift)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def stable_order(keys: np.ndarray) -> np.ndarray:
    """A stable argsort of numbers from 0 on: each takes its place into its lower bits, where there is room, so that plain numbers are sorted."""
    low = len(keys).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + low > 64:
        return np.argsort(keys, kind="stable")
    placed = (keys.astype(np.uint64) << U(low)) | np.arange(len(keys), dtype=np.uint64)
    placed.sort()
    return (placed & U((1 << low) - 1)).astype(np.int64)


class _Digests(dict):
    """Words' hashes as bytes, each made when it is first asked for."""

    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh3_64_digest

    def __missing__(self, word: str) -> bytes:
        made = self[word] = self.digest(word)
        return made


class Shingler:
    """Distinct shingles of texts as sorted 40-bit numbers; the hash of a word is kept once it was made."""

    def __init__(self, words: int, least_words: int):
        self.n, self.least, self.known = words, max(words, least_words), _Digests()

    def words(self, text: str) -> list[str]:
        return _WORD.findall(text.lower())

    def of(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """``(places, sizes, shingles)`` of some texts, one behind the other; those of too few words are left out."""
        if len(self.known) > 1_000_000:
            self.known.clear()
        places, many, hashes = [], [], []
        for k, text in enumerate(texts):
            words = self.words(text) if text else []
            if words and len(words) >= self.least:
                places.append(k), many.append(len(words)), hashes.append(b"".join(map(self.known.__getitem__, words)))
        if not places:
            return [], np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.frombuffer(b"".join(hashes), dtype=">u8").astype(np.uint64)
        n = len(h) - self.n + 1
        x = h[:n]
        for k in range(1, self.n):
            x = mixed(x) + h[k : k + n]
        doc, left = np.repeat(np.arange(len(many)), many)[:n], np.repeat(np.cumsum(many), many)[:n] - np.arange(n)
        keys = ((doc.astype(np.uint64) << U(40)) | (mixed(x) >> U(24)))[left >= self.n]  # none goes over the end of its text
        keys.sort()
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
        return places, np.bincount((keys >> U(40)).astype(np.int64), minlength=len(many)), keys & U((1 << 40) - 1)


def _parts(batch: pa.RecordBatch, texts: int = 1024, characters: int = 2_000_000) -> Iterator[tuple[list[int], list[str | None]]]:
    """Keys and texts of a batch, so many at a time that their words take little memory."""
    keys, held, size = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        keys.append(key), held.append(text)
        size += len(text or "")
        if len(held) == texts or size >= characters:
            yield keys, held
            keys, held, size = [], [], 0
    if held:
        yield keys, held


def shingle_blocks(docs: DataFrame, words: int, least_words: int) -> DataFrame:
    """Sets of ``docs (doc, text)`` in blocks ``(block, docs, sizes, digests, shingles)``: up to 8192 texts or some millions
    of shingles a row; shingles are 5 bytes each, sorted within a text. Texts of too few words give no set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, least_words)
        number, held = TaskContext.get().partitionId() << 32, 0
        ids, sizes, digests, packed = [], [], [], []

        def block() -> pa.RecordBatch:
            columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([digests], pa.list_(pa.string())), pa.array([b"".join(packed)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "docs", "sizes", "digests", "shingles"])

        for batch in batches:
            for keys, texts in _parts(batch):
                places, many, s = shingler.of(texts)
                if not places:
                    continue
                raw, stops = s.view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), np.cumsum(many)
                sums = [np.add.reduceat(mixed(s + U(k)), stops - many).tolist() for k in (1, 2)]
                for place, size, stop, first, second in zip(places, many.tolist(), stops.tolist(), *sums):
                    ids.append(keys[place]), sizes.append(size), packed.append(raw[5 * (stop - size) : 5 * stop]), digests.append(f"{first:016x}{second:016x}")
                    held += size
                    if len(ids) == BLOCK or held >= 2_000_000:
                        yield block()
                        number, held = number + 1, 0
                        ids, sizes, digests, packed = [], [], [], []
        if ids:
            yield block()

    return docs.select(F.col("doc").cast("long"), "text").mapInArrow(run, "block long, docs array<long>, sizes array<int>, digests array<string>, shingles binary")


def in_block(blocks: DataFrame, rows: DataFrame, column: str, buckets: int) -> DataFrame:
    """``blocks`` with the ``column`` of ``rows (block, ...)`` gathered to an array; only ``rows`` are shuffled, as the blocks are bucketed."""
    gathered = rows.repartition(buckets, "block").groupBy("block").agg(F.collect_list(column).alias(column))
    return blocks.join(gathered.hint("shuffle_hash"), "block", "left")


def sets_of(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, sizes and shingles of one block ``(docs, sizes, shingles, dropped)``, without its dropped places."""
    docs, sizes = batch.column(0)[k].values.to_numpy(), batch.column(1)[k].values.to_numpy().astype(np.int64)
    shingles = unpacked([batch.column(2)[k].as_py()])
    if batch.column(3)[k].is_valid and len(batch.column(3)[k].values):
        kept = np.ones(len(docs), dtype=bool)
        kept[batch.column(3)[k].values.to_numpy()] = False
        shingles = shingles[np.repeat(kept, sizes)]
        docs, sizes = docs[kept], sizes[kept]
    return docs, sizes, shingles


def unpacked(column: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :5] = raw
    return wide.view(np.uint64).ravel()


def cell_of(shingles: np.ndarray) -> np.ndarray:
    return (mixed(shingles + U(99)) % U(CELLS)).astype(np.int64)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each hash cell: a table of fixed size (1 MB), counted over all sets of ``sets (docs, sizes, shingles, dropped)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                total += np.bincount(cell_of(sets_of(batch, k)[2]), minlength=CELLS)
        for at in range(0, CELLS, 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total[at : at + (1 << 14)]], pa.list_(pa.int64()))], names=["part", "counts"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": part["part"][:1], "counts": [np.sum(np.stack(part["counts"].to_list()), axis=0)]})

    parts = sets.select("docs", "sizes", "shingles", "dropped").mapInArrow(run, "part int, counts array<long>").groupBy("part").applyInPandas(add, "part int, counts array<long>")
    table = np.zeros(CELLS, dtype=np.int64)
    for row in parts.collect():  # CELLS numbers, whatever the corpus
        table[row["part"] : row["part"] + (1 << 14)] = row["counts"]
    return table


class Scheme:
    """Size bands of ratio 1/t, the segments of each and the allowed difference."""

    def __init__(self, t: float):
        self.t, self.miss = t, (1 - t) / (1 + t)
        edges = [BASE_SIZE]
        while edges[-1] < 1 << 30:
            edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] / t))))
        self.low = np.array([0, *edges])
        self.high = self.low[1:] - 1

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1

    def segments(self, band: np.ndarray) -> np.ndarray:
        return np.maximum(4, (SEGMENTS_PER_SIZE * self.low[band]).astype(np.int64))

    def allowed(self, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.floor((r + s) * self.miss + 1e-9).astype(np.int64)


def widths(size: np.ndarray) -> np.ndarray:
    """Bits of a set's sketch: a power of two, two to four a shingle, so that unlike sets differ in more bits than like ones may."""
    return (1 << np.maximum(7, np.ceil(np.log2(2.0 * np.maximum(size, 1))).astype(np.int64))).astype(np.int64)


def sketches(shingles: np.ndarray, doc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Parity sketches one behind the other, as bytes: bit b of a set is the parity of its shingles that hash to b.

    A sketch of half the width is the exclusive or of the two halves.
    """
    wide = widths(size)
    start = np.cumsum(wide) - wide
    bit = start[doc] + ((mixed(shingles + U(5)) >> U(40)).astype(np.int64) & (wide - 1)[doc])
    return np.packbits((np.bincount(bit, minlength=int(wide.sum())) & 1).astype(np.uint8))


class Sketches:
    """Sketches of some sets, comparable whatever their widths."""

    def __init__(self, raw: np.ndarray, size: np.ndarray):
        self.wide = widths(size)
        start = (np.cumsum(self.wide) - self.wide) // 8
        self.rows, self.at = {}, {}
        for w in np.unique(self.wide).tolist():
            own, double = np.flatnonzero(self.wide == w), np.flatnonzero(self.wide == 2 * w)
            whole = raw[start[own][:, None] + np.arange(w // 8)]
            halves = raw[start[double][:, None] + np.arange(w // 4)]
            self.rows[w] = np.concatenate([whole, halves[:, : w // 8] ^ halves[:, w // 8 :]]).view(np.uint64)
            self.at[w] = np.zeros(len(size), dtype=np.int32)
            self.at[w][np.r_[own, double]] = np.arange(len(own) + len(double))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits of pairs whose sizes are within the similarity: their widths are equal or one double the other (else 0, which rules nothing out)."""
        wa, wb = self.wide[a], self.wide[b]
        low = np.minimum(wa, wb)
        out = np.zeros(len(a), dtype=np.int64)
        for w, rows in self.rows.items():
            k = np.flatnonzero((low == w) & (np.maximum(wa, wb) <= 2 * w))
            if len(k):
                at = self.at[w]
                out[k] = np.bitwise_count(rows[at[a[k]]] ^ rows[at[b[k]]]).sum(axis=1)
        return out


def signatures(shingles: np.ndarray, doc: np.ndarray, size: np.ndarray, counts: np.ndarray, total: int, scheme: Scheme, step: int):
    """Signatures of a block in the size band ``step`` below each set's own: ``(sig, doc, kind, short)``.

    ``short``: the documents whose occupied segments can't take the budget they need; an exact pass handles those.
    """
    own = scheme.band(size) - step
    kept = own[doc] >= 0
    d, x = doc[kept], shingles[kept]
    band = own[d]
    seg = (mixed(x + U(7)) % scheme.segments(band).astype(np.uint64)).astype(np.int64)
    width = int(scheme.segments(np.array([own.max(initial=0)]))[0]) + 1
    order = stable_order(d * width + seg)
    d, x, seg, band = d[order], x[order], seg[order], band[order]
    if not len(d):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (seg[1:] != seg[:-1])])
    many = np.diff(np.r_[first, len(d)])
    group = np.repeat(np.arange(len(first)), many)
    gd = d[first]
    token = mixed(x + U(3))
    chance = np.log(np.minimum(counts[cell_of(x)] + 1.0, total) / total)
    whole, rarity = np.add.reduceat(token, first), np.add.reduceat(chance, first)
    salt = mixed((seg[first].astype(np.uint64) << U(8)) + band[first].astype(np.uint64) + U(12345))
    exact = mixed(whole + salt)
    deleted = mixed((whole + salt)[group] - token)
    one = total * np.exp(rarity)
    more = np.maximum(one, np.add.reduceat(total * np.exp(rarity[group] - chance), first) + one)
    pairs = np.flatnonzero(many >= 2)
    item = np.r_[np.arange(len(first)), pairs]
    cost = np.r_[one, more[pairs]]
    rank = np.clip(((np.log(cost + 1e-9) + 21) * 1000).astype(np.int64), 0, (1 << 17) - 1)
    order = stable_order(gd[item] * (1 << 17) + rank)
    item_doc = gd[item][order]
    head = np.flatnonzero(np.r_[True, item_doc[1:] != item_doc[:-1]])
    place = np.arange(len(item_doc)) - np.repeat(head, np.diff(np.r_[head, len(item_doc)]))
    need = scheme.allowed(size, np.minimum(size, scheme.high[np.maximum(own, 0)])) + 1
    taken = order[place < need[item_doc]]
    budget = np.bincount(item[taken], minlength=len(first))
    spent = np.bincount(gd, weights=budget, minlength=len(size))
    short = np.flatnonzero((own >= 0) & (spent < need))
    # a budget of 1 came from the segment's first item unless only the second was cheap enough: then both are probed
    probe_exact, probe_deleted = budget >= 1, (budget >= 2)[group]
    if step:
        sig, who, kind = np.r_[exact[probe_exact], deleted[probe_deleted]], np.r_[gd[probe_exact], d[probe_deleted]], np.r_[np.full(probe_exact.sum(), PROBED), np.full(probe_deleted.sum(), PROBED | DELETION)]
        return sig, who, kind, short
    # a probe goes up to one deletion only from segments of two shingles on, so only those of three on are met with one deleted
    indexed = (many >= 3)[group]
    some = np.flatnonzero(indexed | probe_deleted)
    kind = np.r_[INDEXED | PROBED * probe_exact, DELETION | INDEXED * indexed[some] | PROBED * probe_deleted[some]]
    return np.r_[exact, deleted[some]], np.r_[gd, d[some]], kind, short


def packed(values: np.ndarray, kind: type) -> bytes:
    """Numbers as compressed byte planes: the upper bytes, mostly zero, take next to no room."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def loose(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Sender:
    """Signatures of a block, ordered by range and signature: the same in both passes."""

    def __init__(self, counts: np.ndarray, total: int, shingles: int, t: float, per_range: int):
        self.counts, self.total, self.scheme = counts, total, Scheme(t)
        #: About two signatures a shingle; six bits more keep chance meetings below 2 %.
        self.bits = int(np.ceil(np.log2(max(2, 2 * shingles)))) + 6
        self.ranges = max(1, -(-2 * shingles // per_range))

    def of(self, size: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(signatures, documents, kinds, where each range begins, short documents)``."""
        doc = np.repeat(np.arange(len(size)), size)
        parts = [signatures(shingles, doc, size, self.counts, self.total, self.scheme, step) for step in (0, 1)]
        sig, who, kind = (np.concatenate(x) for x in list(zip(*parts))[:3])
        sig = sig >> U(64 - self.bits)
        order = stable_order(sig)
        sig = sig[order]
        edges = [-(-(k << self.bits) // self.ranges) for k in range(self.ranges)]
        starts = np.r_[np.searchsorted(sig, np.array(edges, dtype=np.uint64)), len(sig)]
        return sig, who[order], kind[order], starts, np.unique(np.concatenate([p[3] for p in parts]))


def sent(sets: DataFrame, sender: Sender) -> DataFrame:
    """First pass: ``(range, block, deltas, kinds)``, the sorted signatures of each block and range; range -1 holds the places of the
    documents that need the exact pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, size, shingles = sets_of(batch, k)
                sig, _, kind, starts, short = sender.of(size, shingles)
                rows = [(r, packed(np.diff(sig[a:b], prepend=U(0)), np.uint64), packed(kind[a:b], np.uint8)) for r, (a, b) in enumerate(zip(starts, starts[1:])) if a < b]
                if len(short):
                    rows.append((-1, packed(short, np.int32), b""))
                if rows:
                    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([batch.column(4)[k].as_py()] * len(rows), pa.int64()), *(pa.array([r[n] for r in rows], pa.binary()) for n in (1, 2))]
                    yield pa.RecordBatch.from_arrays(columns, names=["range", "block", "deltas", "kinds"])

    return sets.select("docs", "sizes", "shingles", "dropped", "block").mapInArrow(run, "range int, block long, deltas binary, kinds binary")


def met(signatures_: DataFrame) -> DataFrame:
    """``(block, range, bits)``: one bit for each signature of a block and range, set if a signature of another set meets it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        number = group["range"].iloc[0]
        if number < 0:
            return pd.DataFrame({"block": group["block"], "range": group["range"], "bits": group["deltas"]})
        sigs = [np.cumsum(loose(x, np.uint64), dtype=np.uint64) for x in group["deltas"]]
        keys = np.concatenate([(s << U(3)) | loose(x, np.uint8).astype(np.uint64) for s, x in zip(sigs, group["kinds"])])
        keys.sort()
        kind = (keys & U(7)).astype(np.uint8)
        keys >>= U(3)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        many = np.diff(np.r_[first, len(keys)])
        has = lambda wanted: np.logical_or.reduceat(wanted, first)
        plain = (kind & DELETION) == 0
        probed, indexed = (kind & PROBED) > 0, (kind & INDEXED) > 0
        live = keys[first[(many > 1) & ((has(probed & plain) & has(indexed)) | (has(probed) & has(indexed & plain)))]]
        bits = []
        for s in sigs:
            at = np.minimum(np.searchsorted(live, s), max(len(live) - 1, 0))
            bits.append(zstandard.ZstdCompressor(level=3).compress(np.packbits(live[at] == s if len(live) else np.zeros(len(s), bool)).tobytes()))
        return pd.DataFrame({"block": group["block"], "range": group["range"], "bits": bits})

    return signatures_.groupBy("range").applyInPandas(run, "block long, range int, bits binary")


def meeting_blocks(sets: DataFrame, sender: Sender, ranges: int) -> DataFrame:
    """Second pass: ``(range, docs, sizes, sketch, deltas, entries)`` of the signatures that ``sets``' column ``marks``, the
    gathered ``(range, bits)`` of :func:`met`, has set. ``entries``: ``local document * 8 + kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs, size, shingles = sets_of(batch, k)
                marks = {m["range"]: m["bits"] for m in batch.column(4)[k].as_py() or []}
                sig, who, kind, starts, _ = sender.of(size, shingles)
                live = np.zeros(len(sig), dtype=bool)
                for r, (a, b) in enumerate(zip(starts, starts[1:])):
                    if a < b:
                        live[a:b] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(marks[r]), np.uint8), count=b - a).astype(bool)
                sig, who, kind = sig[live], who[live], kind[live]
                sketch = sketches(shingles, np.repeat(np.arange(len(size)), size), size)
                wide = widths(size) // 8
                begin = np.cumsum(wide) - wide
                starts = np.r_[np.searchsorted(sig, np.array([-(-(r << sender.bits) // ranges) for r in range(ranges)], dtype=np.uint64)), len(sig)]
                rows = []
                for r, (a, b) in enumerate(zip(starts, starts[1:])):
                    if a < b:
                        there, local = np.unique(who[a:b], return_inverse=True)
                        cut = np.repeat(begin[there] - np.cumsum(wide[there]) + wide[there], wide[there]) + np.arange(wide[there].sum())
                        rows.append((r, packed(np.diff(docs[there], prepend=0), np.int64), packed(size[there], np.int32), sketch[cut].tobytes(), packed(np.diff(sig[a:b], prepend=U(0)), np.uint64), packed((local << 3) | kind[a:b], np.uint16)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[n] for r in rows], pa.binary()) for n in range(1, 6))], names=["range", "docs", "sizes", "sketch", "deltas", "entries"])

    return sets.select("docs", "sizes", "shingles", "dropped", "marks").mapInArrow(run, "range int, docs binary, sizes binary, sketch binary, deltas binary, entries binary")


def match_blocks(blocks: list[tuple], scheme: Scheme, chunk: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents within one range that agree on a probe and that size and sketch don't rule out."""
    sizes = [loose(b[1], np.int32) for b in blocks]
    docs, size = np.concatenate([np.cumsum(loose(b[0], np.int64)) for b in blocks]), np.concatenate(sizes)
    sketch = Sketches(np.concatenate([np.frombuffer(b[2], np.uint8) for b in blocks]), size)
    start = np.cumsum([0, *map(len, sizes)])
    sig = np.concatenate([np.cumsum(loose(b[3], np.uint64), dtype=np.uint64) for b in blocks])
    codes = [loose(b[4], np.uint16) for b in blocks]
    who = np.concatenate([(c >> 3).astype(np.int32) + s for c, s in zip(codes, start.astype(np.int32))])
    kind = np.concatenate([(c & 7).astype(np.uint8) for c in codes])
    order = stable_order(sig)
    sig, who, kind = sig[order], who[order], kind[order]
    edge = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    many = np.diff(np.r_[edge, len(sig)])
    first, count = np.repeat(edge, many), np.repeat(many, many)
    probes = np.flatnonzero((count > 1) & ((kind & PROBED) > 0))
    found = []
    done = 0
    reach = np.cumsum(count[probes])
    while done < len(probes):
        upto = max(done + 1, int(np.searchsorted(reach, (reach[done - 1] if done else 0) + chunk)))
        p = probes[done:upto]
        done = upto
        n = count[p]
        r = np.repeat(p, n)
        s = np.repeat(first[p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = who[r], who[s]
        ra, sb = size[a], size[b]
        ok = ((kind[s] & INDEXED) > 0) & ((kind[r] & kind[s] & DELETION) == 0) & ((ra > sb) | ((ra == sb) & (docs[a] > docs[b]))) & (sb >= scheme.t * ra - 1e-9)
        a, b = a[ok], b[ok]
        near = sketch.apart(a, b) <= scheme.allowed(size[a].astype(np.int64), size[b].astype(np.int64))
        found.append(np.unique((a[near].astype(np.int64) << 32) | b[near]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    x, y = docs[pairs >> 32], docs[pairs & 0xFFFFFFFF]
    return np.minimum(x, y), np.maximum(x, y)


def candidate_pairs(blocks: DataFrame, t: float) -> DataFrame:
    """``(a, b)`` of each range."""
    scheme = Scheme(t)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = match_blocks(list(group[["docs", "sizes", "sketch", "deltas", "entries"]].itertuples(index=False, name=None)), scheme)
        return pd.DataFrame({"a": a, "b": b})

    return blocks.groupBy("range").applyInPandas(run, "a long, b long")


def prefix_pairs(sets: DataFrame, t: float, counts: np.ndarray) -> DataFrame:
    """Candidates ``(a, b)`` of the documents at the places ``hard`` of their blocks against all sets, by prefix filter.

    Two sets within the similarity share one of the rarest ``size - ceil(t * size) + 1`` shingles of each, by one order of
    all shingles. Those of the hard sets go into a table; a bitmap of fixed size (512 KB) of them keeps others from being
    sent at all. Null ``hard``: none.
    """

    def prefixes(bitmap: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    docs, size, shingles = sets_of(batch, k)
                    doc = np.repeat(np.arange(len(docs)), size)
                    if bitmap is None:
                        if not batch.column(4)[k].is_valid:
                            continue
                        wanted = np.zeros(len(docs), dtype=bool)
                        wanted[batch.column(4)[k].values.to_numpy()] = True
                        asked = np.flatnonzero(wanted[doc])
                    else:
                        cell = rare_cell(shingles)
                        hit = (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
                        wanted = np.zeros(len(docs), dtype=bool)
                        wanted[doc[hit]] = True
                        asked = np.flatnonzero(wanted[doc])
                    d, x = doc[asked], shingles[asked]
                    order = np.lexsort((x, counts[cell_of(x)], d))
                    d, x = d[order], x[order]
                    head = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
                    place = np.arange(len(d)) - np.repeat(head, np.diff(np.r_[head, len(d)]))
                    first = place < size[d] - np.ceil(t * size[d] - 1e-9).astype(np.int64) + 1
                    if bitmap is not None:
                        cell = rare_cell(x)
                        first &= (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
                    yield pa.RecordBatch.from_arrays([pa.array(x[first].astype(np.int64), pa.int64()), pa.array(docs[d[first]], pa.int64()), pa.array(size[d[first]].astype(np.int32), pa.int32())], names=["token", "doc", "size"])

        return run

    columns = ["docs", "sizes", "shingles", "dropped"]
    schema = "token long, doc long, size int"
    hard = saved(sets.where("hard is not null").select(*columns, "hard").mapInArrow(prefixes(None), schema), "p2_hard")
    cell = F.udf(lambda x: int(rare_cell(np.array([x], dtype=np.uint64))[0]), "int")
    bitmap = np.zeros(RARE, dtype=np.uint8)
    bitmap[[r[0] for r in hard.select("token").distinct().select(cell("token")).distinct().collect()]] = 1  # at most RARE small numbers
    all_ = sets.select(*columns).mapInArrow(prefixes(np.packbits(bitmap, bitorder="little")), schema)
    pairs = all_.select("token", "doc", "size").join(hard.select("token", F.col("doc").alias("other"), F.col("size").alias("other_size")), "token").where("doc <> other")
    pairs = pairs.where(F.least("size", "other_size") >= F.greatest("size", "other_size") * t - 1e-9)
    return pairs.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


def rare_cell(shingles: np.ndarray) -> np.ndarray:
    return (mixed(shingles + U(17)) % U(RARE)).astype(np.int64)


def verified(pairs: DataFrame, docs: DataFrame, t: float, words: int) -> DataFrame:
    """Pairs whose texts' shingles, as words, reach the similarity."""
    involved = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "p2_involved")
    small = involved.count() <= 500_000  # 16 bytes each; beyond that an ordinary join
    texts = saved(docs.select("doc", "text").join(F.broadcast(involved) if small else involved, "doc", "left_semi"), "p2_texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grams(text: str) -> set[tuple[str, ...]]:
            w = _WORD.findall(text.lower())
            return set(zip(*(w[k:] for k in range(words))))

        for batch in batches:
            keep, score = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                g, h = grams(x), grams(y)
                both = len(g & h)
                score.append(both / max(1, len(g) + len(h) - both))
                keep.append(score[-1] >= t)
            mask = pa.array(keep, pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["a", "b", "similarity"])
            yield out.filter(mask)

    both = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, t: float = 0.8, words: int = 5, least_words: int = 5, per_range: int = 10_000_000) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates among ``docs (doc, text)`` as ``(links, members)``.

    ``members (doc, rep)``: every text that counts (at least ``least_words`` words) with the lowest ``doc`` that has the
    same shingles. ``links (a, b, similarity)``: all pairs ``a < b`` of such representatives whose shingle sets of
    ``words`` words reach the Jaccard similarity ``t``. Null, empty and too short texts are in neither; no pair is
    lost or capped. Words are runs of letters and digits of the lower-cased text. ``per_range``: signatures that a task of the
    first pass holds; only those that meet others go on.
    """
    docs = docs.select("doc", "text").where("doc is not null")
    buckets = 4 * shuffle_width(docs.sparkSession)
    blocks = bucketed(shingle_blocks(docs, words, least_words), "p2_blocks", "block", buckets)
    keys = blocks.select("block", F.posexplode(F.arrays_zip("docs", "sizes", "digests")).alias("pos", "s")).select("block", "pos", F.col("s.docs").alias("doc"), F.col("s.sizes").alias("size"), F.col("s.digests").alias("digest"))
    lowest = keys.groupBy("digest", "size").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    copied = saved(lowest.where("copies > 1").select("digest", "size", "rep"), "p2_copied")
    twins = saved(keys.join(copied, ["digest", "size"]).select("block", "pos", "doc", "rep"), "p2_twins")
    members = keys.select("doc").join(twins.select("doc", "rep"), "doc", "left").select("doc", F.coalesce("rep", "doc").alias("rep"))
    reps = in_block(blocks, twins.where("doc <> rep").select("block", F.col("pos").alias("dropped")), "dropped", buckets)
    stat = keys.agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).first()  # two numbers
    sender = Sender(counts := shingle_counts(reps), stat["n"] or 1, stat["shingles"] or 1, t, per_range)
    marks = saved(met(sent(reps, sender)), "p2_met")
    live = in_block(reps, marks.where("range >= 0").select("block", F.struct("range", "bits").alias("marks")), "marks", buckets)
    pairs = candidate_pairs(meeting_blocks(live, sender, max(shuffle_width(docs.sparkSession), sender.ranges)), t)
    hard = marks.where("range < 0")
    if not hard.isEmpty():
        places = hard.select("block", F.explode(F.udf(lambda x: loose(x, np.int32).tolist(), "array<int>")("bits")).alias("hard"))
        pairs = pairs.unionByName(prefix_pairs(in_block(reps, places, "hard", buckets), t, counts))
    pairs = saved(pairs.distinct(), "p2_pairs")
    return verified(pairs, docs, t, words), members


def expanded_pairs(links: DataFrame, members: DataFrame, each: int | None = None, block: int = 500) -> DataFrame:
    """All pairs ``(a, b)`` of documents: within classes and of linked classes.

    A class is cut by hash into parts of about ``block`` documents and pairs of parts are joined, so a large class
    spreads over many tasks; every pair is made once. A class of k documents gives k(k - 1)/2 pairs, by definition.
    ``each``, for callers that can do without the rest, pairs only the ``each`` lowest documents of a class and gives
    further ones with their representative only. No query sets it.
    """
    copies = members.where("doc <> rep")
    linked = links.select(F.explode(F.array("a", "b")).alias("rep")).union(copies.select("rep")).distinct().select(F.col("rep").alias("doc"), "rep")
    listed, star = copies, None
    if each is not None:
        placed = copies.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("doc")))
        listed = placed.where(F.col("n") < each).select("doc", "rep")
        star = placed.where(F.col("n") >= each).select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    named = saved(listed.union(linked), "p2_named")
    sizes = saved(named.groupBy("rep").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "p2_parts")
    parted = saved(named.join(sizes, "rep").select("rep", "doc", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part")), "p2_parted")
    counted = lambda side: sizes.select(F.col("rep").alias(side), F.col("parts").alias(f"n_{side}"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    across = links.select("a", "b").join(counted("a"), "a").join(counted("b"), "b").select("a", "b", "n_b", numbers("n_a").alias("i")).select("a", "i", "b", numbers("n_b").alias("j"))
    inside = sizes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), "parts", numbers("parts").alias("i")).select("a", "i", "b", F.explode(F.sequence("i", F.col("parts") - 1)).alias("j"))
    left = parted.select(F.col("rep").alias("a"), F.col("part").alias("i"), F.col("doc").alias("x"))
    right = parted.select(F.col("rep").alias("b"), F.col("part").alias("j"), F.col("doc").alias("y"))
    both = across.union(inside).join(left, ["a", "i"]).join(right, ["b", "j"])
    pairs = both.where((F.col("a") != F.col("b")) | (F.col("i") != F.col("j")) | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs if star is None else pairs.union(star)

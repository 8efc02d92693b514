"""Removal of long repeated byte strings, by run-length suffix indexes over what can repeat.

A byte goes if a string of ``MATCH`` bytes that covers it also starts anywhere
else in the corpus (the same document included); matches never cross documents.

1. Segments. Every 200-byte string has an anchor: the leftmost smallest hash
   among its 32-byte grams. Neighbouring strings with one anchor form a
   segment (at most 169 strings), so each string lies in just one segment, and
   equal strings have equal anchors. A row per segment (anchor, hash of the
   whole segment, document, start) is written to the shared folder: about one
   for 85 bytes.
2. An anchor that occurs once repeats nothing. If all segments of an anchor are
   equal, all their strings repeat. Both are settled by one aggregate and one
   join, which splits hot anchors.
3. What is left are anchors with different segments: the edges of repeated
   passages. Of each distinct segment one copy's bytes are dealt by anchor and
   gathered into tiles of bounded size. A tile's suffix order gives its
   Burrows-Wheeler transform; only its run ends keep samples, with the match
   length to the neighbouring suffix. From those samples the matching
   statistics of the whole tile stream out (a length falls by one from a
   position to the next unless a run ends there), and strings matched over 200
   bytes elsewhere are marked, for every copy of their segment.
4. Anchors whose distinct segments don't fit a tile are not indexed together:
   their strings are hashed (128 bits with the anchor), counted with a partial
   aggregate and joined back; those in a row are one range. No case is dropped.

Equality of segments rests on two 64-bit hashes together.

Defined cases: null and short texts keep all their bytes; repeated rows count
as documents of their own, so all their strings repeat; extra columns are
passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.functions.rowkey import canonical
from tallyscope.llm.common import TABLE_BITS, Scratch, bit_table, give_back, in_table, partitions, reliable, spot, table

MATCH, GRAM = 200, 32
#: Bytes of text hashed at once, and windows of a long text cut at once.
BLOCK, CHUNK = 1 << 18, 1 << 19
#: Bits of a place in a block, below a gram's hash.
PLACE = 20
#: Bytes of a tile, and of one anchor's segments that a tile can take.
TILE, LARGEST = 1 << 20, 4 << 20

_RNG = np.random.default_rng(977)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _RNG.integers(1, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the 32 bytes at each place, by doubling."""
    h = _BYTES[data]
    width = 1
    for step in _STEPS:
        h = h[:-width] * step + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(hashes: np.ndarray) -> np.ndarray:
    """Place of the leftmost smallest hash in each string of ``MATCH`` bytes."""
    places = np.uint64((1 << PLACE) - 1)
    low = (hashes & ~places) | np.arange(len(hashes), dtype=np.uint64)
    span = MATCH - GRAM + 1
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return (low & places).astype(np.int64)


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, strings, anchor hash, place of the anchor in it) of all segments of some texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < MATCH:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.int64),)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    hashes = gram_hashes(data)
    at = anchors(hashes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    whole = np.arange(len(at)) + MATCH <= ends[owner]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    stop = whole.copy()
    stop[:-1] &= ~whole[1:] | new[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(stop)
    text = owner[first]
    return text, first - (ends - sizes)[text], last - first + 1, hashes[at[first]].view(np.int64), at[first] - first


def cut(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Blocks of texts for ``segments``: index, bytes and offset of each; long texts in overlapping parts."""
    index, parts, offsets, size = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < MATCH:
            continue
        for a in range(0, len(t) - MATCH + 1, CHUNK):
            part = t[a : a + CHUNK + MATCH - 1] if len(t) > CHUNK else t
            if size + len(part) > BLOCK and parts:
                yield index, parts, offsets
                index, parts, offsets, size = [], [], [], 0
            index.append(i)
            parts.append(part)
            offsets.append(a)
            size += len(part)
    if parts:
        yield index, parts, offsets


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _segment_rows(docs: DataFrame) -> DataFrame:
    """A row for each segment of the documents (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for index, parts, offsets in cut(_texts(batch)):
                text, start, strings, anchor, place = segments(parts)
                end = start + strings + MATCH - 1
                digest = xxhash.xxh3_64_intdigest
                seg = [
                    digest(parts[t][a:b], p) - (1 << 63)
                    for t, a, b, p in zip(text.tolist(), start.tolist(), end.tolist(), place.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor),
                        pa.array(seg, pa.int64()),
                        pa.array(keys[np.array(index)[text]]),
                        pa.array(start + np.array(offsets, np.int64)[text]),
                        pa.array(strings.astype(np.int32)),
                    ],
                    names=["anchor", "seg", "key", "start", "strings"],
                )
        give_back()

    return docs.select("key", "text").mapInArrow(run, "anchor long, seg long, key long, start long, strings int")


class RunLengthIndex:
    """The run-compressed transform of a row of byte strings, each ended by a mark of its own."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else np.empty(0, np.int64)
        self.size = int((sizes + 1).sum())
        k = len(strings)
        symbols = np.empty(self.size, np.int32)
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        symbols[:] = data
        symbols += k
        marks = self.starts + sizes
        symbols[marks] = np.arange(k)
        order = self._suffixes(symbols)
        # of the transform only its runs are kept: where one ends, the suffixes on both sides
        before = symbols[order - 1]
        ends = np.flatnonzero(before[1:] != before[:-1])
        upper, lower = order[ends], order[ends + 1]
        self.runs = len(ends) + 1
        length = self._common(symbols, upper, lower)
        self.to_previous = self._stream(np.append(lower, order[0]), np.append(length, 0))
        self.to_next = self._stream(np.append(upper, order[-1]), np.append(length, 0))

    @staticmethod
    def _suffixes(symbols: np.ndarray) -> np.ndarray:
        """Suffix order by doubling; marks are unique, so it settles within the longest string."""
        n = len(symbols)
        rank = symbols
        width = 1
        while True:
            key = rank.astype(np.int64)
            key *= int(rank.max()) + 2
            if width < n:
                key[:-width] += rank[width:]
                key[:-width] += 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            order = order.astype(np.int32)
            new = np.empty(n, np.bool_)
            new[0] = False
            np.not_equal(key[1:], key[:-1], out=new[1:])
            del key
            step = np.cumsum(new, dtype=np.int32)
            del new
            if step[-1] == n - 1:
                return order
            rank = np.empty(n, np.int32)
            rank[order] = step
            del step
            width *= 2

    @staticmethod
    def _common(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes; the marks end it."""
        length = np.zeros(len(a), np.int32)
        active = np.arange(len(a), dtype=np.int32)
        while len(active):
            same = symbols[a[active] + length[active]] == symbols[b[active] + length[active]]
            active = active[same]
            length[active] += 1
        return length

    def _stream(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Match length at every place from those at run ends: one less at each step on."""
        # a sample's reach is its place and length together; places between fall short of it by one each
        at = np.zeros(self.size, np.int32)
        at[places] = places
        np.maximum.accumulate(at, out=at)
        reach = np.zeros(self.size, np.int32)
        reach[places] = lengths + places
        out = reach[at]
        del at, reach
        out -= np.arange(self.size, dtype=np.int32)
        return np.maximum(out, 0, out=out)

    def statistics(self) -> np.ndarray:
        """At each place, the longest match that starts anywhere else."""
        return np.maximum(self.to_previous, self.to_next)


def repeated_strings(strings: list[bytes]) -> list[np.ndarray]:
    """For each byte string, which of its ``MATCH``-byte strings also start elsewhere among them."""
    index = RunLengthIndex(strings)
    long = index.statistics() >= MATCH
    return [long[a : a + len(s) - MATCH + 1] for a, s in zip(index.starts.tolist(), strings, strict=True)]


def _ranges(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    yield from zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments arrive by anchor; whole anchors are gathered into tiles."""
    tile: list[tuple[int, int, int, bytes]] = []
    group: list[tuple[int, int, int, bytes]] = []
    sizes = {"tile": 0, "group": 0}

    def done(tile: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        rows = []
        for (anchor, seg, copies, data), mask in zip(tile, repeated_strings([t[3] for t in tile]), strict=True):
            if copies > 1:
                rows.append((anchor, seg, 0, len(data) - MATCH + 1))
            else:
                rows += [(anchor, seg, a, b) for a, b in _ranges(mask)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "seg", "a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "seg", "copies", "bytes")), strict=True):
            if group and group[-1][0] != row[0]:
                if sizes["tile"] + sizes["group"] > TILE and tile:
                    yield done(tile)
                    tile, sizes["tile"] = [], 0
                tile += group
                sizes["tile"] += sizes["group"]
                group, sizes["group"] = [], 0
            group.append(row)
            sizes["group"] += len(row[3])
    tile += group
    if tile:
        yield done(tile)


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every ``MATCH``-byte string of segments, hashed."""
    for batch in batches:
        anchor, seg, copies = (batch.column(c).to_numpy() for c in ("anchor", "seg", "copies"))
        data = batch.column("bytes").to_pylist()
        for a in range(0, len(data), 2000):
            part = data[a : a + 2000]
            n = np.array([len(d) - MATCH + 1 for d in part])
            hashed = [xxhash.xxh3_64_intdigest(d[i : i + MATCH]) - (1 << 63) for d in part for i in range(len(d) - MATCH + 1)]
            at = np.concatenate([np.arange(k) for k in n]) if len(n) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(x[a : a + 2000], n)) for x in (anchor, seg, copies)] + [pa.array(at.astype(np.int64)), pa.array(hashed, pa.int64())],
                names=["anchor", "seg", "copies", "a", "string"],
            )


def _segment_bytes(keyed: DataFrame, distinct: DataFrame) -> DataFrame:
    """(anchor, seg, copies, bytes) of one copy of each distinct segment, with few doubles.

    Segments are cut again in the documents that hold the copies; bit tables of
    fixed size tell documents and anchors, the join tells segments exactly.
    """
    context, low = keyed.sparkSession.sparkContext, (1 << TABLE_BITS) - 1  # anchors are hashes already
    shared = context.broadcast((bit_table(distinct, spot("at.key")), bit_table(distinct, F.col("anchor").bitwiseAND(low))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, of_anchors = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            wanted = np.flatnonzero(in_table(documents, batch.column("spot").to_numpy(zero_copy_only=False)))
            column = batch.column("text").cast(pa.binary())
            for at in range(0, len(wanted), 200):
                for _, parts, _ in cut([column[i].as_py() or b"" for i in wanted[at : at + 200].tolist()]):
                    text, start, strings, anchor, place = segments(parts)
                    rows = []
                    for i in np.flatnonzero(in_table(of_anchors, anchor & low)).tolist():
                        data = parts[text[i]][start[i] : start[i] + strings[i] + MATCH - 1]
                        name = int(anchor[i]), xxhash.xxh3_64_intdigest(data, int(place[i])) - (1 << 63)
                        if name not in seen:
                            seen.add(name)
                            rows.append((*name, data))
                    cols = list(zip(*rows, strict=True)) if rows else [()] * 3
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "seg", "bytes"]
                    )
        give_back()

    cut_again = keyed.select(spot("key").alias("spot"), "text").mapInArrow(run, "anchor long, seg long, bytes binary")
    return cut_again.join(distinct.select("anchor", "seg", "copies"), ["anchor", "seg"])


def repeats(keyed: DataFrame) -> DataFrame:
    """``key`` and ``ranges`` (byte ranges to remove, unordered, overlapping) of documents with any.

    ``keyed`` has ``key`` (a hash of the row), ``id`` and ``text``.
    """
    with Scratch(keyed.sparkSession) as scratch:
        rows = scratch.written(_segment_rows(keyed), "segments")
        counted = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("seg").alias("lo"), F.max("seg").alias("hi"))
        # written: both sides of the join below are then plain exchanges, so a hot anchor's rows can be split
        often = scratch.written(counted.filter("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "repeated-anchors")
        occurring = scratch.written(rows.join(often, "anchor"), "repeated-segments")
        plain = occurring.filter("not mixed").select("key", F.col("start").alias("a"), (F.col("start") + F.col("strings") + (MATCH - 1)).alias("b"))
        mixed = occurring.filter("mixed").drop("mixed")
        distinct = mixed.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("key", "start", "strings")).alias("at"))
        bulk = distinct.groupBy("anchor").agg(F.sum(F.col("at.strings") + (MATCH - 1)).alias("bytes"))
        large = bulk.filter(F.col("bytes") > LARGEST).select("anchor", F.lit(True).alias("large"))
        found = _segment_bytes(keyed, distinct)
        pieces = scratch.written(found.join(large, "anchor", "left").withColumn("large", F.coalesce("large", F.lit(False))), "edge-segments")
        small = pieces.filter("not large").select("anchor", "seg", "copies", "bytes").distinct()
        tiled = small.repartition(partitions(keyed.sparkSession), "anchor").sortWithinPartitions("anchor", "seg").mapInArrow(_tiles, "anchor long, seg long, a long, b long")
        strings = pieces.filter("large").select("anchor", "seg", "copies", "bytes").mapInArrow(_string_hashes, "anchor long, seg long, copies long, a long, string long").distinct()
        twice = strings.groupBy("anchor", "string").agg(F.sum("copies").alias("n")).filter("n > 1").select("anchor", "string")
        # strings in a row are one range, so that the join with the copies below gets a segment's few edges and not its strings
        places = strings.join(twice, ["anchor", "string"]).select("anchor", "seg", "a")
        run = F.col("a") - F.row_number().over(Window.partitionBy("anchor", "seg").orderBy("a"))
        hashed = places.withColumn("run", run).groupBy("anchor", "seg", "run").agg(F.min("a").alias("a"), (F.max("a") + 1).alias("b")).drop("run")
        marked = scratch.written(tiled.unionAll(hashed), "edge-marks")
        edges = (
            mixed.select("anchor", "seg", "key", "start")
            .join(marked, ["anchor", "seg"])
            .select("key", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + (MATCH - 1)).alias("b"))
        )
        return reliable(plain.unionAll(edges).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("ranges")))


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Sorted ranges without overlap; touching ones are one."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def without_repeats(docs: DataFrame, carry: list[str], text_col: str, made: Callable[[bytes, list[tuple[int, int]]], tuple], schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """The columns ``carry`` of every row, and what ``made`` makes of its bytes and the spans to remove."""
    same = [canonical(F.col(c), docs.schema[c].dataType) for c in carry]
    keyed = docs.select(F.xxhash64(*same, F.col(text_col)).alias("key"), F.struct(*carry).alias("id"), F.col(text_col).alias("text"))
    marked = keyed.join(repeats(keyed), "key", "left").select("key", "id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [made(t, merged(r) if r else []) for t, r in zip(_texts(batch), batch.column("ranges").to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            carried = batch.column("id").flatten()
            yield pa.RecordBatch.from_arrays([*carried, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[*carry, *names])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return marked.mapInArrow(run, f"{kinds}, {schema}")


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sizes of what goes and a digest of what stays of every text."""

    def made(data: bytes, spans: list[tuple[int, int]]) -> tuple:
        return len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept(data, spans)).hexdigest()

    return without_repeats(
        docs, [id_col], text_col, made, "n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        ["n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()],
    )


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without its repeated strings (a null text: empty).

    Spans begin and end at any byte; what is left of a cut character goes too.
    """
    carry = [c for c in docs.columns if c != text_col]

    def made(data: bytes, spans: list[tuple[int, int]]) -> tuple:
        return (kept(data, spans).decode("utf-8", "ignore"),)

    out = without_repeats(docs, carry, text_col, made, f"`{text_col}` string", [text_col], [pa.string()])
    return out.select(*docs.columns)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings of all ``documents`` removed."""
    return removal_digests(table(spark, sf_dir, "documents"))

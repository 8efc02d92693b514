"""Exact Jaccard join of documents on word 5-grams, and the groups its links make.

Sets. A text is lower-cased (A-Z) and split at ASCII white space; its set holds
the 64-bit hashes of its 5-word shingles (fewer words: the whole sequence; no
word: empty, linked with nothing). Documents with one and the same set are one
class; only classes are compared.

Candidates. Two sets with a similarity of 3/4 share an element among the first
n - ceil(3n/4) + 1 of each, under any one order of all elements. The order here
puts elements that repeat often last (a bounded list, counted over all
documents; any list is right), so passages that many documents share rarely
get into a prefix. Prefix elements are the only rows that are shuffled by
element, copies inside a task once.

Links are found in two rounds, so that a large group of near copies never has
all its pairs made:

1. Every element's list is sorted by set size, and each member meets the next
   one. (Long lists are dealt into several chains, twice, by two hashes.)
   Verified links give first components.
2. Lists that still hold several components, whole whatever their chains, are
   laid out in size-banded tiles: a member meets its own band and the band
   below, long tiles in blocks. In a tile, parity signatures of two bits an element bound the overlap from above:
   every bit in which two signatures differ is an element of just one set. What
   follows the tile's element in both sets bounds it, too. Pairs of different
   components that pass these bounds are verified. A pair is put out in the tile
   of the first element that both sets share: rows carry the first ``AHEAD``
   elements of their set that have tiles, and a tile leaves out a pair that
   shares one before its own. (Beyond ``AHEAD`` a pair may come out again.)

Verification intersects the sorted arrays of the two sets, read again from the
texts of the documents in question. A fixed-size bit table (2^22 bits) that is
broadcast tells which documents need it; the join that follows is exact.

Nothing is capped: a link between any two sets is found in round 1, joins sets
already in one component, or passes round 2.

Defined cases: null and blank texts have an empty set and are their own
component; a null id is no component's smallest unless alone; repeated rows are
one class and all returned; extra columns are passed over; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import Scratch, bit_table, give_back, in_table, partitions, reliable, spot, table
from tallyscope.llm.components import connected_components

WORDS = 5
#: Elements on the list of frequent ones: the most that is ever broadcast of them.
FREQUENT = 1 << 16
#: Members of one chain, and rows of one block of a tile.
CHAIN, BLOCK = 4096, 2048
#: Fewest 64-bit words of a signature.
LEAST_WORDS = 4
#: Elements of a set that its rows carry to tell in which tile a pair is put out.
AHEAD = 6
#: Over 4/3, so that linked sizes are at most one band apart.
BAND = 1.34
#: Elements counted together inside a task, and the count from which one is reported.
COUNTED, REPORTED = 4 << 20, 8

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hash of each word met; started anew when it is large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHashes()


def _forget() -> None:
    """Give memory back at a task's end; the worker may go on with another operator."""
    _WORDS.clear()
    give_back()


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes (uint64) of a whole text."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b"\n" + b" ".join(words))], np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    h = ids[: n - WORDS + 1]
    for k in range(1, WORDS):
        h = (h ^ (h >> np.uint64(29))) * _M1 + ids[k : n - WORDS + 1 + k]
    h = (h ^ (h >> np.uint64(31))) * _M2
    return np.unique(h ^ (h >> np.uint64(33)))


def set_id(s: np.ndarray) -> int:
    """A set's class: the signed hash of its sorted elements."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signature(s: np.ndarray) -> np.ndarray:
    """Parity of the number of elements at each place, as words; places are a power of two, twice the elements at least."""
    places = 64 * LEAST_WORDS
    while places < 2 * len(s):
        places *= 2
    odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A signature of fewer places: those that fall together are added, as parities."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def may_link(x: np.ndarray, y: np.ndarray, n: int) -> bool:
    """Whether signatures of two sets of ``n`` elements together leave room for a link.

    Places that differ are at most the elements of just one set, which are at
    most a seventh of all if the sets link.
    """
    size = min(len(x), len(y))
    return 7 * int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= n


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link: 100 * intersection >= 75 * union."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum()) if len(b) else 0
    return 4 * common >= 3 * (len(a) + len(b) - common)


def repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values that occur ``REPORTED`` times or more, ascending, and their counts; ``values`` is sorted in place."""
    values.sort()
    first = values[: max(0, len(values) - REPORTED + 1)]
    begins = first == values[REPORTED - 1 :]
    begins[1:] &= first[1:] != first[:-1]
    found = first[begins]
    return found, np.searchsorted(values, found, "right") - np.searchsorted(values, found)


def _describe(docs: DataFrame, kind: str) -> DataFrame:
    """A row a document (part 0: key, class, n, signature) and counts of elements that repeat in a task (part 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        # one buffer, sorted in place: the worker keeps little of what many small arrays and their copies took
        held, size = np.empty(COUNTED, np.uint64), 0

        def counted() -> pa.RecordBatch:
            values, n = repeated(held[:size])
            k = len(values)
            return pa.RecordBatch.from_arrays(
                [
                    pa.nulls(k, key_type), pa.array(np.ones(k, np.int32)), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64)),
                    pa.nulls(k, pa.binary()),
                ], names=names,
            )

        for batch in batches:
            key_type = batch.column("key").type
            ids, ns, wide = [], [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py())
                ids.append(set_id(s))
                ns.append(len(s))
                wide.append(signature(s).tobytes())
                if ids[-1] not in seen:
                    seen.add(ids[-1])
                    if size + len(s) > len(held):
                        yield counted()
                        held, size = held if len(s) <= len(held) else np.empty(len(s), np.uint64), 0
                    held[size : size + len(s)] = s
                    size += len(s)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()),
                    pa.array(wide, pa.binary()),
                ], names=names,
            )
        if size:
            yield counted()
        _forget()

    names = ["key", "part", "sig", "n", "wide"]
    return docs.mapInArrow(run, f"key {kind}, part int, sig long, n long, wide binary")


def _prefixes(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(h, chain, place, sig, n) for the prefix elements of each class in each task.

    ``frequent`` has the elements that go last, ``counts`` theirs; a longer
    list than ``CHAIN`` is dealt to several chains, once by each of two hashes
    (even numbers from 2 and odd ones; a list that is one chain has number 0).
    """
    order = frequent.astype(np.int64).view(np.uint64)
    by_value = np.argsort(order)
    # the rarest of the frequent ones come first
    rank = (-counts).argsort(kind="stable")[::-1].argsort()[by_value]
    chains = -(-counts // CHAIN)[by_value]
    shared = docs.sparkSession.sparkContext.broadcast((order[by_value], rank, chains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, rank, chains = shared.value
        seen: set[int] = set()
        hs: list[np.ndarray] = []
        cs: list[np.ndarray] = []
        ps: list[np.ndarray] = []
        ids: list[int] = []
        ns: list[int] = []
        counts: list[int] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(cs)), pa.array(np.concatenate(ps)),
                    pa.array(np.repeat(np.array(ids, np.int64), counts)), pa.array(np.repeat(np.array(ns, np.int64), counts)),
                ],
                names=["h", "chain", "place", "sig", "n"],
            )

        for batch in batches:
            for t in batch.column("text"):
                s = shingle_set(t.as_py())
                sig = set_id(s)
                if not len(s) or sig in seen:
                    continue
                seen.add(sig)
                p = prefix_length(len(s))
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    often = values[at] == s
                    light = s[~often][:p]
                else:
                    light = s[:p]
                parts, codes, places = [light], [np.zeros(len(light), np.int32)], [np.arange(len(light), dtype=np.int32)]
                if len(light) < p:
                    at = at[often]
                    at = at[np.argsort(rank[at])][: p - len(light)]
                    k = chains[at]
                    places.append(np.arange(len(light), len(light) + len(at), dtype=np.int32))
                    parts.append(values[at])
                    codes.append(np.where(k > 1, 2 * ((sig & 0xFFFFFF) % k) + 2, 0).astype(np.int32))
                    long = at[k > 1]
                    places.append(places[-1][k > 1])
                    parts.append(values[long])
                    codes.append((2 * ((sig >> 24 & 0xFFFFFF) % chains[long]) + 1).astype(np.int32))
                hs += parts
                cs += codes
                ps += places
                ids.append(sig)
                ns.append(len(s))
                counts.append(sum(map(len, parts)))
                if len(ids) == 2000:
                    yield out()
                    hs, cs, ps, ids, ns, counts = [], [], [], [], [], []
        if ids:
            yield out()
        _forget()

    return docs.select("text").mapInArrow(run, "h long, chain int, place int, sig long, n long")


def _sizes_agree(a: str, b: str) -> Column:
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    spark = pairs.sparkSession
    left = classes.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("rep").alias("ra"), F.col("wide").alias("wa"))
    right = classes.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("rep").alias("rb"), F.col("wide").alias("wb"))
    kind = classes.schema["rep"].dataType.simpleString()

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("wa"), batch.column("wb"), batch.column("n").to_pylist(), strict=True)
            ok = pa.array([may_link(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), n) for x, y, n in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b", "ra", "rb")], names=["a", "b", "ra", "rb"])

    near = reliable(
        pairs.join(left, "a")
        .join(right, "b")
        .filter(_sizes_agree("na", "nb"))
        .select("a", "b", "ra", "rb", "wa", "wb", (F.col("na") + F.col("nb")).alias("n"))
        .mapInArrow(bounded, f"a long, b long, ra {kind}, rb {kind}")
    )
    shared = spark.sparkContext.broadcast(bit_table(near.select(F.explode(F.array("ra", "rb")).alias("key")), spot("key")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            wanted = np.flatnonzero(in_table(shared.value, batch.column("spot").to_numpy(zero_copy_only=False)))
            text = batch.column("text")
            for a in range(0, len(wanted), 500):
                ids, data = [], []
                for i in wanted[a : a + 500].tolist():
                    s = shingle_set(text[i].as_py())
                    sig = set_id(s)
                    if len(s) and sig not in seen:
                        seen.add(sig)
                        ids.append(sig)
                        data.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["sig", "elements"])
        _forget()

    found = docs.select(spot("key").alias("spot"), "text").mapInArrow(sets, "sig long, elements binary")
    both = (
        near.select("a", "b")
        .join(found.select(F.col("sig").alias("a"), F.col("elements").alias("ea")), "a")
        .join(found.select(F.col("sig").alias("b"), F.col("elements").alias("eb")), "b")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("ea"), batch.column("eb"), strict=True)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.mapInArrow(verify, "a long, b long").distinct()


def tile_pairs(sig: np.ndarray, comp: np.ndarray, n: np.ndarray, place: np.ndarray, bits: np.ndarray, lower: np.ndarray, block: np.ndarray, across: bool, before: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Pairs of one tile that the size, place and bit bounds leave, of different components.

    ``place``: where the tile's element stands in each set's order. If it is the
    first that two sets share, no more than what follows it can be shared; if
    it is not, the pair meets in the tile of the one that is.

    ``bits``: signatures, folded here to the smaller one's size. ``lower``: the
    member is of the band below (two such meet in their own tile). ``across``:
    only members of different blocks meet. ``before``: of each set's first elements that
    have tiles those before this tile's; a pair that shares one meets there.
    """
    sets: dict[int, set[int]] = {}

    def earlier(i: int) -> set[int]:
        if i not in sets:
            sets[i] = set(before[i].tolist())
        return sets[i]

    out = []
    if (comp == comp[0]).all():
        return out
    sizes = np.array([len(x) // 8 for x in bits])
    # by size: the signatures of that size, and those twice as long folded to it; sizes of linked sets are no further apart
    at_size = {}
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero((sizes == size) | (sizes == 2 * size))
        row_of = np.full(len(bits), -1)
        row_of[rows] = np.arange(len(rows))
        at_size[size] = row_of, np.stack([folded(np.frombuffer(bits[k], np.uint64), size) for k in rows])
    for i in range(len(sig) - 1):
        r = slice(i + 1, None)
        keep = (comp[r] != comp[i]) & (4 * np.minimum(n[r], n[i]) >= 3 * np.maximum(n[r], n[i]))
        keep &= 7 * np.minimum(n[r] - place[r], n[i] - place[i]) >= 3 * (n[r] + n[i])
        if lower[i]:
            keep &= ~lower[r]
        if across:
            keep &= block[r] != block[i]
        at = np.flatnonzero(keep) + i + 1
        smaller = np.minimum(sizes[at], sizes[i])
        for size in np.unique(smaller).tolist():
            row_of, words = at_size[size]
            j = at[smaller == size]
            differ = np.bitwise_count(words[row_of[j]] ^ words[row_of[i]]).sum(axis=1, dtype=np.int64)
            j = j[7 * differ <= n[j] + n[i]]
            if before is not None and len(j) and earlier(i):
                j = j[[earlier(i).isdisjoint(earlier(k)) for k in j.tolist()]]
            if len(j):
                out.append(np.stack([np.minimum(sig[j], sig[i]), np.maximum(sig[j], sig[i])], axis=1))
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles arrive whole and in order of their key; a block bounds each."""
    rest = None
    names = ["h", "band", "bi", "bj", "sig", "comp", "n", "place", "lower", "block"]

    def pairs(cols: dict[str, np.ndarray], upto: int, starts: np.ndarray) -> pa.RecordBatch:
        found = []
        for a, b in zip(starts, [*starts[1:], upto], strict=True):
            if b - a > 1:
                c = {k: v[a:b] for k, v in cols.items()}
                found += tile_pairs(c["sig"], c["comp"], c["n"], c["place"], c["bits"], c["lower"], c["block"], c["bi"][0] != c["bj"][0], c["before"])
        made = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(made[:, 0].copy()), pa.array(made[:, 1].copy())], names=["a", "b"])

    def ends(cols: dict[str, np.ndarray]) -> np.ndarray:
        new = np.zeros(len(cols["h"]), bool)
        new[0] = True
        for k in ("h", "band", "bi", "bj"):
            new[1:] |= cols[k][1:] != cols[k][:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        cols["bits"] = np.array(batch.column("bits").to_pylist(), object)
        ahead = batch.column("ahead")
        cut, elements = ahead.offsets.to_numpy(), ahead.values.to_numpy()
        cols["before"] = np.empty(batch.num_rows, object)
        cols["before"][:] = [elements[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        if rest is not None:
            cols = {k: np.concatenate([rest[k], v]) for k, v in cols.items()}
        starts = ends(cols)
        last = starts[-1]
        if last:
            yield pairs({k: v[:last] for k, v in cols.items()}, last, starts[:-1])
        rest = {k: v[last:] for k, v in cols.items()}
    if rest is not None:
        yield pairs(rest, len(rest["h"]), np.array([0]))


def _tile_candidates(lists: DataFrame, component: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of different components that share a prefix element and pass the bounds."""
    spark = lists.sparkSession
    member = (
        lists.filter(F.col("chain") % 2 == 0)
        .select("h", "chain", "sig", "n", "place")
        .join(component.withColumnRenamed("node", "sig"), "sig", "left")
        .withColumn("comp", F.coalesce("component", "sig"))
        .drop("component")
        .distinct()
    )
    member = reliable(member)
    # the two members of a list that is one chain have met; those of a dealt list may be in chains of their own
    mixed = (
        member.groupBy("h")
        .agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("chain").alias("chain"))
        .filter("(members > 2 or chain > 0) and lo <> hi")
        .select("h", "members")
    )
    # the first elements of each set's order that have tiles: a pair is put out in the tile of the first that both have
    of_set = Window.partitionBy("sig")
    ahead = F.collect_list(F.when(F.col("nth") <= AHEAD, F.struct("place", "h"))).over(of_set)
    met = member.join(mixed, "h").withColumn("nth", F.row_number().over(of_set.orderBy("place", "h"))).withColumn("ahead", ahead)
    met = met.withColumn("ahead", F.transform(F.filter("ahead", lambda x: x["place"] < F.col("place")), lambda x: x["h"]))
    # a short list is one tile, whose size bound parts its bands; a long one is dealt by band and block
    long = F.col("members") > BLOCK
    band = F.when(long, F.floor(F.log(F.col("n")) / F.lit(float(np.log(BAND))))).otherwise(F.lit(0).cast("long"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = (
        met.join(classes.select("sig", F.col("wide").alias("bits")), "sig")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
        .withColumn("tile", F.explode(F.filter(
            F.array(F.struct(band.alias("band"), F.lit(False).alias("lower")), F.struct((band + 1).alias("band"), F.lit(True).alias("lower"))),
            lambda t: long | ~t["lower"],
        )))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("h", F.col("tile.band").alias("band"), F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "sig", "comp", "n", "place", F.col("tile.lower").alias("lower"), "block", "bits", "ahead")
    )
    key = ["h", "band", "bi", "bj"]
    return placed.repartition(partitions(spark), *key).sortWithinPartitions(*key).mapInArrow(_tiles, "a long, b long").distinct()


def _components(lists: DataFrame, classes: DataFrame, base: DataFrame) -> DataFrame:
    """Components of classes, by the two rounds; nothing of it refers to ``lists`` any more."""
    chained = reliable(
        lists.filter(F.col("prev").isNotNull() & (F.col("prev") != F.col("sig")) & _sizes_agree("n", "prev_n"))
        .select(F.least("sig", "prev").alias("a"), F.greatest("sig", "prev").alias("b"))
        .distinct()
    )
    links = reliable(_verified(chained, classes, base))
    component = reliable(connected_components(links))
    more = reliable(_tile_candidates(lists, component, classes).join(chained, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        further = reliable(_verified(more, classes, base))
        if not further.isEmpty():
            component = reliable(connected_components(links.unionAll(further)))
    return component


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``class_id`` and ``component_id`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    described = reliable(_describe(base, kind))
    rows = described.filter("part = 0").select("key", "sig", "n")
    often = (
        described.filter("part = 1")
        .groupBy("sig")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "sig")
        .limit(FREQUENT)
        .toArrow()
    )
    classes = reliable(described.filter("part = 0 and n > 0").groupBy("sig").agg(F.min("key").alias("rep"), F.max("n").alias("n"), F.first("wide").alias("wide")))
    chain = Window.partitionBy("h", "chain").orderBy("n", "sig")
    with Scratch(docs.sparkSession) as scratch:
        lists = scratch.written(
            _prefixes(base, often.column("sig").to_numpy(), often.column("n").to_numpy())
            .select("*", F.lag("sig").over(chain).alias("prev"), F.lag("n").over(chain).alias("prev_n"), F.lead("sig").over(chain).alias("next"))
            # alone in one of a dealt list's chains is not alone in the list, which round 2 takes whole
            .filter("prev is not null or next is not null or (chain > 0 and chain % 2 = 0)")
            .drop("next"),
            "jaccard-lists",
        )
        component = _components(lists, classes, base)
    named = component.join(classes.select(F.col("sig").alias("node"), "rep"), "node")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = classes.select("sig", "rep").join(
        component.withColumnRenamed("node", "sig").join(smallest, "component").select("sig", "component_id"), "sig", "left"
    ).select("sig", F.coalesce("component_id", "rep").alias("component_id"))
    return rows.join(label, "sig", "left").select(
        F.col("key").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"), F.col("sig").alias("class_id")
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` linked by a similarity of 0.75 on five-word shingles."""
    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")

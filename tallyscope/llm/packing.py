"""Packing of tokenised documents along a space-filling curve.

1. Every document is tokenised once (``tokenise``). Its ids are hashed into a
   count vector, the vector is projected to four dimensions by a fixed random
   matrix, and the cell it falls in gets its index on a Hilbert curve. The
   tokenised rows are checkpointed in the shared folder, ids as 16-bit numbers
   where the vocabulary allows.
2. The order is the curve's, ties spread by a hash of the row, so that a huge
   group of copies is no single key. Quantiles of the order value cut it into
   even ranges; one aggregate gives the ids in each range, and their running
   sum (one number a range) the place where each range begins.
3. Rows are dealt by range, sorted inside it and written one behind another:
   the stream is cut at every ``seq_len`` ids, so neighbours on the curve share
   sequences and only the last sequence of all is short. It needs no more
   padding than to the next power of two.

Tokenising goes by a table of distinct chunks in each worker: a single space
between two characters that are not white space always begins a new pre-token
of this kind of tokenizer, so the chunks between such spaces are encoded apart,
each distinct one once, and joined by position. A new chunk's words and signs are
looked up as they stand in the text; single line ends part it again.

Defined cases: a null text is the empty text, which holds just the end id; a
null id stays null; repeated rows are packed as often as they occur; extra
columns are passed over; an empty table gives no piece.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import column_texts, give_back, order_buckets, partitions, reliable, table, text_blocks

SEQ_LEN = 2048
END_ID = 1
#: Hashed dimensions of a document's vector, dimensions and bits of the curve.
HASH_DIMS, CURVE_DIMS, CURVE_BITS = 1024, 4, 7
#: Bits of the row hash below the curve's index; both together fit a double.
TIE_BITS = 24
#: Chunks or groups that one worker's table holds before it is started anew.
MAX_CHUNKS = 400_000

_REGULAR_GAP = re.compile(r"(?<=\S) (?=\S)")
_ODD_GAP = re.compile(r"\s | \s|^ | $")
#: A Latin word, which takes a space before it, and ASCII signs behind it: two groups of the pre-tokenizer.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
#: White space other than a space and a line end; a block of texts without any is split faster.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


class ChunkIds:
    """Distinct chunks of one byte-level tokenizer and their ids as packed numbers."""

    def __init__(self, tokenizer_path: str, max_chunks: int = MAX_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.width == "<u2" else "I"
        self.model = self.tokenizer.model
        self.max_chunks = max_chunks
        if self.tokenizer.normalizer is not None:
            raise ValueError("this tokenizer rewrites texts before it splits them; chunks can't be encoded apart")
        #: ids of a chunk behind a space, of a chunk at a text's start
        self.ids: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        #: ids of a word behind a space, of one without, of signs, of any other group of the pre-tokenizer as it writes it
        self.words: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.groups: dict[str, bytes] = {}
        self.tables = (self.ids, self.first, self.words, self.heads, self.signs, self.groups)
        groups = self.tokenizer.pre_tokenizer.pre_tokenize_str
        #: how the library writes the characters of such groups
        self.written = {c: groups(chr(c))[0][0] for c in range(0x21, 0x250) if _WORD.fullmatch("a" + chr(c)) or _WORD.fullmatch(chr(c))}
        self.space = self.written[0x20] = groups(" a")[0][0][:-1]
        #: characters that the library writes as they are
        self.same = all(c == ord(x) for c, x in self.written.items() if 0x20 < c < 0x80)
        if [g for g, _ in groups(" aé,.")] != [" aé".translate(self.written), ",.".translate(self.written)]:
            raise ValueError("this tokenizer does not part words from signs")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self._encode("a b,c  \n d") != self._encode("a") + self._encode(" b,c  \n d"):
            raise ValueError("this tokenizer does not begin a new token group at a space")
        #: a line end between other characters is a group of its own
        self.line_end = self._encode("\n")
        if groups(" a.\nb") != [(g, at) for (g, _), at in zip([*groups(" a."), *groups("\n"), *groups("b")], [(0, 2), (2, 3), (3, 4), (4, 5)], strict=True)]:
            raise ValueError("this tokenizer does not part lines")

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.width).tobytes()

    def _chunk(self, chunk: str, space: str) -> bytes:
        """Ids of a chunk behind ``space`` (one or none): of its groups, for which the library's model is asked when they are new."""
        words = self.words if space else self.heads
        found = words.get(chunk)
        if found is not None:
            return found
        word = _WORD.fullmatch(chunk)
        if word:
            head, signs = word.groups()
            if signs:
                found = words.get(head)
            else:
                head = chunk
            if found is None:
                found = words[head] = self._ids((self.space if space else "") + head if self.same and head.isascii() else (space + head).translate(self.written))
            if not signs:
                return found
            after = self.signs.get(signs)
            if after is None:
                after = self.signs[signs] = self._ids(signs.translate(self.written))
            return found + after
        lines = chunk.split("\n")
        if len(lines) > 1 and all(map(_WORD.fullmatch, lines)):
            return self.line_end.join([self._chunk(lines[0], space), *[self._chunk(x, "") for x in lines[1:]]])
        if any(s in chunk for s in self.special):
            return self._encode(space + chunk)
        return b"".join([self._group(g) for g, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(space + chunk)])

    def _group(self, group: str) -> bytes:
        found = self.groups.get(group)
        if found is None:
            found = self.groups[group] = self._ids(group)
        return found

    def _ids(self, group: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(group)]).tobytes()

    def forget(self) -> None:
        """Give memory back at a task's end; the worker may go on with another operator."""
        for known in self.tables:
            known.clear()

    def encode_block(self, texts: list[str]) -> Iterator[bytes]:
        """The packed ids of each text."""
        for known in self.tables:
            if len(known) > self.max_chunks:
                known.clear()
        ids, first = self.ids, self.first
        together = "".join(texts)
        plain = not any(c in together for c in _OTHER_SPACE)
        for t in texts:
            if not t:
                yield b""
                continue
            if plain and not ("  " in t or " \n" in t or "\n " in t or t[0] == " " or t[-1] == " "):
                parts = t.split(" ")
            else:
                parts = _REGULAR_GAP.split(t) if _ODD_GAP.search(t) else t.split(" ")
            head = parts[0]
            found = list(map(ids.get, parts))
            found[0] = first.get(head)
            if None in found:
                for i, x in enumerate(found):
                    if x is None:
                        if i:
                            # one chunk may stand here more than once
                            x = ids.get(parts[i])
                            if x is None:
                                x = ids[parts[i]] = self._chunk(parts[i], " ")
                        else:
                            x = first[head] = self._chunk(head, "")
                        found[i] = x
            yield b"".join(found)


_TABLES: dict[str, ChunkIds] = {}


def chunk_ids(tokenizer_path: str) -> ChunkIds:
    """The worker's tokenizer, kept from task to task; chunks are dropped with each."""
    if tokenizer_path not in _TABLES:
        _TABLES[tokenizer_path] = ChunkIds(tokenizer_path)
    return _TABLES[tokenizer_path]


def projection() -> np.ndarray:
    """The fixed random matrix from hashed counts to the curve's dimensions."""
    return np.random.default_rng(20240229).standard_normal((HASH_DIMS, CURVE_DIMS))


def curve_cells(vectors: np.ndarray) -> np.ndarray:
    """Cells of projected unit vectors: an even spread of a normal value over the grid."""
    side = 1 << CURVE_BITS
    return np.clip(((np.tanh(vectors) + 1) / 2 * side).astype(np.int64), 0, side - 1)


def hilbert_index(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Index on the Hilbert curve of each row of grid cells (n rows, d dimensions)."""
    x = cells.astype(np.int64).copy()
    n, d = x.shape
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the turns of each level, from the coarsest
        low = bit - 1
        for i in range(d):
            turned = (x[:, i] & bit) != 0
            swap = (x[:, 0] ^ x[:, i]) & low
            first = np.where(turned, x[:, 0] ^ low, x[:, 0] ^ swap)
            if i:
                x[:, i] = np.where(turned, x[:, i], x[:, i] ^ swap)
            x[:, 0] = first
        bit >>= 1
    for i in range(1, d):  # Gray code
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where(x[:, d - 1] & bit, turn ^ (bit - 1), turn)
        bit >>= 1
    x ^= turn[:, None]
    out = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def curve_keys(rows: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Hilbert index of each row of ids, by its hashed and projected counts."""
    lengths = np.array([len(ids) for ids in rows])
    hashed = (np.concatenate(rows).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22)
    place = np.repeat(np.arange(len(rows), dtype=np.int32) * HASH_DIMS, lengths)
    place += hashed.view(np.int32)
    counts = np.sqrt(np.bincount(place, minlength=len(rows) * HASH_DIMS).reshape(len(rows), HASH_DIMS))
    counts -= counts.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(counts, axis=1, keepdims=True)
    return hilbert_index(curve_cells(counts / np.where(norm == 0, 1, norm) @ matrix))


def tokenise(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids`` (packed numbers) and ``ord``, the place in the packing order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, matrix = chunk_ids(tokenizer_path), projection()
        end = np.array([end_id], chunks.width).tobytes()
        size = len(end)
        for batch in batches:
            texts = column_texts(batch)
            ties = np.asarray(batch.column("tie"))
            for a, b in text_blocks(texts):
                ids = [x + end for x in chunks.encode_block(texts[a:b])]
                keys = np.concatenate([curve_keys([np.frombuffer(x, chunks.width) for x in ids[i : i + 256]], matrix) for i in range(0, b - a, 256)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(a, b - a),
                        pa.array([len(x) // size for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array((keys << TIE_BITS) | ties[a:b], pa.int64()),
                    ],
                    names=[id_col, "n_tokens", "ids", "ord"],
                )
        chunks.forget()
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    tie = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << TIE_BITS) - 1)
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), tie.alias("tie")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids binary, ord long"
    )


def pack(tokens: DataFrame, id_col: str = "doc_id", seq_len: int = SEQ_LEN) -> DataFrame:
    """Pieces of tokenised rows in gapless sequences, in the order of ``ord``.

    ``tokens`` must be stable when read again (checkpointed): its order value
    decides the ranges.
    """
    spark = tokens.sparkSession
    n = partitions(spark)
    dealt, bucket = order_buckets(tokens, "ord", 8 * n)
    # one row a range: as many as the buckets asked for, whatever the input's size
    sums = dealt.groupBy(bucket).agg(F.sum("n_tokens").alias("ids")).orderBy(bucket).collect()
    starts, total = {}, 0
    for r in sums:
        starts[r[bucket]] = total
        total += r.ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            rows: list[tuple] = []
            index: list[int] = []
            for i, (b, n_ids, ids) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids"), strict=True)):
                if b != now:
                    now, at = b, starts[b]
                packed = ids.as_buffer()
                view = np.frombuffer(packed, f"<u{packed.size // n_ids}").astype("<u4")
                done = 0
                while done < len(view):
                    length = min(seq_len - at % seq_len, len(view) - done)
                    rows.append((done, length, zlib.crc32(view[done : done + length]), len(view), at // seq_len, at % seq_len))
                    index.append(i)
                    done += length
                    at += length
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(index, pa.int32())), *[pa.array(c, pa.int64()) for c in cols]],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = tokens.schema[id_col].dataType.simpleString()
    return (
        dealt.select(F.col(id_col).alias("key"), bucket, "ord", "n_tokens", "ids")
        .repartition(n, bucket)
        .sortWithinPartitions(bucket, "ord", "key", "ids")
        .mapInArrow(cut, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN) -> DataFrame:
    """Tokenise and pack; the tokenised rows are checkpointed between. Only tasks load the tokenizer."""
    return pack(reliable(tokenise(docs, tokenizer_path, id_col, text_col)), id_col, seq_len)


def sequences(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """One row a sequence: its pieces, its ids and the padding it needs."""
    used = F.sum("length")
    padded = F.when(used == seq_len, used).otherwise(F.least(F.lit(seq_len), F.pow(2.0, F.ceil(F.log2(used))).cast("long")))
    return pieces.groupBy("sequence_id").agg(F.count("*").alias("pieces"), used.alias("used"), (padded - used).alias("padding"))


def piece_order() -> Window:
    """Pieces as they stand in their sequence."""
    return Window.partitionBy("sequence_id").orderBy("offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, tokenised with the 50k byte-level vocabulary, in sequences of 2048."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of such a vocabulary holds a space marker behind another character,
so no merge ever crosses the place where a marker follows a word. A text is
thus a row of marked words ("chunks", each with the run of markers before it),
and the ids of the text are the ids of its chunks one after another. Each task
keeps a table of the distinct chunks it has met, lets the library segment only
the new ones, and joins ids back by position. The property is checked against
the model when the table is made; a model without it is refused.

The table is local to a Python worker and holds at most ``MAX_CHUNKS`` chunks;
a full table is started anew, which changes no result. Nothing is shuffled.

Defined cases: a null text is the empty text; an empty text has no ids and
decodes to itself; a literal U+2581 counts as a space, as in the library;
runs of spaces, leading and trailing spaces are kept as the model keeps them;
extra columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import column_texts, table, text_blocks

#: Chunks that one worker's table holds before it is started anew.
MAX_CHUNKS = 400_000

MARK = "▁"
_CHUNK = re.compile(r" +[^ ]*")
#: A space next to another one, or at an end of the text.
_ODD = re.compile(r"  |^ | $")


class ChunkTable:
    """Distinct marked words of one model with their ids and decoded text."""

    def __init__(self, model_path: str, max_chunks: int = MAX_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross space markers; chunks can't be encoded apart")
        if self.model.encode("a  B") != self.model.encode("a ") + self.model.encode("B"):
            raise ValueError("this model rewrites texts before it splits them; chunks can't be encoded apart")
        self.max_chunks = max_chunks
        self.ids: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        #: the ids of a lone marker, as at the end of a text
        self.lone = ",".join(map(str, self.model.encode("x ")[len(self.model.encode("x")) :]))

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks (each without its first marker) that are new."""
        new = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(new) > self.max_chunks:
            self.forget()
            new = list(chunks)
        for c, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            self.ids[c] = ",".join(map(str, ids))
            back = self.model.decode(ids)
            if back != c:
                self.odd[c] = back
        if "" in chunks:
            self.ids[""] = self.lone
            self.odd.pop("", None)

    def forget(self) -> None:
        """Give the table's memory back; the worker may go on with another operator."""
        self.ids.clear()
        self.odd.clear()

    def encode_block(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """The ids, as decimals with commas, and the decoded text of each text."""
        rows = []
        for t in texts:
            t = t.replace(MARK, " ")
            if not t:
                rows.append([])
            elif _ODD.search(t):
                rows.append([c[1:] for c in _CHUNK.findall(" " + t)])
            else:
                rows.append(t.split(" "))
        self.learn(set(chain.from_iterable(rows)))
        ids, odd = self.ids, self.odd
        for parts in rows:
            joined = ",".join(map(ids.__getitem__, parts))
            if odd and not odd.keys().isdisjoint(parts):
                parts = [odd.get(p, p) for p in parts]
            yield joined, " ".join(parts)


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(model_path: str) -> ChunkTable:
    """The worker's model, kept from task to task; what it has learned is dropped with each."""
    if model_path not in _TABLES:
        _TABLES[model_path] = ChunkTable(model_path)
    return _TABLES[model_path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int) and ``decoded`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_table(model_path)
        for batch in batches:
            texts = column_texts(batch)
            for a, b in text_blocks(texts):
                pairs = list(chunks.encode_block(texts[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(a, b - a),
                        pa.array([list(map(int, i.split(","))) if i else [] for i, _ in pairs], pa.list_(pa.int32())),
                        pa.array([d for _, d in pairs], pa.string()),
                    ],
                    names=[id_col, "ids", "decoded"],
                )
        chunks.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, ids array<int>, decoded string"
    )


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, but only the number of ids and digests of ids and text leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_table(model_path)
        sha = hashlib.sha256
        for batch in batches:
            texts = column_texts(batch)
            for a, b in text_blocks(texts):
                n, ids, back = [], [], []
                for joined, decoded in chunks.encode_block(texts[a:b]):
                    n.append(joined.count(",") + 1 if joined else 0)
                    ids.append(sha(joined.encode()).hexdigest())
                    back.append(sha(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        chunks.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded with the 32k piece model."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Every task tokenises its documents, cuts off full-length pieces and packs the remainders of a block
of about ``block_tokens`` tokens: in descending order each goes to the sequence of lowest estimated
attention cost (linear plus quadratic in the piece lengths) that still has room for it; if none has,
it is cut at the room of the cheapest open sequence. A block opens exactly as much room as it has
tokens: full-length sequences, and powers of two for what is left over, which need no padding. Blocks
are bounded, so memory is too, and nothing is shuffled; a lost task is simply run again.

Sequence ids carry the task's number in their upper bits and so are unique. Which documents share a
block depends on how the input is split; within a task the result is deterministic.

Documents are cut no more than needed, so a long piece makes its sequence dearer than short ones make
theirs: costs even out to the extent that pieces are short.

Defined results: a null text is an empty one, and an empty text is the single end token; a text of any
length is cut into as many pieces as it takes; repeated rows are packed each; ids of any type, nulls
included, are passed through; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END_TOKEN = 0
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


#: Fixed value: how byte-level BPE vocabularies of this kind split text before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TextTokenizer:
    """Token ids of whole texts.

    tiktoken merges by the ranks in the given vocabulary file, which yields the ids of tokenizers at
    several times its speed. Texts that contain a special token's string go to tokenizers itself,
    which reads it as that token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = self.slow.get_added_tokens_decoder()
        self.specials = [token.content for token in special.values()]
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items() if rank not in special}
        self.fast = tiktoken.Encoding("texts", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def text_ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.specials):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        return np.asarray(ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> TextTokenizer:
    """One tokenizer per worker process and vocabulary."""
    return TextTokenizer(path)


def assign(lengths: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in piece, length, sequence, offset) for remainders of ``lengths`` into sequences with ``room``, whose sums are equal."""
    size, cost, placed = room.astype(np.int64), np.zeros(len(room)), []
    left = size.copy()
    for piece in np.argsort(-lengths, kind="stable"):
        start, length = 0, int(lengths[piece])
        while length:
            fits = left >= length
            if not fits.any():
                fits = left > 0
            j = int(np.argmin(np.where(fits, cost, np.inf)))
            part = min(length, int(left[j]))
            placed.append((int(piece), start, part, j, int(size[j] - left[j])))
            left[j] -= part
            cost[j] += LINEAR * part + QUADRATIC * part * part
            start, length = start + part, length - part
    return placed


def pack_block(counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents with ``counts`` tokens, and the number of sequences."""
    pieces, used = [], 0
    for d, n in enumerate(counts // capacity):
        for k in range(int(n)):
            pieces.append((d, k * capacity, capacity, used, 0))
            used += 1
    rest = counts % capacity
    docs = np.flatnonzero(rest)
    total = int(rest.sum())
    room = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    for piece, start, length, sequence, offset in assign(rest[docs], np.array(room, dtype=np.int64)):
        d = int(docs[piece])
        pieces.append((d, int(counts[d] - rest[d]) + start, length, used + sequence, offset))
    return pieces, used + len(room)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_token: int = END_TOKEN,
    block_tokens: int = 1 << 20,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the token ids.

    ``capacity`` is a power of two. ``tokenizer_path`` must exist on every worker.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [T.StructField(id_col, source.schema["id"].dataType)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def pack(batches):
        tokenise, base, end = tokenizer(tokenizer_path).text_ids, TaskContext.get().partitionId() << 36, np.array([end_token], dtype="<u4").tobytes()
        keys, ids, held = [], [], 0

        def block():
            nonlocal base, keys, ids, held
            key = pa.chunked_array(keys).combine_chunks()
            counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            pieces, sequences = pack_block(counts, capacity)
            doc, start, length, sequence, offset = np.array(pieces, dtype=np.int64).T
            cut = [ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length)]
            columns = [key.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(counts[doc]), pa.array(base + sequence), pa.array(offset)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(c, "<u4").astype(np.int64) for c in cut], pa.list_(pa.int64())))
            base, keys, ids, held = base + sequences, [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [tokenise(x) + end for x in part.column(1).to_pylist()]
                keys.append(part.column(0))
                ids += found
                held += sum(map(len, found)) // 4
                if held >= block_tokens:
                    yield block()
        if ids:
            yield block()

    return source.mapInArrow(pack, T.StructType(fields))

"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

Texts of at most ``huge`` code points are encoded whole. A longer one is cut into chunks, each of which
reaches ``overlap`` code points into its successor; the chunks are dealt to tasks and encoded with
offsets. Where both encodings of an overlap hold the same piece at the same place, the text is spliced
behind that piece: pieces up to it count from the left chunk, later ones from the right chunk.

Why such a boundary is stable: byte-pair encoding merges the best adjacent pair first, whatever lies
around it. So an encoding is that of its text if and only if every two neighbouring pieces are the
encoding of their joint text: the first merge that crossed a boundary would also be made within the two
pieces beside it. Each two neighbours of a spliced encoding are neighbours in the encoding of a chunk,
since the common piece belongs to both. This needs a model whose scores are ranks of merges, which is
checked, and a normalisation that leaves characters as they are. The space that the library puts before
a text only changes pieces before the first common one.

Documents with an overlap that has no common piece (a long run of one letter, say, that the chunks cut
in different phase) are encoded again with chunks and overlaps twice as long, until one chunk holds
the whole text, which needs no splice. So every count is that of the whole text.

Defined results: a null text is an empty one with no tokens; texts of any length are counted whole;
null and repeated ids are passed through, repeated rows are counted each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.sources.shared import written

CHUNK, OVERLAP = 1 << 15, 1 << 8
MARKS = "uid long, joint long, piece long, begin long, end long, left long, right long"


@functools.lru_cache(maxsize=2)
def processor(path: str):
    """One sentencepiece processor per worker process and model; models that are not byte-pair encodings are an error."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    if not all(model.get_score(i).is_integer() for i in range(model.get_piece_size())):
        raise ValueError(f"{path} is no byte-pair encoding: its scores are no ranks of merges")
    return model


def chunk_marks(model, uid: int, k: int, last: bool, text: str, chunk: int, overlap: int) -> list[tuple]:
    """Rows of ``MARKS`` for one chunk: the pieces in its overlaps, with how many pieces end there; the last chunk adds its number of pieces under a null joint."""
    found = model.encode_as_offset_mapping(text)
    ids, spans, base = found["ids"], found["offsets"], k * chunk
    rows = [(uid, None, None, None, None, len(ids), None)] if last else []
    for n, (piece, (begin, end)) in enumerate(zip(ids, spans), 1):
        if begin == end or model.is_byte(piece):
            continue
        if k and 0 < begin and end <= overlap:
            rows.append((uid, k - 1, piece, base + begin, base + end, None, n))
        if not last and begin > chunk and end <= chunk + overlap:
            rows.append((uid, k, piece, base + begin, base + end, n, None))
    return rows


def _cut(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(uid, k, last, text) for every chunk of ``rows`` (uid, n_chars, text)."""

    def cut(batches):
        for batch in batches:
            for uid, n, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parts = max(1, -(-n // chunk))
                for at in range(0, parts, 64):
                    ks = range(at, min(parts, at + 64))
                    yield pa.RecordBatch.from_pydict({"uid": [uid] * len(ks), "k": list(ks), "last": [k == parts - 1 for k in ks], "text": [text[k * chunk : (k + 1) * chunk + overlap] for k in ks]}, schema=pa.schema([("uid", pa.int64()), ("k", pa.int64()), ("last", pa.bool_()), ("text", pa.string())]))

    return rows.select("uid", "n_chars", "text").mapInArrow(cut, "uid long, k long, last boolean, text string")


def _marks(chunks: DataFrame, model_path: str, chunk: int, overlap: int) -> DataFrame:
    schema = pa.schema([(n, pa.int64()) for n in ("uid", "joint", "piece", "begin", "end", "left", "right")])

    def encode(batches):
        model = processor(model_path)
        for batch in batches:
            for uid, k, last, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if rows := chunk_marks(model, uid, k, last, text, chunk, overlap):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return chunks.mapInArrow(encode, MARKS)


def spliced_counts(huge: DataFrame, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(uid, n_tokens) for stored rows (uid, n_chars, text)."""
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be positive and shorter than a chunk")
    waiting, done = huge, None
    while not waiting.isEmpty():
        chunks = _cut(waiting, chunk, overlap).repartition("uid", "k")
        met = _marks(chunks, model_path, chunk, overlap).groupBy("uid", "joint", "piece", "begin", "end").agg(F.max("left").alias("left"), F.max("right").alias("right"))
        met = met.where("joint is null or (left is not null and right is not null)")
        joints = met.groupBy("uid", "joint").agg(F.min_by(F.col("left") - F.coalesce("right", F.lit(0)), F.coalesce("end", F.lit(0))).alias("tokens"))
        counts = written(joints.groupBy("uid").agg(F.sum("tokens").alias("n_tokens"), F.count("joint").alias("joints")), "spliced")
        whole = counts.join(waiting.select("uid", (F.ceil(F.col("n_chars") / chunk) - 1).alias("expected")), "uid").where(F.col("joints") == F.greatest("expected", F.lit(0)))
        found = written(whole.select("uid", "n_tokens"), "counted")
        done = found if done is None else done.unionByName(found)
        waiting = waiting.join(found, "uid", "left_anti")
        chunk, overlap = 2 * chunk, 2 * overlap
    return huge.select("uid", F.lit(0).cast("long").alias("n_tokens")).limit(0) if done is None else done


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", huge: int = 2 * CHUNK, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``model_path`` must exist on every worker.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.char_length(text).cast("long").alias("n_chars"), text.alias("text"))
    fields = T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches):
        model = processor(model_path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = model.encode_as_numpy(part.column("text").to_pylist(), num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(np.fromiter(map(len, found), np.int64, len(found)))], names=["id", "n_bytes", "n_tokens"])

    short = rows.where(F.col("n_chars") <= huge).select("id", "n_bytes", "text").mapInArrow(count, fields)
    long = written(rows.where(F.col("n_chars") > huge).withColumn("uid", F.monotonically_increasing_id()), "huge-texts")
    counted = long.select("uid", "id", "n_bytes").join(spliced_counts(long, model_path, chunk, overlap), "uid").select("id", "n_bytes", "n_tokens")
    return short.unionByName(counted).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

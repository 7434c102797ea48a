"""Document fingerprints: a quartile digest of hashed byte triplets, and their likeness.

**Digest.** The byte triplets that lie within five neighbouring bytes of the text are hashed into 256
buckets. The quartiles of the bucket counts turn every bucket into two bits. In front stand a
checksum, the logarithm of the length and how the quartiles relate to each other.

**Likeness.** Two digests differ by the steps between their buckets' quarters (a step across all quarters
weighs more), and by length and quartile ratios. The difference is bounded by what two unrelated
digests have on average; likeness is one minus the difference over that bound.

**Following documents.** Rows are sorted by id over range partitions; a task sees each row's next one
while it streams. Only the first and last row of every partition leave it with their texts, and the last
is joined with the first of the partition that follows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buywave.llm.common import materialize, ship, whole_text

BUCKETS = 256
#: The triplets of five neighbouring bytes that hold the first one.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: What a step between quarters adds to the difference, by its length.
STEPS = np.array([0, 1, 2, 6])
#: The mean difference of two digests with independent buckets: 1.625 for each.
MOST_DIFFERENT = 416
#: What the header can add: length (steps of an eighth of a doubling) and both quartile ratios.
MOST_LENGTH, MOST_RATIO = 64, 15
#: Characters of texts and bytes counted at once.
CHARS_AT_ONCE, BYTES_AT_ONCE = 1_000_000, 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
HEADER = 4


def _bucket_counts(body: np.ndarray, document: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Triplets by (document, bucket). ``body`` has the documents' bytes one after the other, ``document`` the
    number of each byte's document and ``ends`` where each document ends."""
    counts = np.zeros(len(ends) * BUCKETS, dtype=np.int64)
    for start in range(0, len(body), BYTES_AT_ONCE):
        stop = min(start + BYTES_AT_ONCE, len(body))
        whose = document[start:stop]
        left = ends[whose] - np.arange(start, stop)  # bytes from here to the document's end
        wide = np.zeros(stop - start + 4, dtype=np.uint64)
        wide[: min(len(body) - start, len(wide))] = body[start : stop + 4]
        first = wide[: stop - start]
        n = stop - start
        for kind, (a, b) in enumerate(TRIPLETS):
            code = first | wide[a : a + n] << np.uint64(8) | wide[b : b + n] << np.uint64(16) | np.uint64(kind << 24)
            bucket = ((code * _MIX) >> np.uint64(56)).astype(np.int64)
            whole = left > b
            counts += np.bincount(whose[whole] * BUCKETS + bucket[whole], minlength=len(counts))
    return counts.reshape(-1, BUCKETS)


def digests(texts: list[bytes]) -> np.ndarray:
    """One digest (a row of bytes) for every text. A text of less than three bytes has no triplets; equal
    texts have equal digests."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    body = np.frombuffer(b"".join(texts), dtype=np.uint8)
    counts = _bucket_counts(body, np.repeat(np.arange(len(texts)), lengths), ends)
    q1, q2, q3 = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].T
    quarter = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    out = np.zeros((len(texts), HEADER + BUCKETS // 4), dtype=np.uint8)
    out[:, 0] = [zlib.crc32(x) & 255 for x in texts]
    out[:, 1] = np.minimum(np.floor(8 * np.log2(lengths + 1.0)), 255)
    out[:, 2] = 15 * q1 // np.maximum(q3, 1)
    out[:, 3] = 15 * q2 // np.maximum(q3, 1)
    for k in range(4):
        out[:, HEADER:] |= quarter[:, k::4] << np.uint8(2 * k)
    return out


def _quarters(prints: np.ndarray) -> np.ndarray:
    return np.stack([(prints[:, HEADER:] >> np.uint8(2 * k)) & 3 for k in range(4)], axis=-1).reshape(len(prints), -1).astype(np.int64)


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Between 0 and 1 for each pair of digests; 1 for equal ones."""
    difference = STEPS[np.abs(_quarters(one) - _quarters(other))].sum(axis=1)
    head = np.abs(one[:, :HEADER].astype(np.int64) - other[:, :HEADER].astype(np.int64))
    difference = difference + (head[:, 0] > 0) + np.minimum(np.maximum(head[:, 1] - 1, 0) * 2, MOST_LENGTH)
    difference = difference + np.minimum(head[:, 2] + head[:, 3], MOST_RATIO)
    return 1.0 - np.minimum(difference, MOST_DIFFERENT) / MOST_DIFFERENT


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


# --- over the table ---------------------------------------------------------------------------

#: What the tasks return beside the id; the last three columns hold the edges of the partitions.
_TYPES = {
    "n_chars": pa.int64(),
    "edited_sha256": pa.binary(),
    "fingerprint": pa.binary(),
    "edited_fingerprint": pa.binary(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
    "part": pa.int32(),
    "edge": pa.string(),
    "t": pa.string(),
}
_EDGES = 3
_MADE = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(ids: list, texts: list[str]) -> dict:
    """Columns of all rows but the last, each compared with the one after it."""
    changed = [edited(x, y).encode("utf-8", "surrogatepass") for x, y in zip(texts, texts[1:])]
    prints = digests([x.encode("utf-8", "surrogatepass") for x in texts])
    others = digests(changed)
    return {
        "id": ids[:-1],
        "n_chars": [len(x) for x in texts[:-1]],
        "edited_sha256": [hashlib.sha256(x).digest() for x in changed],
        "fingerprint": [x.tobytes() for x in prints[:-1]],
        "edited_fingerprint": [x.tobytes() for x in others],
        "near_edited": likeness(prints[:-1], others),
        "near_next": likeness(prints[:-1], prints[1:]),
    }


def _runs(batch: pa.RecordBatch, held: tuple | None) -> Iterator[tuple[list, list[str]]]:
    """The batch's (ids, texts) in overlapping runs of some million characters: each begins with the last
    row of the one before, which for the first is ``held``."""
    ids, texts = ([held[0]], [held[1]]) if held else ([], [])
    size = 0
    for i, x in zip(batch.column("id"), batch.column("t")):
        ids.append(i.as_py())
        texts.append(x.as_py())
        size += len(texts[-1])
        if size >= CHARS_AT_ONCE:
            yield ids, texts
            ids, texts, size = ids[-1:], texts[-1:], 0
    if len(texts) > 1 or held is None:
        yield ids, texts


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text's last half comes from the next row in ascending id (after the last, the first);
    null ids come last, rows of one id follow the hash of their texts, and a single row follows itself.
    Null texts are empty texts; two empty texts are alike (1). Repeated rows all come back. Other columns
    of ``docs`` are not read, so their names cannot clash.
    """
    ship(docs.sparkSession)
    named = docs.select(F.col(f"`{id_column}`").alias("id"), whole_text(F.col(f"`{text}`")).alias("t"))
    # Equal rows may go to different ranges, so that a group of them is no single task.
    order = [F.col("id").asc_nulls_last(), F.xxhash64("t"), F.rand(11)]
    ordered = named.select("*", *[c.alias(f"o{n}") for n, c in enumerate([F.col("id").isNull(), *order[1:]])])
    by = ["o0", "id", "o1", "o2"]
    ranged = ordered.repartitionByRange(*by).sortWithinPartitions(*by).select("id", "t")
    kind = named.schema["id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = held = None
        for batch in batches:
            types = {"id": batch.schema.field("id").type, **_TYPES}
            for ids, texts in _runs(batch, held):
                first = first or (ids[0], texts[0])
                held = (ids[-1], texts[-1])
                if len(ids) > 1:
                    yield _batch(_compared(ids, texts), types)
        if first:
            yield _batch({"id": [first[0], held[0]], "part": [part, part], "edge": ["first", "last"], "t": [first[1], held[1]]}, types)

    streamed = materialize(ranged.mapInArrow(stream, f"id {kind}, {_MADE}, part int, edge string, t string"), "fingerprints")
    inside = streamed.filter(F.col("edge").isNull()).drop("part", "edge", "t")
    # The edges: two rows of every partition. The numbers of all partitions are one small window.
    parts = streamed.filter("edge = 'first'").select("part")
    along = Window.orderBy("part")
    whole = Window.partitionBy()
    follows = parts.select("part", F.coalesce(F.lead("part").over(along), F.min("part").over(whole)).alias("next part"))
    lasts = streamed.filter("edge = 'last'").select("part", "id", "t")
    firsts = streamed.filter("edge = 'first'").select(F.col("part").alias("next part"), F.col("t").alias("following"))
    pairs = lasts.join(follows, "part").join(firsts, "next part").select("id", "t", "following")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = dict(list({"id": batch.schema.field("id").type, **_TYPES}.items())[:-_EDGES])
            for i, x, y in zip(*(batch.column(c).to_pylist() for c in ("id", "t", "following"))):
                yield _batch(_compared([i, None], [x, y]), types)

    made = inside.unionByName(pairs.mapInArrow(compare, f"id {kind}, {_MADE}"))
    hexed = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return made.withColumns(hexed).withColumnRenamed("id", id_column)


def _batch(columns: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A batch of the named columns; those not given are null."""
    n = len(columns["id"])
    arrays = [pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))

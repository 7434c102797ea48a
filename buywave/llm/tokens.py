"""Token counts with a digest cache.

Texts and the tokenizer file are told by their digests. Stored counts are joined on both digests;
only the distinct texts without a stored count are encoded, and their counts are appended to the
cache, a Parquet folder.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buywave.llm.common import materialize, new_folder, ship, whole_text

LIMIT = 4096
CACHE = T.StructType(
    [
        T.StructField("tokenizer", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
#: Distinct words that a worker remembers the counts of, and the longest such word.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 40

_SPACE = "▁"
_CHUNK = re.compile(" +[^ ]*")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine; a path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(name: str) -> str:
    with open(tokenizer_path(name), "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def counter(name: str) -> Callable[[str], int]:
    """Counts the tokens of a text as the file's library does, without special tokens."""
    path = tokenizer_path(name)
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if not splits_at_spaces(model):
        return lambda text: len(model.encode(text))
    return _by_word(model)


def splits_at_spaces(model) -> bool:
    """Whether no token can reach over the start of a run of spaces, and spaces are kept as they are.

    True when the space sign stands only at the start of pieces and the model neither strips nor joins
    spaces. Then the tokens of a text are those of its chunks (spaces and the word after them).
    """
    pieces = (model.id_to_piece(k) for k in range(model.get_piece_size()))
    if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
        return False
    probe = "  a  b \n c   "
    return "".join(model.encode(probe, out_type=str)).replace(_SPACE, " ").replace("<0x0A>", "\n") == f" {probe}"


def _by_word(model) -> Callable[[str], int]:
    known: dict[str, int] = {}
    lead = len(model.encode("a"))

    def count_chunk(chunk: str) -> int:
        # "a" keeps the library from adding its own space; no token joins it with the chunk.
        return len(model.encode(f"a{chunk}")) - lead

    def count(text: str) -> int:
        if not text:
            return 0
        if len(known) > REMEMBERED:
            known.clear()
        total = 0
        # The library stores a space as its sign, so a sign in the text is a space to it.
        for chunk in _CHUNK.findall(f" {text}".replace(_SPACE, " ")):
            n = known.get(chunk)
            if n is None:
                n = count_chunk(chunk)
                if len(chunk) <= REMEMBERED_CHARS:
                    known[chunk] = n
            total += n
        return total

    return count


_counters: dict[str, Callable[[str], int]] = {}


def _counter_of(name: str) -> Callable[[str], int]:
    """One counter per worker process, so that its memory of words outlives a task."""
    if name not in _counters:
        _counters[name] = counter(name)
    return _counters[name]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a cache that does not exist yet is empty."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def count_missing(docs: DataFrame, tokenizer: str, cache: str) -> None:
    """Encode each distinct text that the cache has no count for, and append the counts.

    Copies are reduced to one text per map task before the shuffle by digest, so a text that a third
    of all rows share does not land in one task.
    """
    spark = docs.sparkSession
    ship(spark)
    version = tokenizer_digest(tokenizer)
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("digest")
    texts = docs.select(whole_text("text").alias("body")).select(F.sha2("body", 256).alias("digest"), "body")
    missing = texts.groupBy("digest").agg(F.first("body").alias("body")).join(stored, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter_of(tokenizer)
        for batch in batches:
            counts = [count(x.as_py()) for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts), pa.string()), batch.column("digest"), pa.array(counts, pa.int64())],
                names=CACHE.fieldNames(),
            )

    missing.select("digest", "body").mapInArrow(encode, CACHE).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and digest of every row.

    ``cache`` is the folder of stored counts (a fresh one if left out); it is extended by the counts of
    the texts it lacked. Null texts are empty: 0 bytes, 0 tokens. Null ids stay null, repeated rows
    all come back. Two jobs that append the same counts at once leave equal rows; one is used.
    """
    spark = docs.sparkSession
    cache = cache or new_folder(spark, "token-cache")
    count_missing(docs, tokenizer, cache)
    version = tokenizer_digest(tokenizer)
    body = whole_text("text")
    rows = materialize(
        docs.select("doc_id", F.octet_length(body).cast("bigint").alias("n_bytes"), F.sha2(body, 256).alias("digest")),
        "digests",
    )
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    # A table of its own, so that the join below reads both sides from plain exchanges and a digest
    # that many rows share can be split.
    counts = materialize(
        rows.select("digest").distinct().join(stored, "digest").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")),
        "counts",
    )
    return rows.join(counts, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest"
    )

"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own measures and those of its neighbours. A document's
quality is the mean of its lines' forward-backward marginals, weighted by line length.

Training knows only labels of whole documents. All lines of a good document count as good. The
lines of a bad document start as bad; after a first fit those that look good are relabelled, the
worst line always stays bad, and the field is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buywave.llm import crf
from buywave.llm.common import portions, ship, whole_text

FOLDS, HELD_OUT_FOLD = 4, 2
#: Bounds of the labelled sample that is fitted on: documents, and lines of one document.
TRAIN_DOCUMENTS, TRAIN_LINES = 3000, 80
ACCEPT = 0.7
#: Characters classified at once, which bounds a task's memory whatever the batch holds.
CHARS_AT_ONCE = 1_000_000

_UPPER, _LETTER, _DIGIT, _SPACE, _MARK, _SYMBOL = range(6)
_SENTENCE_MARKS = ".,;:!?'\"()-"
_OWN = 15
#: Measures that are also taken from the line before and the line after.
_NEIGHBOURS = [1, 2, 4, 5, 7, 8]
WIDTH = _OWN + 2 * len(_NEIGHBOURS) + 2


def _char_kinds() -> np.ndarray:
    kinds = np.full(0x110000, _LETTER, dtype=np.uint8)
    low = [chr(c) for c in range(0x250)]
    for c in low:
        kind = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SPACE if c.isspace() else _SYMBOL
        kinds[ord(c)] = _UPPER if c.isupper() else _MARK if c in _SENTENCE_MARKS else kind
    kinds[0x2000:0x2C00] = _SYMBOL
    return kinds


_KINDS = _char_kinds()


def lines_of(text: str) -> list[str]:
    """Lines split at \\n; blank lines are left out, and a blank text is one empty line."""
    return [x for x in text.split("\n") if x and not x.isspace()] or [""]


def line_features(documents: list[list[str]]) -> np.ndarray:
    """One row of measures per line, documents one after the other."""
    lines = [line for doc in documents for line in doc]
    own = np.zeros((len(lines), _OWN))
    chars = np.array([len(x) for x in lines], dtype=np.int64)
    counts = np.zeros((len(lines), 6))
    begin = 0
    while begin < len(lines):
        end, size = begin, 0
        while end < len(lines) and (size == 0 or size + chars[end] <= CHARS_AT_ONCE):
            size += chars[end]
            end += 1
        points = np.frombuffer("".join(lines[begin:end]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(points):
            which = np.repeat(np.arange(end - begin, dtype=np.int64) * 6, chars[begin:end])
            found = np.bincount(which + _KINDS[points], minlength=6 * (end - begin))
            counts[begin:end] = found.reshape(-1, 6)
        begin = end
    shown = np.maximum(chars - counts[:, _SPACE], 1)
    letters = counts[:, _UPPER] + counts[:, _LETTER]
    own[:, 0] = np.log1p(chars)
    own[:, 1] = counts[:, _UPPER] / np.maximum(letters, 1)
    own[:, 2] = counts[:, _SYMBOL] / shown
    own[:, 3] = counts[:, _DIGIT] / shown
    own[:, 4] = letters / shown
    own[:, 9] = counts[:, _MARK] / shown
    k = 0
    for doc in documents:
        seen: set[str] = set()
        for line in doc:
            words = line.split()
            n = len(words)
            if n:
                row = own[k]
                row[5] = 1.0 - len(set(words)) / n
                row[6] = np.log1p(n)
                row[7] = sum(map(eq, words, words[1:])) / n
                row[8] = line.count(" | ") / n
                row[10] = line.count("!") / n
                row[11] = min(shown[k] / n, 30.0)
                row[12] = line[-1] in ".!?:"
                row[13] = line in seen
                row[14] = n <= 2
            seen.add(line)
            k += 1
    lengths = np.array([len(doc) for doc in documents], dtype=np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    near = own[:, _NEIGHBOURS]
    before, after = np.vstack([near[:1], near[:-1]]), np.vstack([near[1:], near[-1:]])
    before[starts], after[ends - 1] = near[starts], near[ends - 1]
    edge = np.zeros((len(lines), 2))
    edge[starts, 0], edge[ends - 1, 1] = 1.0, 1.0
    return np.hstack([own, before, after, edge])


def in_held_out_fold(doc_id: Column) -> Column:
    """Whether the crc32 of the id's text falls in the held-out fold; a null id reads as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT_FOLD


def training_lines(docs: DataFrame, labels: DataFrame, max_documents: int, max_lines: int) -> DataFrame:
    """Line measures of a bounded sample of labelled documents outside the held-out fold.

    The ids are drawn by a hash, so the sample does not depend on partitioning. Ids labelled both
    good and bad, null ids and null labels are left out. Of several texts of one id the one of the smallest
    hash is taken, so the bound holds for the rows too. Labelled documents of more than ``max_lines`` lines are
    left out of the fit.
    """
    sample = (
        labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("good"))
        .filter(F.col("id").isNotNull() & F.col("good").isin(0, 1) & ~in_held_out_fold(F.col("id")))
        .groupBy("id")
        .agg(F.min("good").alias("good"), F.max("good").alias("other"))
        .filter(F.col("good") == F.col("other"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_documents)
        .select("id", "good")
    )
    texts = docs.select(F.col("doc_id").alias("id"), whole_text("text").alias("text"))
    labelled = texts.join(F.broadcast(sample), "id")  # at most max_documents ids
    # One text an id, reduced in the map tasks: at most max_documents rows.
    rows = labelled.groupBy("id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pydict()
            split = [lines_of(x) for x in table["text"]]
            kept = [k for k, x in enumerate(split) if len(x) <= max_lines]
            if kept:
                documents = [split[k] for k in kept]
                flat = line_features(documents).astype(np.float32)
                ends = np.cumsum([len(x) for x in documents])[:-1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array([table["id"][k] for k in kept], pa.int64()),
                        "good": pa.array([table["good"][k] for k in kept], pa.int32()),
                        "features": pa.array([x.tobytes() for x in np.split(flat, ends)], pa.binary()),
                    }
                )

    return rows.select("id", "good", "text").withColumn("id", F.col("id").cast("bigint")).mapInArrow(
        measure, "id bigint, good int, features binary"
    )


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    max_documents: int = TRAIN_DOCUMENTS,
    max_lines: int = TRAIN_LINES,
) -> crf.Chain:
    """Fit the field on at most ``max_documents`` labelled documents of at most ``max_lines`` lines.

    Only the measures of that sample come to the driver. Without labels every score is 0.5.
    """
    ship(docs.sparkSession)
    sample = training_lines(docs, labels, max_documents, max_lines).toPandas()
    sample = sample.sort_values(["id", "features"], kind="stable")
    matrices = [np.frombuffer(x, dtype=np.float32).reshape(-1, WIDTH) for x in sample["features"]]
    features = np.vstack([np.zeros((0, WIDTH)), *matrices])
    lengths = np.array([len(x) for x in matrices], dtype=np.int64)
    good = np.repeat(sample["good"].to_numpy(dtype=np.int64), lengths)
    chain = crf.fit(features, good, lengths)
    if not len(features):
        return chain
    believed = crf.marginals(chain.scores(features), chain.transition, lengths)
    # Relative to a bad document's own worst line, lines that look like good documents are good.
    starts = np.cumsum(lengths) - lengths
    worst = np.repeat(np.minimum.reduceat(believed, starts), lengths)
    relabelled = np.where(good == 1, 1, ((believed > 0.5) & (believed > worst)).astype(np.int64))
    return crf.fit(features, relabelled, lengths)


def score_quality(docs: DataFrame, chain: crf.Chain, keep: list[str], text: str = "text", score: str = "score") -> DataFrame:
    """``keep`` columns of every row and its ``score`` (or the given name): the length-weighted mean of P(line is good).

    Null and empty texts are one empty line. Whole texts are scored. Repeated rows score alike, and
    the score depends on the text only.
    """
    ship(docs.sparkSession)
    weights = chain.to_dict()
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)], whole_text(text).alias("t"))
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "score double"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = crf.Chain.from_dict(weights)
        for batch in batches:
            means: list[float] = []
            for part in portions(batch.column("t"), CHARS_AT_ONCE):
                documents = [lines_of(x) for x in part]
                lengths = np.array([len(x) for x in documents], dtype=np.int64)
                p = crf.marginals(field.scores(line_features(documents)), field.transition, lengths)
                weight = np.array([len(x) + 1.0 for doc in documents for x in doc])
                starts = np.cumsum(lengths) - lengths
                mean = np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts)
                means += np.clip(mean, 0.0, 1.0).tolist()
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(means, pa.float64())], names=names)

    names = [*(f"k{n}" for n in range(len(keep))), "score"]
    passed = source.mapInArrow(scored, out)
    return passed.select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(keep)], F.col("score").alias(score))


def classify(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted (1 if score >= 0.7).

    Learns from labelled rows outside the held-out fold only. Null ids are kept and are not held
    out unless the empty text falls in that fold.
    """
    chain = fit_quality(docs, labels, **bounds)
    scored = score_quality(docs, chain, ["doc_id"])
    return scored.select(
        "doc_id",
        in_held_out_fold(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``docs`` whose text scores at least 0.7, with the same columns, in one narrow pass."""
    chain = fit_quality(docs, labels, **bounds)
    return score_quality(docs, chain, docs.columns, score="quality score").filter(F.col("quality score") >= ACCEPT).drop("quality score")

"""Collocations from a weighted de Bruijn graph of words, by language.

**Graph.** Texts are cut into pieces at punctuation and line ends. The nodes are the word pairs of a piece, and an
edge leads from a pair to the one that overlaps it by a word: it stands for three words, and its weight is how
often they occur. Every task adds up the edges of some million characters before they are shuffled.

**Shorter counts** are not counted: a pair occurs as often as its outgoing edges weigh, plus the pieces that
end with it; a word as often as the pairs that begin with it, plus the pieces that end with it. Both sums are
linear, so words are summed up in the tasks, and pairs where their edges meet.

**Hot nodes.** Edges are dealt by their first pair, so that its flow needs no second exchange. A pair of
two frequent words may hold a large share of all edges: those pairs are dealt by the third word too, and
their partial flows added up afterwards. At most ``FREQUENT`` words are frequent, whatever the corpus.

**Compaction.** Where an edge's weight is the whole flow of the node it leads to, and another edge takes that
whole flow on, the node is unary: both edges belong to one path. Paths are found by pointer doubling. The
nodes inside a path occur only within its edges and just as often, so they are no candidates of their own.
Edges lighter than the smallest count carry flow, but neither they nor their paths can hold a candidate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buywave.llm.common import materialize, ship, whole_text

MIN_COUNT, COVERED, TOP = 10, 50, 2000
#: The score's factor.
SCALE = 1_000_000
UNKNOWN = "und"
#: A word is frequent if it has more than one in so many of all words.
FREQUENT = 20_000
#: Characters whose graph a task adds up at once, and words for each partition of edges.
CHARS_AT_ONCE, WORDS_PER_PARTITION = 8_000_000, 1_000_000
#: Edges that a task holds before it adds them up.
ROWS_AT_ONCE = 1_000_000

_PIECE_END = re.compile(rb"[.,;:!?\n-\r]")
_PLAIN = bytes(10 if _PIECE_END.match(bytes([c])) else 32 if c == 9 else c for c in range(256))
#: An arc is one string, since there are nearly as many as words: language, node and next word with tabs between
#: them, and a line end in front where both words of the node are frequent. Words hold neither.
_ARCS = "arc string, n bigint"
_ARC_TYPES = pa.schema([("arc", pa.string()), ("n", pa.int64())])
_HOT = "\n"


# --- words of a task --------------------------------------------------------------------------


@dataclass
class Words:
    """The words of some texts of one language: numbers into ``names``, and each word's piece."""

    names: pa.Array
    number: np.ndarray
    piece: np.ndarray


def words_of(bodies: list[bytes]) -> Words:
    """ASCII-lower-cased words of whole texts, with piece numbers that grow. Texts end a piece."""
    plain = np.frombuffer(b"\n".join(bodies).lower().translate(_PLAIN), dtype=np.uint8)
    ends = plain == 10
    inside = ~ends & (plain != 32)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(stops - starts)])
    body = pa.py_buffer(plain[inside].tobytes())
    places = pa.py_buffer(offsets.astype(np.int64).tobytes())
    coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, places, body]).dictionary_encode()
    piece = np.cumsum(ends, dtype=np.int64)[starts]
    return Words(coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64), piece)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) of about CHARS_AT_ONCE characters together. Longer texts are cut at a piece's end."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, body in zip(batch.column("lang").to_pylist(), batch.column("t").cast(pa.binary()).to_pylist()):
            while len(body) > CHARS_AT_ONCE:
                end = _PIECE_END.search(body, CHARS_AT_ONCE)
                if not end:
                    break
                yield lang, [body[: end.start()]]
                body = body[end.end() :]
            held.setdefault(lang, []).append(body)
            size += len(body)
            if size >= CHARS_AT_ONCE:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def graph_of(lang: str, words: Words, frequent: set[str]) -> Iterator[pa.RecordBatch]:
    """The arcs of one portion: edges, pairs that end a piece, and words with their flow."""
    names, number, piece = words.names, words.number, words.piece
    n = len(number)
    if not n:
        return
    often = np.array([w in frequent for w in names.to_pylist()], dtype=bool)
    joined = np.zeros(n, dtype=bool)  # whether the next word is of the same piece
    joined[:-1] = piece[:-1] == piece[1:]
    first = np.flatnonzero(joined)
    keys, node = np.unique(number[first] * len(names) + number[first + 1], return_inverse=True)
    w1, w2 = np.divmod(keys, len(names))
    mark = quote(lang, safe="") + "\t"  # no tab or line end of its own
    marks = pa.array([mark, _HOT + mark]).take(pa.array((often[w1] & often[w2]).astype(np.int64)))
    pair = pc.binary_join_element_wise(names.take(pa.array(w1)), names.take(pa.array(w2)), " ")
    pair = pc.binary_join_element_wise(marks, pair, "\t", "")
    goes_on = joined[first + 1]
    # Edges: a node and the word that follows it.
    edges, weight = np.unique(node[goes_on] * len(names) + number[first[goes_on] + 2], return_counts=True)
    at, w3 = np.divmod(edges, len(names))
    yield _arcs(pc.binary_join_element_wise(pair.take(pa.array(at)), names.take(pa.array(w3)), ""), weight)
    # Corrections: pieces that end with the node.
    ending = np.bincount(node[~goes_on], minlength=len(keys))
    ends = np.flatnonzero(ending)
    yield _arcs(pair.take(pa.array(ends)), ending[ends])
    # A word: the flow of the nodes that begin with it, and the pieces that end with it.
    out = np.bincount(at, weights=weight, minlength=len(keys)).astype(np.int64) + ending
    flow = np.bincount(w1, weights=out, minlength=len(names)).astype(np.int64)
    flow += np.bincount(number[~joined], minlength=len(names))
    yield _arcs(pc.binary_join_element_wise(mark, names, "\t", ""), flow)


def _arcs(arc: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([arc, pa.array(n, pa.int64())], schema=_ARC_TYPES)


def flows_of(arcs: pa.Table, min_count: int) -> Iterator[pa.Table]:
    """(lang, node, next, n) of summed arcs: the flows of nodes and words, without next, and the edges.

    Those below ``min_count`` are left out, but not the flows of pairs of frequent words, which other tasks add to.
    """
    parts = pc.list_flatten(pc.split_pattern(arcs["arc"].combine_chunks(), "\t"))
    lang, node, following = (parts.take(pa.array(np.arange(k, len(parts), 3))) for k in range(3))
    edges = pa.table({"lang": lang, "node": node, "next": following, "n": arcs["n"]})
    nodes = _added(edges, "lang", "node")
    nodes = nodes.append_column("next", pa.nulls(len(nodes), pa.string())).select(edges.column_names)
    for table, counts in ((nodes, pc.starts_with(nodes["lang"], _HOT)), (edges.filter(pc.not_equal(edges["next"], "")), False)):
        kept = table.filter(pc.or_(counts, pc.greater_equal(table["n"], min_count)))
        yield kept.set_column(0, "lang", pc.ascii_ltrim(kept["lang"], _HOT))


def _added(table: pa.Table, *by: str) -> pa.Table:
    return table.group_by(list(by)).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


# --- over the table ---------------------------------------------------------------------------


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    named = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN))
    return docs.select(named.alias("lang"), whole_text(F.col(f"`{text}`")).alias("t"))


def word_statistics(texts: DataFrame) -> tuple[DataFrame, int, set[str]]:
    """(lang and ``words`` of every language, all words, the frequent words).

    A task returns a portion's words that have one in 2 x FREQUENT of it. What the others lose is less than that
    share of all words, so the words whose returned sum has that share include all that have one in FREQUENT,
    and are at most 2 x FREQUENT: this bounds what comes to the driver and goes to the tasks.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, bodies in portions(batches):
            words = words_of(bodies)
            counts = np.bincount(words.number, minlength=len(words.names))
            many = np.flatnonzero(counts * 2 * FREQUENT >= len(words.number))
            named = pa.concat_arrays([pa.nulls(1, pa.string()), words.names.take(pa.array(many))])
            totals = pa.array([len(words.number), *counts[many].tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(named)), named, totals], names=["lang", "word", "n"])

    found = texts.mapInArrow(counted, "lang string, word string, n bigint")
    by_word = materialize(found.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-statistics")
    totals = by_word.filter(F.col("word").isNull()).select("lang", F.col("n").alias("words"))
    everything = totals.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    often = by_word.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    frequent = often.filter(F.col("n") * 2 * FREQUENT >= everything).select("word").collect()
    return totals, everything, {r["word"] for r in frequent}


def weighted_graph(texts: DataFrame, all_words: int, frequent: set[str], min_count: int) -> tuple[DataFrame, DataFrame]:
    """(edges, flows) of at least ``min_count``: (lang, node, next, n) and (lang, gram, n) of pairs and words."""
    spark = texts.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), all_words // WORDS_PER_PARTITION + 1)

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, bodies in portions(batches):
            yield from graph_of(lang, words_of(bodies), frequent)

    def flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        fresh = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            fresh += batch.num_rows
            if fresh >= ROWS_AT_ONCE:
                held, fresh = [_added(pa.concat_tables(held), "arc")], 0
        if held:
            for table in flows_of(_added(pa.concat_tables(held), "arc"), min_count):
                yield from table.to_batches()

    # Arcs of one node meet in one task, but those of two frequent words are dealt by the third word too.
    node = F.when(F.startswith("arc", F.lit(_HOT)), F.col("arc")).otherwise(F.substring_index("arc", "\t", 2))
    found = texts.mapInArrow(arcs, _ARCS).repartition(partitions, node).mapInArrow(flows, "lang string, node string, next string, n bigint")
    graph = materialize(found.withColumn("lang", F.url_decode("lang")), "phrase-graph")
    edges = graph.filter(F.col("next").isNotNull())
    nodes = graph.filter(F.col("next").isNull()).groupBy("lang", F.col("node").alias("gram")).agg(F.sum("n").alias("n"))
    return edges, materialize(nodes.filter(F.col("n") >= min_count), "phrase-flows")


def compacted(edges: DataFrame, flows: DataFrame) -> DataFrame:
    """The edges with the ``path`` they belong to, named by its first three words, and their ``place`` in it from 0.

    Columns lang, gram, source, target, n, path, place. The number of rounds is the logarithm of the longest path.
    """
    second = F.substring_index("node", " ", -1)
    grams = edges.select(
        "lang",
        F.concat_ws(" ", "node", "next").alias("gram"),
        F.col("node").alias("source"),
        F.concat_ws(" ", second, "next").alias("target"),
        "n",
    )
    grams = materialize(grams, "phrase-edges")
    whole = flows.select(F.col("lang"), F.col("gram").alias("whole"), F.col("n"))  # an edge of a node's whole flow
    comes = grams.withColumnRenamed("target", "whole").join(whole, ["lang", "whole", "n"]).select("lang", "whole", F.col("gram").alias("up"))
    leaves = grams.withColumnRenamed("source", "whole").join(whole, ["lang", "whole", "n"]).select("lang", "whole", "gram")
    links = leaves.join(comes, ["lang", "whole"]).select("lang", "gram", "up", F.lit(1).cast("bigint").alias("steps"))
    links = materialize(links, "phrase-links")
    while True:
        on = links.select("lang", F.col("gram").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        doubled = links.join(on, ["lang", "up"], "left")
        links = materialize(
            doubled.select(
                "lang", "gram", F.coalesce("further", "up").alias("up"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("more").isNotNull().alias("moved"),
            ),
            "phrase-links",
        )
        if links.filter("moved").isEmpty():
            break
    heads = links.select("lang", "gram", F.col("up").alias("head"), "steps")
    return materialize(
        grams.join(heads, ["lang", "gram"], "left").select(
            "lang", "gram", "source", "target", "n", F.coalesce("head", "gram").alias("path"), F.coalesce("steps", F.lit(0)).alias("place")
        ),
        "phrase-paths",
    )


def paths(docs: DataFrame, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang") -> DataFrame:
    """The compacted graph: lang, path (its first three words), n and ``words`` of every unary path of that weight."""
    ship(docs.sparkSession)
    texts = _texts(docs, text, lang)
    _, all_words, frequent = word_statistics(texts)
    edges = compacted(*weighted_graph(texts, all_words, frequent, min_count))
    return edges.groupBy("lang", "path").agg(F.min("n").alias("n"), (F.count("*") + 2).alias("words"))


def _cuts(phrases: DataFrame) -> DataFrame:
    """A row for every cut k of the phrases, with the parts ``left`` and ``right``."""
    cuts = phrases.withColumn("words", F.size(F.split("phrase", " ")))
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = {"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")}
    return cuts.withColumns(parts).drop("words")


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE a a / (l r)), exact: the products are decimals of 38 digits."""
    exact = {c: f"cast({c} as decimal(18,0))" for c in (a, left, right)}
    return F.expr(f"(cast({SCALE} as decimal(7,0)) * ({exact[a]} * {exact[a]})) div ({exact[left]} * {exact[right]})")


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    covered: int = COVERED,
    top: int = TOP,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of two or three words of each language.

    Null texts are empty, null languages read ``und``; a language without candidates has no rows, and neither has an empty
    table. Repeated rows count each time. Ties of score and count go by the phrase's bytes. A phrase of
    two words is dropped if one of three words, in which it lies, has at least ``covered`` percent of its count.
    Other columns are not read, so their names cannot clash.
    """
    ship(docs.sparkSession)
    texts = _texts(docs, text, lang)
    totals, all_words, frequent = word_statistics(texts)
    edges, flows = weighted_graph(texts, all_words, frequent, min_count)
    triples = compacted(edges, flows)
    # A node inside a path has the count of the edges around it; the others are compared with theirs.
    inner = triples.filter("place > 0").select("lang", F.col("source").alias("gram")) if covered <= 100 else None
    around = triples.select("lang", F.explode(F.array("source", "target")).alias("gram"), "n")
    longer = around.groupBy("lang", "gram").agg(F.max("n").alias("longer"))
    pairs = flows.filter(F.contains("gram", F.lit(" ")))
    if inner is not None:
        pairs = pairs.join(inner, ["lang", "gram"], "left_anti")
    kept = pairs.join(longer, ["lang", "gram"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * covered)
    )
    candidates = kept.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a")).unionByName(
        triples.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))
    )
    part = lambda side, count: flows.select("lang", F.col("gram").alias(side), F.col("n").alias(count))
    scored = _cuts(candidates).join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    lowest = F.min(F.struct(_score("a", "l", "r").alias("score"), "k", "l", "r"))
    best = scored.groupBy("lang", "phrase", "a").agg(lowest.alias("cut")).select("lang", "phrase", "a", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(totals.withColumnRenamed("words", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

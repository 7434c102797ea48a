"""Benchmark decontamination: BM25 with block-max pruning, then a check of question and answer.

The test items form an inverted index whose postings are cut into blocks of items; for every term and
block it keeps the largest impact. Impacts are BM25 contributions divided by the item's score with
itself, so an item that a passage holds whole scores 1. Every passage of every document is a query:

1. The most common terms of every item, up to ``SLACK`` of its score, are not essential. Only postings of
   essential terms are walked. Their block maxima are summed for the pairs of text block and item block that they
   name, sparsely; a passage's pair lives on if the sum and what is not essential can reach the threshold. This
   is WAND's pivot, with the terms below it fixed in advance because the threshold is.
2. The block maxima of all terms that the passage shares with the block are summed. Pairs below the threshold
   are skipped, which is the block-max test.
3. Items of the remaining blocks are scored exactly; all at or above the threshold are retrieved.
4. A retrieved item counts if the document has enough of the 5-word shingles of its question and of
   its answer around the passage.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buywave.llm.common import materialize, portions, ship, whole_text

K1, B = 1.2, 0.75
THRESHOLD, SLACK = 0.6, 0.5
SHINGLE, OVERLAP = 5, 0.8
BLOCK_ITEMS = 2
#: Words of an index entry at most; longer items have several entries.
ENTRY_WORDS = 512
#: Items whose index goes to every task at once; a larger benchmark is searched in several passes.
INDEX_ITEMS, INDEX_CHARS = 50_000, 50_000_000
#: Impacts are added up as whole numbers, rounded up, of this unit.
IMPACT_BITS = 16
#: Postings, or terms of candidate pairs, and characters held at once.
SUMS_AT_ONCE, CHARS_AT_ONCE = 1_000_000, 1_000_000

_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("score", pa.float64()),
        ("question_overlap", pa.float64()),
        ("answer_overlap", pa.float64()),
    ]
)
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=\S)")


#: Lower-cased bytes; ASCII letters and digits and all bytes of other characters make words.
_WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_HASH_PLACES = 32
_BYTE_HASHES = np.random.default_rng(11).integers(0, 1 << 63, size=_HASH_PLACES * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _word_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; whatever is not a letter or digit in ASCII separates them."""
    return _word_bytes(text).split()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts in order, and each text's number of words.

    A word's hash is the sum of random numbers drawn for its bytes and their places. Places beyond
    the last one share it, so some very long words may collide. Words of equal hash are one term: a passage
    may be retrieved for the other word, but the shingles, which are compared as words, then tell.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = joined != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, stops = edges[::2], edges[1::2]
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    lengths = stops - starts
    firsts = np.cumsum(lengths) - lengths
    places = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(firsts.astype(np.int32), lengths)
    np.minimum(places, _HASH_PLACES - 1, out=places)
    places *= 256
    places += joined[inside]
    return np.add.reduceat(_BYTE_HASHES[places], firsts), counts


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's words before its last sentence, and those of its last sentence.

    An item of one sentence is all question.
    """
    sentences = _SENTENCE_END.split(text.strip())
    return words_of(" ".join(sentences[:-1] or sentences)), words_of(sentences[-1] if len(sentences) > 1 else "")


def shingles(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}


def contained(part: list[bytes], region: list[bytes]) -> float:
    """Share of the part's shingles that the region has; a part without words is contained."""
    if not part:
        return 1.0
    n = min(SHINGLE, len(part))
    wanted = shingles(part, n)
    return len(wanted & shingles(region, n)) / len(wanted)


@dataclass
class Index:
    """Blocks of entries: the postings of their essential terms, their terms' largest impacts, and the entries."""

    items: list[tuple]  # (item id, question, answer), by item
    entry_item: np.ndarray
    impacts: list[dict[int, float]]  # per entry: term to impact
    posting_starts: np.ndarray  # per term, into the next two
    posting_block: np.ndarray  # blocks in which the term is essential
    posting_max: np.ndarray  # its largest impact there, as a whole number
    block_rest: np.ndarray  # what the other terms can add
    block_starts: np.ndarray  # per block, into the next two
    block_term: np.ndarray
    block_max: np.ndarray
    text_block: int  # words
    hashes: np.ndarray  # of the vocabulary, sorted; a term is a place in it

    @property
    def n_blocks(self) -> int:
        return len(self.block_starts) - 1


def entries_of(question: list[bytes], answer: list[bytes]) -> Iterator[Counter]:
    """An item's words, counted in entries of at most ENTRY_WORDS words."""
    words = question + answer
    for at in range(0, len(words), ENTRY_WORDS):
        yield Counter(words[at : at + ENTRY_WORDS])


@dataclass
class Statistics:
    """Entries, their mean length, how many of them hold a term, and the words of the longest item."""

    entries: int
    mean_length: float
    holding: dict[bytes, int]
    longest: int = 0

    @classmethod
    def of(cls, entries: list[Counter]) -> Statistics:
        words = sum(sum(e.values()) for e in entries)
        return cls(len(entries), words / max(len(entries), 1), Counter(t for e in entries for t in e))


def build_index(
    items: list[tuple], block_items: int = BLOCK_ITEMS, slack: float = SLACK, statistics: Statistics | None = None
) -> Index:
    """items: (id, text). Items without words are left out; equal rows count once. ``statistics`` are those
    of the whole benchmark if the items are a part of it."""
    split = [(i, *question_and_answer(text)) for i, text in sorted(set(items), key=repr)]
    split = [x for x in split if x[1] or x[2]]
    entries, entry_item = [], []
    for k, (_, question, answer) in enumerate(split):
        for entry in entries_of(question, answer):
            entries.append(entry)
            entry_item.append(k)
    n = len(entries)
    df = Counter(t for entry in entries for t in entry)
    known = statistics or Statistics.of(entries)
    lengths = np.array([sum(e.values()) for e in entries] or [1], dtype=np.float64)
    idf = {t: np.log(1 + (known.entries - known.holding[t] + 0.5) / (known.holding[t] + 0.5)) for t in df}
    words = list(df)
    hashes, term = np.unique(word_hashes(words)[0], return_inverse=True)
    term_of = dict(zip(words, term.tolist()))
    common = np.zeros(len(hashes), dtype=np.int64)
    np.add.at(common, term, list(df.values()))
    impacts = []
    for entry, length in zip(entries, lengths):
        norm = K1 * (1 - B + B * length / known.mean_length)
        raw: dict[int, float] = {}
        for t, c in entry.items():
            raw[term_of[t]] = raw.get(term_of[t], 0.0) + idf[t] * c * (K1 + 1) / (c + norm)
        whole = sum(raw.values())
        impacts.append({t: x / whole for t, x in raw.items()})
    starts, terms, maxima = [0], [], []
    essential: list[tuple[int, int, float]] = []
    rests = []
    for b in range(-(-n // block_items)):
        best: dict[int, float] = {}
        needed: set[int] = set()
        rest = 0.0
        for entry_impacts in impacts[b * block_items : (b + 1) * block_items]:
            common_part = 0.0
            for t in sorted(entry_impacts, key=lambda t: (-common[t], t)):
                x = entry_impacts[t]
                best[t] = max(best.get(t, 0.0), x)
                if t in needed or common_part + x > slack:
                    needed.add(t)
                else:
                    common_part += x
            rest = max(rest, common_part)
        essential += [(t, b, best[t]) for t in needed]
        rests.append(rest)
        terms += best.keys()
        maxima += best.values()
        starts.append(len(terms))
    essential.sort()
    essential_term = np.array([t for t, _, _ in essential], dtype=np.int64)
    longest = max((len(x[1]) + len(x[2]) for x in split), default=0)
    longest = max(longest, known.longest)
    return Index(
        split,
        np.array(entry_item, dtype=np.int64),
        impacts,
        np.searchsorted(essential_term, np.arange(len(hashes) + 1)),
        np.array([b for _, b, _ in essential], dtype=np.int64),
        np.ceil(np.array([x for _, _, x in essential]) * (1 << IMPACT_BITS)).astype(np.int64),
        np.array(rests),
        np.array(starts, dtype=np.int64),
        np.array(terms, dtype=np.int64),
        np.array(maxima, dtype=np.float64),
        min(max(longest, 32), ENTRY_WORDS),
        hashes,
    )


def search(texts: list[str], index: Index, threshold: float, block_items: int = BLOCK_ITEMS) -> list[tuple]:
    """(document, item, score, question overlap, answer overlap) of every item retrieved and verified.

    A passage is two neighbouring text blocks of as many words as the longest entry, so a whole entry lies
    in some passage.
    """
    if not index.n_blocks:
        return []
    if index.block_rest.max() >= threshold - 1e-6:
        raise ValueError("the index leaves out terms that reach the threshold alone: build it with less slack")
    size = index.text_block
    hashes, n_words = word_hashes([_word_bytes(x) for x in texts])
    counts = -(-n_words // size)
    first_block = np.concatenate([[0], np.cumsum(counts)])
    n_text = int(first_block[-1])
    place = np.minimum(np.searchsorted(index.hashes, hashes), len(index.hashes) - 1)
    known = np.flatnonzero(index.hashes[place] == hashes)
    ids = place[known]
    # A word's text block: its place among its document's words, after the blocks of earlier documents.
    first_word = np.cumsum(n_words) - n_words
    document = np.searchsorted(first_word + n_words, known, side="right")
    text_block = (known - first_word[document]) // size + first_block[document]
    # A term counts once in a text block.
    n_terms = len(index.hashes)
    held = np.unique(text_block * n_terms + ids)
    lasts = np.zeros(n_text, dtype=bool)
    lasts[first_block[1:][counts > 0] - 1] = True
    words: dict[int, list[bytes]] = {}
    best: dict[tuple[int, int], float] = {}
    answers: dict[tuple[int, int], tuple] = {}
    for passage, block in _likely(held, lasts, index, threshold):
        a, b = np.searchsorted(held, [passage * n_terms, (passage + 1 + (not lasts[passage])) * n_terms])
        terms = set((held[a:b] % n_terms).tolist())
        for entry in range(block * block_items, min((block + 1) * block_items, len(index.impacts))):
            score = sum(x for t, x in index.impacts[entry].items() if t in terms)
            if score >= threshold:
                doc = int(np.searchsorted(first_block, passage, side="right")) - 1
                item = int(index.entry_item[entry])
                if (doc, item) not in best or score > best[doc, item]:
                    best[doc, item] = score
                if (doc, item) not in answers or min(answers[doc, item]) < OVERLAP:
                    if doc not in words:
                        words[doc] = words_of(texts[doc])
                    found = _verified(words[doc], (passage - int(first_block[doc])) * size, index, item)
                    answers[doc, item] = max(answers.get((doc, item), (0.0, 0.0)), found, key=min)
    return [(d, i, best[d, i], *answers[d, i]) for d, i in sorted(best) if min(answers[d, i]) >= OVERLAP]


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every run, one run after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _slices(lengths: np.ndarray) -> Iterator[slice]:
    """Neighbouring elements whose lengths are about SUMS_AT_ONCE together."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        limit = (ends[at - 1] if at else 0) + SUMS_AT_ONCE
        stop = max(int(np.searchsorted(ends, limit, side="right")), at + 1)
        yield slice(at, stop)
        at = stop


def _likely(held: np.ndarray, lasts: np.ndarray, index: Index, threshold: float) -> Iterator[tuple[int, int]]:
    """The (passage, item block) pairs whose sum of block maxima reaches the threshold, in order.

    ``held`` has the sorted keys text block x terms + term. A passage is a text block and the next one of its document.
    """
    n_terms = len(index.hashes)
    text_block, term = np.divmod(held, max(n_terms, 1))
    lengths = index.posting_starts[term + 1] - index.posting_starts[term]
    need = np.ceil((threshold - 1e-6 - index.block_rest) * (1 << IMPACT_BITS)).astype(np.int64)
    firsts = np.searchsorted(text_block, np.arange(len(lasts) + 1))
    postings = np.concatenate([[0], np.cumsum(lengths)])[firsts]
    for part in _slices(np.diff(postings)):
        # One text block more than is asked about: the second half of the last passage.
        rows = slice(firsts[part.start], firsts[min(part.stop + 1, len(lasts))])
        cells, sums = _essential_sums(text_block[rows], term[rows], lengths[rows], index)
        own, block = np.divmod(cells, index.n_blocks)
        strong = 2 * sums >= need[block]  # one half of a passage that reaches it has half of it
        own, block = own[strong], block[strong]
        before = (own > part.start) & ~lasts[own - 1]
        inside = own < part.stop
        found = np.unique(np.concatenate([cells[strong][inside], cells[strong][before] - index.n_blocks]))
        passage, block = np.divmod(found, index.n_blocks)
        both = _value(found, cells, sums) + np.where(lasts[passage], 0, _value(found + index.n_blocks, cells, sums))
        likely = both >= need[block]
        yield from _block_max(passage[likely], block[likely], held, lasts, index, threshold)


def _essential_sums(text_block: np.ndarray, term: np.ndarray, lengths: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells (text block x item blocks + item block) that essential terms touch, and the sums of their impacts."""
    at = _runs(index.posting_starts[term], lengths)
    keys = np.repeat(text_block * index.n_blocks, lengths) + index.posting_block[at]
    # The impact rides in the key, so that a plain sort brings a cell's impacts together.
    keys = np.sort(keys << (IMPACT_BITS + 1) | index.posting_max[at])
    cells = keys >> (IMPACT_BITS + 1)
    starts = np.flatnonzero(np.diff(cells, prepend=-1))
    if not len(starts):
        return cells, cells
    return cells[starts], np.add.reduceat(keys & ((1 << (IMPACT_BITS + 1)) - 1), starts)


def _value(keys: np.ndarray, ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key among the ordered ones, 0 if it is not there."""
    if not len(ordered):
        return np.zeros(len(keys), dtype=np.int64)
    place = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return np.where(ordered[place] == keys, values[place], 0)


def _block_max(
    passage: np.ndarray, block: np.ndarray, held: np.ndarray, lasts: np.ndarray, index: Index, threshold: float
) -> Iterator[tuple[int, int]]:
    """Those pairs whose block maxima of all shared terms reach the threshold."""
    n_terms = len(index.hashes)
    starts = index.block_starts[block]
    lengths = index.block_starts[block + 1] - starts
    for part in _slices(lengths):
        at = _runs(starts[part], lengths[part])
        key = np.repeat(passage[part], lengths[part]) * n_terms + index.block_term[at]
        there = _among(key, held)
        there |= np.repeat(~lasts[passage[part]], lengths[part]) & _among(key + n_terms, held)
        sums = np.add.reduceat(index.block_max[at] * there, np.cumsum(lengths[part]) - lengths[part])
        for k in np.flatnonzero(sums >= threshold - 1e-9):
            yield int(passage[part][k]), int(block[part][k])


def _among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return ordered[place] == keys


def _verified(words: list[bytes], start: int, index: Index, item: int) -> tuple[float, float]:
    """Overlap of question and answer with the document around the passage, an item's length either way."""
    _, question, answer = index.items[item]
    margin = len(question) + len(answer)
    region = words[max(start - margin, 0) : start + 2 * index.text_block + margin]
    return contained(question, region), contained(answer, region)


def term_counts(items: DataFrame) -> DataFrame:
    """(term, n): how many entries of the whole benchmark hold the term; the row without a term counts the
    entries and, in ``words``, their words, and has the words of the longest item."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holding: Counter = Counter()
            n = words = longest = 0
            for text in batch.column("text"):
                question, answer = question_and_answer(text.as_py())
                longest = max(longest, len(question) + len(answer))
                for entry in entries_of(question, answer):
                    holding.update(entry.keys())
                    n, words = n + 1, words + sum(entry.values())
            rows = [(None, n, words, longest), *((t, c, 0, 0) for t, c in holding.items())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "n", "words", "longest"])

    ship(items.sparkSession)
    found = items.distinct().select("text").mapInArrow(counted, "term binary, n bigint, words bigint, longest bigint")
    return found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest"))


def statistics_for(part: list[tuple], counts: DataFrame) -> Statistics:
    """Statistics of the whole benchmark for the terms of one part, whose size bounds what is collected."""
    terms = sorted({t for _, text in part for entry in entries_of(*question_and_answer(text)) for t in entry})
    wanted = counts.sparkSession.createDataFrame([(bytearray(t),) for t in terms], "term binary")
    whole = counts.filter(F.col("term").isNull()).first()
    holding = {bytes(r["term"]): r["n"] for r in counts.join(wanted, "term").collect()}
    n = whole["n"] if whole else 0
    return Statistics(n, whole["words"] / max(n, 1) if whole else 0.0, holding, whole["longest"] if whole else 0)


def indexes(
    benchmark: DataFrame, max_items: int | None = None, max_chars: int | None = None, *, slack: float = SLACK
) -> Iterator[Index]:
    """Indexes that cover the benchmark: one if its measured size allows, else one per part.

    Scores and passages do not depend on the number of parts: all use the term statistics and the longest item
    of the whole benchmark. The items of one part at a time come to the driver.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), whole_text("text").alias("text"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(-(-n // (max_items or INDEX_ITEMS)), -(-chars // (max_chars or INDEX_CHARS)), 1)
    if parts == 1:
        yield build_index([tuple(r) for r in items.collect()], slack=slack)
        return
    counts = materialize(term_counts(items), "benchmark-terms")
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        rows = [tuple(r) for r in items.filter(part == k).collect()]
        yield build_index(rows, slack=slack, statistics=statistics_for(rows, counts))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap for every document that holds an item.

    Every passage of every whole text is a query. Null and empty texts hold nothing, null and empty items
    are in nothing; null ids stay null; repeated documents all come back.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text("text").alias("t"))
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    found = None
    for index in indexes(benchmark, slack=min(SLACK, 0.8 * threshold)):
        sent = spark.sparkContext.broadcast(index)

        def query(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, at = batch.column("doc_id").to_pylist(), 0
                for part in portions(batch.column("t"), CHARS_AT_ONCE):
                    hits = search(part, sent.value, threshold)
                    rows = [(ids[at + d], sent.value.items[i][0], *rest) for d, i, *rest in hits]
                    at += len(part)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)

        part = texts.mapInArrow(query, schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with the same columns, in one narrow pass per index."""
    spark = docs.sparkSession
    ship(spark)
    columns = docs.columns
    for index in indexes(benchmark, slack=min(SLACK, 0.8 * threshold)):
        sent = spark.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held, at = set(), 0
                for part in portions(batch.column(batch.num_columns - 1), CHARS_AT_ONCE):
                    held.update(at + d for d, *_ in search(part, sent.value, threshold))
                    at += len(part)
                kept = pa.array([k not in held for k in range(batch.num_rows)], pa.bool_())
                yield batch.select(list(range(batch.num_columns - 1))).filter(kept)

        named = docs.select(*[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(columns)], whole_text("text").alias("t"))
        passed = named.mapInArrow(clean, named.drop("t").schema)
        docs = passed.select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(columns)])
    return docs

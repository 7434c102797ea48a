"""Near duplicates by SimHash: fingerprints, a trie self-join within a bit distance, components.

**Fingerprint.** Words of the ASCII-lower-cased whole text, shingles of some words, 64-bit hashes; a
bit is set where more than half of the hashes set it.

**Links.** The distinct fingerprints are joined with themselves through a binary trie. Pairs of trie
nodes at the same depth are walked together; the differing bits of their paths are added up and a
pair is dropped once they exceed the budget. A pair of differing fingerprints within ``d`` bits has
at most ``d // 3`` of them in one of three bit ranges, so the trie is built three times, each time with
another range first and the smaller budget for that range. The first bits of a path deal the work to
tasks. Only a spanning forest of the links a task finds leaves it, so dense groups cost no quadratic
output, and node pairs whose fingerprints are already linked with each other are not walked again.

**Components.** Large-star and small-star steps over the forests' edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buywave.llm.common import CONTENT_KEYS, materialize, rows_of, ship, whole_text, with_content_keys

HASH_SEED = 42
#: Lengths of the three bit ranges.
RANGES = (21, 21, 22)
#: Fingerprints wanted under one path prefix, and most rows of one task's group before it is split.
GROUP_ROWS, SPLIT_ROWS = 256, 50_000
#: Rows walked at once in a task, and node pairs held at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 200_000, 200_000
#: Hashes counted at once, which bounds the memory for very long texts.
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle_words: int) -> int:
    """The 64-bit SimHash of one text, unsigned; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(stops), HASHES_AT_ONCE):
        hashes = b"".join(
            [digest(joined[a:b], HASH_SEED) for a, b in zip(starts[k : k + HASHES_AT_ONCE], stops[k : k + HASHES_AT_ONCE])]
        )
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(stops)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], shingle_words: int, text: str = "text") -> DataFrame:
    """``keep`` columns and ``fingerprint`` (a signed long) of every row's whole text."""
    ship(docs.sparkSession)
    source = docs.select(*[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)], whole_text(text).alias("t"))
    names = [*(f"k{n}" for n in range(len(keep))), "fingerprint"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "fingerprint bigint"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column("t")], dtype=np.uint64)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], names=names)

    out = source.mapInArrow(hashed, schema)
    return out.select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(keep)], "fingerprint")


def hex_digits(fingerprint: str | Column) -> Column:
    """16 lowercase hex digits of the unsigned value."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


# --- the walk inside a task -------------------------------------------------------------------


def _join_groups(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after linking left[k] with right[k]: the smallest position of each linked group."""
    while True:
        a, b = label[left], label[right]
        open_ = a != b
        if not open_.any():
            return label
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label = shorter


class _Walk:
    """Walks pairs of trie nodes; a node is a range of the sorted ``paths`` that share a prefix."""

    def __init__(self, paths: np.ndarray, first_range: int, distance: int):
        self.paths, self.first_range, self.distance = paths, first_range, distance
        self.label = np.arange(len(paths))
        self.ones: dict[int, np.ndarray] = {}

    def ones_before(self, depth: int) -> np.ndarray:
        if depth not in self.ones:
            bits = (self.paths >> np.uint64(63 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        return self.ones[depth]

    def run(self, roots: np.ndarray, depth: int) -> np.ndarray:
        """roots: rows of (a from, a to, b from, b to, differing bits). Budgets grow step by step, so
        that most of a dense group is linked before its many distant pairs come up."""
        for budget in sorted({min(1, self.distance), self.distance // 2, self.distance}):
            changes = np.cumsum(np.concatenate([[0], self.label[1:] != self.label[:-1]]))
            stack = [(depth, roots)]
            while stack:
                level, pairs = stack.pop()
                if len(pairs) > PAIRS_AT_ONCE:
                    half = len(pairs) // 2
                    stack += [(level, pairs[half:]), (level, pairs[:half])]
                    continue
                pairs = self.prune(pairs, level, budget, changes)
                if len(pairs):
                    stack.append((level + 1, self.children(pairs, level)))
        return self.label

    def prune(self, pairs: np.ndarray, level: int, budget: int, changes: np.ndarray) -> np.ndarray:
        in_first = self.distance // len(RANGES)
        limit = min(budget, in_first) if level <= self.first_range else budget
        alo, ahi, blo, bhi, bits = pairs.T
        pairs = pairs[(ahi > alo) & (bhi > blo) & (bits <= limit)]
        alo, ahi, blo, bhi, bits = pairs.T
        # Nodes whose fingerprints are all linked with each other already have nothing to add.
        done = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo])
        done &= self.label[alo] == self.label[blo]
        # Two single fingerprints are compared at once.
        single = ~done & (ahi - alo == 1) & (bhi - blo == 1)
        left, right = alo[single], blo[single]
        near = np.bitwise_count(self.paths[left] ^ self.paths[right]) <= budget
        self.label = _join_groups(self.label, left[near], right[near])
        return pairs[~(done | single)]

    def children(self, pairs: np.ndarray, level: int) -> np.ndarray:
        alo, ahi, blo, bhi, bits = pairs.T
        ones = self.ones_before(level)
        amid = ahi - (ones[ahi] - ones[alo])
        bmid = bhi - (ones[bhi] - ones[blo])
        other = alo != blo  # a node paired with itself has one mixed pair of children
        return np.vstack(
            [
                np.column_stack([alo, amid, blo, bmid, bits]),
                np.column_stack([amid, ahi, bmid, bhi, bits]),
                np.column_stack([alo, amid, bmid, bhi, bits + 1]),
                np.column_stack([amid, ahi, blo, bmid, bits + 1])[other],
            ]
        )


def _rotate(values: np.ndarray, by: int) -> np.ndarray:
    return (values << np.uint64(by)) | (values >> np.uint64(64 - by)) if by else values


def _forest(rows: pd.DataFrame, distance: int, depth: int) -> pd.DataFrame:
    """Spanning links among whole groups of one bit range. Rows are sorted by group, own first, path."""
    turn = int(rows["turn"].iloc[0])
    paths = rows["path"].to_numpy(dtype=np.int64).view(np.uint64)
    group = rows["group"].to_numpy()
    own = rows["own"].to_numpy(dtype=bool)
    # A node is a run of rows of one group that share the prefix; a group's own node comes first.
    prefix = paths >> np.uint64(64 - depth)
    new_group = np.concatenate([[True], group[1:] != group[:-1]])
    new_node = new_group | np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (own[1:] != own[:-1])])
    starts = np.flatnonzero(new_node)
    stops = np.concatenate([starts[1:], [len(rows)]])
    which = np.cumsum(new_group[starts]) - 1
    home = np.flatnonzero(new_group[starts])[which]
    meets = own[starts[home]]  # visitors without a host have nobody to meet there
    bits = (~own[starts]).astype(np.int64)
    roots = np.column_stack([starts[home], stops[home], starts, stops, bits])[meets]
    label = _Walk(paths, RANGES[turn], distance).run(roots, depth)
    linked = np.flatnonzero(label != np.arange(len(label)))
    back = (64 - sum(RANGES[:turn])) % 64
    as_was = lambda x: _rotate(paths[x], back).view(np.int64)
    return pd.DataFrame({"u": as_was(linked), "v": as_was(label[linked])})


# --- the distributed join ---------------------------------------------------------------------


def link_forest(distinct: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) that connect exactly those fingerprints that chains of near pairs connect.

    ``distinct`` has one column ``fingerprint`` without repeats. A group is a path prefix: its own
    fingerprints, and those whose prefix is one set bit away ("visitors"). Groups of more than
    ``SPLIT_ROWS`` rows are cut into chunks and every two chunks meet in a task of their own. The
    table of such groups is bounded by the number of prefixes, not of fingerprints.
    """
    if not 0 <= distance < 2 * len(RANGES):
        raise ValueError(f"distance must be 0 to {2 * len(RANGES) - 1}")
    ship(distinct.sparkSession)
    count = distinct.count()
    depth = min(max(math.ceil(math.log2(max(count, 1) / GROUP_ROWS + 1)), 6), min(RANGES))
    fp = F.col("fingerprint")
    turned = [
        F.struct(
            F.lit(turn).alias("turn"),
            (fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))).alias("path"),
        )
        for turn, by in enumerate((0, RANGES[0], RANGES[0] + RANGES[1]))
    ]
    prefix = F.shiftrightunsigned("path", 64 - depth).cast("int")
    visited = [
        F.when(F.col("prefix").bitwiseAND(F.lit(1 << b)) != 0, F.col("prefix").bitwiseXOR(F.lit(1 << b)))
        for b in range(depth if distance >= len(RANGES) else 0)
    ]
    rows = (
        distinct.select(F.inline(F.array(*turned)))
        .withColumn("prefix", prefix)
        .withColumn("to", F.explode(F.array_compact(F.array("prefix", *visited))))
        .select("turn", (F.col("to") == F.col("prefix")).alias("own"), F.col("to").alias("prefix"), "path")
    )
    crowded = (
        rows.groupBy("turn", "prefix").count().filter(F.col("count") > SPLIT_ROWS).select(
            "turn", "prefix", F.ceil(F.col("count") * 2 / SPLIT_ROWS).cast("int").alias("chunks")
        )
    ).collect()  # at most three rows for each prefix of `depth` bits
    one_task = F.concat_ws(":", "turn", "prefix")
    if crowded:
        table = distinct.sparkSession.createDataFrame(crowded, "turn int, prefix int, chunks int")
        mine = F.pmod(F.xxhash64("path"), F.col("chunks")).cast("int")
        others = F.transform(
            F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("mine")),
            lambda c: F.concat_ws(":", "turn", "prefix", F.least(c, "mine"), F.greatest(c, "mine")),
        )
        rows = rows.join(F.broadcast(table), ["turn", "prefix"], "left").withColumn("mine", mine)
        rows = rows.withColumn("group", F.explode(F.when(F.col("chunks").isNull(), F.array(one_task)).otherwise(others)))
    else:
        rows = rows.withColumn("group", one_task)
    dealt = (
        rows.select("turn", "group", "own", "path")
        .repartition("group")
        .sortWithinPartitions("turn", "group", F.desc("own"), "path")
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _whole_groups(batches):
            yield _forest(part, distance, depth)

    return dealt.mapInPandas(walk, "u bigint, v bigint")


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sorted rows in parts that hold whole groups of one turn, of about ROWS_AT_ONCE rows."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch)
        if size >= ROWS_AT_ONCE:
            rows = pd.concat(held, ignore_index=True)
            complete = (rows["group"] != rows["group"].iloc[-1]).to_numpy().nonzero()[0]
            cut = complete[-1] + 1 if len(complete) else 0
            yield from _by_turn(rows.iloc[:cut])
            held = [rows.iloc[cut:]]
            size = len(rows) - cut
    if size:
        yield from _by_turn(pd.concat(held, ignore_index=True))


def _by_turn(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, part in rows.groupby("turn", sort=True):
        yield part.reset_index(drop=True)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v): root is the component's smallest node.

    Alternates large-star and small-star steps, each written to the shared folder, until the links
    stay the same; the number of rounds grows with the logarithm of the longest chain.
    """
    edge = (F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = materialize(links.filter("u <> v").select(*edge).distinct(), "links")
    mark = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u")
        small = hooked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        found = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if found == mark:
            break
        mark = found
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 4,
    distance: int = 4,
    keep: tuple[str, ...] = (),
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """Every row's id, ``keep`` columns, fingerprint (hex) and component_id.

    Fingerprints within ``distance`` bits link. ``component_id`` is the smallest id reachable over
    links, the row's own included. Null and wordless texts have fingerprint zero and link like any
    other. Null ids count as no id: a component of only such rows has a null component_id. Repeated
    rows all come back. Other columns of ``docs`` are not read, so their names cannot clash.
    """
    found = _grouped(docs, shingle_words, distance, keep, text, id_column)
    return found.select(id_column, *keep, hex_digits("fingerprint").alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, shingle_words: int, distance: int, keep: tuple[str, ...], text: str, id_column: str) -> DataFrame:
    """Every row's id, ``keep`` columns, fingerprint, component_id and the component's smallest fingerprint, root."""
    marked = materialize(fingerprints(docs, [id_column, *keep], shingle_words, text), "fingerprints")
    distinct = materialize(
        marked.groupBy("fingerprint").agg(F.min(id_column).alias("least_id")), "distinct-fingerprints"
    )
    roots = components(link_forest(distinct.select("fingerprint"), distance))
    placed = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    answer = placed.select("fingerprint", "root").join(smallest, "root")
    return marked.join(answer, "fingerprint").select(id_column, *keep, "fingerprint", "component_id", "root")


def keep_one(docs: DataFrame, shingle_words: int = 4, distance: int = 4) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``.

    The row with the smallest doc_id stays (null ids last, then by content hash); of rows that agree
    in id, source and text one stays.
    """
    keyed = with_content_keys(docs)
    groups = _grouped(keyed, shingle_words, distance, CONTENT_KEYS, "text", "doc_id")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", *CONTENT_KEYS)
    # By root, which components without any id have too.
    winners = groups.groupBy("root").agg(F.min(first).alias("w"))
    return rows_of(keyed, winners.select(*[F.col(f"w.{c}") for c in CONTENT_KEYS]))

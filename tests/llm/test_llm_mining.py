"""Document fingerprints, centroid clustering and phrase collocations against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from buywave.llm import centroids, fingerprint, phrases
from tests.conftest import SMALL

# --- fingerprints -----------------------------------------------------------------------------


def plain_digest(body):
    """One byte triplet after the other."""
    counts = [0] * fingerprint.BUCKETS
    for i in range(len(body)):
        for kind, (a, b) in enumerate(fingerprint.TRIPLETS):
            if i + b < len(body):
                code = body[i] | body[i + a] << 8 | body[i + b] << 16 | kind << 24
                counts[(code * 0x9E3779B97F4A7C15) % (1 << 64) >> 56] += 1
    ranked = sorted(counts)
    quartiles = [ranked[len(ranked) * k // 4 - 1] for k in (1, 2, 3)]
    return [sum(c > q for q in quartiles) for c in counts], quartiles


def test_digest_equals_plain_counting(monkeypatch):
    monkeypatch.setattr(fingerprint, "BYTES_AT_ONCE", 7)
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcdefgh \xc3\xa9") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 40, 700, 0, 3000)]
    prints = fingerprint.digests(texts)
    for body, quarters in zip(texts, fingerprint._quarters(prints)):
        assert quarters.tolist() == plain_digest(body)[0]
    alone = np.vstack([fingerprint.digests([x]) for x in texts])
    assert (alone == prints).all()
    assert fingerprint.likeness(prints, prints).tolist() == [1.0] * len(texts)
    mixed = fingerprint.likeness(prints, prints[::-1])
    assert ((mixed >= 0) & (mixed <= 1)).all() and (mixed == mixed[::-1]).all()


def expected_fingerprints(rows):
    """rows in order of id: (id, text)."""
    found = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        one, two, after = (fingerprint.digests([x.encode()]) for x in (text, new, following))
        found.append(
            (i, len(text), hashlib.sha256(new.encode()).hexdigest(), one.tobytes().hex(), two.tobytes().hex(),
             float(fingerprint.likeness(one, two)[0]), float(fingerprint.likeness(one, after)[0]))
        )
    return found


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_following_documents(spark, partitions, monkeypatch):
    monkeypatch.setattr(fingerprint, "CHARS_AT_ONCE", 50)
    rng = random.Random(partitions)
    rows = [(k * 3, "".join(rng.choice("abcé  𝄞\n") for _ in range(rng.choice((0, 1, 2, 30, 200))))) for k in range(60)]
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id bigint, text string").repartition(partitions)
    found = fingerprint.fingerprint_documents(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == expected_fingerprints(rows)


def test_fingerprints_awkward(spark):
    schema = "doc_id bigint, text string, id string, t string, part int"
    row = lambda i, x: (i, x, "i", "t", 1)
    rows = [row(1, "same text"), row(1, "same text"), row(2, None), row(2, None), row(3, ""), row(4, "x" * 300_000), row(None, "no id"), row(None, None)]
    found = fingerprint.fingerprint_documents(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.n_chars for r in found) == [0, 0, 0, 0, 5, 9, 9, 300_000]
    # Equal rows follow each other, so the first is compared with itself and the second with the next id.
    assert sorted(r.near_next for r in found if r.doc_id == 1)[1] == 1.0
    assert {r.fingerprint for r in found if r.doc_id == 1}.__len__() == 1
    assert fingerprint.fingerprint_documents(spark.createDataFrame([], schema)).count() == 0
    alone = fingerprint.fingerprint_documents(spark.createDataFrame([row(5, "abcdef")], schema)).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and alone.near_next == 1.0


def test_edited_texts_are_nearer_than_following_ones(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = fingerprint.fingerprint_documents(docs).collect()
    assert len(found) == docs.count()
    assert sum(r.near_edited > r.near_next for r in found) > 0.95 * len(found)


# --- clustering -------------------------------------------------------------------------------


@pytest.mark.parametrize("largest", [3, 40, 1 << 21, 1 << 25])
@pytest.mark.parametrize("k", [1, 2, 16, 40])
def test_search_equals_all_distances(largest, k):
    rng = np.random.default_rng(k)
    rows = rng.integers(-largest, largest, size=(300, 9))
    middle = rng.integers(-largest, largest, size=(k, 9))
    middle[k // 2] = middle[0]  # a tie
    rows[:20] = middle[0]
    number, distance = centroids.Search(middle.tolist()).nearest(rows)
    for i, x in enumerate(rows.astype(object)):
        every = [(sum((x - c) ** 2), n) for n, c in enumerate(middle.astype(object))]
        assert (distance[i], number[i]) == min(every)


def test_search_fails_where_a_distance_does_not_fit():
    with pytest.raises(OverflowError):
        centroids.Search([[1 << 61, 0]]).nearest(np.array([[-(1 << 61), 0]]))


def plain_clusters(vectors, k, rounds, scale, seed):
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors]
    name = lambda i: hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    middle = [v for _, v in sorted(rows, key=lambda r: (name(r[0]), r[1]))[:k]]
    best = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(best(v)[1], []).append(v)
        middle = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(middle)]
    found = [(i, *best(v)[::-1]) for i, v in rows]
    sums = Counter()
    for _, n, d in found:
        sums[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, n, d, sums[n], sum(sums.values()), digest[n]) for i, n, d in found), key=repr)


@pytest.mark.parametrize("k, rounds", [(16, 3), (4, 0), (200, 2)])
def test_clusters_equal_plain_rounds(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(rng.choice((-1, 0, 2)), 0.3) for _ in range(5)]) for i in range(150)]
    rows += [(None, [0.5] * 5), (7, [0.25] * 5), (7, [0.25] * 5), (8, [100000.125] * 5)]
    bad = [(900, None), (901, [1.0] * 4), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [])]
    table = spark.createDataFrame([(*r, "a", 1) for r in rows + bad], "vec_id bigint, embedding array<double>, cluster string, number int").repartition(3)
    found = centroids.cluster(table, k=k, rounds=rounds, width=5, scale=64)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_clusters(rows, k, rounds, 64, 1)
    assert centroids.cluster(table.limit(0), width=5).count() == 0


# --- phrases ----------------------------------------------------------------------------------


def plain_collocations(docs, min_count, covered, top):
    counts, totals = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in docs:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    rows = []
    for lang, f in counts.items():
        names = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        scored = []
        for p, a in names.items():
            if any(100 * b >= covered * a for q, b in names.items() if len(q) > len(p) and p in (q[:2], q[1:])):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(rows)


def phrase_docs(seed):
    rng = random.Random(seed)
    words = ["of", "the", "The", "a", "é", "b\xa0c", "x|y", "word"] + [f"w{k}" for k in range(12)]
    passage = "one long passage that comes again and again without any change of its words"
    docs = []
    for k in range(80):
        text = "".join(rng.choice(words) + rng.choice("      .,\t\n") for _ in range(rng.randint(0, 120)))
        text += ". " + passage if k % 3 == 0 else ""
        docs.append((rng.choice(["en", "en", "en", "de", None, "und", "x\ty é%+"]), text))
    return docs + [(None, None), ("fr", ""), ("fr", " \t. "), ("en", "of the " * 3000)]


@pytest.mark.parametrize("covered, top, chars, frequent", [(50, 2000, 4_000_000, 20_000), (90, 20, 200, 3), (101, 2000, 50, 1)])
def test_collocations_equal_plain_counting(spark, monkeypatch, covered, top, chars, frequent):
    monkeypatch.setattr(phrases, "CHARS_AT_ONCE", chars)
    monkeypatch.setattr(phrases, "FREQUENT", frequent)
    monkeypatch.setattr(phrases, "ROWS_AT_ONCE", 500)
    docs = phrase_docs(chars)
    table = spark.createDataFrame([(*d, 1, "n") for d in docs], "lang string, text string, n int, gram string").repartition(4)
    found = phrases.collocations(table, min_count=5, covered=covered, top=top)
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(docs, 5, covered, top)


def test_paths_are_maximal_repeats(spark):
    docs = spark.createDataFrame(phrase_docs(1), "lang string, text string")
    found = {(r.lang, r.path): (r.n, r.words) for r in phrases.paths(docs, min_count=5).collect()}
    # The passage is repeated as a whole, and nothing else leads into it.
    passages = {lang: v for (lang, path), v in found.items() if path == "one long passage"}
    assert set(passages) and all(words == 14 for _, words in passages.values())


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "a b c")], "lang string, text string")).count() == 0


def test_long_text_is_cut_at_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "CHARS_AT_ONCE", 30)
    import pyarrow as pa

    text = "a b c. " * 50 + "no end here " * 20
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "t": [text, "x"]})
    parts = list(phrases.portions(iter([batch])))
    assert len(parts) > 5 and max(len(b) for _, bodies in parts for b in bodies) < 300
    words = lambda bodies: [w for b in bodies for w in b.replace(b".", b" ").split()]
    assert [w for _, bodies in parts for w in words(bodies)] == words([text.encode(), b"x"])


def test_scores_beyond_64_bits(spark):
    a, left, right = 3_000_000_007, 5_000_000_000_011, 4_000_000_000_037
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("l"), F.lit(right).alias("r"))
    assert row.select(phrases._score("a", "l", "r").alias("s")).first().s == 1_000_000 * a * a // (left * right)

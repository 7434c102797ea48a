"""Every operator and stage on Spark: brute force, and nulls, empties, ties, repeats, clashing names."""

import hashlib
import itertools
import math
import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from buywave.llm import chat, decontamination, html, licenses, mixing, quality, sharding, simhash, tokens, topk
from buywave.llm import queries as llm_queries
from tests.conftest import SMALL

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, fingerprint string, score double"


def awkward(spark, empty=False):
    """Nulls in every column, empty and long texts, repeated rows, and names the operators use inside."""
    long = " ".join(f"w{k % 911}" for k in range(60_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon.\nA second line of words here.", "en", "a", 1, "r", "f", 0.5),
        (1, "Alpha beta gamma delta epsilon.\nA second line of words here.", "en", "a", 1, "r", "f", 0.5),
        (2, "Alpha beta gamma delta epsilon.\nA second line of words here.", None, "b", None, None, None, None),
        (3, None, "en", None, 0, "r", "f", 0.1),
        (4, "", "en", "a", 0, "r", "f", 0.1),
        (None, "no id at all in this one", "en", "a", 0, "r", "f", 0.1),
        (None, None, None, None, None, None, None, None),
        (5, long, "en", "b", 0, "r", "f", 0.1),
        (6, " \t\n ", "en", "b", 0, "r", "f", 0.1),
        (7, "Licensed under the Apache License, Version 2.0.", "en", "c", 0, "r", "f", 0.1),
    ]
    return spark.createDataFrame([] if empty else rows, DOCS)


def small(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


# --- near duplicates --------------------------------------------------------------------------


def linked(prints, ids, distance):
    """Smallest id of each row's component, by comparing all pairs."""
    prints = np.array(prints, dtype=np.uint64)
    group = list(range(len(prints)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[:i]) <= distance):
            group[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(prints))]


@pytest.mark.parametrize("distance", [0, 2, 4])
@pytest.mark.parametrize("split_rows", [simhash.SPLIT_ROWS, 20])
def test_trie_join_equals_all_pairs(spark, monkeypatch, distance, split_rows):
    monkeypatch.setattr(simhash, "SPLIT_ROWS", split_rows)
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    prints = set(centres)
    for _ in range(500):
        x = rng.choice(centres[:8] + list(prints)[:50])
        for b in rng.sample(range(64), rng.randint(1, 7)):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.link_forest(spark.createDataFrame([(x,) for x in signed], "fingerprint bigint"), distance)
    root = {r.node: r.root for r in simhash.components(links).collect()}
    wanted = linked(prints, range(len(prints)), distance)
    found = {}
    for x, w in zip(signed, wanted):
        found.setdefault(root.get(x, x), set()).add(w)
    assert len(found) == len(set(wanted)) and all(len(v) == 1 for v in found.values())


def test_long_chains_are_one_component(spark):
    rows = [(k, k + 1) for k in range(300)] + [(500, 501), (7, 7)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(rows, "u bigint, v bigint")).collect()}
    assert found == {**{k: 0 for k in range(301)}, 500: 500, 501: 500}


def test_near_duplicates_of_table(spark):
    found = simhash.near_duplicates(small(spark, "documents")).orderBy("doc_id").collect()
    texts = {r.doc_id: r.text for r in small(spark, "documents").collect()}
    prints = [simhash.fingerprint(texts[r.doc_id], 4) for r in found]
    assert [r.fingerprint for r in found] == [f"{x:016x}" for x in prints]
    assert [r.component_id for r in found] == linked(prints, [r.doc_id for r in found], 4)


def test_near_duplicates_awkward(spark):
    found = simhash.near_duplicates(awkward(spark)).collect()
    assert len(found) == 10
    blank = [r for r in found if r.fingerprint == "0" * 16]
    assert len(blank) == 4 and {r.component_id for r in blank} == {3}
    assert Counter(r.component_id for r in found)[1] == 3
    assert simhash.near_duplicates(awkward(spark, empty=True)).count() == 0
    kept = simhash.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "7", "None"]
    nameless = awkward(spark).filter("doc_id is null and text is null")
    assert simhash.keep_one(nameless).count() == 1
    assert simhash.near_duplicates(nameless).first().component_id is None


def test_keep_one_of_near_copies_without_ids(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(words), " ".join(words[:1500] + ["other"] + words[1501:]), " ".join(reversed(words))]
    prints = [simhash.fingerprint(t, 4) for t in texts]
    assert 1 <= (prints[0] ^ prints[1]).bit_count() <= 4 < (prints[0] ^ prints[2]).bit_count()
    for ids, wanted in (((None, None, None), [None, None]), ((None, 2, None), [2, None]), ((5, 2, 2), [2, 2])):
        docs = spark.createDataFrame([(i, t, "en", "a") for i, t in zip(ids, texts)], "doc_id bigint, text string, lang string, source string")
        kept = simhash.keep_one(docs).collect()
        assert sorted(map(str, (r.doc_id for r in kept))) == sorted(map(str, wanted)), ids
        assert texts[2] in {r.text for r in kept}


# --- chats ------------------------------------------------------------------------------------


def test_chats_awkward(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x<|y"), (2, None, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("messages", F.lit(1))
    found = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert chat.read_turns(found[1].formatted) == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert chat.read_turns(found[None].formatted) == [("", "x<|y")]
    assert len(found[1].loss_spans) == 2 and found[2].n_turns == 1
    assert chat.format_chats(table.limit(0)).count() == 0
    parts = F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("a.png").alias("ref"), F.lit(3).alias("units")))
    typed = chat.format_chats(table, parts=F.when(F.col("conv_id") == 1, parts)).collect()
    assert sorted(r.expanded_tokens for r in typed) == [0, 0, 3 * 3 * 256]


# --- pages ------------------------------------------------------------------------------------


def test_pages_awkward(spark):
    rows = [(1, "u", None), (None, None, "<article><p>A story of some length is told here.</p></article>"), (2, "u", ""), (2, "u", "")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    found = html.extract_main_text(table).collect()
    assert sorted((r.text, r.n_chars) for r in found)[-1] == ("A story of some length is told here.", 36)
    assert [r.n_chars for r in found].count(0) == 3
    assert html.extract_main_text(table.limit(0)).count() == 0


def test_pages_of_table(spark):
    """The article's blocks and nothing of menus, adverts and footers."""
    for r in html.extract_main_text(small(spark, "pages")).join(small(spark, "pages").select("page_id", "html"), "page_id").collect():
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = [x[0] for x in html.leaf_blocks(article)]
        assert r.text == "\n".join(blocks)


# --- search -----------------------------------------------------------------------------------


def test_top_k_awkward(spark):
    rng = random.Random(6)
    rows = [(k, [rng.choice((-0.5, 0.0, 0.25, 1.0)) for _ in range(3)]) for k in range(0, 400, 2)]
    rows += [(k, [0.5, 0.5, 0.5]) for k in range(1001, 1101)]  # one vector a third of all rows share
    rows += [(None, [1.0, 1.0, 1.0]), (50_000, None), (50_050, [1.0, None, 1.0]), (50_100, [1.0, float("nan"), 1.0])]
    rows += [(50_150, [float("inf"), 0.0, 0.0]), (50_200, []), (100, [1.0, 1.0, 1.0]), (50_250, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("slab", F.lit(1))
    found = topk.top_k(table, F.col("id") % 50 == 0, slab_rows=32, group_queries=3)
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    wanted = []
    for q, a in usable:
        if q % 50 == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(a) == len(b))
            wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near[:5])]
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)
    assert topk.top_k(table.limit(0), F.col("id") % 50 == 0).count() == 0


def test_top_k_large_components_stay_exact(spark):
    rows = [(k, [float(3_000_001 + k), float(k)]) for k in range(60)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 50 == 0).collect()
    whole = {k: [math.floor(256 * x) for x in v] for k, v in rows}
    for r in found:
        assert r.score == sum(x * y for x, y in zip(whole[r.query_id], whole[r.vec_id]))


@pytest.mark.parametrize("size", [2.0**20, 2.0**22 + 0.5, 2.0**40, 2.0**45])
def test_top_k_is_exact_at_any_size(spark, size):
    rng = random.Random(3)
    rows = [(k, [rng.choice((-1, 1)) * (size + rng.randint(0, 3)) if k % 2 else rng.choice((-0.5, 0.25, 3.0)), rng.random()]) for k in range(120)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 50 == 0, slab_rows=32).collect()
    whole = {k: [math.floor(256 * x) for x in v] for k, v in rows}
    wanted = []
    for q in range(0, 120, 50):
        near = sorted((-sum(x * y for x, y in zip(whole[q], whole[i])), i) for i in whole if i != q)
        wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near[:5])]
    assert sorted(tuple(r) for r in found) == wanted


@pytest.mark.parametrize("size", [1e9, 1e17, 1e300])
def test_top_k_fails_where_a_score_does_not_fit(spark, size):
    rows = [(k, [size, float(k)]) for k in range(60)]
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 50 == 0).collect()


def test_search_slab_with_products_beyond_a_long():
    rows = np.array([[1 << 60, 1 << 60, 3], [1 << 60, -(1 << 60), 5], [1, 1, 2]], dtype=np.int64)
    queries = np.array([[1 << 58, -(1 << 58), 7]], dtype=np.int64)
    best_id, best, _ = topk.search_slab(np.array([9]), queries, np.arange(1), rows[:1], 1)
    assert best_id.tolist() == [[0]] and best.tolist() == [[21]]
    with pytest.raises(OverflowError):
        topk.search_slab(np.array([9]), queries, np.arange(3), rows, 1)


# --- mixing -----------------------------------------------------------------------------------


def targets(sizes, weights, most):
    """Sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        share = {s: most * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in full and share[s] > most * sizes[s]}
        if not over:
            return share
        full |= over


def test_targets_equal_repeated_sharing(spark):
    rng = random.Random(8)
    for n in (1, 2, 7, 12):
        sizes = {f"s{k}": rng.choice((0, 3, 50, 1000, 20_000)) for k in range(n)} | {None: 10, "é": 4, "Z": 70}
        found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"))
        wanted = targets(sizes, mixing.WEIGHTS, mixing.MOST_EPOCHS)
        for r in found.collect():
            assert r.target == pytest.approx(wanted[r.source], rel=1e-9, abs=1e-9)


def test_mix_of_table(spark):
    docs = small(spark, "documents")
    for buckets in (1, 16, mixing.BUCKETS):
        rows = mixing.mix(docs, buckets=buckets).collect()
        by = {}
        for r in rows:
            by.setdefault(r.source, []).append(r)
            assert 0 <= r.taken <= 3 * r.size
        for found in by.values():
            largest = max(r.size for r in found)
            assert sum(r.size for r in found) == found[0].source_size
            assert abs(sum(r.taken for r in found) - found[0].target) <= largest / 2 + 1
            assert len({r.epochs for r in found if r.size}) <= 2  # complete epochs, then at most one more
        if buckets > 1:
            assert sorted(map(tuple, rows)) == before  # the buckets do not change the sample
        before = sorted(map(tuple, rows))


def test_heavier_documents_are_sampled_more(spark):
    docs = spark.createDataFrame([(k, "word " * 10, "ab"[k % 2]) for k in range(4000)], "doc_id bigint, text string, source string")
    heavy = F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(0.5)
    rows = mixing.mix(docs, weights=(3.0, 1.0), quality=heavy).filter("source = 'b'").collect()
    taken = Counter(r.doc_id % 4 < 2 for r in rows if r.epochs)
    assert taken[True] > 1.3 * taken[False]


def test_mix_awkward(spark):
    rows = mixing.mix(awkward(spark)).collect()
    assert len(rows) == 10
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert {r.source_size for r in rows if r.source is None} == {0}
    assert mixing.mix(awkward(spark, empty=True)).count() == 0
    drawn = mixing.mixed_documents(awkward(spark))
    assert drawn.columns == awkward(spark).columns
    assert drawn.count() == sum(r.epochs for r in rows)


# --- token counts -----------------------------------------------------------------------------


def test_token_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = awkward(spark)
    first = tokens.count_tokens(docs, "piece_bpe_32k.model", cache, limit=20_000).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in docs.filter("doc_id is not null").collect()}
    assert len(first) == 10
    for r in first:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(model.encode(texts[r.doc_id])))
            assert r.over_limit == (r.n_tokens > 20_000)
    stored = tokens.read_cache(spark, cache)
    assert stored.count() == stored.select("digest").distinct().count() == 6
    # What is stored is not encoded again: a wrong count planted in the cache comes back.
    planted = spark.createDataFrame([(tokens.tokenizer_digest("piece_bpe_32k.model"), "0" * 64, 1)], tokens.CACHE)
    planted.withColumn("digest", F.sha2(F.lit("new"), 256)).withColumn("n_tokens", F.lit(77).cast("bigint")).write.mode("append").parquet(cache)
    again = tokens.count_tokens(spark.createDataFrame([(9, "new")], "doc_id bigint, text string"), "piece_bpe_32k.model", cache)
    assert again.first().n_tokens == 77 and tokens.read_cache(spark, cache).count() == 7
    assert tokens.count_tokens(awkward(spark, empty=True), "piece_bpe_32k.model").count() == 0


def test_token_counts_of_table(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in small(spark, "documents").collect()}
    for r in llm_queries.op6_token_counts(spark, SMALL).collect():
        assert r.n_tokens == len(model.encode(texts[r.doc_id]))


# --- benchmark --------------------------------------------------------------------------------


def test_decontamination_on_spark(spark, monkeypatch):
    docs, items = small(spark, "documents"), small(spark, "benchmark")
    rows = decontamination.contaminated(docs, items).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    texts = {r.doc_id: decontamination.words_of(r.text) for r in docs.collect()}
    wanted = set()
    for r in items.collect():
        question, answer = decontamination.question_and_answer(r.text)
        for d, words in texts.items():
            if min(decontamination.contained(question, words), decontamination.contained(answer, words)) >= 0.8:
                wanted.add((d, r.item_id))
    assert found == wanted and wanted
    kept = decontamination.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in wanted}
    monkeypatch.setattr(decontamination.indexes, "__defaults__", (7, 10**9))  # a benchmark beyond one index
    # The number of indexes changes neither what is found nor the scores.
    rounded = lambda rows: {(r.doc_id, r.item_id, round(r.score, 9)) for r in rows}
    assert rounded(decontamination.contaminated(docs, items).collect()) == rounded(rows)
    assert decontamination.clean_documents(docs, items).count() == kept.count()


def test_decontamination_awkward(spark):
    items = spark.createDataFrame([(1, None), (None, "no id at all in this one"), (2, ""), (2, "")], "item_id bigint, text string")
    found = decontamination.contaminated(awkward(spark), items).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(None, None)]
    assert decontamination.clean_documents(awkward(spark), items).count() == 9
    assert decontamination.contaminated(awkward(spark, empty=True), items).count() == 0
    assert decontamination.clean_documents(awkward(spark), items.limit(0)).count() == 10


def test_parts_of_a_benchmark_find_what_one_index_finds(spark, monkeypatch):
    rng = random.Random(12)
    items = [(k, " ".join(f"q{rng.randrange(4000)}" for _ in range(n)) + ". " + " ".join(f"a{rng.randrange(4000)}" for _ in range(12)) + ".") for k, n in enumerate((20, 24, 28, 30, 36, 40, 300))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    whole = next(decontamination.indexes(benchmark))
    assert {x.text_block for x in decontamination.indexes(benchmark, max_items=2)} == {whole.text_block}
    rows = []
    for doc in range(60):
        # Halves of an item with other words between them: whether it is found depends on the passage.
        question, answer = items[doc % 6][1].split(". ")
        filler = " ".join(f"f{rng.randrange(10**6)}" for _ in range(doc * 7 % 290))
        rows.append((doc, f"{filler} {question}. {filler} {answer} {filler}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = sorted(map(tuple, decontamination.contaminated(docs, benchmark).collect()))
    monkeypatch.setattr(decontamination, "INDEX_ITEMS", 2)
    found = sorted(map(tuple, decontamination.contaminated(docs, benchmark).collect()))
    assert wanted and [r[:2] for r in found] == [r[:2] for r in wanted]
    assert np.allclose([r[2:] for r in found], [r[2:] for r in wanted])


# --- licences ---------------------------------------------------------------------------------


def test_licenses(spark):
    notice = {name: text for name, text in reversed(licenses.TEMPLATES)}
    rows = [
        ("k1", "LICENSE", notice["MIT"]),
        ("k2", "a/b/COPYING.txt", "x y\n" + notice["GPL-3.0"] + "."),
        ("k3", "a/b/c/d/one.txt", "words"),
        ("k4", "a/one.txt", None),
        ("k5", "a/b/two.txt", "line\n" + notice["CC-BY-NC-4.0"] + ".\nmore"),
        ("k6", None, "nothing"),
        (None, "a/b/x.txt", notice["MIT"]),
        ("k7", "e/LICENSE", "no such words"),
        ("k8", "e/f.txt", "All about a licence to fish, and the copyright of songs by many hands."),
        ("k9", "", ""),
    ]
    table = spark.createDataFrame(rows, "key string, path string, text string").withColumn("dir", F.lit(1))
    found = {r.key: (r.license, r.found_in, r.license_dir) for r in licenses.scan_licenses(table).collect()}
    assert found == {
        "k1": ("MIT", "file", None),
        "k2": ("GPL-3.0", "file", None),
        "k3": ("GPL-3.0", "directory", "a/b"),
        "k4": ("MIT", "directory", ""),
        "k5": ("CC-BY-NC-4.0", "header", None),
        "k6": (None, None, None),
        None: ("GPL-3.0", "directory", "a/b"),
        "k7": ("MIT", "directory", ""),
        "k8": ("MIT", "directory", ""),
        "k9": ("MIT", "directory", ""),
    }
    assert licenses.scan_licenses(table.limit(0)).count() == 0


APACHE_START = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License.
"""


def found_licenses(spark, rows):
    table = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "key bigint, path string, text string")
    found = {r.key: (r.license, r.found_in) for r in licenses.scan_licenses(table).collect()}
    return [found[k] for k in range(len(rows))]


def test_whole_license_files(spark):
    prose = "\n".join(f"Word{k} of a long file and nothing about it." for k in range(200))
    full = dict(licenses.FULL_TEXTS)
    wrapped = {name: "Copyright (c) 2020 A. Holder\n\n" + "\n".join(textwrap.wrap(text, 72)) for name, text in full.items()}
    rows = [(f"{name}/LICENSE", text) for name, text in wrapped.items()]
    rows += [("apache/LICENSE", APACHE_START), ("long/LICENSE", f"{prose}\nLicensed under CC BY-NC 4.0.\n{prose}"), ("long/a/b.txt", "x")]
    rows += [("plain/LICENSE", f"{prose}\nCopyright of all words.\n{prose}")]
    wanted = [(name, "file") for name in wrapped]
    assert found_licenses(spark, rows) == wanted + [("Apache-2.0", "file"), ("CC-BY-NC-4.0", "file"), ("CC-BY-NC-4.0", "directory"), (None, None)]


def test_long_license_headers(spark):
    headers = {
        "We wrote all of these pages in spring. Licensed under CC BY-NC 4.0. Please send us your remarks.": "CC-BY-NC-4.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': "Apache-2.0",
        "Copyright 2020 X. All rights reserved. Licensed under the MIT license.": "MIT",
        "This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.": "GPL-3.0",
        "# SPDX-License-Identifier: MIT": "MIT",
        "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0",
        "SPDX-License-Identifier: (Zlib OR BSD-3-Clause)": "BSD-3-Clause",
        "SPDX-License-Identifier: Zlib": None,
        "SPDX-License-Identifier: GPL-1.0": None,
        "This software is released under the license of the company and may not be copied.": None,
        "Licensed under the Foo License, all uses need our written approval first.": None,
    }
    rows = [(f"{k}.txt", f"first line\n{text}\nlast line") for k, text in enumerate(headers)]
    assert found_licenses(spark, rows) == [(name, name and "header") for name in headers.values()]


# --- shards -----------------------------------------------------------------------------------


def test_shards_follow_the_method(spark):
    docs = small(spark, "documents")
    rows = sharding.assign_shards(docs, buckets=8).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    named = {d: f"9|{d}|{len(r.text.encode()) + 16}|{zlib.crc32(r.text.encode())}|1" for d, r in texts.items()}
    key = {d: int(hashlib.md5(name.encode()).hexdigest()[:13], 16) for d, name in named.items()}
    order = []
    for source in {r.source for r in texts.values()}:
        ids = sorted((d for d in texts if texts[d].source == source), key=key.get)
        order += [((k + 0.5) / len(ids), source, d) for k, d in enumerate(ids)]
    order.sort()
    wanted = {d: p * 40 // len(order) for p, (_, _, d) in enumerate(order)}
    assert {r.doc_id: r.shard for r in rows} == wanted
    for r in rows:
        body = texts[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 16, zlib.crc32(body), "rows", None)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_awkward(spark):
    rows = sharding.assign_shards(awkward(spark), shards=4).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [2, 2, 3, 3]
    assert sorted(r.size for r in rows)[:3] == [16, 16, 16]
    assert len({r.shard for r in sharding.assign_shards(awkward(spark)).collect()}) == 10
    assert sharding.assign_shards(awkward(spark, empty=True)).count() == 0
    whole = sharding.sharded_documents(awkward(spark).withColumn("shard", F.lit(-1)), shards=4)
    assert whole.count() == 10 and sorted({r.shard for r in whole.collect()}) == [0, 1, 2, 3]


def spread_docs(spark):
    """Rows of which a third has no id and a third one id, with sizes and sources that repeat."""
    ids = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id"))
    words = F.concat_ws(" ", F.array_repeat(F.lit("word"), (F.col("id") % 5 + 1).cast("int")))
    return spark.range(12_000).select(ids.cast("bigint").alias("doc_id"), words.alias("text"), F.lit("s").alias("source"))


def test_hot_ids_fill_no_bucket(spark, monkeypatch):
    from buywave.llm import common

    monkeypatch.setattr(common, "COPIES_AT_ONCE", 100)
    docs = spread_docs(spark)
    written = {}

    def seen(df, name):
        made = common.materialize(df, name)
        written[name] = made
        return made

    monkeypatch.setattr(mixing, "materialize", seen)
    monkeypatch.setattr(sharding, "materialize", seen)
    assert mixing.mix(docs, buckets=32).count() == 12_000
    assert written["mix"].groupBy("bucket").count().agg(F.max("count")).first()[0] < 1_000
    rows = sharding.assign_shards(docs, buckets=32).collect()
    assert len(rows) == 12_000 and set(Counter(r.shard for r in rows).values()) == {300}
    assert written["shuffled"].groupBy("bucket").count().agg(F.max("count")).first()[0] < 1_000
    again = sharding.assign_shards(docs.repartition(5), buckets=32).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_stages_keep_rows_that_differ_in_one_column(spark, monkeypatch):
    from buywave.llm import common

    monkeypatch.setattr(common, "COPIES_AT_ONCE", 1)
    schema = "doc_id bigint, text string, lang string, source string, tags map<string, string>"
    rows = [(1, "a b c", "en", "x", {"k": "v"}), (1, "a b c", "de", "x", {"k": "v"}), (1, "a b c", "de", "x", {"k": "w"}), (1, "a b c", None, "x", None)]
    rows += [(1, "a b c", "x", "x", None), rows[0]]
    docs = spark.createDataFrame(rows, schema)
    as_rows = lambda found: sorted(repr(tuple(r)[:5]) for r in found)
    assert as_rows(sharding.sharded_documents(docs, shards=2).collect()) == as_rows(docs.collect())
    mixed = Counter(as_rows(mixing.mixed_documents(docs, weights=(1.0,)).collect()))
    assert mixed == Counter(as_rows(docs.collect()))


# --- quality ----------------------------------------------------------------------------------


def test_quality_on_held_out_fold(spark):
    path = SMALL.replace("sf0.001", "sf0.01")
    found = llm_queries.op10_quality_classifier(spark, path)
    labels = spark.read.parquet(f"{path}/labels.parquet")
    tested = found.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in tested) / len(tested) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in tested)


def test_quality_scores_equal_enumeration(spark):
    """Every labelling of a document's lines, weighed by the field; then the mean of P(good) by line length."""
    docs = small(spark, "documents")
    chain = quality.fit_quality(docs, small(spark, "labels"))
    found = {r.doc_id: r.score for r in quality.score_quality(docs, chain, ["doc_id"]).collect()}
    compared = 0
    for r in docs.collect():
        lines = quality.lines_of(r.text)
        if len(lines) > 9:
            continue
        scores = chain.scores(quality.line_features([lines]))
        total, good = 0.0, [0.0] * len(lines)
        for labels in itertools.product((0, 1), repeat=len(lines)):
            weight = sum(scores[t][y] for t, y in enumerate(labels)) + sum(chain.transition[x][y] for x, y in zip(labels, labels[1:]))
            total += math.exp(weight)
            good = [g + math.exp(weight) * y for g, y in zip(good, labels)]
        lengths = [len(x) + 1 for x in lines]
        wanted = sum(g / total * n for g, n in zip(good, lengths)) / sum(lengths)
        assert found[r.doc_id] == pytest.approx(wanted, abs=1e-6)
        compared += 1
    assert compared > 20


def test_quality_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 0), (7, 1), (None, 1), (4, None), (99, 1)], "doc_id bigint, quality int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert len({r.score for r in found if r.doc_id == 1}) == 1
    undecided = quality.classify(docs, labels.limit(0)).collect()
    assert {round(r.score, 9) for r in undecided} == {0.5}
    assert quality.classify(awkward(spark, empty=True), labels).count() == 0
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_quality_sample_has_one_text_an_id(spark):
    docs = spark.createDataFrame([(1, f"text number {k % 50}") for k in range(500)] + [(2, "other"), (3, "a\n" * 200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, quality int")
    sample = [r for r in quality.training_lines(docs, labels, 3, 80).collect()]
    assert sorted(r.id for r in sample) == [d for d in (1, 2) if zlib.crc32(str(d).encode()) % 4 != 2]
    assert sample == quality.training_lines(docs.repartition(7), labels, 3, 80).orderBy(F.col("id")).collect() or len(sample) < 2


# --- the pipeline -----------------------------------------------------------------------------


def test_stages_by_brute_force(spark, tmp_path):
    """Each stage against what its decisions should be on the rows it was given."""
    path = SMALL
    docs = small(spark, "documents")
    given = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given[name] = {r.doc_id: r for r in docs.collect()}
        made = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        given[name + " out"] = docs.collect()
    scores = {r.doc_id: r.predicted for r in llm_queries.op10_quality_classifier(spark, path).collect()}
    assert {r.doc_id for r in given["quality classifier out"]} == {d for d, p in scores.items() if p}
    rows = sorted(given["SimHash near-dedup"].values(), key=lambda r: r.doc_id)
    first = linked([simhash.fingerprint(r.text, 4) for r in rows], [r.doc_id for r in rows], 4)
    assert {r.doc_id for r in given["SimHash near-dedup out"]} == set(first)
    items = [tuple(r) for r in small(spark, "benchmark").collect()]
    index = decontamination.build_index(items)
    rows = list(given["benchmark decontamination"].values())
    held = {rows[d].doc_id for d, *_ in decontamination.search([r.text for r in rows], index, 0.6)}
    assert {r.doc_id for r in given["benchmark decontamination out"]} == {r.doc_id for r in rows} - held
    sizes = Counter()
    for r in given["mixing sources to target weights"].values():
        sizes[r.source] += len(r.text.split())
    wanted = targets(sizes, mixing.WEIGHTS, mixing.MOST_EPOCHS)
    taken = Counter()
    for r in given["mixing sources to target weights out"]:
        taken[r.source] += len(r.text.split())
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= max(len(r.text.split()) for r in given["mixing sources to target weights"].values() if r.source == s) / 2 + 1
    shards = Counter(r.shard for r in given["sharding out"])
    assert max(shards.values()) - min(shards.values()) <= 1
    assert len(given["sharding out"]) == len(given["mixing sources to target weights out"])


def test_stages_awkward(spark, tmp_path):
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for empty in (False, True):
        docs = awkward(spark, empty)
        for _, stage in corpus_pipeline.STAGES:
            assert (stage(spark, docs, str(tmp_path)).count() == 0) == empty or not empty


def test_registered_with_twins():
    names = entry_points.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{n}" for n in range(1, 11)}
    assert "pipeline" in names and set(llm_queries.ORACLES) <= set(names)

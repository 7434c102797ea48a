"""The chain field, page blocks, chat template, token chunks and shingle search, without Spark."""

import itertools
import random
import re
import time

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from buywave.llm import chat, crf, decontamination, html, quality, simhash, tokens, topk


def paths(scores, transition):
    """Weight of every labelling of one sequence."""
    for labels in itertools.product((0, 1), repeat=len(scores)):
        total = sum(scores[t][y] for t, y in enumerate(labels))
        yield labels, total + sum(transition[a][b] for a, b in zip(labels, labels[1:]))


def test_marginals_and_viterbi_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 6, 2])
    scores, transition = rng.normal(size=(12, 2)), rng.normal(size=(2, 2))
    found, best = crf.marginals(scores, transition, lengths), crf.viterbi(scores, transition, lengths)
    at = 0
    for n in lengths:
        ways = list(paths(scores[at : at + n], transition))
        total = sum(np.exp(w) for _, w in ways)
        for t in range(n):
            assert found[at + t] == pytest.approx(sum(np.exp(w) for y, w in ways if y[t] == 1) / total)
        assert tuple(best[at : at + n]) == max(ways, key=lambda x: x[1])[0]
        at += n
    assert len(crf.marginals(np.zeros((0, 2)), transition, np.array([], dtype=int))) == 0


def test_fit_learns_the_transition():
    """Single rows say little; that labels come in runs must be learnt."""
    rng = np.random.default_rng(2)
    labels = np.repeat(rng.integers(0, 2, 200), 8)
    features = (labels + rng.normal(scale=1.2, size=len(labels)))[:, None]
    lengths = np.full(len(labels) // 40, 40)
    chain = crf.fit(features, labels, lengths)
    decoded = crf.viterbi(chain.scores(features), chain.transition, lengths)
    alone = (features[:, 0] > 0.5).astype(int)
    assert (decoded == labels).mean() > (alone == labels).mean() + 0.1
    assert chain.transition[0, 0] > chain.transition[0, 1]


def test_quality_lines():
    assert quality.lines_of("") == [""] and quality.lines_of("\n \n") == [""]
    assert quality.lines_of("a\n\nb") == ["a", "b"]
    assert quality.line_features([[""], ["x" * 10, "A B"]]).shape == (3, quality.WIDTH)


def test_head_without_end_tag():
    head = "<!DOCTYPE html><html><head><meta charset=utf-8><title>t</title><style>p{}</style><script>var a='<p>';</script>\n"
    for body in ("<body><p>a<p>b", "<p>a<p>b</html>", "<img src=x><div>a</div><div>b</div>", "a<p>b", "</head><body><p>a<p>b"):
        assert [x[0] for x in html.leaf_blocks(head + body)] == ["a", "b"], body
    assert html.leaf_blocks(head + "<template><p>x</p></template><noscript><p>y</p></noscript></head>") == []


def test_long_attributes():
    style, words = f' style="{"margin:0;" * 500}"', f" data-page='{'<p class=\"comment\"> id=menu ' * 100}'"
    for attributes in ('class="advert"', "id=advert", 'CLASS = "x advert"'):
        short = html.leaf_blocks(f"<div {attributes}>a</div>")
        assert short[0][2][0][1] and html.leaf_blocks(f"<div{style}{words} {attributes}>a</div>") == short
        assert html.leaf_blocks(f"<div {attributes}{words}{style}>a</div>") == short


def test_page_blocks():
    page = "<body><p>a <b>b</b>&amp;c<p>d<br>e &lt; f<ul><li>x<li>y</ul><script>if (a<b) {'<p>no'}</script><!-- no --><div>z<"
    assert [x[0] for x in html.leaf_blocks(page)] == ["a b&c", "d e < f", "x", "y", "z<"]
    assert html.leaf_blocks("") == [] and html.leaf_blocks("<p>\xa0\n</p>") == []
    nested = html.leaf_blocks('<nav class="menu"><a href=x>go</a></nav>')
    assert nested[0][1] == 2 and [t for t, _ in nested[0][2]] == ["nav"]


@pytest.mark.parametrize("unit", ["<div>one word", '<a "', '<a ">" ', "<b></i>", "<p class='ad'>t", "<x1 class=ad><div>w ", "<!", "<ul><li>x</p>"])
def test_long_pages_take_time_in_proportion(unit):
    took = []
    for size in (500_000, 5_000_000):
        page = unit * (size // len(unit))
        start = time.process_time()
        html.block_features(html.leaf_blocks(page))
        took.append(time.process_time() - start)
    assert took[1] < 25 * took[0] + 2


def test_tags_end_outside_quotes():
    assert [x[0] for x in html.leaf_blocks('<p title="a > b">x<p title=\'">\'>y<p title="z>w<p>v')] == ["x", "y", "w", "v"]
    assert [x[0] for x in html.leaf_blocks("a<b>c</b><!-- d <p>e")] == ["ac"]


HAND_MADE = {
    "article in a table": (
        "<html><head><title>T</title></head><body><table><tr><td class='nav'><ul><li><a href=/a>Start</a></li><li><a href=/b>Shop</a></li></ul></td>"
        "<td class='content'><h1>How bread rises in the oven</h1><p>Yeast turns sugar into gas, and the gas lifts the dough while it is warm.</p>"
        "<p>A hot oven sets the crumb before the gas can leave it again, so the loaf stays high.</p></td></tr></table>"
        "<div class='footer'>© 2020 Bakers. All rights reserved.</div></body></html>",
        ["How bread rises in the oven", "Yeast turns sugar into gas, and the gas lifts the dough while it is warm.",
         "A hot oven sets the crumb before the gas can leave it again, so the loaf stays high."],
    ),
    "main without article": (
        "<body><header class='masthead'><a href='/'>The Daily Pages</a></header><nav><a href=1>News</a> <a href=2>Sport</a></nav><main>"
        "<h2>The river is back in its bed</h2><p>After three weeks of rain the water has gone down, the mayor said on Monday.</p>"
        "<p>Most of the roads along the banks can be used again from tomorrow, but two bridges stay closed.</p></main>"
        "<aside class='sidebar'><h3>Most read</h3><ul><li><a href=x>Ten tips</a></li></ul></aside>"
        "<section id='comments'><h3>Comments</h3><div class='comment'><p>Thanks for writing this, I was there too.</p></div></section>"
        "<footer><p>Imprint | Privacy | Terms</p></footer></body>",
        ["The river is back in its bed", "After three weeks of rain the water has gone down, the mayor said on Monday.",
         "Most of the roads along the banks can be used again from tomorrow, but two bridges stay closed."],
    ),
}


@pytest.mark.parametrize("name", HAND_MADE)
def test_hand_made_layouts(name):
    page, wanted = HAND_MADE[name]
    assert html.extract_texts([page], html.fit_extractor())[0] == "\n".join(wanted)


def test_extractor_on_unseen_layouts():
    chain = html.fit_extractor()
    wrong = total = 0
    for page, labels in html.labelled_pages(150, seed=123) + html.labelled_old_pages(40, seed=124):
        blocks = html.leaf_blocks(page)
        assert len(blocks) == len(labels)
        wanted = "\n".join(b[0] for b, y in zip(blocks, labels) if y)
        wrong += html.extract_texts([page], chain)[0] != wanted
        total += 1
    assert wrong / total < 0.05
    assert html.extract_texts(["", "<p>"], chain) == ["", ""]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab<|\\>\n"), st.lists(st.text("<|\\im_end>\na"), max_size=3)), max_size=4))
def test_chat_round_trip(turns):
    done = chat.format_conversation([(role, [{"type": "text", "text": t} for t in texts]) for role, texts in turns])
    assert chat.read_turns(done["formatted"]) == [(role, "".join(texts)) for role, texts in turns]


def test_chat_parts():
    parts = [
        {"type": "text", "text": "see <|image_0|>"},
        {"type": "image", "ref": "s3/a.png", "units": 2},
        {"type": "audio", "ref": "b.wav", "units": 3},
        {"type": "document", "ref": "c.pdf"},
        {"type": "video", "text": "kept"},
    ]
    done = chat.format_conversation([("user", parts), ("assistant", [{"type": "text", "text": "ok<|im_end|>"}])])
    assert [(a["type"], a["ref"], a["tokens"], a["turn"]) for a in done["attachments"]] == [
        ("image", "s3/a.png", 512, 0),
        ("audio", "b.wav", 75, 0),
        ("document", "c.pdf", 512, 0),
    ]
    for a in done["attachments"]:
        assert done["formatted"][a["position"] :].startswith(f"<|{a['type']}_{a['number']}|>")
    assert done["expanded_tokens"] == 512 + 75 + 512
    (span,) = done["loss_spans"]
    assert chat.unescape(done["formatted"][span["start"] : span["stop"]]) == "ok<|im_end|>"
    with pytest.raises(ValueError):
        chat.read_turns("x" + done["formatted"])


PIECES = "piece_bpe_32k.model"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t  <s>/▁①x\xa0　"))
def test_word_counts_equal_the_library(text):
    model = _model()
    assert tokens._counter_of(PIECES)(text) == len(model.encode(text))


_models = {}


def _model():
    if not _models:
        _models[0] = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path(PIECES))
    return _models[0]


def test_json_tokenizer_counts():
    assert tokens.counter("byte_bpe_50k.json")("") == 0
    assert tokens.counter("byte_bpe_50k.json")("hello world") == 2


def test_fingerprint_equals_bit_counts():
    import xxhash

    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 70):
        words = [rng.choice(["Ab", "é", "x,", "long-word"]) for _ in range(n)]
        text = "\t".join(words)
        lower = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
        shingles = [" ".join(lower[k : k + 4]) for k in range(max(n - 3, min(n, 1)))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        wanted = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text, 4) == (wanted if n else 0)


def test_search_slab_breaks_ties_by_id_and_prunes_nothing_needed():
    rng = np.random.default_rng(5)
    rows = rng.integers(-2, 3, size=(700, 4)).astype(np.float64)
    ids = rng.permutation(700)
    queries, query_ids = rows[:40], ids[:40]
    best_id, best, found = topk.search_slab(query_ids, queries, ids, rows, 5, block_rows=32)
    for q in range(40):
        ranked = sorted((-int(s), i) for s, i in zip(rows @ queries[q], ids) if i != query_ids[q])[:5]
        assert [(-s, i) for s, i in zip(best[q], best_id[q])] == ranked and found[q].all()


ITEM = "The quick brown fox jumps over the lazy dog near a river bank. It was seen by seven old men from town."


def brute_force(texts, items):
    """Pairs whose question and answer shingles the whole document has."""
    out = set()
    for d, text in enumerate(texts):
        words = decontamination.words_of(text)
        for i, item in items:
            question, answer = decontamination.question_and_answer(item)
            if (question or answer) and min(decontamination.contained(question, words), decontamination.contained(answer, words)) >= 0.8:
                out.add((d, i))
    return out


def test_decontamination_equals_brute_force():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    items = [(i, " ".join(sentence(rng.randint(4, 30)) for _ in range(rng.randint(1, 3)))) for i in range(60)]
    items += [(100, ITEM), (101, ""), (102, " ".join(sentence(300) for _ in range(3)))]
    texts = [sentence(rng.randint(0, 500)) for _ in range(80)]
    for k in range(0, 80, 3):
        at = rng.randint(0, len(texts[k]))
        at = texts[k].find(" ", at) if " " in texts[k][at:] else 0
        texts[k] = texts[k][:at] + " %% " + rng.choice(items)[1].upper() + "$$ " + texts[k][at:]
    texts += ["", " ", items[-1][1], ITEM.split(". ")[0], "x " * 3000 + ITEM + " y" * 3000]
    for block_items in (1, 2, 7):
        index = decontamination.build_index(items, block_items)
        found = {(d, index.items[i][0]) for d, i, *_ in decontamination.search(texts, index, 0.6, block_items)}
        assert found == brute_force(texts, items)
    assert decontamination.search(texts, decontamination.build_index([]), 0.6) == []


@pytest.mark.parametrize("threshold, slack", [(0.6, 0.5), (0.6, 0.1), (0.3, 0.24)])
def test_block_max_search_retrieves_what_plain_scores_retrieve(monkeypatch, threshold, slack):
    """All (text, item) pairs by adding up the impacts of every passage, without pruning and without verification."""
    monkeypatch.setattr(decontamination, "SUMS_AT_ONCE", 200)
    monkeypatch.setattr(decontamination, "OVERLAP", 0.0)
    rng = random.Random(int(100 * slack))
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 2) for k in range(60)]
    line = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    items = [(k, line(rng.randint(3, 30)) + ". " + line(rng.randint(1, 6))) for k in range(80)]
    texts = [line(rng.randint(0, 300)) + " " + rng.choice(items)[1] + " " + line(40) for _ in range(25)] + ["", "w1"]
    index = decontamination.build_index(items, slack=slack)
    places = {h: k for k, h in enumerate(index.hashes.tolist())}
    wanted = set()
    for d, text in enumerate(texts):
        hashes = decontamination.word_hashes([decontamination._word_bytes(text)])[0].tolist()
        for at in range(0, len(hashes), index.text_block):
            terms = {places[h] for h in hashes[at : at + 2 * index.text_block] if h in places}
            for entry, impacts in enumerate(index.impacts):
                if sum(x for t, x in impacts.items() if t in terms) >= threshold:
                    wanted.add((d, int(index.entry_item[entry])))
    assert {(d, i) for d, i, *_ in decontamination.search(texts, index, threshold)} == wanted and len(wanted) > 20
    with pytest.raises(ValueError, match="slack"):
        decontamination.search(texts, index, slack / 2)

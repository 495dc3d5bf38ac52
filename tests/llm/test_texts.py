"""Packing, pieces, extraction, classifiers, line labelling and the pipeline."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import crf, html, packing, pieces, pu, quality, toxicity
from textlab.llm.common import read_table
from textlab.llm.queries import LLM_ORACLE, LLM_QUERIES, vocabulary
from tests.llm.conftest import ODD, SF

TOKENIZER = vocabulary(packing.TOKENIZER)
MODEL = vocabulary(pieces.MODEL)


def whole_ids(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOKENIZER)
    return [e.ids + [2] for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_word_by_word_ids_are_the_tokenizers(sf_rows):
    odd = ["", "İstanbul Σας ΟΔΟΣ it's IT'S <|endoftext|> x<|startoftext|>y é é", "½ ² Ⅷ 中文字 don't 'Ll rock'n'roll'ten\x1cfoo\x85bar",
           "ﬁ ǅ Ǆungla ß ẞ  ‑ naïve—dash “q” a​b ÅÅÅ 10×20÷3", "𝔘𝔫𝔦 ﻿ e̅x ŉ ª º"]
    texts = odd + [t for _, t in sf_rows[:150]]
    coder = packing.coder(TOKENIZER)
    for t, ids in zip(texts, whole_ids(texts)):
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == ids[:-1], t[:60]


def test_ids_of_every_byte_alone_and_between_letters():
    texts = [x for b in (*range(0x00, 0x100), 0x2028, 0x3000, 0xAD, 0x200B) for c in [chr(b)]
             for x in (c, f"a{c}b", f"1{c}'ve", f"I'VE{c} {c}x", f"é{c}é", f"{c}{c}\x1c{c}")]
    coder = packing.coder(TOKENIZER)
    for t, ids in zip(texts, whole_ids(texts)):
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == ids[:-1], repr(t)


def test_three_limits_through_the_dataframe(spark):
    rng = random.Random(12)
    word = lambda n: " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(n))
    rows = [(i, [(word(rng.randrange(30)), False), (word(rng.randrange(60)), True)] * rng.randrange(1, 3)) for i in range(150)]
    rows += [(900, None), (901, []), (902, [None, ("x", None)]), (903, [(None, True)]), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, parts array<struct<text string, loss boolean>>").repartition(2)
    limits = packing.Limits(tokens=256, segments=4, loss=100)
    got = packing.packed_examples(df, TOKENIZER, limits).collect()
    tokens, segments, loss, by_doc = Counter(), Counter(), Counter(), Counter()
    for r in got:
        tokens[r["sequence_id"]] += r["length"]
        segments[r["sequence_id"]] += 1
        loss[r["sequence_id"]] += r["loss_tokens"]
        by_doc[r["doc_id"]] += r["length"]
    ids = lambda t: len(whole_ids([t or ""])[0]) - 1
    want = Counter()
    for i, parts in rows:
        want[i] += 1 + sum(ids(p[0]) for p in parts or [] if p)
    assert by_doc == want
    bears = sum(ids(p[0]) for _, parts in rows for p in parts or [] if p and p[1]) + sum(
        bool(parts and parts[-1] and parts[-1][1]) for _, parts in rows)
    assert sum(loss.values()) == bears
    assert max(segments.values()) <= 4 and max(loss.values()) <= 100 and max(loss.values()) > 90
    assert all(n == 256 or n & (n - 1) == 0 for n in tokens.values())
    assert packing.packed_examples(df.limit(0), TOKENIZER).count() == 0


def check_pieces(rows, docs, limits=packing.Limits()):
    """Every id in exactly one piece, sequences gapless, padding none, limits kept."""
    want = Counter()
    for (i, _), ids in zip(docs, whole_ids([t or "" for _, t in docs])):
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == limits.tokens or at & (at - 1) == 0 and at < limits.tokens
        assert len(members) <= limits.segments
    assert sum(r["length"] for r in rows) == sum(n * k for (_, n, _), k in want.items())
    return by_doc


def test_packing_keeps_every_id_once(docs_of, sf_rows):
    docs = sf_rows[:200]
    rows = packing.packed_pieces(docs_of(docs, extra=("start",)).repartition(3), TOKENIZER).collect()
    by_doc = check_pieces(rows, docs)
    for (i, _), ids in zip(docs, whole_ids([t for _, t in docs])):
        at = 0
        for r in sorted(by_doc[i, len(ids)], key=lambda r: r["start"]):
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4")
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing_of_odd_rows(docs_of):
    check_pieces(packing.packed_pieces(docs_of(ODD), TOKENIZER).collect(), ODD)
    assert packing.packed_pieces(docs_of([]), TOKENIZER).count() == 0


def test_packing_keeps_all_three_limits():
    rng = random.Random(9)
    limits = packing.Limits(tokens=512, segments=6, loss=200)
    examples, size = [], {}
    for k in range(400):
        n = rng.randrange(1, 900)
        bears = np.array([rng.random() < 0.5 for _ in range(n)])
        examples.append((k, n, np.concatenate(([0], np.cumsum(bears)))))
        size[k] = n
    marks = {k: m for k, _, m in examples}
    tokens, segments, loss, got = Counter(), Counter(), Counter(), Counter()
    for p in packing.pack(examples, limits):
        tokens[p.sequence] += p.length
        segments[p.sequence] += 1
        loss[p.sequence] += marks[p.example][p.start + p.length] - marks[p.example][p.start]
        got[p.example] += p.length
    assert got == size
    assert max(segments.values()) <= 6 and max(loss.values()) <= 200
    assert all(n == 512 or n & (n - 1) == 0 for n in tokens.values())


def slow_segmentation(model, text):
    """Best score of ``text`` by trying every piece at every position, and each byte step."""
    best = [0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + pieces._UNCOVERED
        for start in range(max(0, end - 16), end):
            if (found := model.scores.get(text[start:end])) and best[start] + found[1] > best[end]:
                best[end] = best[start] + found[1]
    return best[-1]


def score_of(model, ids):
    """Score of a segmentation; the bytes of one character cost one step."""
    piece_of = {i: s for i, s in model.scores.values()}
    total = 0
    for i in ids:
        if i in piece_of:
            total += piece_of[i]
        elif model.raw[i][0] & 0xC0 != 0x80:
            total += pieces._UNCOVERED
    return total


PIECE_TEXTS = ["", " ", "a", "  two  spaces   three ", "line\nline\n\nend", "punctuation, here. (and) there!?", "中文字 \U0001f600\U0001f9ff xyz",
               "\t\x00\x7f é́ ﬁ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "🙂" * 30, "▁ mark", " \n \n"]


def test_viterbi_is_the_best_segmentation(sf_rows):
    model = pieces.model(MODEL)
    for t in PIECE_TEXTS + [t[:300] for _, t in sf_rows[:40]]:
        marked = pieces.MARK + t.replace(" ", pieces.MARK)
        assert score_of(model, model.segment(marked)) == slow_segmentation(model, marked), t[:50]


def test_ids_are_the_librarys(sf_rows):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = pieces.model(MODEL)
    code = ["def f(x):\n        return x + 1  # ok\n", " " * 40 + "the end" + " " * 33, "a.b,c;d:e!f?g ...,,,!!!", "日本語のテキスト。 Привет мир",
            "Machine learning models process natural language text, and researchers evaluate them carefully."]
    for t in PIECE_TEXTS[:-2] + code + [t for _, t in sf_rows[:300]]:
        assert np.frombuffer(model.encode(t), "<i4").tolist() == library.encode(t), t[:50]


def test_decoding_restores_texts(docs_of, sf_rows):
    rows = [(n, t) for n, t in enumerate(PIECE_TEXTS)] + ODD + sf_rows[:80]
    docs = docs_of(rows, extra=("ids",))
    coded = pieces.piece_ids(docs, MODEL)
    got = coded.collect()
    assert len(got) == len(rows) and all(r["restored"] for r in got)
    assert all(r["n_ids"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes()) for r in got)
    texts = Counter((r["doc_id"], r["text"]) for r in pieces.piece_texts(coded, MODEL).collect())
    assert texts == Counter((i, (t or "").replace("▁", " ")) for i, t in rows)
    assert pieces.piece_ids(docs_of([]), MODEL).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- note <p>no</p> --><div class="cookie-notice">We use cookies</div>
<article><h1>Head&shy;line &lt;1&gt;</h1><p><b>First &eacute;l&#233;ment
  here<br>and on<p>Second <i>one</i>, open<form><input value="a > b"><p>Sign up</p></form><aside>Side</aside><p>Third</p>
<section id="comments"><p>A reader says</p></section></article><div class="sidebar"><p>More</p></div><footer>&copy; us</footer>"""


def test_zones_of_a_page():
    assert main_text(PAGE) == "Head\xadline <1>\nFirst élément here and on\nSecond one, open\nThird"


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain text only", "plain text only"), ("<p>a<p>b", "a\nb"), ("</p>x</div>y", "x\ny"), ("<p unclosed='", ""),
    ("a < b &amp; c > d", "a < b & c > d"), ("<script>x", ""), ("<div>a<span>b</span>c</div>", "abc"), ("<!-- never ends", ""),
    ("<main><p>in</p></main><p>out</p>", "in"), ("<p hidden>x</p><p>y</p>", "y"), ("<head><title>t</title><body>b", "b")])
def test_broken_and_small_pages(page, text):
    assert main_text(page) == text


def main_text(page):
    return html.main_text(html.page_blocks(page))


@pytest.mark.parametrize("page,text", [
    # marks of a page's wrapper do not hold back the article
    ('<div class="layout has-sidebar"><article><p>a</p></article><div class="sidebar">s</div></div>', "a"),
    ('<div id="page" class="page sidebar-left"><nav>n</nav><main><p>a</p></main></div>', "a"),
    ('<form id="aspnetForm"><div class="header">h</div><main>a</main></form>', "a"),
    ('<div class="content with-sidebar no-banner">a</div><div class="sidebar">s</div>', "a"),
    ('<article class="post has-sidebar"><div class="entry is-widget">a</div></article>', "a"),
    # hidden and display:none by attribute, not by words in other values
    ('<article class="md hidden lg">a</article>', "a"), ('<div title="the hidden cost of war">a</div>', "a"),
    ('<p hidden>x</p><p hidden="until-found">y</p><p style="color:red; display : none">z</p><p data-style="display:none">a</p>', "a"),
    # reader comments as articles, beside the article and inside it
    ('<article><p>a</p></article><article class="comment">c</article><div id="comments"><article>d</article></div>', "a"),
    ('<article><p>a</p><article class="comment-body">c</article><form>f</form></article>', "a"),
    # the headline in an article's header stays, its byline goes
    ('<article><header><h1>T</h1><p>by B</p></header><p>a</p><footer>f</footer></article>', "T\na"),
    ('<header><h1>Site</h1></header><article>a</article>', "a")])
def test_layouts_of_themes(page, text):
    assert main_text(page) == text

def test_suffix_ranks_order_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(30):
        tokens = rng.integers(0, 3, 60).astype(np.uint64)
        ranks = html.suffix_ranks(tokens, 10)
        prefix = [tuple(tokens[i:i + 10].tolist()) for i in range(60)]
        order = {p: n for n, p in enumerate(sorted(set(prefix)))}
        assert (np.argsort(np.argsort(np.unique(ranks))) == np.arange(len(order))).all()
        assert [order[p] for p in prefix] == (np.unique(ranks, return_inverse=True)[1]).tolist()


def loose_pages():
    notice = "sign up for our weekly letter and never miss a story again"
    rows = [(n, f"http://h.example/{n}", f"<div>{notice}</div><div>story number {n} tells of {n * 7} things, page {n} only</div>"
             f"<div>tail {n} {notice}</div>") for n in range(12)]
    rows += [(100, "http://other.example/", f"<div>{notice}</div>"), (101, None, None), (102, "x", ""), (103, "http://h.example/z", "<article><p>" + notice + "</p></article>")]
    return rows, notice


def test_repeated_substrings_of_a_host_go(spark):
    rows, notice = loose_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html.extract_pages(pages).collect()}
    for n in range(12):
        assert got[n] == f"story number {n} tells of {n * 7} things, page {n} only\ntail {n}"
    assert got[100] == notice  # on one page of that host only
    assert got[101] == got[102] == "" and got[103] == notice
    assert html.extract_pages(pages.where("page_id < 0")).count() == 0


def extracted(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    return {r["page_id"]: r["text"] for r in html.extract_pages(pages).collect()}


def story(n):
    return " ".join(f"w{n}x{k}" for k in range(14))


def test_unmarked_notices_in_articles_go(spark):
    notice = "<div>sign up for our weekly letter</div><div>and never miss a story again</div>"
    rows = [(n, "http://h.example/", f"<article><p>{story(n)}</p>{notice}<p>Share this</p></article>") for n in range(12)]
    rows += [(100 + n, "http://h.example/", f"<article><p>{story(100 + n)} {story(999)}</p></article>") for n in range(3)]
    got = extracted(spark, rows)
    for n in range(12):
        assert got[n] == story(n)
    for n in range(100, 103):  # a long quotation of three pages stays
        assert got[n] == f"{story(n)} {story(999)}"


def test_short_blocks_of_a_host_go(spark):
    menu = "<ul><li>Home</li><li>World news</li><li>Sport</li><li>Letters to the editor</li><li>About us all</li></ul>"
    rows = [(n, "http://h.example/", f"{menu}<div>{story(n)}</div><div>By {n}</div><div>All rights reserved</div>") for n in range(9)]
    got = extracted(spark, rows)
    assert all(got[n] == f"{story(n)}\nBy {n}" for n in range(9))


def test_copies_of_a_page_keep_their_text(spark):
    notice = "this paper is free for all of its readers every day of the week"
    rows = [(n, "http://h.example/", f"<div>{story(n // 4)}</div><div>{notice}</div>") for n in range(16)]
    rows += [(n, "http://two.example/", f"<div>{story(7)}</div>") for n in range(20, 24)]  # one page, four times
    rows += [(30, "http://h.example/", f"<div>{story(30)} {story(99)}</div>"), (31, "http://h.example/", f"<div>{story(31)} {story(99)}</div>")]
    got = extracted(spark, rows)
    assert all(got[n] == story(n // 4) for n in range(16)) and all(got[n] == story(7) for n in range(20, 24))
    assert all(got[n] == f"{story(n)} {story(99)}" for n in (30, 31))


def test_extraction_gives_the_articles(spark):
    for r in html.extract_pages(read_table(spark, SF, "pages")).join(read_table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert "".join(r["text"].split()) == "".join(__import__("html").unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert r["n_chars"] == len(r["text"])


def test_positive_unlabelled_fit_recovers_a_mark():
    rng = np.random.default_rng(2)

    def row(toxic):
        words = rng.integers(10, 400, 40)
        return np.unique(np.append(words, rng.integers(0, 4)) if toxic else words).astype(np.int32)
    rows = [(x := row(k % 10 == 0), np.ones(len(x), np.float32)) for k in range(3000)]
    pos = [(x := row(True), np.ones(len(x), np.float32)) for _ in range(150)]
    model = pu.fit_rows(pu.Rows.of(pos), pu.Rows.of(rows), 0.1, pu.Fit(dims=512, purity=0.4, sigmas=5.0))
    hit = [model.score(*r) >= 0.5 for r in rows]
    assert sum(hit[::10]) >= 295 and sum(hit) - sum(hit[::10]) <= 5


def test_fit_without_positives_scores_the_prior():
    model = pu.fit_rows(pu.Rows.of([]), pu.Rows.of([(np.array([1]), np.ones(1))]), 0.2)
    assert model.score(np.empty(0, int), np.empty(0)) == pytest.approx(0.2)


@pytest.mark.parametrize("name,label,threshold,least", [("op2_toxicity", "toxic", 0.5, 0.9), ("op10_quality", "quality", 0.7, 0.95)])
def test_held_out_accuracy(spark, name, label, threshold, least):
    rows = LLM_QUERIES[name](spark, SF).join(read_table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r[label] for r in rows) / len(rows) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in rows)


@pytest.mark.parametrize("scores", [toxicity.toxicity_scores, quality.quality_scores])
def test_scores_of_odd_rows(spark, docs_of, scores):
    labels = read_table(spark, SF, "labels")
    docs = docs_of(ODD, extra=("score", "positive"))
    got = scores(docs, labels).collect()
    assert len(got) == len(ODD)
    same = {r["score"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(same) == 1
    assert scores(docs_of([]), labels).count() == 0
    none = scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def slow_counts(text):
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_base_counts_are_the_definition(sf_rows):
    odd = ["", "a a a a", "a b c a b c", "x\n\nx\nx \n y", "a\x0bb\x0cc\x1cd\x85e f g", "é é é é # | <", " \n", "q " * 999]
    for t in odd + [t for _, t in sf_rows[:200]]:
        assert tuple(crf.base_counts(t, crf.split_words(t))) == slow_counts(t), t[:40]


def test_likelihood_and_gradient_match_enumeration():
    rng = np.random.default_rng(5)
    parts = [([[int(k) for k in rng.choice(crf.N_FEATURES, 3, replace=False)] for _ in range(n)],
              [int(x) for x in rng.integers(0, 2, n)]) for n in (1, 4, 2, 3)]
    weight = rng.random(len(parts)) + 0.1
    emit, move = rng.normal(size=(crf.N_FEATURES, 2)), rng.normal(size=(2, 2))
    likelihood = crf.Likelihood(parts, weight)

    def score(feats, states):
        return sum(emit[x, s].sum() for x, s in zip(feats, states)) + sum(move[a, b] for a, b in zip(states, states[1:]))

    want = 0.0
    for w, (feats, states) in zip(weight, parts):
        every = [score(feats, s) for s in itertools.product((0, 1), repeat=len(feats))]
        want += w * (np.logaddexp.reduce(every) - score(feats, states))
    value, g_emit, g_move = likelihood(emit, move)
    assert value == pytest.approx(want)
    for table, grad in ((emit, g_emit), (move, g_move)):
        for at in [(0, 0), (1, 1)] + [(int(k), 1) for k in parts[1][0][0]] * (table is emit):
            table[at] += 1e-5
            up = likelihood(emit, move)[0]
            table[at] -= 2e-5
            down = likelihood(emit, move)[0]
            table[at] += 1e-5
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_texts_of_two_halves_keep_their_content_lines(spark):
    """Labels of the fold crc32 mod 4 = 2 are not learnt from; its good and bad texts are joined."""
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    labels = read_table(spark, SF, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    chain = crf.learn_chain(docs, labels.where(~held))
    rows = docs.join(labels.where(held), "doc_id").orderBy("doc_id").collect()
    long = [[r["text"] for r in rows if r["quality"] == q and len(crf.text_lines(r["text"] or "")[0]) > 3] for q in (1, 0)]
    kept = lost = both = 0
    for good, bad in zip(*long):
        lines = len(crf.text_lines(good)[0])
        states = chain.viterbi(crf.text_lines(good + "\n" + bad)[0])
        both += len(set(states)) == 2
        kept += sum(s == crf.CONTENT for s in states[:lines])
        lost += lines
    assert lost and kept / lost >= 0.8
    if min(map(len, long)) >= 5:
        assert both >= 0.7 * min(map(len, long))


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(3)
    chain = crf.Chain(rng.normal(size=(crf.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        feats = [sorted(rng.choice(crf.N_FEATURES, 3, replace=False).tolist()) for _ in range(n)]

        def value(states):
            return sum(chain.emit[f, s].sum() for f, s in zip(feats, states)) + sum(chain.move[a, b] for a, b in zip(states, states[1:]))
        paths = [[code >> i & 1 for i in range(n)] for code in range(1 << n)]
        assert value(chain.viterbi(feats)) == pytest.approx(max(map(value, paths)))
    assert chain.viterbi([]) == []


def test_chain_training_separates_forms():
    good = [crf.text_lines("This is a line of text, with words. \nAnd another one here, it ends.")[0]] * 20
    bad = [crf.text_lines("buy | cheap | now | here | buy\n### $$$ %%% ###")[0]] * 20
    chain = crf.train_chain([(f, 0) for f in good] + [(f, 1) for f in bad])
    assert chain.viterbi(good[0]) == [0, 0] and chain.viterbi(bad[0]) == [1, 1]
    assert not crf.train_chain([(good[0], 0)]).emit.any()


def test_quality_rules_hold_against_labels(spark):
    rows = LLM_QUERIES["op8_quality_rules"](spark, SF).join(read_table(spark, SF, "labels"), "doc_id").collect()
    judged = [r for r in rows if not r["base_failed"]]
    assert sum(r["kept"] == (r["quality"] == 1) for r in judged) / len(judged) > 0.95
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_quality_rules_of_odd_rows(spark, docs_of):
    chain = crf.learn_chain(docs_of(ODD), read_table(spark, SF, "labels").limit(0))
    docs = docs_of(ODD, extra=("kept", "n_words"))
    got = crf.quality_verdicts(docs, chain, *docs.columns, prefix="__").collect()
    assert len(got) == len(ODD) and all(r["__base_failed"] for r in got)
    assert crf.quality_verdicts(docs_of([]), chain, "doc_id").count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    docs, seen = read_table(spark, SF, "documents"), []
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= before and after
        if k < 4:
            assert docs.columns == names
        seen.append(len(after))
    labels = {r["doc_id"]: r for r in read_table(spark, SF, "labels").collect()}
    clean = {i for i, r in labels.items() if r["quality"] == 1 and not r["toxic"]}
    assert seen[0] > 800 and seen[3] == seen[4]
    packed = corpus_pipeline.run(spark, SF)
    assert packed.agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0]
    assert len(clean & {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "1")).collect()}) > 0.9 * len(clean)


def test_pipeline_stages_with_odd_rows(spark, docs_of):
    import corpus_pipeline
    for rows in (ODD, []):
        docs = docs_of(rows, extra=("__score2", "score", "kept", "fp", "key"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(rows)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
    assert set(LLM_ORACLE) <= set(LLM_QUERIES)

"""Importance resampling, URL filter and hard negatives against brute force."""

import fnmatch
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import negatives as N
from textlab.llm import resample as R
from textlab.llm import urls as U
from textlab.llm.common import ranked
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGET = [(1, "alpha beta x beta"), (2, None), (3, "Éa 中文")]


# ------------------------------------------------------------------ resampling

def plain_features(text, low, high):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def plain_resample(rows, target, low=1, high=1, buckets=R.BUCKETS, share=10, min_words=R.MIN_WORDS):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *plain_features(t, low, high)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, fs in found:
        s.update(map(bucket, fs))
    for _, text in target:
        t.update(map(bucket, plain_features(text, low, high)[1]))
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * a / ((s[k] + 1) * b)))
    out = []
    for i, n, fs in found:
        w = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{R.SEED}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    may = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    return out, may[:share * len(may) // 100]


def check_resample(rows, got, **params):
    want, drawn = plain_resample(rows, TARGET, **params)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(r[:4] for r in want)
    ranked_rows = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked_rows] == list(range(1, len(drawn) + 1))
    assert [(r["score"], r["doc_id"]) for r in ranked_rows] == [(r[3], r[0]) for r in drawn]


def target_of(spark, rows=TARGET):
    return spark.createDataFrame(rows, "item_id long, text string")


def texts(n, seed=1):
    rng = random.Random(seed)
    words = "Alpha beta gamma-delta é 中文 x\x00y Zeta3 the of".split()
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(n)]


def test_resample_matches_plain_python(spark, docs_of):
    rows = texts(400)
    check_resample(rows, R.importance_resample(docs_of(rows, extra=("score", "rank", "bucket")), target_of(spark)).collect())


def test_resample_of_runs_few_buckets_and_all_drawn(spark, docs_of):
    rows = texts(120, 2)
    params = dict(low=1, high=3, buckets=7, share=100, min_words=0)
    check_resample(rows, R.importance_resample(docs_of(rows), target_of(spark), **params).collect(), **params)


def test_resample_of_odd_rows_and_ties(spark, docs_of):
    long = " ".join(["word"] * 30)
    rows = ODD + [(50, long)] * 7 + [(None, long)] * 3 + [(51, long), (52, long.upper())]
    check_resample(rows, R.importance_resample(docs_of(rows), target_of(spark), share=60, min_words=3).collect(), share=60, min_words=3)
    assert R.importance_resample(docs_of([]), target_of(spark)).count() == 0
    got = R.importance_resample(docs_of(rows), target_of(spark, [])).collect()
    assert len(got) == len(rows)
    assert all(r["rank"] is None for r in R.importance_resample(docs_of([(1, "few words")]), target_of(spark)).collect())


def test_long_texts_are_read_in_pieces_without_loss(monkeypatch):
    monkeypatch.setattr(R, "_PIECE", 50)
    text = " ".join(f"w{i % 90}" for i in range(900)) + " " + "y" * 500 + " end"
    bucket = {}
    for high in (1, 2, 4):
        want_words, want = plain_features(text, 1, high)
        bucket = {f: zlib.crc32(f.encode()) for f in want}
        words, times = R.document_features(R.splitter(), bucket, text, 1, high)
        assert words == want_words and times == Counter(bucket[f] for f in want)


def test_ranks_over_ranges(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 50).alias("k"), "id").repartition(7)
    got = ranked(rows, [F.desc("k"), F.asc("id")]).collect()
    got.sort(key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 3001))
    assert [(r["k"], r["id"]) for r in got] == sorted(((r["k"], r["id"]) for r in got), key=lambda r: (-r[0], r[1]))
    assert ranked(rows.limit(0), [F.desc("k")]).count() == 0


# ------------------------------------------------------------------ URL filter

def plain_match(glob, text):
    out = ""
    chars = iter(glob)
    for c in chars:
        out += ".*" if c == "*" else "." if c == "?" else re.escape(next(chars, "\\") if c == "\\" else c)
    return re.fullmatch(out, text, re.S) is not None


def test_automaton_matches_regular_expressions():
    rng = random.Random(4)
    globs = ["".join(rng.choice("ab*?é.") for _ in range(rng.randrange(9))) for _ in range(60)] + ["", "*", "?", r"\*a", "a\\", "**a?"]
    words = ["".join(rng.choice("abé.*\\") for _ in range(rng.randrange(12))) for _ in range(300)] + ["", "*a", "a\\", "a" * 70_000 + "b"]
    machine = U.Automaton([U.glob_tokens(g) for g in globs])
    assert machine.words > 3  # states over several words
    hits = machine.matches([w.encode() for w in words])
    for i, w in enumerate(words):
        if len(w) < 100:
            assert [bool(x) for x in hits[i]] == [plain_match(g, w) for g in globs], w
        else:
            assert hits[i][globs.index("*")] and not hits[i][globs.index("?")]
    assert U.Automaton([]).matches([b"a"]).shape == (1, 0) and machine.matches([]).shape == (0, len(globs))


def plain_verdict(url, rules, blocked):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(raw):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        best = max(fits)
        return host, path, best[3], best[4]
    hit = any(fnmatch.fnmatchcase(host, h) and fnmatch.fnmatchcase(path, p + "*") for h, p in blocked)
    return host, path, None, "block" if hit else "allow"


URLS = [None, "", "no scheme.org/es/", "http://example.org/es/1", "http://EXAMPLE.Org/es/1", "http://a.b.example.org/en/1",
        "http://example.org/en/2", "http://example.org", "http://example.org?x=/es/", "http://notexample.org/es/",
        "http://x.com/fr/a", "http://x.com/de/a", "http://x.com/FR/a", "http://x.com/a#/de/", "https://spam-farm.net/en/",
        "https://evil.net/x.example.org/en/1", "https://evil.net/spam", "http://a.net/wp-admin/x", "://com/fr/", "a://b://org/",
        "http://é.org/", "http://x.net/" + "y" * 30_000, "http://x.com:80/fr/", "http://x.com\n/fr/", "http://.com/fr/"]


def test_verdicts_match_plain_python(spark):
    rows = [(i, u, 5) for i, u in enumerate(URLS)] + [(3, URLS[3], 5), (None, URLS[3], 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict int")
    got = U.url_verdicts(df).collect()
    want = Counter((i, *plain_verdict(u, U.RULES, U.BLOCKED)) for i, u, _ in rows)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want
    assert {r["glob"] for r in got if r["host"] == "spam-farm.net"} == {"*spam*"}
    assert U.url_verdicts(df.limit(0)).count() == 0


def test_rules_with_wildcards_and_ties(spark):
    rules = [("block", "*.net", "/a?c/"), ("allow", "x.net", "/abcd"), ("block", "x.net", "/a"), ("allow", "x.net", "/a")]
    df = spark.createDataFrame([(1, "http://q.x.net/abc/d"), (2, "http://x.net/abcde"), (3, "http://x.net/ab")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.url_verdicts(df, rules, []).collect()}
    assert got == {1: ("*.net/a?c/", "block"), 2: ("x.net/abcd", "allow"), 3: ("x.net/a", "block")}


# ------------------------------------------------------------------ hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, score int"


def plain_negatives(rows, anchor_every, top=5, share=80):
    use = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        use.append((i, tuple(math.floor(256 * float(np.float32(x))) for x in v), label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, v, label in sorted(set(r for r in use if r[0] % anchor_every == 0)):
        scored = [(-dot(v, w), i, m) for i, w, m in use if i != a]
        for p, pos, _ in sorted(s for s in scored if s[2] == label)[:top]:
            fit = sorted(s for s in scored if s[2] != label and -80 * p <= -100 * s[0] <= -100 * p)
            out += [(a, pos, r, s[1], -p, -s[0]) for r, s in enumerate(fit[:top], 1)]
    return Counter(out)


def mined(spark, rows, anchor_every=10, **params):
    df = spark.createDataFrame([(i, v, label, 9) for i, v, label in rows], VECTORS).repartition(5)
    return Counter(tuple(r) for r in N.hard_negatives(
        N.usable(N.relabelled(df)), F.col("id") % anchor_every == 0, **params).collect())


def clustered(n, dims=6, labels=4, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    return [(i, [float(x) for x in centres[i % labels] + rng.normal(size=dims) * 0.6], int(i % labels)) for i in range(n)]


def test_negatives_match_all_pairs(spark):
    rows = clustered(400)
    want = plain_negatives(rows, 10)
    assert len(want) > 100
    assert mined(spark, rows) == want


def test_negatives_over_several_blocks_and_references(spark):
    rows = clustered(240, labels=10, seed=5)
    want = plain_negatives(rows, 3)
    assert mined(spark, rows, 3, block_size=16, most_references=2) == want


def test_negatives_of_odd_rows(spark):
    same = [0.5, -0.25, 1.0]
    rows = [(0, same, 1), (0, same, 1), (10, same, 1), (11, same, 2), (12, same, 2), (12, same, 2), (13, [-0.5, 0.25, -1.0], 2),
            (20, None, 1), (21, [None, 1.0, 1.0], 1), (22, [float("nan"), 1.0, 1.0], 1), (23, [float("inf"), 1.0, 1.0], 2),
            (24, same, None), (None, same, 1), (30, [], 1), (40, [0.0, 0.0, 0.0], 2), (41, [1.0], 1), (50, [0.001, 0.0, 0.0], 3),
            (60, [2e4, -3e4, 1e4], 3), (61, [2e4, -3e4, 1.1e4], 4), (62, [2e4, -3e4, 1e4], 3), (63, [1.9e4, -3e4, 1e4], 3)]
    assert mined(spark, rows) == plain_negatives(rows, 10)
    assert mined(spark, []) == Counter()
    assert mined(spark, [(10, [], 1), (11, [], 1), (12, [], 2)]) == plain_negatives([(10, [], 1), (11, [], 1), (12, [], 2)], 10)


def test_one_common_vector(spark):
    rows = [(i, [1.0, 0.5, 0.25], i % 3) if i % 2 else (i, [float(i % 7), 1.0, -1.0], i % 3) for i in range(300)]
    assert mined(spark, rows) == plain_negatives(rows, 10)


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(1)
    matrix = np.floor(256 * np.concatenate([rng.normal(size=(300, 8)), np.zeros((3, 8)), np.tile(rng.normal(size=8), (9, 1)) * [[k] for k in range(9)]]))
    refs = rng.normal(size=(5, 8))
    refs /= np.linalg.norm(refs, axis=1, keepdims=True)
    block = N.Block(np.arange(len(matrix)), np.zeros(len(matrix)), matrix, refs)
    who = np.arange(len(matrix))
    scores = N.exact_scores(matrix, matrix, float(block.norms.max() ** 2))
    assert (scores == (matrix.astype(object) @ matrix.T.astype(object)).astype(np.int64)).all()
    low, high = N.tile_windows(block, who, block.angles, block.norms)
    assert (scores.max(axis=1) <= high).all() and (scores.min(axis=1) >= low).all()
    left_out = 0
    for a, b in ((0, 10**9), (20_000, 60_000), (-10**9, -50_000)):
        keep = N.row_overlap(block, who, block.angles, block.norms, np.full(len(who), a), np.full(len(who), b))
        assert keep[(scores >= a) & (scores <= b)].all()
        left_out += (~keep).sum()
    assert left_out > 0


def test_scores_beyond_a_long_count_as_the_nearest():
    big = np.array([[2.0 ** 40, 2.0 ** 40], [-(2.0 ** 40), 2.0 ** 10]])
    got = N.exact_scores(big, big, float("inf"))
    assert got[0, 0] == (1 << 63) - 1 and got[0, 1] == -(1 << 63) and got[1, 1] == (1 << 63) - 1
    near = np.array([[2.0 ** 30, 3.0]])
    assert N.exact_scores(near, near, 2.0 ** 61)[0, 0] == (1 << 60) + 9


def test_sf_tables_need_few_scores(spark):
    """On the given table the bounds leave out rows, and the result is that of all pairs."""
    from tests.llm.conftest import SF
    rows = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert mined(spark, rows, 100) == plain_negatives(rows, 100)


if __name__ == "__main__":
    pytest.main([__file__])

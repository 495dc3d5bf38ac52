"""Sharding, exact dedup, SimHash and line dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from textlab.llm import lines as L
from textlab.llm.common import components, numbered, durable
from textlab.llm.exact import exact_groups
from textlab.llm.shards import balanced_shards, flows, quotas
from textlab.llm.simhash import block_masks, fingerprint, near_duplicates, one_of_each
from tests.llm.conftest import ODD

BLANK = re.compile("[\x20\x09-\x0D]")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    sets = Sets()
    for a, b in edges:
        if a != b:
            sets.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: sets.find(x) for x in sets.up}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_numbers_have_no_gap(spark):
    df = durable(spark.range(1000).select("id", (F.col("id") % 3).alias("k")))
    got = defaultdict(list)
    for r in numbered(df, "k", ["id"], buckets=16).collect():
        got[r["k"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and len(got) == 3


def check_shards(rows, texts):
    assert len(rows) == len(texts)
    held = Counter(r["shard"] for r in rows)
    assert [held.get(s, 0) for s in range(8)] == quotas(len(rows), 8)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(held.get(s, 0)))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)


def test_shards_of_odd_rows(docs_of):
    check_shards(balanced_shards(docs_of(ODD, extra=("shard", "row"))).collect(), ODD)
    assert balanced_shards(docs_of([])).count() == 0


def test_shards_keep_groups_whole_and_counts_even(docs_of):
    rng = random.Random(5)
    texts = [(i, f"text {rng.randrange(200)}" if i % 3 else f"single {i}") for i in range(900)]
    rows = balanced_shards(docs_of(texts)).collect()
    check_shards(rows, texts)
    spread = defaultdict(set)
    for r in rows:
        spread[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in spread.values()) <= 12  # of 200 groups


def test_shards_split_a_group_larger_than_a_shard(docs_of):
    texts = [(i, "the same" if i % 3 == 0 else f"text {i}") for i in range(600)]
    rows = balanced_shards(docs_of(texts)).collect()
    check_shards(rows, texts)
    held = Counter(r["shard"] for r in rows if r["doc_id"] % 3 == 0)
    assert sum(n > 60 for n in held.values()) >= 2  # 200 copies, 75 rows a shard


def test_shards_where_every_row_has_copies(docs_of):
    rng = random.Random(9)
    texts = [(i, f"text {i // 2 if i < 800 else 400 + i // 4}") for i in range(1200)]
    rng.shuffle(texts)
    rows = balanced_shards(docs_of(texts)).collect()
    check_shards(rows, texts)
    spread = defaultdict(set)
    for r in rows:
        spread[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in spread.values()) <= 0.1 * len(spread)  # by hash alone 9 of 10


def test_flows_keep_quotas():
    rng = random.Random(4)
    for _ in range(200):
        asked = {(s, t): rng.randrange(50) for s in range(8) for t in range(8) if s != t and rng.random() < 0.4}
        free = [rng.randrange(9) * (rng.random() < 0.3) for _ in range(8)]
        got = flows(asked, free)
        assert all(0 <= got[p] <= asked[p] for p in asked)
        for s in range(8):
            assert sum(n for (_, t), n in got.items() if t == s) - sum(n for (f, _), n in got.items() if f == s) <= free[s]
    assert flows({(0, 1): 5, (1, 0): 3}, [0, 0]) == {(0, 1): 3, (1, 0): 3}
    assert flows({(0, 1): 5, (1, 2): 3}, [0, 0, 2]) == {(0, 1): 2, (1, 2): 2}


def brute_exact(texts):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(texts):
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i is None, i, n))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0, m[3]))
        out += [(m[2], best[2], len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return Counter(out), len(groups)


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_exact_groups_of_odd_rows(docs_of, parts):
    texts = ODD + [(100 + i, "copy" + " " * (i % 4)) for i in range(90)]
    got = exact_groups(docs_of(texts, extra=("run", "keep_id")).repartition(parts)).collect()
    want, groups = brute_exact(texts)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["digest"].hex()) for r in got) == want
    assert sum(r["kept"] for r in got) == groups


def test_exact_groups_of_nothing(docs_of):
    assert exact_groups(docs_of([])).count() == 0


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_the_definition(sf_rows):
    for _, t in sf_rows[:120] + [r for r in ODD if r[1] and len(r[1]) < 1000]:
        assert fingerprint(t) == slow_fingerprint(t)


def test_masks_cover_every_close_pair():
    rng = random.Random(1)
    masks = [m & (1 << 64) - 1 for m in block_masks()]
    assert len(masks) == 20
    for _ in range(2000):
        diff = 0
        for b in rng.sample(range(64), 3):
            diff |= 1 << b
        assert any(not diff & m for m in masks)


def test_near_duplicates_match_all_pairs(docs_of, sf_rows):
    rng = random.Random(2)
    texts = list(sf_rows[:250]) + ODD[:5]
    for k in range(150):  # near copies, some of them chains
        i, t = texts[rng.randrange(len(texts))]
        words = (t or "").split(" ")
        if len(words) > 60:
            words[rng.randrange(len(words))] = f"w{k}"
        texts.append((10_000 + k, " ".join(words)))
    fps = [fingerprint(t or "") for _, t in texts]
    sets = Sets()
    for a in range(len(texts)):
        sets.find(a)
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                sets.join(a, b)
    low = defaultdict(list)
    for n, (i, _) in enumerate(texts):
        low[sets.find(n)].append(i)
    got = near_duplicates(docs_of(texts, extra=("fp", "root"))).collect()
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == Counter(
        (i, fps[n], min(low[sets.find(n)])) for n, (i, _) in enumerate(texts))
    one = one_of_each(docs_of(texts, extra=("fp", "root"))).collect()
    assert sorted(r["doc_id"] for r in one) == sorted(min(v) for v in low.values())


def test_near_duplicates_of_odd_rows(docs_of):
    assert near_duplicates(docs_of(ODD)).count() == len(ODD)
    assert near_duplicates(docs_of([])).count() == 0
    kept = one_of_each(docs_of(ODD, extra=("doc", "id")))
    assert kept.count() == len({fingerprint(t or "") for _, t in ODD}) and kept.columns[-1] == "id"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n):
    for _ in range(n):
        at, kind = rng.randrange(len(text) + 1), rng.randrange(3)
        letter = rng.choice("abc")
        text = text[:at] + ("" if kind == 1 else letter) + text[at + (kind > 0):]
    return text


def test_banded_distance_is_levenshtein():
    rng = random.Random(4)
    for n in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        b = edited(rng, a, rng.randrange(5)) if n % 2 else "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        for most in (1, 2, 3):
            assert L.edit_distance_within(a, b, most) == (levenshtein(a, b) <= most), (a, b, most)


BANDS = ((0, 0), (6, 1), (12, 2), (24, 3))


def test_segments_find_every_close_pair():
    rng = random.Random(6)
    lines = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    pairs = [(a, edited(rng, a, rng.randrange(4))) for a in lines]
    flat = [x for p in pairs for x in p]
    key, row, own = L.segment_keys(flat, BANDS)
    odd = L.odd_counts(flat).tolist()
    assert all(((odd[2 * k] ^ odd[2 * k + 1]) & (1 << 64) - 1).bit_count() <= 2 * levenshtein(a, b) for k, (a, b) in enumerate(pairs))
    for n in (3, 5, 7):  # as many groups as two an edit, and one more: some group's counts stay
        sums = L.group_sums(flat, n).tolist()
        for k, (a, b) in enumerate(pairs):
            if levenshtein(a, b) <= n // 2:
                assert any(x == y for x, y in zip(sums[2 * k], sums[2 * k + 1]))
    wanted, stored = defaultdict(set), defaultdict(set)
    for k, r, o in zip(key.tolist(), row.tolist(), own.tolist()):
        wanted[r].add(k)
        if o:
            stored[r].add(k)
    close = 0
    for n, (a, b) in enumerate(pairs):
        most = int(L.edits_of(min(len(a), len(b)), BANDS))
        if a != b and most and b and levenshtein(a, b) <= most:
            short, long = (2 * n, 2 * n + 1) if len(a) <= len(b) else (2 * n + 1, 2 * n)
            assert wanted[long] & stored[short], (a, b)
            close += 1
    assert close > 300
    assert all(len(stored[r]) <= int(L.edits_of(len(flat[r]), BANDS)) + 1 for r in stored)
    assert L.segment_keys([], BANDS)[0].size == 0 and L.segment_keys(["", "a"], BANDS)[0].size == 0


def test_keys_are_of_the_substring_wherever_it_lies():
    lines = ["xxabcé中", "abcé中", "yabcé中zz"]
    text = L.SubstringKeys(lines)
    five = lambda row, at, n=5, segment=1: text.of(L.np.array([row]), L.np.array([at]), L.np.array([5]), L.np.array([n]), segment)[0]
    assert five(0, 2) == five(1, 0) == five(2, 1)
    assert len({five(0, 2), five(0, 1), five(0, 2, 6), five(0, 2, 5, 2)}) == 4


def test_near_lines_have_near_counts(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcdefgh é中") for _ in range(rng.randrange(1, 60)))
        b = edited(rng, a, rng.randrange(3))
        pairs.append((a, b, levenshtein(a, b) <= 2))
    a, b = (L.line_ids([p[k] for p in pairs]).tolist() for k in (0, 1))
    df = spark.createDataFrame([(x, y, p[2]) for x, y, p in zip(a, b, pairs)], "a long, b long, near boolean")
    assert df.where("near").where(~L.may_be_near(F.col("a"), F.col("b"), 2)).count() == 0


def brute_lines(texts, bands=L.BANDS):
    """Kept and removed lines of (doc_id, text) rows by comparing all lines."""
    where = defaultdict(list)
    for i, t in dict.fromkeys(texts):
        for pos, raw in enumerate((t or "").split("\n")):
            if raw.strip():
                where[raw.strip()].append((i, t, pos))
    lines, sets, linked = list(where), Sets(), set()
    for a in range(len(lines)):
        sets.find(a)
        for b in range(a):
            x, y = lines[a], lines[b]
            most = max(k for n, k in bands if min(len(x), len(y)) >= n)
            if most and abs(len(x) - len(y)) <= most and levenshtein(x, y) <= most:
                sets.join(a, b)
                linked |= {x, y}
    classes = defaultdict(list)
    for n, line in enumerate(lines):
        classes[sets.find(n)] += [(occurrence, line) for occurrence in where[line]]
    gone, low, has_link = defaultdict(list), {}, Counter()
    for members in classes.values():
        first = min(members, key=lambda m: (m[0][0] is None, m[0][0] or 0, m[0][2]))[0]
        for (i, t, pos), line in members:
            has_link[i, t] += line in linked
            low[i, t] = min(low.get((i, t), first[0]), first[0])
            if (i, t, pos) != first:
                gone[i, t].append(pos)
    return gone, low, has_link


LINES = ["the quick brown fox jumps over the lazy dog again", "the quick brown fax jumps over the lazy dog again",
         "the quick brown fax jumps over the lazy dogs again", "five words make a line", "five words make a lime",
         "short one", "All rights reserved", "Yes", "Yet", "an entirely different line of text, and long enough for edits"]


def line_docs():
    rng = random.Random(8)
    return [(i, "\n".join(rng.choice(LINES) if rng.random() < 0.6 else f"line {i} {k} is here only, and nowhere else {rng.random()}"
                          for k in range(5))) for i in range(40)]


def near_docs():
    """Long and short lines with up to four edits, and one crowded key: lines that share their
    beginning and differ in more than the limit, some of them in pairs that do not."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip() for n in (19, 20, 22, 39, 41, 60, 61, 130, 400)]
    out = [(i, "\n".join(edited(rng, b, rng.randrange(5)) for b in base)) for i in range(12)]
    for i in range(60):
        number = "".join(rng.choice("0123456789") for _ in range(12))
        twin = number[:5] + "x" + number[6:]
        out += [(100 + 2 * i, f"this template line begins with the same words {number}"),
                (101 + 2 * i, f"this template line begins with the same words {twin}")]
    return out


def test_crowded_keys_are_split_without_losing_a_link(docs_of, monkeypatch):
    monkeypatch.setattr(L, "CROWD", 3)
    texts = near_docs()
    rng = random.Random(10)
    passage = "a passage that very many lines have in the middle"
    for i in range(50):
        ends = ["".join(rng.choice("abcdefgh ") for _ in range(45)).strip() for _ in range(2)]
        line = f"{ends[0]}{passage}{ends[1]}"
        texts += [(500 + 2 * i, line), (501 + 2 * i, edited(rng, line, 2) if i % 4 == 0 else line[::-1])]
    gone, low, _ = brute_lines(texts)
    got = {r["doc_id"]: r for r in L.line_report(docs_of(texts)).collect()}
    for i, t in texts:
        assert got[i]["removed"] == sorted(gone.get((i, t), [])) and got[i]["class_id"] == low[i, t], i


def test_near_lines_of_all_bands_match_all_pairs(docs_of):
    texts = near_docs()
    for bands in (L.BANDS, ((0, 0), (15, 1), (38, 2), (100, 3))):
        gone, low, _ = brute_lines(texts, bands)
        got = {r["doc_id"]: r for r in L.line_report(docs_of(texts), bands).collect()}
        assert len(got) == len(texts) and sum(map(len, gone.values())) > 60
        for i, t in texts:
            assert got[i]["removed"] == sorted(gone.get((i, t), [])), (i, bands)
            assert got[i]["class_id"] == low[i, t]


def test_line_report_matches_all_pairs(docs_of):
    texts = line_docs() + [(900, None), (901, ""), (902, " \n\n")]
    gone, low, n_links = brute_lines(texts)
    got = L.line_report(docs_of(texts, extra=("key", "line"))).collect()
    assert len(got) == len(texts)
    text = dict(texts)
    for r in got:
        key = (r["doc_id"], text[r["doc_id"]])
        assert r["removed"] == sorted(gone.get(key, [])) and r["n_removed"] == len(r["removed"])
        assert r["class_id"] == low.get(key, r["doc_id"]) and (r["n_links"] > 0) == (n_links.get(key, 0) > 0)


def test_every_link_inside_a_class_counts(docs_of, monkeypatch):
    line = "the quick brown fox jumps over the lazy dog again and again"
    # one edit each from one line, so two from each other; a chain whose ends are too far apart
    near = [line] + [f"{line[:k]}#{line[k + 1:]}" for k in (2, 9, 17, 26, 33, 41, 50, 57)]
    chain = [f"{'x' * k}another line of text that is long enough for two edits" for k in range(5)]
    texts = [(i, t) for i, t in enumerate(near + chain)]
    for crowd in (L.CROWD, 2):
        monkeypatch.setattr(L, "CROWD", crowd)
        got = {r["doc_id"]: r["n_links"] for r in L.line_report(docs_of(texts)).collect()}
        assert got == {i: sum(a != t and levenshtein(a, t) <= 2 for _, a in texts) for i, t in texts}
        assert [got[i] for i in range(len(near))] == [8] * 9 and [got[9 + k] for k in range(5)] == [2, 3, 4, 3, 2]


def test_lines_are_taken_out(docs_of):
    texts = line_docs() + [(900, None), (901, ""), (903, LINES[0]), (904, LINES[3] + "\nshort one")]
    gone = brute_lines(texts)[0]
    want = {}
    for i, t in texts:
        left = [x for n, x in enumerate((t or "").split("\n")) if n not in gone.get((i, t), ())]
        if not gone.get((i, t)) or any(x.strip() for x in left):
            want[i] = t if t is None else "\n".join(left)
    out = L.without_repeated_lines(docs_of(texts, extra=("doc", "removed")))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "doc", "removed"]


def test_short_lines_and_lines_without_spaces_take_part(docs_of):
    url = "https://news.example.org/archive/2024/05/index.html?page="
    texts = [(i, f"版权所有不得转载\nAll rights reserved\nShare\n{url}{i}\n这一行只在第{'零一二三'[i]}篇里") for i in range(4)]
    got = {r["doc_id"]: r["removed"] for r in L.line_report(docs_of(texts)).collect()}
    assert got == {0: [], 1: [0, 1, 2, 3], 2: [0, 1, 2, 3], 3: [0, 1, 2, 3]}


def test_lines_of_odd_rows(docs_of):
    assert L.line_report(docs_of(ODD)).count() == len(ODD)
    assert L.line_report(docs_of([])).count() == 0
    assert L.without_repeated_lines(docs_of([])).count() == 0

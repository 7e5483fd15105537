"""Corpus operators against brute force, exact round trips and held-out accuracy, with awkward rows."""

import functools
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("weftline.llm.registry")

from weftline.llm import components, decontaminate, exact_dedup, langid, licences, line_dedup, packing, quality, registry, samples, simhash, token_counts, toxicity, wordbpe  # noqa: E402

SF = "/root/testdata/sf0.001"
BPE = registry.tokenizer_path()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, rank string, part long, words long"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """Rows (doc_id, text) with null and clashing further columns."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", 1, 2) for i, t in rows], SCHEMA)


LONG = " ".join(f"word{i % 97} stays{i % 13}" for i in range(6000))
AWKWARD = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (None, "null id"), (None, "null id"), (5, LONG), (6, LONG), (7, LONG + "!"), (8, "É é"), (9, " \n\n "), (7, "same id, other text")]


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, AWKWARD)


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


def test_exact_dedup(spark, awkward):
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(awkward, block_bytes=64).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha"))).collect())
    groups = defaultdict(list)
    for i, t in AWKWARD:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            want[(i, keep, len(ids), bool(i == keep and left), hashlib.sha256(t.encode()).hexdigest())] += 1
            left -= i == keep
    assert got == want


def test_exact_dedup_keeps_rows(spark, awkward, nothing):
    kept = exact_dedup.drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted({t or "" for _, t in AWKWARD})
    assert exact_dedup.drop_exact_copies(nothing).count() == 0


@given(st.lists(st.binary(max_size=9), max_size=30), st.integers(1, 4))
@settings(max_examples=30, deadline=None)
def test_blocks_cover_text(texts, size):
    for t in texts:
        assert b"".join(t[i : i + size] for i in range(0, max(len(t), 1), size)) == t


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    text = text.encode("utf-8", "ignore").decode()
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2])
def test_covering_masks(radius):
    masks = simhash.covering_masks(radius)
    for a in range(64):
        for b in range(64):
            flip = 1 << a | (1 << b if radius == 2 else 0)
            assert any(not flip & m for m in masks)
    assert min(bin(m).count("1") for m in masks) > 32


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("small", [0, 24])
def test_links(spark, small):
    """Dense balls, so that large buckets take the way by midpoints, and loners."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for b in base for _ in range(8)})
    want = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = simhash.links(df, small=small).collect()
    at = {x: i for i, x in enumerate(fps)}
    got = union_find(len(fps), [(at[r["a"] % (1 << 64)], at[r["b"] % (1 << 64)]) for r in found])
    assert got == want


@pytest.mark.parametrize("small", [0, 24])
def test_links_radius_1(spark, small):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    bits = [rng.sample(range(64), 4) for _ in base]
    fps = sorted({0b1111, 0b1110, 0b0111, 0b1010} | {b ^ sum(1 << x for x in rng.sample(k, rng.randrange(4))) for b, k in zip(base, bits, strict=True) for _ in range(7)})
    want = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 1])
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, radius=1, small=small).collect()]
    at = {x: i for i, x in enumerate(fps)}
    assert all((a ^ b).bit_count() == 1 for a, b in found)
    assert union_find(len(fps), [(at[a], at[b]) for a, b in found]) == want


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 240)] + [(5, 5), (None, 3)]
    want = union_find(300, [x for x in links if None not in x])
    rows = components.connected(spark.createDataFrame(links, "a long, b long")).collect()
    roots = {}
    for r in rows:
        roots.setdefault(want[r["node"]], set()).add(r["root"])
    assert all(len(x) == 1 for x in roots.values())
    assert len({next(iter(x)) for x in roots.values()}) == len(roots)
    assert {r["node"] for r in rows} == {x for p in links if None not in p and p[0] != p[1] for x in p}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups(spark, awkward, nothing):
    rows = simhash.near_groups(awkward).collect()
    fps = [brute_fingerprint(t) for _, t in AWKWARD]
    comp = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for (i, _), c in zip(AWKWARD, comp, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = Counter((i, f, least.get(c)) for (i, _), f, c in zip(AWKWARD, fps, comp, strict=True))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows) == want
    assert simhash.drop_near_copies(awkward).count() == len(set(comp))
    assert simhash.near_groups(nothing).count() == 0


def brute_contamination(docs, items):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: rx.findall((t or "").translate(UP))
    wins = [(i, w[k : k + 13]) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - 12))]
    out = Counter()
    for d, t in docs:
        w = split(t)
        hit, ids = set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(str(i))
        out[(d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    return out


def test_decontaminate(spark, nothing):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(1, "x " + passage.upper() + " y"), (1, "x " + passage.upper() + " y"), (2, " ".join(passage.split()[:13])), (3, " ".join(passage.split()[:12])), (4, None), (None, "tiny item here"), (5, "the the " * 40), (6, "q " * 5000 + passage + " q" * 5000), (7, "")]
    items = [(10, passage), (11, "Tiny, item"), (12, None), (13, ""), (14, passage), (15, "the " * 20)]
    d, b = table(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute_contamination(docs, items)
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontaminate.contaminated(nothing, b).count() == 0
    assert decontaminate.contaminated(d, b.limit(0)).filter("n_hit > 0").count() == 0


def brute_near(docs, items, share=0.8, slack=4):
    """{(doc, item)} by the words of every passage around every probed term."""
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: rx.findall((t or "").translate(UP))
    tokens = [(d, split(t)) for d, t in docs]
    df = Counter(x for _, w in tokens for x in w)
    out = set()
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            win = w[k : k + 13]
            terms = set(win)
            need = math.ceil(len(terms) * share - 1e-9)
            rare = sorted(terms, key=lambda x: (df[x], win.index(x)))[: len(terms) - need + 1]
            for d, words in tokens:
                for at, x in enumerate(words):
                    if x in rare:
                        start = at - win.index(x)
                        if len(terms & set(words[max(0, start - slack) : max(0, start + len(win) + slack)])) >= need:
                            out.add((d, item))
    return out


@pytest.mark.parametrize("block", [4, 1 << 15])
def test_proximity(spark, nothing, block, monkeypatch):
    """Changed, inserted and lost words; ties, repeats and nulls; windows in one block and in several."""
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "WORDS_BLOCK", block)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(20)]
    words = [*passage, "the", "of", "x"]
    docs = [(1, "a " * 50 + " ".join(x for p in passage[:14] for x in (p, "so") if x == p or p in ("p3", "p7"))), (2, "nothing near"), (3, " ".join(passage[:9])), (4, " ".join([*passage[:5], "y", *passage[6:9], "z", *passage[9:20]]))]
    docs += [(5, None), (None, " ".join(passage)), (None, " ".join(passage)), (6, ""), *((10 + k, " ".join(rng.choice(words) for _ in range(40))) for k in range(12))]
    items = [(9, " ".join(passage)), (10, "the of the of the x"), (11, None), (12, ""), (13, "P3 p4"), (9, " ".join(passage))]
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.matches(table(spark, docs), b, block=block)[2:]
    got = rows[0].join(rows[1], "wid").select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in got} == brute_near(docs, items)
    assert {(1, 9), (4, 9), (None, 9)} <= {tuple(r) for r in got} and (3, 9) not in {tuple(r) for r in got}
    assert decontaminate.proximity(nothing, b).count() == 0


TEXTS = ["It's we're I'll don't 'tis '' 's's ''s x'd'm 've", "", "   ", "Ünï 12 3½ ²x a_b ’s", "İstanbul ΣΑΣ", "a\x1cb", "<|endoftext|>hi", "x" * 300, "é" * 40 + " b", "áb", "漢字 かな!", "\n\t mixed\r\nlines "]


@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abst'relvm d1É!é ", max_size=40)), max_size=6))
@settings(max_examples=80, deadline=None)
def test_word_bpe_equals_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + TEXTS
    bpe = wordbpe.word_bpe(BPE)
    for t, ids in zip(texts, bpe.encode(texts), strict=True):
        assert list(ids) == bpe.lib.encode(t, add_special_tokens=False).ids


def test_word_bpe_begins_anew(monkeypatch):
    monkeypatch.setattr(wordbpe, "KEPT", 3)
    bpe = wordbpe.WordBpe(BPE)
    for k in range(4):
        t = " ".join(f"w{k}x{i}" for i in range(20))
        assert list(bpe.encode([t])[0]) == bpe.lib.encode(t, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 60), st.integers(0, 30), max_size=20))
@settings(max_examples=200, deadline=None)
def test_plan(counts):
    made = packing.plan(counts, 60)
    used = Counter()
    for n, content in made:
        assert sum(length * each for length, each in content) <= 60
        for length, each in content:
            used[length] += n * each
    assert +used == +Counter(counts)
    n = sum(n for n, _ in made)
    assert packing.lower_bound(counts, 60) <= n <= 1.5 * packing.lower_bound(counts, 60) + 2


def test_pack(spark, awkward, nothing):
    rows = packing.pack(awkward, BPE, capacity=512).collect()
    lib = wordbpe.word_bpe(BPE).lib
    want = Counter()
    for i, t in AWKWARD:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), 512)):
            part = ids[s : s + 512]
            want[(i, p, s, len(part), zlib.crc32(np.array(part, "<u4")))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(nothing, BPE).count() == 0


@given(st.text(alphabet="abst'rel 1É!\n", max_size=200), st.lists(st.tuples(st.integers(0, 220), st.integers(0, 12), st.text(alphabet="ab't 2É", max_size=8)), max_size=5))
@settings(max_examples=150, deadline=None)
def test_edits(text, edits):
    bpe = wordbpe.word_bpe(BPE)
    old, token_counts.LEAF = token_counts.LEAF, 3
    try:
        tree = token_counts.Tree(*token_counts.build(bpe, [text])[0])
        for at, removed, inserted in edits:
            tree, text, _ = token_counts.edit(bpe, tree, text, at, removed, inserted)
            assert tree.tokens == len(bpe.lib.encode(text, add_special_tokens=False).ids)
            assert tree.chars == len(text)
    finally:
        token_counts.LEAF = old


def test_token_counts(spark, awkward, nothing):
    lib = wordbpe.word_bpe(BPE).lib
    rows = token_counts.token_counts(awkward, BPE).collect()
    assert Counter((r["doc_id"], r["tokens"]) for r in rows) == Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in AWKWARD)
    edits = F.expr("array(struct(100 as at, 3 as removed, 'new words' as inserted), null)")
    first = token_counts.token_counts(awkward.filter("doc_id = 5"), BPE, edits)
    r = first.first()
    new = LONG[:100] + "new words" + LONG[103:]
    assert r["tokens_after"] == len(lib.encode(new, add_special_tokens=False).ids)
    assert r["chars_encoded"] < 1000
    # The edited text with its tree, which is used; and trees that aren't the text's, which aren't.
    kept = table(spark, [(5, new)]).withColumn("mine", F.struct(F.lit(r["leaf_chars"]).alias("leaf_chars"), F.lit(r["leaf_tokens"]).alias("leaf_tokens")))
    again = token_counts.token_counts(kept, BPE, F.expr("array(struct(7000 as at, 0 as removed, 'x' as inserted))"), "mine").first()
    assert again["tokens"] == r["tokens_after"] and again["chars_encoded"] < 1000
    assert again["tokens_after"] == len(lib.encode(new[:7000] + "x" + new[7000:], add_special_tokens=False).ids)
    wrong = F.struct(F.array(F.lit(9)).alias("leaf_chars"), F.array(F.lit(99)).alias("leaf_tokens"))
    clash = awkward.withColumns({"leaf_chars": F.array(F.lit(9)), "leaf_tokens": F.array(F.lit(99)), "tree": F.lit(1), "edits": F.lit(2)})
    for made in (token_counts.token_counts(clash, BPE), token_counts.token_counts(awkward, BPE, tree=wrong)):
        assert Counter((x["doc_id"], x["tokens"]) for x in made.collect()) == Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in AWKWARD)
    assert token_counts.token_counts(nothing, BPE).count() == 0


def test_word_bpe_collisions(monkeypatch):
    """Pre-tokens that share a hash with another one still get their own ids and counts; long texts come in pieces."""
    texts = ["one two three four, one", "five six it's seven two", "", "ab " * 90]
    bpe = wordbpe.WordBpe(BPE)
    want = [bpe.lib.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(wordbpe, "CHUNK", 16)
    assert [list(x) for x in bpe.encode(texts)] == want
    bpe = wordbpe.WordBpe(BPE)
    bpe.mix[:] = 0  # all pre-tokens of one length have one hash
    assert [list(x) for x in bpe.encode(texts)] == want
    assert [int(n.sum()) for _, n in bpe.pretoken_counts(texts)] == [len(x) for x in want]


def brute_lines(rows, min_lines=3, long_line=40):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = {1: set(), min_lines: set()}, {}
    for k in order:
        lines = (rows[k][1] or "").split("\n")
        gone = set()
        for p in range(len(lines)):
            if lines[p] in seen[1] and len(lines[p].split()) >= long_line:
                gone.add(p)
            seen[1].add(lines[p])
            run = tuple(lines[p : p + min_lines])
            if len(run) == min_lines:
                if run in seen[min_lines]:
                    gone |= set(range(p, p + min_lines))
                seen[min_lines].add(run)
        out[k] = (rows[k][0], len(lines), tuple(sorted(gone)))
    return out


def test_line_dedup(spark, nothing):
    long = "w " * 50
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "b\nc"), (4, f"q\n{long}"), (5, f"{long}\nr"), (6, None), (7, ""), (8, "z\nz\nz\nz\nz"), (9, "x\nb\nc\nd\ny"), (None, "a\nb\nc"), (9, "x\nb\nc\nd\ny")]
    got = line_dedup.repeated_lines(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["lines"], tuple(r["deleted"])) for r in got) == Counter(brute_lines(rows).values())
    kept = line_dedup.drop_repeated_lines(table(spark, rows))
    want = Counter((i, t if t is None or not (g := brute_lines(rows)[k][2]) else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in g)) for k, (i, t) in enumerate(rows))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    assert kept.columns == table(spark, []).columns
    assert line_dedup.repeated_lines(nothing).count() == 0


@pytest.mark.parametrize("min_lines", [1, 2, 4, 5])
def test_line_dedup_depths(spark, min_lines):
    rng = random.Random(min_lines)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for i in range(25)]
    got = line_dedup.repeated_lines(table(spark, rows), min_lines=min_lines, long_line=10**6).collect()
    assert Counter((r["doc_id"], r["lines"], tuple(r["deleted"])) for r in got) == Counter(brute_lines(rows, min_lines, 10**6).values())


def test_line_dedup_short_runs(spark):
    """Runs of fewer than min_lines lines go by their words in all; scripts without blanks by characters."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(n)) for k, n in (("a", 30), ("b", 30), ("c", 9)))
    han = "\u6f22\u5b57" * 45
    rows = [(1, f"x\n{a}\n{b}\ny"), (2, f"{a}\n{b}\nz"), (3, f"q\n{a}\n{c}"), (4, f"{a}\n{c}\n{a}"), (5, f"{c}\n{a}"), (6, f"r\n{han}"), (7, f"{han}\ns"), (8, f"{han[:30]}\nt"), (9, f"{han[:30]}\nu")]
    got = {r["doc_id"]: r["deleted"] for r in line_dedup.repeated_lines(table(spark, rows), long_line=39).collect()}
    assert got == {1: [], 2: [0, 1], 3: [], 4: [0, 1], 5: [0, 1], 6: [], 7: [0], 8: [], 9: []}


@pytest.mark.parametrize("min_lines", [3, 6])
def test_line_dedup_words(spark, min_lines):
    rng = random.Random(min_lines)
    lines = ["a a a", "b", "c c c c c", "d d"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(9)))) for i in range(20)]
    want, seen = {}, set()
    for i, t in rows:
        x, gone = t.split("\n"), set()
        for p in range(len(x)):
            for n in range(1, min_lines + 1):
                run = tuple(x[p : p + n])
                if len(run) == n:
                    if run in seen and (n == min_lines or sum(len(s.split()) for s in run) >= 9):
                        gone |= set(range(p, p + n))
                    seen.add(run)
        want[i] = sorted(gone)
    got = {r["doc_id"]: r["deleted"] for r in line_dedup.repeated_lines(table(spark, rows), min_lines, 9).collect()}
    assert got == want


def test_runs(spark, nothing):
    """Maximal runs against each position's first copy, by brute force; all deleted lines lie in them."""
    rng = random.Random(11)
    body = [f"line {k}" for k in range(40)]
    rows = [(1, "\n".join(body)), (2, "\n".join(["q", *body[3:29], "r"])), (3, "\n".join(body)), (4, "\n".join(["s", *body[30:35], "t", *body[:13]]))]
    rows += [(10 + i, "\n".join(rng.choice("abcde") for _ in range(rng.randrange(14)))) for i in range(20)]
    lines = {i: t.split("\n") for i, t in rows}
    got = line_dedup.runs(table(spark, rows)).collect()
    uids = {r["uid"]: r["doc_id"] for r in got} | {r["first_uid"]: None for r in got if r["first_uid"] not in {x["uid"] for x in got}}
    spans = {(r["doc_id"], r["first"], r["length"]) for r in got}
    assert {(2, 1, 26), (3, 0, 40), (4, 1, 5), (4, 7, 13)} <= spans and len(uids) > 4
    where = {r["uid"]: r["doc_id"] for r in line_dedup.repeated_lines(table(spark, rows)).collect()}
    for r in got:
        here, there = lines[r["doc_id"]][r["first"] :], lines[where[r["first_uid"]]][r["first_line"] :]
        same = next((k for k, (a, b) in enumerate(zip(here, there, strict=False)) if a != b), min(len(here), len(there)))
        assert r["length"] == same and r["words"] == sum(len(x.split()) for x in here[:same])
        assert (where[r["first_uid"]], r["first_line"]) < (r["doc_id"], r["first"])
    covered = {i: set() for i in lines}
    for r in got:
        covered[r["doc_id"]] |= set(range(r["first"], r["first"] + r["length"]))
    assert {r["doc_id"]: set(r["deleted"]) for r in line_dedup.repeated_lines(table(spark, rows)).collect()} == covered
    assert line_dedup.runs(nothing).count() == 0


def test_clashing_names(spark):
    """Columns with the names that operators use inside come back as they were."""
    schema = "doc_id long, text string, deleted string, row string, id string, sha string, __id string, rid string, rsha string, cuts string, quality_score string, out string, stay string, lines string"
    docs = spark.createDataFrame([(k, t, *["z"] * 12) for k, t in [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (2, "x\na\nb\nc"), (None, None)]], schema)
    for kept, texts in ((line_dedup.drop_repeated_lines(docs), [None, "", "a\nb\nc\nd", "x"]), (exact_dedup.drop_exact_copies(docs), [None, "a\nb\nc\nd", "x\na\nb\nc"])):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert all(tuple(r)[2:] == ("z",) * 12 for r in rows) and sorted((r["text"] or "", r["text"] is not None) for r in rows) == sorted((t or "", t is not None) for t in texts)


def test_licences(spark, nothing):
    rows = [(1, "prose here\nReleased under the MIT License.\nmore"), (2, "RELEASED under: the MIT licence"), (3, None), (4, "Licensed under the Apache License, Version 2.0."), (5, ""), (1, "Released under the MIT License."), (6, "word " * 9000)]
    got = {(r["doc_id"], r["license_id"]): r["dice"] for r in licences.scan(table(spark, rows)).collect()}
    assert got == {(1, "mit-notice"): 1.0, (4, "apache-2.0-notice"): 1.0}
    assert licences.scan(nothing).count() == 0


def test_licences_across_lines(spark):
    """Notices that are wrapped, or stand within a longer line, and full licence texts."""
    prose = "".join(f"some words{i} about{i} nothing{i} at all\n" for i in range(60))

    def wrapped(text, width):
        return "\n".join(" * " + x for x in textwrap.wrap(text, width))

    t = licences.TEMPLATES
    bsd = "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n"
    rows = [
        (1, prose + wrapped(t["gpl-3.0-header"], 60) + "\n" + prose),
        (2, wrapped(t["mpl-2.0-header"], 50) + "\n" + prose + wrapped(t["mpl-2.0-header"], 70)),
        (3, bsd + prose),
        (4, prose + "A longer line that ends so: " + t["gpl-2.0-notice"] + " And it goes on for some more words, " * 9),
        (5, "Copyright (c) 2020 Somebody\n\n" + licences.full_texts()["mit"]),
        (6, prose + licences.full_texts()["isc"] + prose),
        (7, prose + "Released under\nthe MIT licence\n" + prose),
    ]
    got = {(r["doc_id"], r["license_id"]): (r["units"], r["dice"]) for r in licences.scan(table(spark, rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, "gpl-3.0-header"): 1, (2, "mpl-2.0-header"): 2, (3, "bsd-3-clause-notice"): 1, (4, "gpl-2.0-notice"): 1, (4, "gpl-3.0-notice"): 1, (5, "mit"): 1, (6, "isc"): 1}
    assert all(v[1] == 1 for k, v in got.items() if k not in ((4, "gpl-3.0-notice"), (5, "mit")))


def test_licences_long_unit(spark):
    """A line of over 20,000 words that repeats one notice, which the SQL leaves out."""
    got = licences.scan(table(spark, [(1, "Released under the MIT License. " * 4500)])).collect()
    assert [tuple(r) for r in got] == [(1, "mit-notice", 1, 0.888889)]


def holdout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels


def test_quality_at_once(monkeypatch):
    """Short texts are scored by few bytes at a time, and score the same alone."""
    sizes, of = [], quality.features
    monkeypatch.setattr(quality, "features", lambda texts, skip=0: sizes.append(sum(map(len, texts))) or of(texts, skip))
    model = quality.Model(np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32), 0.1)
    texts = [f"some words {k} ".encode() * 900 for k in range(200)]
    got = model.scores(texts)
    assert max(sizes) <= quality.AT_ONCE < sum(map(len, texts))
    assert got == pytest.approx([model.scores([t])[0] for t in texts], abs=1e-12)


def test_quality(spark, awkward, nothing):
    docs, labels = holdout(spark)
    model = quality.train(docs, labels)
    rows = quality.scored(docs, model).join(labels, "doc_id").filter(samples.remainder(4) == 2).select("quality_score", "quality").collect()
    assert np.mean([(r["quality_score"] >= 0.7) == r["quality"] for r in rows]) > 0.95
    got = quality.scored(awkward, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert quality.keep_good(awkward, model).columns == awkward.columns
    assert quality.scored(nothing, model).count() == 0
    assert quality.train(docs, labels.limit(0)).scores([b"x"])[0] == 0.5


def test_toxicity(spark, awkward, nothing):
    """All held-out rows: what is found, and false alarms."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(samples.remainder(5) == 0).select("toxicity_score", "toxic").collect()
    hit = {v: np.mean([r["toxicity_score"] >= 0.5 for r in rows if r["toxic"] == v]) for v in (0, 1)}
    assert hit[1] > 0.8 and hit[0] < 0.02
    got = toxicity.scored(awkward, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["toxicity_score"] <= 1 for r in got)
    assert toxicity.scored(nothing, model).count() == 0


def plain_toxic(model, text):
    """The average of a text's embeddings and the softmax, n-gram by n-gram."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
    inner = lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
    words, word = [], []
    for c in [*low, 0]:
        if inner(c):
            word.append(c)
        elif word:
            words.append(word)
            word = []
    wide, mix, step = (1 << 64) - 1, [int(x) for x in toxicity._MIX], [int(x) for x in toxicity._STEP]

    def bucket(h, kind):
        h ^= h >> 32
        return (h * step[60 - kind] & wide) >> 64 - toxicity.BITS

    found = []
    for w in words:
        value = [mix[0], *(mix[c] for c in w), mix[0]]
        for n in toxicity.GRAMS:
            found += [bucket(sum(v * step[k] for k, v in enumerate(value[at : at + n])) & wide, n) for at in range(len(value) - n + 1)]
        whole = [v * step[k & 31] & wide for k, v in enumerate(value[1:-1])]
        found.append(bucket(sum(v ^ v >> 29 for v in whole) & wide, 0))
    mean = model.embedding[found].mean(0) if found else np.zeros(toxicity.DIM)
    logits = mean @ model.softmax + model.bias
    return float(np.exp(logits[1]) / np.exp(logits).sum())


def test_toxicity_scores(monkeypatch):
    """Against a plain scorer, long texts in pieces too."""
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 2, (1 << toxicity.BITS, toxicity.DIM)), rng.normal(0, 1, (toxicity.DIM, 2)), np.array([0.2, -0.1]))
    texts = [b"", b"!!", b"You IDIOT, you", "\u00e9t\u00e9 a bb ccc 12".encode(), b"x" * 50, b"some words " * 40 + b"and\nlines\n" * 30]
    want = [plain_toxic(model, t) for t in texts]
    assert np.allclose(model.scores(texts), want, atol=1e-5)
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    monkeypatch.setattr(samples, "CHUNK", 64)
    assert np.allclose(model.scores(texts), want, atol=1e-5)


def test_quality_ftrl():
    """Weights and bias against FTRL-proximal weight by weight."""
    rows = [("good plain words here and more of them", 1), ("BUY now!!! $$$", 0), ("a calm sentence about rivers", 1), ("zz zz zz zz zz", 0), ("rivers and words", 1)]
    epochs, alpha, beta, l1, l2 = 3, 2.0, 1.0, 1e-4, 1e-3
    xs = []
    for t, _ in rows:
        kinds, _ = quality.features([t.encode()])
        xs.append({b: c / len(kinds[0]) for b, c in Counter(int(b) for k in kinds for b in k).items()})
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i, lasso: 0.0 if abs(z[i]) <= lasso else -(z[i] - math.copysign(lasso, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    rng, good = np.random.default_rng(0), sum(y for _, y in rows)
    for _ in range(epochs):
        for k in rng.permutation(len(xs)):
            y = rows[k][1]
            w = {i: weight(i, l1) for i in xs[k]} | {"bias": weight("bias", 0.0)}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in xs[k].items()) - w["bias"]))
            g = (p - y) * len(rows) / 2 / (good if y else len(rows) - good)
            for i, v in [*xs[k].items(), ("bias", 1.0)]:
                z[i] += g * v - (math.sqrt(n[i] + (g * v) ** 2) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += (g * v) ** 2
    model = quality.fit(rows, 0.5, epochs)
    assert model.bias == pytest.approx(weight("bias", 0.0), rel=1e-6)
    used = [i for i in z if i != "bias"]
    assert np.allclose(model.weights[used], [weight(i, l1) for i in used], atol=1e-5) and np.count_nonzero(model.weights) <= len(used)
    # What stands before a text in its batch doesn't matter.
    assert np.allclose(model.scores([t.encode() for t, _ in rows]), [model.scores([t.encode()])[0] for t, _ in rows])
    text = "rivers good zz"
    kinds, _ = quality.features([text.encode()])
    score = 1 / (1 + math.exp(-sum(float(model.weights[b]) for k in kinds for b in k) / 3 - model.bias))
    assert model.scores([text.encode()])[0] == pytest.approx(score, abs=1e-6)


def test_quality_long_texts(monkeypatch):
    model = quality.fit([("good words " * 9, 1), ("BAD !! $$ bad " * 9, 0)])
    texts = ["good words and BAD $$ ones, or so.\n".encode() * 60, b"short"]
    want = model.scores(texts)
    monkeypatch.setattr(quality, "CHUNK", 128)
    monkeypatch.setattr(quality, "LOOK", 64)
    monkeypatch.setattr(samples, "CHUNK", 128)
    assert np.allclose(model.scores(texts), want, atol=1e-6)


def test_queries(spark):
    """The registered queries without SQL, over a whole table, against brute force."""
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    remainder = lambda i, n: zlib.crc32(str(i).encode()) % n
    lib = wordbpe.word_bpe(BPE).lib
    ids = {i: lib.encode(r["text"] or "", add_special_tokens=False).ids for i, r in rows.items()}
    got = registry.op2_token_counts(spark, SF).collect()
    assert {r["doc_id"]: r["tokens"] for r in got} == {i: len(x) for i, x in ids.items()} and len(got) == len(rows)
    got = registry.op4_simhash(spark, SF).collect()
    keys = list(rows)
    fps = [brute_fingerprint(rows[i]["text"]) for i in keys]
    comp = union_find(len(keys), [(i, j) for i in range(len(keys)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = defaultdict(lambda: 1 << 62)
    for i, c in zip(keys, comp, strict=True):
        least[c] = min(least[c], i)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{f:016x}", least[c]) for i, f, c in zip(keys, fps, comp, strict=True)}
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lang = langid.train(docs)
    best, score = lang.predict([(r["text"] or "").encode() for r in rows.values()])
    want = {i: (remainder(i, 4) == 2, lang.languages[b] if any(c.isalpha() for c in r["text"] or "") else "und", round(float(s), 6)) for (i, r), b, s in zip(rows.items(), best, score, strict=True)}
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in registry.op5_language_id(spark, SF).collect()}
    assert got == {i: (h, k, s if k != "und" else 0.0) for i, (h, k, s) in want.items()}
    for query, module, n, held, cut in ((registry.op7_toxicity, toxicity, 5, 0, 0.5), (registry.op8_quality, quality, 4, 2, 0.7)):
        score = module.train(docs, labels).scores([(r["text"] or "").encode() for r in rows.values()])
        got = {r["doc_id"]: (r["held_out"], round(r["score"], 6), r["predicted"]) for r in query(spark, SF).collect()}
        assert got == {i: (remainder(i, n) == held, round(float(s), 6), int(s >= cut)) for i, s in zip(rows, score, strict=True)}
    pieces, used = set(), defaultdict(list)
    for r in registry.op9_packing(spark, SF).collect():
        pieces.add((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]))
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    want = {(i, p, s, len(part), zlib.crc32(np.array(part, "<u4"))) for i, x in ids.items() for full in [[*x, 1]] for p, s in enumerate(range(0, len(full), 4096)) for part in [full[s : s + 4096]]}
    assert pieces == want
    for held in used.values():
        ends = [0, *np.cumsum([n for _, n in sorted(held)])]
        assert [at for at, _ in sorted(held)] == ends[:-1] and ends[-1] <= 4096
    assert len(used) <= 1.05 * packing.lower_bound(Counter(n for *_, n, _ in pieces)) + 1


def test_subword_grams():
    """Buckets of n-grams don't depend on what stands around a word."""
    alone, beside = toxicity.features([b"idiot"]), toxicity.features([b"an idiot, so", b""])
    for (a, _), (b, cuts) in zip(alone, beside, strict=True):
        assert set(a.tolist()) <= set(b.tolist())
        assert cuts[1] == cuts[2] == len(b)


def test_language(spark, nothing):
    docs, _ = holdout(spark)
    model = langid.train(docs)
    rows = langid.predicted(docs, model).filter(samples.remainder(4) == 2).select("lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    odd = langid.predicted(table(spark, [(1, None), (2, "123 !?"), (3, "x")]), model).select("doc_id", "lang_pred", "lang_score").collect()
    assert [r["lang_pred"] == "und" for r in sorted(odd)] == [True, True, False]
    assert langid.predicted(nothing, model).count() == 0
    assert {r["lang_pred"] for r in langid.predicted(docs, langid.train(docs.limit(0))).select("lang_pred").distinct().collect()} == {"und"}


def plain_ppm(samples, text, order=3):
    """Bits of a text: PPM, method C with exclusion, by the recursion itself."""
    follow = defaultdict(Counter)
    for t in samples:
        t = b"\0" * order + t
        for at in range(order, len(t)):
            for k in range(order + 1):
                follow[t[at - k : at]][t[at]] += 1

    @functools.cache
    def chances(context):
        lower = chances(context[1:]) if context else [1 / 256] * 256
        seen = follow.get(context)
        if not seen:
            return lower
        total, left = seen.total() + len(seen), 1 - sum(lower[b] for b in seen)
        if left <= 1e-12:
            return [seen[b] / seen.total() for b in range(256)]
        return [seen[b] / total if b in seen else lower[b] * len(seen) / total / left for b in range(256)]

    text = b"\0" * order + text
    return -sum(math.log2(chances(text[at - order : at])[text[at]]) for at in range(order, len(text)))


def test_language_code_lengths():
    """Against a plain PPM, with bytes, contexts and languages that training didn't show."""
    rng = random.Random(6)
    samples = {k: ["".join(rng.choices(a, k=rng.randrange(60))).encode() for _ in range(9)] for k, a in {"a": "abcd ", "b": "xyz\u00e9 ", "c": "ab\u4e00\u4e8c", "d": "q", "e": "abx "}.items()}
    model = langid.fit(samples)
    assert isinstance(model, langid.Models) and model.languages == list("abcde")
    texts = [b"", b"abcd", "x\u00e9z ab\u4e00 q\u0416".encode(), bytes(range(256)), "".join(rng.choices("abxyq \u4e8c", k=200)).encode()]
    got = model.lengths(texts)
    want = np.array([[plain_ppm(samples[k], t) for k in "abcde"] for t in texts])
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_language_long_texts(monkeypatch):
    """A text in pieces has the code length of the whole."""
    model = langid.fit({"a": [b"abcabcabd" * 9], "b": [b"xyzxyx " * 9]})
    text = b"abcab xyzabd" * 50
    whole = model.lengths([text, b"xyz"])
    monkeypatch.setattr(langid, "CHUNK", 64)
    monkeypatch.setattr(samples, "CHUNK", 64)
    assert np.allclose(model.lengths([text, b"xyz"]), whole, rtol=1e-6)


def test_language_learns_all(spark):
    """More than 64 languages, one of them rare and one with long texts only."""
    rng = random.Random(1)
    letters = [chr(k) for k in [*range(97, 123), *range(0x3B1, 0x3C9), *range(0x430, 0x44F), *range(0x5D0, 0x5EA), *range(0x905, 0x930), *range(0x4E00, 0x4E20)]]
    langs = {f"l{k:02}": rng.sample(letters, 8) for k in range(70)}

    def text(lang, n):
        return " ".join("".join(rng.choices(langs[lang], k=5)) for _ in range(n))

    rows = [(i, text(k, 20), k) for i, k in enumerate([k for k in langs for _ in range(3 if k == "l69" else 8)]) if k != "l68"]
    rows += [(10_000 + i, text("l68", 4000), "l68") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == sorted(langs)
    fresh = [(k, text(k, 20).encode()) for k in langs]
    best, _ = model.predict([t for _, t in fresh])
    assert [model.languages[i] for i in best] == [k for k, _ in fresh]


def test_pipeline(spark):
    """Every stage against brute force on its own input."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = cp.good_quality(spark, docs, SF)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [tuple(r) for r in docs.collect()]
    want = [r for r, s in zip(rows, model.scores([r[1].encode() for r in rows]), strict=True) if s >= 0.7]
    assert sorted(tuple(r) for r in kept.collect()) == sorted(want)
    last = {}
    for r in sorted(want):
        last[r[1]] = r
    docs = spark.createDataFrame(want, docs.schema)
    kept = cp.without_copies(spark, docs, SF)
    assert sorted(tuple(r) for r in kept.collect()) == sorted(last.values())
    want = sorted(last.values())
    fps = [brute_fingerprint(r[1]) for r in want]
    comp = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    want = [want[i] for i in sorted(set(comp))]
    kept = cp.without_near_copies(spark, spark.createDataFrame(sorted(last.values()), docs.schema), SF)
    assert sorted(tuple(r) for r in kept.collect()) == want
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {k[0] for k in brute_contamination([(r[0], r[1]) for r in want], items) if k[-1]}
    kept = cp.without_benchmark(spark, spark.createDataFrame(want, docs.schema), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in want if r[0] not in bad]
    assert {r["doc_id"] for r in cp.packed(spark, kept, SF).collect()} == {r[0] for r in want} - bad


def test_pipeline_run(spark, tmp_path):
    """All stages over rows with nulls, repeats, ties, long and empty texts and clashing columns; an empty table; and a run that goes on."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ("quality_score", "sha", "id", "row", "part", "rid", "keep", "wid", "component_id")
    rows = [tuple(r) for r in docs.limit(120).collect()]
    odd = [*rows, *rows[:9], (None, None, None, None, None), (None, "null id", "en", None, 7), (9_000_001, "", "en", "x", 0), (9_000_002, LONG, "en", "x", 1)]
    more = ", ".join(f"{n} string" for n in names)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for folder, data in (("odd", odd), ("none", [])):
        spark.createDataFrame([(*r, *["v"] * len(names)) for r in data], f"{schema}, {more}").write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        for name in ("labels", "benchmark"):
            table_ = spark.read.parquet(f"{SF}/{name}.parquet")
            (table_ if data else table_.limit(0)).write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
    got = cp.run(spark, f"{tmp_path}/odd")
    assert got.count() > 50 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)
    assert got.groupBy("doc_id", "piece").count().filter("count > 1").isEmpty()
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
    kept = cp.good_quality(spark, spark.read.parquet(f"{tmp_path}/odd/documents.parquet"), f"{tmp_path}/odd")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", *names] and kept.filter("quality_score <> 'v'").isEmpty()
    ran = []
    stages = [(n, lambda s, d, f, n=n, make=make: ran.append(n) or make(s, d, f)) for n, make in cp.STAGES]
    old, cp.STAGES = cp.STAGES, [*stages[:2], ("broken", lambda s, d, f: 1 / 0)]
    try:
        with pytest.raises(ZeroDivisionError):
            cp.run(spark, SF, "again")
        cp.STAGES = stages
        first = cp.run(spark, SF, "again").count()
    finally:
        cp.STAGES = old
    assert ran == [n for n, _ in old] and first == cp.run(spark, SF, "again").count()


def test_registered():
    assert [int(n.split("_")[0][2:]) for n in registry.QUERIES] == list(range(1, 11))

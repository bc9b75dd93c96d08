import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cellmill.llm import decontaminate, embedding, graph, near_copies, simhash, substring
from cellmill.llm.bitmap import Bitmap, maybe_in
from cellmill.llm.common import text_key
from cellmill.llm.graph import components

#: A table whose other columns have the operators' own names.
DOCS = "doc_id long, text string, id long, fp string, gone int, doc string, component string, node string, repeats int, sources int, __x int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", 2, "d", "c", "n", 3, 4, 5) for i, t in rows], DOCS)


def prose(rng, n, words=2000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("local_links", [graph.LOCAL_LINKS, 0])
def test_components_against_union_find(spark, monkeypatch, local_links):
    monkeypatch.setattr(graph, "LOCAL_LINKS", local_links)
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {n for a, b in pairs for n in (a, b) if a != b}
    assert got == union_find(pairs, linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_keeps_all_members(spark):
    df = spark.range(5000).withColumn("h", F.xxhash64("id"))
    bitmap = Bitmap.of(df.filter("id % 7 = 0"), F.col("h"))
    maybe, never = maybe_in(df, F.col("h"), bitmap)
    assert {r.id for r in maybe.collect()} >= set(range(0, 5000, 7)) and maybe.count() < 800
    assert maybe.count() + never.count() == 5000


def slow_fingerprint(text):
    words = [w for w in "".join(c if c > "\x7f" else c.lower() for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "É é x\x85y z", "a b c d e f a b c", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_xxh64_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("two words é"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("two words é".encode(), 42)


def near_fingerprints(rng):
    """Dense clusters, chains of three-bit steps, and strangers."""
    out = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(4):
        base = rng.getrandbits(64)
        out |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(60)}
        for _ in range(12):
            base ^= sum(1 << b for b in rng.sample(range(64), 3))
            out.add(base)
    base = rng.getrandbits(64)
    return sorted(out | {base ^ x for x in range(64)})


def test_grid_join_finds_every_link(spark):
    rng = random.Random(3)
    fps = near_fingerprints(rng)
    a = np.array(fps, np.uint64)
    pairs = [(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3) if i < j]
    signed = a.view(np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    got = {r.fp: r.component for r in simhash.fingerprint_components(nodes).collect()}
    want = union_find([(int(signed[i]), int(signed[j])) for i, j in pairs], map(int, signed))
    assert {f: got.get(f, f) for f in want} == want


def test_manhattan_is_a_lower_bound(spark):
    rng = random.Random(4)
    rows = [(x, x ^ sum(1 << b for b in rng.sample(range(64), 5))) for x in (rng.getrandbits(64) for _ in range(200))]
    df = spark.createDataFrame([(simhash.signed(a), simhash.signed(b)) for a, b in rows], "a long, b long")
    u, v = simhash.unary_popcounts(F.col("a")), simhash.unary_popcounts(F.col("b"))
    got = df.select(F.bit_count(u.bitwiseXOR(v)).alias("m"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("h")).collect()
    for (a, b), r in zip(rows, got):
        assert r.m == sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2)) <= r.h == 5


def test_simhash_documents(spark):
    rng = random.Random(5)
    base = prose(rng, 400)
    rows = [(10, base), (11, base), (12, base.replace("w1 ", "w2 ", 1) + " x"), (3, prose(rng, 300)), (4, None), (5, ""), (6, " "), (None, base), (7, prose(rng, 40_000)), (3, rows_text := prose(rng, 50))]
    assert rows_text
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got if r.doc_id not in (3, None)}
    fps = {i: simhash.fingerprint(t) for i, t in rows if i not in (3, None)}
    want = union_find([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], fps)
    assert by == want and by[4] == by[5] == by[6] == 4
    assert [r.component_id for r in got if r.doc_id is None] == [10]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_block_number_grows_with_the_table():
    found = [simhash.grid_blocks(10**k) for k in range(2, 14)]
    assert found == sorted(found) and found[0] == 4 and found[-1] > 8
    for blocks in set(found):  # whatever the number, two vectors three apart share a cell
        for at in range(0, 64, 7):
            x = 1 << at | 1 << (at + 9) % 64 | 1 << (at + 31) % 64
            assert any(not (x & m % (1 << 64)) for m in simhash.grid_masks(3, blocks))


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def slow_shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("cell, block", [(near_copies.CELL, near_copies.BLOCK_NODES), (12, 16)])
def test_near_copies_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(near_copies, "BLOCK_NODES", block)
    monkeypatch.setattr(near_copies.sub_grids, "__defaults__", (cell, near_copies.RECALL))
    rng = random.Random(15)
    rows = []
    for _ in range(12):
        base = prose(rng, rng.randint(60, 400))
        rows += [base, base] + [edited(rng, base, rng.randint(0, max(1, len(base.split()) // 25))) for _ in range(12)]
    rows += [prose(rng, rng.randint(1, 300)) for _ in range(60)] + [None, "", " \n", "one two", "one two", prose(rng, 30_000)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(spark, rows)).collect()}
    sets = {i: slow_shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and slow_alike(sets[a], sets[b])]
    edits = [(a, b) for a, b in links if sets[a] != sets[b]]
    assert len(edits) > 100 and all(got[a] == got[b] for a, b in links if sets[a] == sets[b])
    assert sum(got[a] == got[b] for a, b in edits) >= (0.98 if cell > 12 else 0.95) * len(edits)
    whole = union_find(links, sets)
    assert all(whole[i] == whole[c] for i, c in got.items())  # nothing joins what the rule does not
    kept = near_copies.keep_one(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == docs(spark, []).columns


def test_near_copies_do_not_depend_on_the_number_of_texts(spark):
    rng = random.Random(20)
    pairs = []
    for _ in range(150):
        base = prose(rng, 100)
        words = base.split()
        at = rng.randint(20, 70)
        pairs += [base, " ".join([*words[:5], "new", *words[6:at], "new", *words[at + 1 :]])]
    rows = list(enumerate(pairs))
    sets = {i: slow_shingles(t) for i, t in rows}
    assert all(0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.85 for i in range(0, 300, 2))
    strangers = [(1000 + k, prose(rng, 12)) for k in range(3000)]
    alone = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(spark, rows)).collect()}
    among = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(spark, rows + strangers)).collect()}
    assert {i: among[i] for i in alone} == alone and sum(alone[i + 1] == i for i in range(0, 300, 2)) > 140


def test_near_copies_lose_no_link(spark):
    """Short texts that differ in one of nine shingles (similarity 0.8) and, by chance, in more bits than the first step looks for."""
    rng = random.Random(22)
    far, far_wide, rows = [], [], []
    while len(far) < 6 or len(far_wide) < 6:
        words = prose(rng, 13, 10**6).split()
        a, b = " ".join(words), " ".join([*words[:-1], "new"])
        (x, x2, _), (y, y2, _) = near_copies.wide_fingerprint(a), near_copies.wide_fingerprint(b)
        bits, more = ((p ^ q) & (2**64 - 1) for p, q in ((x, y), (x2, y2)))
        if bits.bit_count() > near_copies.MAX_BITS:
            far.append((a, b))
        elif bits.bit_count() + more.bit_count() > near_copies.MAX_WIDE:
            far_wide.append((a, b))
    for a, b in far + far_wide:
        rows += [(len(rows), a), (len(rows) + 1, b), (len(rows) + 2, f"{a} and this is longer")]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(spark, rows)).collect()}
    assert got == {i: i - 1 if i % 3 == 1 else i for i, _ in rows}
    assert sorted(r.doc_id for r in near_copies.keep_one(docs(spark, rows)).collect()) == sorted(set(got.values()))


def test_rarest_shingles_of_near_copies_meet():
    rng = np.random.default_rng(23)
    common = rng.integers(0, 3, near_copies.SLOTS).astype(np.uint32)
    for n in [1, 4, 5, 9, 10, 45, 300] * 20:
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        change = rng.integers(0, n // 9 + 1)
        b = np.unique(np.concatenate([a[rng.permutation(n)[change:]], rng.integers(0, 2**63, change).astype(np.uint64)]))
        assert near_copies.alike(a, b) and np.isin(near_copies.rarest(a, common), near_copies.rarest(b, common)).any()
        x, y = (np.frombuffer(near_copies.bucket_counts(s), np.uint8).astype(int) for s in (a, b))
        assert np.abs(x - y).sum() <= len(np.setxor1d(a, b)) <= (len(a) + len(b)) / 9 + 1e-6
    assert (near_copies.rarest(a[:0], common) == [0]).all()


def test_texts_agree_in_bands_as_their_similarity_says():
    rng = random.Random(21)
    agree = []
    for _ in range(150):
        words = prose(rng, 85).split()
        other = [*words[:3], "new", *words[4:40], "new", *words[41:]]
        a, b = slow_shingles(" ".join(words)), slow_shingles(" ".join(other))
        same = near_copies.band_cells(" ".join(words)) == near_copies.band_cells(" ".join(other))
        agree.append((same.sum(), near_copies.BANDS * (len(a & b) / len(a | b)) ** near_copies.BAND_ROWS))
    got, want = np.array(agree).T
    assert abs(got.mean() - want.mean()) < 0.8 and got.std() < 3.4 and got.min() > 0
    assert not (near_copies.band_cells(prose(rng, 300)) == near_copies.band_cells(prose(rng, 300))).any()
    assert (near_copies.band_cells(None) == near_copies.band_cells(" \n")).all() and (near_copies.band_cells("A  b") == near_copies.band_cells("a b")).all()


def test_near_copies_tell_rows_apart_by_content(spark):
    rng = random.Random(16)
    p, u, v = (prose(rng, 120) for _ in range(3))
    rows = [(1, p), (7, p), (7, u), (7, edited(rng, p, 1)), (None, u), (None, v), (None, v), (9, None), (None, ""), (9, None), (2, " x ")]
    kept = near_copies.keep_one(docs(spark, rows)).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept if r.text) == sorted([(1, p), (7, u), (0, v), (2, " x ")])
    assert [r.doc_id for r in kept if not r.text] == [9]
    assert near_copies.keep_one(docs(spark, [])).count() == near_copies.near_copies(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bound", [("BLOCK_TEXTS", 4), ("BLOCK_CHARS", 3000)])
def test_verification_in_blocks(spark, monkeypatch, bound):
    monkeypatch.setattr(near_copies, *bound)
    rng = random.Random(17)
    base = prose(rng, 200)
    rows = list(enumerate([base, base + " x"] + [edited(rng, base, rng.randint(2, 9)) for _ in range(40)] + [None, "", "a b"]))
    table = docs(spark, rows)
    sketched = [(i, *near_copies.wide_fingerprint(t)) for i, t in rows[:42]]
    keys = table.filter("doc_id < 42").select(F.col("doc_id").alias("node"), *text_key(F.col("text")))
    nodes = keys.join(spark.createDataFrame(sketched, "node long, fp long, fp2 long, size long"), "node")
    links = near_copies.verified(nodes.select("node", F.lit(0).cast("long").alias("in_group")), nodes, table).collect()
    sets = {i: slow_shingles(t) for i, t in rows[:42]}
    alike = [(a, b) for a in sets for b in sets if a < b and slow_alike(sets[a], sets[b])]
    assert {(r.a, r.b) for r in links} <= set(alike)
    assert union_find([(r.a, r.b) for r in links], sets) == union_find(alike, sets) and len(alike) > 10


def test_wide_fingerprints_of_different_shingles():
    assert near_copies.wide_fingerprint(None) == near_copies.wide_fingerprint(" ") == (0, 0, 0)
    once, often = near_copies.wide_fingerprint("a b c d e f"), near_copies.wide_fingerprint("a b c d e f " * 500)
    assert once[2] == 2 and often[2] == 6 and near_copies.wide_fingerprint("A  b") == near_copies.wide_fingerprint("a b")
    rng = random.Random(19)
    a = prose(rng, 300)
    bits = lambda x, y: sum((p ^ q) & (2**64 - 1) and ((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x[:2], y[:2]))
    assert bits(near_copies.wide_fingerprint(a), near_copies.wide_fingerprint(edited(rng, a, 2))) < 29 < bits(near_copies.wide_fingerprint(a), near_copies.wide_fingerprint(prose(rng, 300)))


def slow_pieces(text):
    """The sentences of a text, found character by character."""
    out, piece = [], ""
    for at, c in enumerate(text or ""):
        before = text[at - 1] if at else ""
        piece += c
        if c == "\n" or c in "。！？" or (c.isspace() and before and before in ".!?"):
            out.append(piece)
            piece = ""
    return out + [piece] if piece else out


def slow_repeats(spark, rows):
    """What is left of each document: {(id, text): (text, removed)}, by the rule itself and with none of the module's code."""
    keys = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "k int, id long, text string").select("k", *text_key(F.col("text"))).collect()
    place = {rows[r.k]: (rows[r.k][0] is None, rows[r.k][0] or 0, r.d1, r.d2) for r in keys}
    first, left = {}, {}
    for doc in sorted(set(rows), key=place.get):
        parts = slow_pieces(doc[1])
        gone = set()
        for start in range(len(parts)):
            words = []
            for after in range(start + 1, len(parts) + 1):
                words += parts[after - 1].lower().split()
                if after >= start + 2 and len(words) >= 13 or after == start + 1 and len(words) >= 25:
                    break
            else:
                continue
            if parts[start].split() and first.setdefault(" ".join(words), (doc, start)) != (doc, start):
                gone |= set(range(start, after))
        left[doc] = "".join(p for k, p in enumerate(parts) if k not in gone), len(gone)
    return left


def sentence(rng):
    return (prose(rng, rng.choice([3, 4, 6, 9, 9, 30])) + ".").capitalize()


@pytest.mark.parametrize("max_fill", [substring.MAX_FILL, -1.0])
def test_substring_against_brute_force(spark, monkeypatch, max_fill):
    monkeypatch.setattr(substring, "MAX_FILL", max_fill)
    rng = random.Random(6)
    shared = [" ".join(sentence(rng) for _ in range(8)) for _ in range(5)]
    rows = []
    for i in range(80):
        parts = [sentence(rng) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(200, None), (201, ""), (202, "One. Two."), (203, shared[0] + " " + shared[1] + " " + shared[0])]
    rows += [(7, shared[2] + " " + sentence(rng)), (7, unique := " ".join(sentence(rng) for _ in range(9))), (None, shared[3]), (None, shared[3]), (None, sentence(rng) + " " + shared[3]), (None, unique + " End.")]
    want = slow_repeats(spark, rows)
    changed, untouched = substring.remove_repeats(docs(spark, rows))
    got = {(r.doc.doc_id, r.doc.text): (r.repeats.text, r.repeats.removed) for r in changed.collect()}
    same = {(r.doc_id, r.text): (r.text or "", 0) for r in untouched.collect()}
    assert len(got[None, unique + " End."][0].split()) < 15 and (7, unique) in same
    assert got == {i: v for i, v in want.items() if v[1]} and len(got) > 20
    assert same == {i: v for i, v in want.items() if not v[1]}
    assert set(untouched.columns) == set(docs(spark, []).columns)
    for r in changed.collect():
        assert r.repeats.sources and (r.doc.doc_id is None or all(s <= r.doc.doc_id for s in r.repeats.sources))


@pytest.mark.parametrize("max_fill", [substring.MAX_FILL, -1.0])
def test_substring_edges(spark, monkeypatch, max_fill):
    monkeypatch.setattr(substring, "MAX_FILL", max_fill)
    assert [x.count() for x in substring.remove_repeats(docs(spark, []))] == [0, 0]
    text = " ".join(f"Sentence number {i} has some six words." for i in range(6))
    changed, untouched = substring.remove_repeats(docs(spark, [(1, text), (1, text), (None, text), (None, None)]))
    assert [r.doc.doc_id for r in changed.collect()] == [None]  # null ids come last; equal rows are one document
    assert sorted((r.doc_id or 0, r.text or "") for r in untouched.collect()) == [(0, ""), (1, text), (1, text)]
    for t in (text, "x\n\ny. z", "a.b.c", "。", "no end", "e! f? g"):
        assert "".join(substring.sentences(t)) == t


def test_sentences_stay_whole(spark):
    stretch = "who came by the old road from the hills on the second day of the long rain that"
    rows = [(1, f"The man, {stretch}, slept at last."), (2, f"Nobody believed the story until later, {stretch}, fell in June."),
            (3, f"One more. {stretch} stood, and then some. The end of the matter was plain to all who saw it. Good night."), (4, f"Another start. {stretch} stood, and then some. The end of the matter was plain to all who saw it. But she, alone, went on.")]
    changed, untouched = substring.remove_repeats(docs(spark, rows))
    assert {r.doc.doc_id: r.repeats.text for r in changed.collect()} == {4: "Another start. But she, alone, went on."}
    assert {r.doc_id for r in untouched.collect()} == {1, 2, 3}


def escapes(n, masks):
    """Places of substitutions inside a stretch of n tokens (a fifth of them at most) that no mask avoids."""
    out = []
    for k in range(int(0.2 * n + 1e-9) + 1):
        for bad in combinations(range(1, n - 1), k):
            if not any(all(at + o not in bad for o, bit in enumerate(m) if bit == "1") for m in masks for at in range(n - len(m) + 1)):
                out.append(bad)
    return out


def test_masks_catch_every_allowed_substitution():
    assert not [b for n in range(13, 20) for b in escapes(n, decontaminate.MASKS)]
    assert not [b for n in range(4, 15) for b in escapes(n, decontaminate.SHORT_MASKS)]
    assert [decontaminate.masks_for(n) for n in (0, 1, 4, 5, 15, 16)] == [(), ("1",), ("1111",), decontaminate.SHORT_MASKS, decontaminate.SHORT_MASKS, decontaminate.MASKS]


def slow_overlap(equal, similarity):
    best = 0
    for i in range(len(equal)):
        for j in range(i + 1, len(equal) + 1):
            if equal[i] and equal[j - 1] and sum(equal[i:j]) >= similarity * (j - i) - 1e-9:
                best = max(best, j - i)
    return best


def test_longest_overlap():
    rng = random.Random(7)
    for _ in range(300):
        equal = np.array([rng.random() < 0.7 for _ in range(rng.randint(1, 40))])
        begin, end = decontaminate.longest_overlap(equal)
        assert end - begin == slow_overlap(list(equal), 0.8)


def slow_words(text):
    return re.findall(r"\w+", (text or "").lower())


def slow_leaks(rows, items, min_item=1):
    """(id, text, item): longest stretch, by trying every diagonal of every pair; with none of the module's code."""
    out = {}
    for i, text in set(rows):
        doc = slow_words(text)
        for item_id, item_text in set(items):
            item = slow_words(item_text)
            need = min(13, -(-len(item) * 8 // 10))
            if len(item) < max(1, min_item):
                continue
            best = 0
            for shift in range(-len(item) + 1, len(doc)):
                equal = [shift + k >= 0 and shift + k < len(doc) and doc[shift + k] == w for k, w in enumerate(item)]
                if sum(equal) >= 0.8 * need - 1e-9:
                    best = max(best, slow_overlap(equal, 0.8))
            if best >= need:
                out[i, text, item_id] = best
    return out


def substituted(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = "changed"
    return " ".join(words)


@pytest.mark.parametrize("hot", [decontaminate.HOT_PLACES, 0])
def test_leaks_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(decontaminate, "HOT_PLACES", hot)
    monkeypatch.setattr(decontaminate, "PART", 5)
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 3)
    rng = random.Random(18)
    items = [(n, prose(rng, n)) for n in range(1, 41)] + [(50, None), (51, ""), (None, prose(rng, 9)), (3, prose(rng, 3))]
    rows = [(k, prose(rng, rng.randint(0, 60))) for k in range(60)]
    for k in range(400):
        item = rng.choice([t for _, t in items if t])
        n = len(item.split())
        part = item.split()[rng.randint(0, n // 8) : n - rng.randint(0, n // 8)]
        rows.append((100 + k // 2, f"{prose(rng, rng.randint(0, 25))} {substituted(rng, ' '.join(part), rng.randint(0, len(part) // 4))} {prose(rng, rng.randint(0, 25))}"))
    rows += [(None, items[20][1]), (None, prose(rng, 30)), (7, None), (7, ""), (1, items[9][1])]
    test = spark.createDataFrame([(i, t, "x") for i, t in items] + [(5, items[4][1], "y")], "item_id long, text string, id string")
    want = slow_leaks(rows, items)
    found = decontaminate.leaks(docs(spark, rows), test)
    texts = {(r.id, r.d1): r.text for r in spark.createDataFrame(rows, "id long, text string").select("id", "text", *text_key(F.col("text"))).collect()}
    got = {(r.id, texts[r.id, r.document.d1], r.item): r.n_tokens for r in found.collect()}
    assert len(want) > 200 and set(got) <= set(want)
    assert all(got[k] <= want[k] for k in got)
    by_size = {}
    for key in want:
        size = len(slow_words(dict(items)[key[2]]))
        by_size.setdefault(size, []).append(key in got)
    assert all(all(hits) for size, hits in by_size.items() if size < 16) and sum(sum(h) for h in by_size.values()) >= 0.99 * len(want)
    left = decontaminate.clean(docs(spark, rows), test).collect()
    bad = {(i, t) for i, t, _ in slow_leaks(rows, items)}
    assert sorted((r.doc_id or -1, r.text or "") for r in left) == sorted((i or -1, t or "") for i, t in rows if (i, t) not in bad)


def test_a_stem_of_many_items_is_not_multiplied_out(spark):
    """500 texts and 400 items with the same nine words at their beginning; 20 texts hold a whole item."""
    rng, stem = random.Random(4), "which of the following statements is true about the"
    items = [(i, f"{stem} {prose(rng, 20)}") for i in range(400)]
    rows = [(i, f"{prose(rng, 20)} {stem} {prose(rng, 20)}") for i in range(500)] + [(1000 + i, f"{prose(rng, 5)} {items[i][1]} {prose(rng, 5)}") for i in range(20)]
    test = spark.createDataFrame(items, "item_id long, text string")
    own = lambda df, n: df.select(F.col(n).alias("id"), "text")
    lines = decontaminate.candidates(own(docs(spark, rows), "doc_id"), own(test, "item_id"))
    assert lines.count() < len(rows) + len(items)
    assert {(r.id, r.item) for r in decontaminate.leaks(docs(spark, rows), test).collect()} == {(1000 + i, i) for i in range(20)}


def test_a_text_that_holds_the_whole_benchmark(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(5, 30))) for i in range(300)]
    rows = [(1, " and ".join(t for _, t in items)), (1, " and ".join(t for _, t in items)), (2, prose(rng, 50))]
    found = decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.id, r.item) for r in found) == [(1, i) for i in range(300)]


@pytest.mark.parametrize("n", [*range(1, 17), 20, 30, 40])
def test_recall_by_item_length(n):
    """Whole items with a fifth of their tokens substituted anywhere: the share with a common seed on the right diagonal and a verified overlap."""
    rng = random.Random(n)
    hits = total = 0
    for _ in range(200):
        item = [f"w{k}" for k in range(n)]
        doc = item[:]
        for at in rng.sample(range(n), n // 5):
            doc[at] = "changed"
        a, b = (decontaminate.tokens(" ".join(x)) for x in (doc, item))
        masks = decontaminate.masks_for(n)
        (h, _, at), (g, _, place) = decontaminate.seeds([a], masks), decontaminate.seeds([b], masks)
        common = {(int(s), int(p)) for s, p in zip(h, at)} & {(int(s), int(p)) for s, p in zip(g, place)}
        hits += bool(common) and decontaminate.verify(a, b, 0) is not None
        total += 1
    assert hits >= 0.9 * total, hits / total


def test_leaks(spark):
    rng = random.Random(8)
    items = [prose(rng, n) for n in (40, 20, 13, 7, 5, 3)] + [None, ""]
    test = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(0, items[0], "x")], "item_id long, text string, id string")
    other = lambda n: prose(rng, n)
    few = items[0].split()
    for at in (4, 11, 17, 25, 33):
        few[at] = "changed"
    many = [w if k % 3 else "changed" for k, w in enumerate(items[0].split())]
    rows = [
        (1, other(50) + " " + items[0].upper() + ", " + other(30)), (2, " ".join(few)), (3, " ".join(many)), (4, other(5000) + " " + " ".join(items[1].split()[3:17])),
        (5, items[2]), (6, items[3] + " " + other(9)), (7, items[4]), (8, items[5]), (9, None), (10, ""), (11, other(300)), (12, " ".join(items[1].split()[:9]) + " " + other(10)), (None, items[2]), (1, other(8)),
    ]
    found = decontaminate.leaks(docs(spark, rows), test).collect()
    assert {(r.id, r.item) for r in found} == {(1, 0), (2, 0), (4, 1), (5, 2), (6, 3), (7, 4), (8, 5), (None, 2)}
    by = {(r.id, r.item): r for r in found}
    assert (by[1, 0].start, by[1, 0].n_tokens, by[1, 0].n_equal) == (50, 40, 40) and (by[2, 0].n_tokens, by[2, 0].n_equal) == (40, 35)
    left = decontaminate.clean(docs(spark, rows), test)
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 9, 10, 11, 12] and set(left.columns) == set(docs(spark, []).columns)
    assert decontaminate.leaks(docs(spark, []), test).count() == decontaminate.leaks(docs(spark, rows), test.limit(0)).count() == 0
    assert decontaminate.clean(docs(spark, rows), test.limit(0)).count() == len(rows)


VECTORS = "vec_id long, embedding array<float>, label int, key string, node long, cell int, vector string, links int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "k", 1, 2, "v", 3) for i, v, lab in rows], VECTORS)


@pytest.mark.parametrize("cell, split", [(40, 10**6), (60, 80), (10**6, 60)])
def test_embeddings_against_brute_force(spark, monkeypatch, cell, split):
    """Cells of one level, of two, and of the second alone."""
    monkeypatch.setattr(embedding, "CELL", min(cell, 40))
    monkeypatch.setattr(embedding, "SPLIT", split)
    monkeypatch.setattr(embedding, "SUB_ROWS", 50)
    monkeypatch.setattr(embedding.fit_cells, "__defaults__", (cell, embedding.SAMPLE, embedding.MARGIN))
    rng = np.random.default_rng(9)
    rows, at = [], 0
    for label in (0, 1):
        for _ in range(60):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 14)):
                rows.append((at, [float(x) for x in (centre + rng.normal(size=16) * 0.12 * rng.random()).astype(np.float32)], label))
                at += 1
    rows += [(at + k, rows[0][1], 0) for k in range(5)] + [(at + 9, [2 * x for x in rows[0][1]], 0), (at + 10, rows[0][1], 1)]
    odd = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [None] + [1.0] * 15, 0), (1004, [float("nan")] * 16, 0), (1005, [float("inf")] * 16, 0), (1006, rows[0][1], None), (None, rows[0][1], 0), (1008, [1.0] * 3, 0), (1009, [2.0] * 3, 0)]
    got = embedding.near_duplicates(vectors(spark, rows + odd)).collect()
    ids = [r[0] for r in rows] + [1008, 1009]
    links = set()
    every = rows + odd[-2:]
    for x in range(len(every)):
        for y in range(x + 1, len(every)):
            a, b = (np.array(every[k][1], np.float64) for k in (x, y))
            if every[x][2] == every[y][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links.add((every[x][0], every[y][0]))
    want = union_find(links, ids)
    degree = {i: sum(i in p for p in links) for i in ids}
    assert len(got) == len(rows) + len(odd)
    for r in got:
        if r.vec_id in want:
            assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert embedding.near_duplicates(vectors(spark, [])).count() == 0


def test_blocks_of_a_large_cell(spark):
    rng = np.random.default_rng(10)
    centre = rng.normal(size=8)
    rows = [(i, [float(x) for x in centre + rng.normal(size=8) * 0.02], 0) for i in range(300)]
    embedding.BLOCK, block = 64, embedding.BLOCK
    try:
        got = embedding.near_duplicates(vectors(spark, rows)).collect()
    finally:
        embedding.BLOCK = block
    u = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    degree = (u @ u.T >= 0.98).sum(axis=1) - 1
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(degree.tolist()))
    assert {r.component_id for r in got} == {0}


def test_few_copies_of_vectors_are_written(spark, monkeypatch):
    """Three tables with vectors, with the numbers of the table, and no join that shuffles vectors."""
    written, joins, cut = [], [], embedding.cut

    def noted(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        written.append(df.dtypes)
        joins.extend(line for line in plan.split("\n") if "SortMergeJoin" in line and any("vector" in c for c in df.columns))
        return cut(df)

    monkeypatch.setattr(embedding, "cut", noted)
    rng = np.random.default_rng(12)
    embedding.near_duplicates(vectors(spark, [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(50)])).collect()
    kinds = [kind for columns in written for name, kind in columns if "vector" in name]
    assert kinds == ["array<float>"] * 3 and not joins


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.05], 0), (2, [0.0, 1.0], 0), (5, [0.0, 1.0], 0), (5, [0.0, 1.0], 0), (5, [-1.0, 0.0], 0), (4, [-1.0, 0.05], 0), (3, [5.0, 5.0], 1)]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(vectors(spark, rows)).collect()]
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 2, 2, True), (5, 2, 2, False), (5, 2, 2, False), (5, 1, 4, False), (4, 1, 4, True), (3, 0, 3, True)]
    assert sorted(got) == sorted(want)


def test_centroids_stay_apart():
    rng = np.random.default_rng(11)
    dense = embedding.unit(np.ones(8) + rng.normal(size=(2000, 8)) * 0.01)
    assert len(embedding.apart(dense, 8.0)) == 1
    spread = embedding.unit(rng.normal(size=(1500, 8)))
    kept = embedding.apart(spread, 30.0)
    angles = np.degrees(np.arccos(np.clip(kept @ kept.T, -1, 1))) + 180 * np.eye(len(kept))
    assert 10 < len(kept) < 1500 and angles.min() >= 30 and (np.degrees(np.arccos(np.clip(spread @ kept.T, -1, 1))).min(axis=1) < 30.001).all()

"""Licences, SimHash, line dedup, mixing, packing: against brute force and in corner cases."""

import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sieveloom.llm import license_scan, line_dedup, mixing, packing, simhash
from sieveloom.llm.common import clear_scratch, connected_components, materialize
from sieveloom.llm.license_texts import TEXTS
from sieveloom.llm.queries import tokenizer_path
from tests.llm.helpers import DOCS, documents, rows


def components(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(r.randrange(60, 90), r.randrange(60, 90)) for _ in range(25)] + [(5, 5), (7, 6)] + [(95, i) for i in range(41, 55)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = components(100, pairs)
    assert got == {n: want[n] for n in {x for p in pairs for x in p if p[0] != p[1]}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_intermediate_tables_are_cleared(spark):
    kept = materialize(spark.range(5), "test")
    path = kept.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 5 and os.path.exists(path)
    clear_scratch(spark)
    assert not os.path.exists(path)


# ---- licences -----------------------------------------------------------------------


def test_licences_match_whatever_their_spelling(spark):
    mit = TEXTS["MIT"]
    variants = [
        mit, mit.upper(), "Copyright (c) 2020 Some Body\n\n" + mit, mit.replace("License", "Licence").replace("sublicense", "sub-licence"), mit.replace(" ", "  \n").replace('"', "“"),
        mit + " and more", mit[:200], None, "", "!!!", TEXTS["ISC"] + "\n© 1999 X",
    ]
    docs = documents(spark, list(enumerate(variants))).withColumn("license_id", F.lit("clash")).withColumn("digest", F.lit(1))
    got = {r.doc_id: r.license_id for r in license_scan.scan(docs, license_scan.known_licenses(spark)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: None, 6: None, 7: None, 8: None, 9: None, 10: "ISC"}


def test_copyright_lines_without_a_year(spark):
    line = license_scan.ANY_COPYRIGHT_LINE
    heads = ["Copyright (c) The Foo Authors", "Copyright Jane Doe", "Copyright (C) Jane Doe. All rights reserved.", "(c) Copyright 2020 X", "Copyright: (c) 2020 X", "© Jane Doe", " * Copyright Joyent, Inc. and other contributors", "Copyright (C) Jane Doe 2019"]
    docs = [(i, f"{head}\n\n{text}") for i, (head, text) in enumerate((h, t) for h in heads for t in (TEXTS["MIT"], TEXTS["ISC"]))]
    wrong = [(100, "Copyright holders may do as they like\n" + TEXTS["MIT"]), (101, TEXTS["MIT"].replace("copyright notice", "notice")), (102, None)]
    got = {r.doc_id: r.license_id for r in license_scan.scan(documents(spark, docs + wrong), license_scan.known_licenses(spark, copyright_line=line), copyright_line=line).collect()}
    assert got == {i: ("MIT", "ISC")[i % 2] for i, _ in docs} | {100: None, 101: None, 102: None}
    every = license_scan.scan(documents(spark, list(enumerate(TEXTS.values()))), license_scan.known_licenses(spark, copyright_line=line), copyright_line=line)
    assert {r.doc_id: r.license_id for r in every.collect()} == dict(enumerate(TEXTS))


def test_licence_corner_cases(spark):
    known = license_scan.known_licenses(spark)
    assert license_scan.scan(spark.createDataFrame([], DOCS), known).count() == 0
    same = spark.createDataFrame([("b", "d"), ("a", "d"), ("c", None)], "license_id string, digest string")
    docs = documents(spark, [(1, TEXTS["MIT"]), (1, TEXTS["MIT"]), (None, "x" * 500_000)])
    assert license_scan.scan(docs, same).where("license_id IS NOT NULL").count() == 0
    assert license_scan.scan(docs, known).where("license_id = 'MIT'").count() == 2
    assert license_scan.scan(docs, known.limit(0)).count() == 3


# ---- SimHash ------------------------------------------------------------------------


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if shingles and bits[b] * 2 > len(shingles))


def near_texts(n=150, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        if out and r.random() < 0.4:
            words = r.choice(out).split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([2, 5, 60, 120]))]
        out.append(" ".join(words))
    return out


def test_fingerprints_are_exact():
    for text in ["", None, " \t\n", "A", "Ab cD", "a b c", "É a\x0bb  c d é", "x " * 70000, *near_texts(20)]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("tile,probe", [(4096, 64), (4, 1)])
def test_simhash_components_equal_brute_force(spark, tile, probe):
    texts = [*near_texts(), None, "", "same text here", "same text here"]
    fps = [brute_fingerprint(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert len(pairs) > 20
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(documents(spark, list(enumerate(texts))), tile=tile, probe=probe).collect()}
    want = components(len(texts), pairs)
    assert got == {i: (fps[i], want[i]) for i in range(len(texts))}


def test_bk_search_finds_all_pairs_of_a_dense_cluster():
    r = random.Random(5)
    base = r.getrandbits(64)
    fps = sorted({base ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) & (1 << 64) - 1 for _ in range(400)})
    array = np.array(fps, np.uint64)
    parent, dist = simhash.build_forest(array, np.zeros(len(array), np.int64))
    at = np.arange(len(array))
    found = {(int(q), int(n)) for qs, ns in simhash.search_forest(array, parent, dist, np.zeros(len(array), np.int64), array, at) for q, n in zip(qs, ns, strict=True)}
    assert found == {(i, j) for i in at for j in at if (fps[i] ^ fps[j]).bit_count() <= 3}


@pytest.mark.parametrize("radius", [0, 2, 3, 4, 6])
def test_simhash_links_at_any_radius(spark, radius):
    r = random.Random(radius)
    fps = [r.getrandbits(64) for _ in range(20)]
    fps += [x ^ sum(1 << b for b in r.sample(range(64), radius + far)) for x in fps for far in (0, 1)]
    fps = sorted(set(fps))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= radius]
    reps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    found = [(x.src, x.dst) for x in simhash.links(reps, radius).collect()]
    assert components(len(fps), found) == components(len(fps), pairs)


def test_simhash_corner_cases(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    docs = documents(spark, [(3, "a b c d"), (3, "a b c d"), (1, "A B C D"), (None, "a b c d"), (None, "z y x w v u"), (9, None)])
    got = rows(simhash.near_duplicates(docs.withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))).select("doc_id", "component_id"))
    assert got == sorted([(3, 1), (3, 1), (1, 1), (None, 1), (None, None), (9, 9)], key=repr)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and rows(kept.select("doc_id")) == sorted([(1,), (9,), (None,), (None,)], key=repr)
    twice = documents(spark, [(1, "b one two three"), (1, "a one two three"), (2, "other words all of them")])
    assert rows(simhash.keep_one(twice).select("doc_id", "text"))[0] == (1, "a one two three")


# ---- lines ----------------------------------------------------------------------------


def similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return 1 - row[-1] / max(len(a), len(b), 1)


def line_fp(line):
    votes, total = [0] * 64, 0
    for w in line.split(" "):
        h, weight = xxhash.xxh64_intdigest(w.encode(), 42), max(1, min(7, len(w) // 2)) ** 2
        total += weight
        for b in range(64):
            votes[b] += weight * (h >> b & 1)
    return sum(1 << b for b in range(64) if votes[b] * 2 > total)


def test_lines_equal_brute_force(spark):
    r = random.Random(9)
    vocabulary = ["the", "of", "a", *["".join(r.choice("abcdefgh") for _ in range(r.randrange(4, 11))) for _ in range(200)]]
    pool = []
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randrange(3, 40))]
        pool.append(" ".join(words))
        for _ in range(r.randrange(4)):
            changed = list(words)
            changed[r.randrange(len(words))] = r.choice(["the", "of", "a", "to"])
            pool.append(" ".join(changed).upper())
    texts = [" \n".join(r.choice(pool) for _ in range(r.randrange(1, 6))) for _ in range(60)] + ["", None, "\n\n", pool[0], pool[0] + "\n" + pool[0]]
    norm = lambda x: " ".join(x.lower().split())
    lines = sorted({norm(x) for t in texts if t for x in t.split("\n") if norm(x)})
    fps = [line_fp(x) for x in lines]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3 and similarity(lines[i], lines[j]) >= 0.8 - 1e-9]
    assert len(pairs) > 5
    group = dict(zip(lines, components(len(lines), pairs), strict=True))
    seen = set()
    first = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if norm(x):
                first.setdefault(group[norm(x)], i)
    got = {r_.doc_id: r_ for r_ in line_dedup.dedup_lines(documents(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].text is None
            continue
        before = Counter(group[norm(x)] for x in t.split("\n") if norm(x))
        after = Counter(group[norm(x)] for x in got[i].text.split("\n") if norm(x))
        for g, n in after.items():  # of a group one line stays, in the first document that has it
            assert n == 1 and g not in seen and first[g] == i and before[g]
            seen.add(g)
    assert seen == set(group.values())


def test_line_corner_cases(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(f"word{i % 977}" for i in range(60000))
    docs = documents(spark, [(2, "one line here\n\none line  HERE\nother"), (1, "x\none line here"), (None, "other\nnull's own"), (None, None), (7, long), (8, long + "\nmore"), (5, "twice"), (5, "twice")])
    out = line_dedup.dedup_lines(docs.withColumn("line", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("pos", F.lit(2)))
    assert rows(out.select("doc_id", "text")) == sorted([(2, "\nother"), (1, "x\none line here"), (None, "null's own"), (None, None), (7, long), (8, "more"), (5, "twice"), (5, "twice")], key=repr)
    assert out.where("line = 'clash'").count() == 8


def test_lines_of_equal_fingerprint_are_all_compared(spark):
    base = ["abcdefghijklmn " + f"{c * 3} " * 6 for c in "bcd"]
    lines = [*[x + "x" for x in base], *[x + "q" for x in base]]
    assert len({line_fp(x) for x in lines}) == 1
    assert {(i, j) for i, j in itertools.combinations(range(6), 2) if similarity(lines[i], lines[j]) >= 0.8} == {(0, 3), (1, 4), (2, 5)}
    got = line_dedup.dedup_lines(documents(spark, list(enumerate(lines))))
    assert rows(got.select("doc_id", "text")) == [(i, x if i < 3 else "") for i, x in enumerate(lines)]


def test_fingerprints_of_heavy_and_common_lines(spark):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(14)) for _ in range(500)]
    common, heavy = (" ".join(r.choice(words) for _ in range(n)) for n in (9_000, 60_000))
    docs = documents(spark, [*[(None, common)] * 24, *[(i, common) for i in range(24)], (70, heavy), (71, "short one")]).select("doc_id", "text")
    got = {x.size: (x.fp % (1 << 64), x.n) for x in line_dedup.distinct_lines(docs).collect()}
    assert len(heavy) > line_dedup.HEAVY > len(common)
    assert got == {len(x): (line_fp(x), n) for x, n in ((common, 48), (heavy, 1), ("short one", 1))}


def test_reversed_lines_lose_no_link(spark):
    r = random.Random(21)
    lines = []
    for _ in range(20):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9))) for _ in range(14)]
        back = words[::-1]
        swapped = [*back[:5], back[6], back[5], *back[7:]]
        lines += [" ".join(x) for x in (words, back, swapped)]
        assert len({line_fp(x) for x in lines[-3:]}) == 1 and similarity(lines[-2], lines[-1]) >= 0.8 > similarity(lines[-3], lines[-2])
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(documents(spark, list(enumerate(lines)))).collect()}
    assert got == {i: "" if i % 3 == 2 else x for i, x in enumerate(lines)}


def test_many_equal_lines_in_one_text_and_many_null_ids(spark):
    line = "the same line of some length, which comes again and again " * 5
    many = "\n".join([line.strip()] * 5_000)
    docs = documents(spark, [(1, many), (2, "its own line\n" + line.strip()), *[(None, f"null text number {i}\n" + line.strip()) for i in range(5_000)]])
    got = line_dedup.dedup_lines(docs)
    assert {x.doc_id: x.text for x in got.where("doc_id IS NOT NULL").collect()} == {1: line.strip(), 2: "its own line"}
    assert got.where("doc_id IS NULL AND contains(text, 'again')").count() == 0 and got.count() == 5_002


def test_piecewise_edits_are_never_too_few(spark):
    r = random.Random(31)
    pairs = []
    for n in (1, 40, 200, 300, 900):
        for kind in range(6):
            a = [r.choice(["the", "of", "thor", "andinn", *["".join(r.choice("abcdé") for _ in range(r.randrange(2, 9))) for _ in range(3)]]) for _ in range(n)]
            b = list(a)
            for _ in range(kind):
                at = r.randrange(len(b) + 1)
                b[at : at + r.randrange(2)] = r.choice([[], ["new"], ["thor"] * 20])
            pairs.append((" ".join(a), " ".join(b)))
    pairs += [("thor " * 300, "tho " * 300), ("", ""), ("x" * 400, "x" * 380)]
    frame = spark.createDataFrame([(a, b, int(max(len(a), len(b)) * 0.2)) for a, b in pairs], "a string, b string, room int")
    got = frame.select("a", "b", "room", line_dedup._in_pieces("a", "b", "room").alias("n"), F.levenshtein("a", "b").alias("whole")).collect()
    assert all(x.n >= x.whole for x in got)
    assert sum(x.n <= x.room for x in got) > 20


# ---- mixing ---------------------------------------------------------------------------


def water(sizes, weights=(3, 1, 2), percent=150, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()) * percent / 100, set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s in share if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {s: cap * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_mix_meets_its_targets(spark):
    r = random.Random(4)
    docs = [(i, " ".join(["w"] * r.randrange(0, 400)), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(300)]
    got = mixing.mix(documents(spark, docs).withColumn("size", F.lit("clash")).withColumn("shard", F.lit(1))).collect()
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(t.split())
    goal, taken = water(sizes), defaultdict(int)
    assert len(got) == 300
    for x in got:
        taken[x.source] += x.taken
        assert 0 <= x.taken <= 2 * x.size and x.source_size == sizes[x.source] and abs(x.target - goal[x.source]) < 1e-6
    assert all(abs(taken[s] - goal[s]) <= 64 for s in goal)
    again = mixing.mix(documents(spark, docs).repartition(7).orderBy(F.desc("doc_id"))).select("doc_id", "taken")
    assert rows(again) == sorted([(x.doc_id, x.taken) for x in got], key=repr)


def test_applied_mix_holds_the_taken_words(spark):
    r = random.Random(6)
    docs = [(i, "\n".join(f"d{i}w{k}" for k in range(r.randrange(1, 200))), r.choice("abc")) for i in range(60)]
    frame = documents(spark, docs).withColumn("taken", F.lit("clash")).withColumn("__x", F.lit(1))
    taken = {x.doc_id: x.taken for x in mixing.mix(frame).collect()}
    out = mixing.apply_mix(frame)
    words = Counter()
    for x in out.collect():
        assert x.n_chars == len(x.text) and set(x.text.split()) <= set(dict((d, t) for d, t, _ in docs)[x.doc_id].split())
        words[x.doc_id] += len(x.text.split())
    assert out.columns == frame.columns and words == Counter({k: v for k, v in taken.items() if v})


def test_mix_of_null_and_repeated_ids(spark):
    r = random.Random(14)
    long = lambda i: " ".join(f"t{i}w{k}" for k in range(r.randrange(1, 90)))
    docs = [(None, long(i)) for i in range(300)] + [(7, f"{a} {b} {c}") for a in "abcd" for b in "efgh" for c in "ij"] + [(9, "the same row")] * 40
    frame = documents(spark, docs)
    mixed = mixing.mix(frame, shard_docs=64)
    assert mixed.count() == len(docs)
    size, target = sum(x.size for x in mixed.collect()), mixed.agg(F.max("target")).first()[0]
    assert abs(mixed.agg(F.sum("taken")).first()[0] - target) <= 0.05 * target and target == 1.5 * size
    out = rows(mixing.apply_mix(frame, shard_docs=64))
    assert out == rows(mixing.apply_mix(frame.repartition(9).orderBy(F.desc("text")), shard_docs=64))
    assert sum(len(x[1].split()) for x in out) == mixed.agg(F.sum("taken")).first()[0]


def test_sainte_lague_equals_brute_force(spark):
    r = random.Random(8)
    votes = [(g, k, r.choice([0, 1, 5, r.randrange(1000)]), 1, seats) for g, seats in (("a", 7), ("b", 500), ("c", 0), ("d", 33)) for k in range(9)]
    got = {(x.g, x.k): x.quota for x in mixing.sainte_lague(spark.createDataFrame(votes, "g string, k int, num long, den long, seats long"), ["g"], ["k"]).collect()}
    for g, seats in (("a", 7), ("b", 500), ("c", 0), ("d", 33)):
        mine = {k: n for h, k, n, _, _ in votes if h == g}
        won = Counter()
        for _ in range(seats):
            won[max((k for k in mine if mine[k]), key=lambda k: (mine[k] / (2 * won[k] + 1), -k))] += 1
        assert {k: won[k] for k in mine} == {k: got[g, k] for k in mine}


def test_mix_corner_cases(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert rows(mixing.mix(documents(spark, [(1, None), (2, " \n")])).select("doc_id", "size", "target", "taken")) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    got = mixing.mix(documents(spark, [(1, " a  b\tc "), (1, " a  b\tc "), (None, "d")]))
    assert sorted(x.size for x in got.collect()) == [1, 3, 3]
    assert mixing.mix(documents(spark, [(1, "x y")] * 3)).agg(F.sum("taken")).first()[0] == 9
    assert mixing.apply_mix(documents(spark, [(1, "x y")] * 3)).count() > 3


# ---- packing --------------------------------------------------------------------------


def test_packs_are_whole(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    r = random.Random(2)
    texts = ["", None, "Hello, World! it's", "a<|endoftext|>b", "é ñ ß Ünïcode — “x” 漢字 ١٢", "x" * 5000, *[" ".join(r.choice(["the", "Of", "tion,", "Straße", "don't", "12a"]) for _ in range(r.randrange(1, 3000))) for _ in range(40)], "twice", "twice"]
    docs = documents(spark, [*enumerate(texts), (0, "twice")]).withColumn("length", F.lit("clash"))
    got = packing.pack_documents(docs, tokenizer_path(), with_ids=True).collect()
    pieces, placed = defaultdict(dict), defaultdict(dict)
    for x in got:
        assert x.length == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        if x.doc_id:
            pieces[x.doc_id][x.start] = x
        assert x.offset not in placed[x.sequence_id]
        placed[x.sequence_id][x.offset] = x.length
    for i, t in enumerate(texts[1:], 1):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert [z for s in sorted(pieces[i]) for z in pieces[i][s].ids] == ids and {x.doc_tokens for x in pieces[i].values()} == {len(ids)}
    for seq in placed.values():
        at = 0
        for offset in sorted(seq):
            assert offset == at
            at += seq[offset]
        assert at <= 2048
    assert sorted(placed) == list(range(len(placed)))


def test_words_are_cut_as_the_tokenizer_cuts_them():
    words = packing.WordIds(tokenizer_path())
    whole = lambda x: np.array(words.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert len(spaces) == 29
    for c in [*spaces, "\x00", "\u200b", "\ufeff"]:
        for text in (f"ab{c}cd", c, f"{c}ab", f"ab {c} cd{c}", f"it{c}'s {c}{c}\n{c}1"):
            assert words.encode(text) == whole(text), repr(text)


def test_every_code_point_gives_the_tokenizers_ids():
    words = packing.WordIds(tokenizer_path())
    texts = [t for c in range(0x3001) for t in (chr(c), f"ab{chr(c)}cd")]
    whole = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, e in zip(texts, whole, strict=True) if words.encode(t) != np.array(e.ids, "<u4").tobytes()]
    assert not wrong


def test_histogram_packing_uses_it_up_and_pads_little():
    r = random.Random(1)
    counts = Counter(min(2048, int(r.expovariate(1 / 300)) + 1) for _ in range(50000))
    patterns = packing.pack_histogram(dict(counts))
    used = Counter()
    for times, pattern in patterns:
        assert sum(n * k for n, k in pattern) <= 2048
        for n, k in pattern:
            used[n] += times * k
    assert used == counts
    total = sum(n * k for n, k in counts.items())
    assert sum(t for t, _ in patterns) * 2048 < total * 1.01
    assert packing.pack_histogram({}) == [] and packing.pack_histogram({2048: 3}) == [(3, ((2048, 1),))]


@pytest.mark.parametrize("hot", [60, 120, 300])
def test_hot_lengths_share_sequences(hot):
    r = random.Random(1)
    counts = Counter(max(1, min(2048, int(r.lognormvariate(5.5, 1)))) for _ in range(20000))
    counts[hot] += 10000
    patterns = packing.pack_histogram(dict(counts))
    used = Counter()
    for times, pattern in patterns:
        assert times > 0 and sum(n * k for n, k in pattern) <= 2048
        for n, k in pattern:
            used[n] += times * k
    assert used == counts
    assert sum(t for t, _ in patterns) * 2048 < sum(n * k for n, k in counts.items()) * 1.01
    assert sum(t for t, _ in packing.pack_histogram({100: 1000})) == 50 == -(-1000 // (2048 // 100))


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0

"""Problems 4, 5, 7, 8 and 9 against other implementations, brute force and their own rules."""

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import bpe, leakage, mixing, packing, splitting

TEXTS = ["", "a", "Hello world's 123  x\n\n y", "<|endoftext|> is text", "नमस्ते दुनिया", "😀 ok", " lead", "trail  ", "=" * 300, "\r\n\t", chr(0xA0) + "x" + chr(0x1C) + "y"]


@pytest.fixture(scope="module")
def own():
    return bpe.load(bpe.default_vocabulary(), bpe.default_pattern())


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.default_vocabulary(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("other", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", TEXTS)
def test_encode(own, other, text):
    assert own.encode(text) == other.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab's l t12\n\t.,é क्" + chr(0xA0) + chr(0x200B), max_size=60))
def test_encode_any(text):
    tiktoken = pytest.importorskip("tiktoken")
    if not hasattr(test_encode_any, "other"):
        with open(bpe.default_vocabulary(), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        test_encode_any.other = tiktoken.Encoding("other", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    assert bpe.load(bpe.default_vocabulary(), bpe.default_pattern()).encode(text) == test_encode_any.other.encode_ordinary(text)


def test_documents_of_any_kind(spark, other):
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate([*TEXTS, None, "a"])], "doc_id long, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_documents(df).collect()}
    assert got == {k: other.encode_ordinary(t or "") for k, t in enumerate([*TEXTS, None, "a"])}
    back = {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_documents(df)).collect()}
    assert back == {k: t or "" for k, t in enumerate([*TEXTS, None, "a"])}
    assert bpe.encode_documents(df.limit(0)).count() == 0


def rule_broken(text, pieces, own, limit):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b < d
    for a, b, n in pieces:
        assert len(own.encode(text[a:b])) == n <= limit


@pytest.mark.parametrize("text", [" ".join(f"word{k}." for k in range(4000)), "\n\n".join(["A line of words. Another one."] * 900), "नमस्ते" * 3000, "x" * 30_000, ("y" * 5000 + " ") * 4])
def test_pieces_keep_their_rules(own, text):
    rule_broken(text, splitting.pieces_of(text, own, 512, 64), own, 512)


def test_cuts_prefer_paragraphs(own):
    text = "\n\n".join(["One sentence here. Another sentence there."] * 300)
    pieces = splitting.pieces_of(text, own, 256, 32)
    assert all(text[b : b + 2] == "\n\n" for _, b, _ in pieces[:-1])


def test_greedy_cuts_match_a_loop(own):
    random.seed(5)
    text = " ".join(random.choice(["alpha", "beta.", "gamma\n", "delta,"]) for _ in range(3000))
    ids, chars, kinds = splitting.boundaries(text, own)
    starts, ends = splitting.cuts(ids, kinds, 200, 20)
    s, walked = 0, []
    table = dict(zip(starts.tolist(), ends.tolist()))
    while True:
        walked.append(s)
        e = table[s]
        if e == len(ids) - 1:
            break
        s = min(range(s + 1, e + 1), key=lambda k: (abs(int(ids[k]) - (int(ids[e]) - 20)), k))
    assert walked == starts.tolist()


def test_split_tables(spark):
    long_ = "word. " * 3000
    df = spark.createDataFrame([(1, long_, 0), (2, "short", 0), (3, None, 0), (4, "", 0), (1, long_, 0)], "doc_id long, text string, piece int")
    assert [r.doc_id for r in splitting.oversized(df).collect()] == [1, 1]
    rows = splitting.split_documents(df).where("doc_id = 1").collect()
    assert all(long_[r.first : r.after] == r.text and r.n_ids <= 2048 for r in rows)
    assert splitting.split_documents(df.limit(0)).count() == 0


ITEMS = ["Because the oven failed Tesvasund rented one hundred pastries out of Orrimor and sold four of them per week until nothing at all remained. How many remained at the end?", "The keeper of the northern archive counted every medieval treaty twice before the winter and then gave seven of them away to a friend. How many remained at the end?"]


def test_leaks(spark):
    words = ITEMS[0].split()
    half = " ".join(words[4:18])
    swapped = " ".join("changed" if k == 7 else w for k, w in enumerate(words[4:20]))
    spoiled = " ".join("changed" if k % 4 == 0 else w for k, w in enumerate(words))
    rows = [
        (1, f"Before. {ITEMS[0].upper()} After."), (2, f"x {half} y"), (3, f"x {swapped} y"), (4, spoiled), (5, "How many remained at the end?"), (6, f"<b>{half.replace(' ', '</b> <i>', 1)}</i>"),
        (7, half.replace(" ", " " + chr(0x200B)).replace("out", "o" + chr(0xAD) + "ut")), (8, None), (9, ""), (10, " ".join(words[:6])), (11, ITEMS[1] + " " + ITEMS[0]), (1, ITEMS[0]),
    ]
    corpus = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEMS[0]), (2, ITEMS[1]), (3, None), (4, ""), (2, ITEMS[1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(corpus, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (6, 1), (7, 1), (11, 1), (11, 2)}
    assert leakage.find_leaks(corpus.limit(0), items).count() == 0 and leakage.find_leaks(corpus, items.limit(0)).count() == 0


def test_leaks_match_brute_force():
    import numpy as np

    random.seed(11)
    vocabulary = [f"w{k}" for k in range(12)]
    items = leakage.Items([(k, " ".join(random.choice(vocabulary) for _ in range(random.randint(10, 24)))) for k in range(6)])
    texts = []
    for _ in range(60):
        words = [random.choice([*vocabulary, "zz"]) for _ in range(30)]
        item = [next(w for w, n in items.words.items() if n == x) for x in items.arrays[random.randrange(6)]]
        part = item[random.randrange(4) : random.randrange(6, len(item) + 1)]
        for _ in range(random.randrange(3)):
            if part:
                part[random.randrange(len(part))] = "zz"
        texts.append(words[:10] + part + words[10:])
    ids = [np.append([items.words.get(w, 0) for w in t], 0).astype(np.int64) for t in texts]
    begins = np.cumsum([0, *map(len, ids)])
    shard = leakage.Shard(np.concatenate(ids), items)
    told = {(d, k): (n, at - begins[d], run) for d, k, n, at, run in leakage.leaks(shard, leakage.parted(begins))}
    want = {}
    for d, doc in enumerate(x[:-1] for x in ids):
        for k, item in enumerate(items.arrays):
            best = 0
            for shift in range(-len(item), len(doc)):
                same = [0 <= shift + j < len(doc) and doc[shift + j] == item[j] for j in range(len(item))]
                inside = [0 <= shift + j < len(doc) for j in range(len(item))]
                for a in range(len(item)):
                    for b in range(a + items.least[k], len(item) + 1):
                        if all(inside[a:b]) and (b - a - sum(same[a:b])) * leakage.EXCHANGED <= b - a:
                            best = max(best, b - a)
            if best:
                want[d, k] = best
    assert {k: n for k, (n, _, _) in told.items()} == want
    for (d, k), (n, at, run) in told.items():
        part = ids[d][at : at + n].tolist()
        item = items.arrays[k].tolist()
        assert any(sum(x != y for x, y in zip(part, item[a : a + n])) * leakage.EXCHANGED <= n for a in range(len(item) - n + 1)) and run >= items.seeds[k]


def test_the_suffix_array_is_in_full_order_and_gives_the_longest_matches():
    import numpy as np

    random.seed(3)
    items = leakage.Items([(k, " ".join(random.choice("abcde") for _ in range(random.randint(8, 30)))) for k in range(5)])
    words = np.array([random.choice([0, 1, 2, 3, 4, 5]) if random.random() < 0.2 else random.choice([1, 2, 3, 4, 5]) for _ in range(600)])
    words[100:112] = items.arrays[0][-12:]
    shard = leakage.Shard(words, items)
    # A suffix is compared up to the first word that no item has.
    cut = lambda a: tuple(words[a:][: np.argmax(np.append(words[a:], 0) == 0)][: items.longest])
    assert [cut(a) for a in shard.all] == sorted(map(cut, shard.all)) and len(set(shard.all)) == len(shard.all)
    shortest = min(items.suffixes)
    assert sorted(shard.all) == [a for a in range(600 - shortest + 1) if (words[a : a + shortest] > 0).all()]
    seen = 0
    for found in shard.searched():
        starts, which, at, *_ = found
        matched, where = shard.longest(*found)
        for w, a, n, b in zip(which, at, matched, where):
            item = items.arrays[w][a:]
            shared = lambda p: next((k for k, (x, y) in enumerate(zip([*item, -1], [*words[p:], -2])) if x != y))
            assert n == max(map(shared, starts)) == shared(b)
            seen += 1
    assert seen > 20


def test_hot_seeds_are_searched_in_bounded_blocks(monkeypatch):
    import numpy as np

    monkeypatch.setattr(leakage, "CELLS", 100)
    items = leakage.Items([(1, "a b a b a b a b c d e f")])
    words = np.array([items.words["a"], items.words["b"]] * 400 + [0])
    assert [(d, k, n, run) for d, k, n, _, run in leakage.leaks(leakage.Shard(words, items), leakage.parted(np.array([0, 801])))] == [(0, 0, 9, 8)]


def test_leaking_documents_are_removed(spark):
    corpus = spark.createDataFrame([(1, ITEMS[0], "x"), (2, "nothing here", "y"), (2, "nothing here", "y"), (None, "no id", None)], "doc_id long, text string, words string")
    items = spark.createDataFrame([(7, ITEMS[0])], "item_id long, text string")
    leaks = leakage.find_leaks(corpus, items)
    row = leaks.first()
    assert (row.doc_id, row.item_id, row.words, row.first_word, row.verbatim) == (1, 7, row.item_words, 0, row.item_words)
    assert [tuple(r) for r in leakage.longest_matches(corpus, items).collect()] == [(7, row.item_words, 0, 1, 0)]
    assert leakage.longest_matches(corpus, items.limit(0)).count() == 0 and leakage.longest_matches(corpus.limit(0), items).count() == 0
    kept = leakage.without_leaks(corpus, leaks)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 2] and kept.columns == corpus.columns


def test_items_beyond_a_block_are_searched_in_several(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_CHARS", 100)
    corpus = spark.createDataFrame([(1, ITEMS[0]), (2, ITEMS[1])], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEMS[0]), (2, ITEMS[1])], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(corpus, items).collect()} == {(1, 1), (2, 2)}


def test_packing_keeps_documents_whole(spark):
    random.seed(7)
    rows = [("s", k, f"d{k}", [5 + (k + j) % 50 for j in range(random.choice([0, 1, 300, 700, 1100, 2048, 2049, 5000]))]) for k in range(300)]
    df = spark.createDataFrame([*rows, rows[3], rows[5], ("s", 999, None, None)], "shard_id string, pos int, doc_id string, tokens array<int>")
    got = packing.pack(df).collect()
    tokens = {r[2]: r[3] for r in rows}
    seen = {}
    for r in got:
        assert r.used + r.padding_count == 2048 == len(r.input_ids) and r.utilization == r.used / 2048
        for s in r.spans:
            part = r.input_ids[s.start_idx : s.end_idx]
            assert part == tokens[s.doc_id][s.doc_start : s.doc_start + len(part)]
            seen.setdefault(s.doc_id, []).append(len(part))
    assert {k: sum(v) for k, v in seen.items()} == {k: len(v) for k, v in tokens.items() if v}
    assert all(len(v) == 1 for k, v in seen.items() if len(tokens[k]) <= 2048)
    assert len({r.sequence_id for r in got}) == len(got)
    assert packing.pack(df.limit(0)).count() == 0


def test_bins_match_best_fit():
    bins = packing.Bins(10, 3)
    closed = [b for n, size in enumerate([6, 5, 4, 3, 9, 8, 5]) for b in bins.put((n, 0, size), size)]
    # 6 and 4 fill a bin; with three bins open, the fullest (9) closes when 5 finds no room.
    assert [i[0] for i in closed[0]] == [0, 2]
    rest = bins.rest()
    assert sorted(i[0] for b in closed + rest for i in b) == list(range(7)) and all(sum(i[2] for i in b) <= 10 for b in closed + rest)


def test_mixing_meets_shares(spark):
    random.seed(9)
    names = ["code", " Code", "CODE ", "general-web", "General", "indic"]
    rows = [(f"s{k}", random.randint(500, 1500), names[k % 6], f"2025-01-0{1 + k % 9}") for k in range(900)]
    rows += [("s0", None, None, "2024-01-01"), ("n", None, "code", "2025-01-01"), ("z", 0, "code", "2025-01-01"), (None, 5, "code", "2025-01-01"), ("x", 700, None, "2025-01-01")]
    shards = spark.createDataFrame(rows, "shard_id string, token_count int, capability_lane string, at string").selectExpr("shard_id", "token_count", "capability_lane", "to_timestamp(at) AS ingested_at")
    lanes = spark.createDataFrame([("f", "s", 0, "code", 0.5, 2), ("f", "s", 1, "general_web", 0.2, 3), ("f", "s", 2, "indic", 0.35, 1)], "family string, stage string, pos int, lane string, share double, max_repeats int")
    got = mixing.select_shards(shards, lanes, 4096).cache()
    total = sum(r[1] for r in rows if r[0] and r[1] and r[0] not in ("n", "z"))
    by = {r.lane: (r.tokens, r.most) for r in got.groupBy("lane").agg(F.sum("tokens").alias("tokens"), F.max("take").alias("most")).collect()}
    for lane, share, most in (("code", 0.5 / 1.05, 2), ("general_web", 0.2 / 1.05, 3)):
        assert abs(by[lane][0] / total - share) < 0.01 and by[lane][1] <= most
    held = sum(r[1] for r in rows if r[2] == "indic" and r[1])
    # A lane that falls short gives all but what the schedule's rounding leaves.
    assert held - 4 * 4096 <= by["indic"][0] <= held and by["indic"][1] == 1
    size = dict((r[0], r[1]) for r in rows if r[1])
    pieces = {}
    for r in got.collect():
        pieces.setdefault((r.lane, r.shard_id, r.take), []).append((r.first_token, r.first_token + r.tokens))
    for (_, shard, _), parts in pieces.items():
        parts.sort()
        assert all(a < b <= size[shard] for a, b in parts) and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
    # Every slot but a lane's last holds a whole block, and every stretch of the schedule is close to the shares.
    filled = {}
    for r in got.collect():
        filled.setdefault(r.slot, [r.lane, 0])[1] += r.tokens
    assert sum(n != 4096 for _, n in filled.values()) <= 3
    order = [filled[k][0] for k in sorted(filled)]
    whole = sum(n for n, _ in by.values())
    for upto in (40, 100, len(order)):
        assert all(abs(order[:upto].count(lane) / upto - by[lane][0] / whole) < 0.08 for lane in by)
    assert mixing.select_shards(shards.limit(0), lanes).count() == 0


def test_schedule_is_even(spark):
    stages = [{"family": "f", "stage": "s", "lane": n, "take": u} for n, u in (("a", 100_000), ("b", 140_000), ("none", 0), ("c", 160_000))]
    rows = mixing.slots(stages, 10, spark).collect()
    assert len(rows) == 40_000
    first = [r.lane for r in sorted(rows, key=lambda r: r.slot)]
    for upto in (100, 1000, 20_000, 40_000):
        assert abs(first[:upto].count("a") - 0.25 * upto) < 8
    assert sorted(r.rank for r in rows if r.lane == "b") == list(range(first.count("b")))


def test_what_gives_way_where_a_lane_is_short():
    lanes = [{"lane": "a", "share": 0.5, "max_repeats": 1}, {"lane": "b", "share": 0.25, "max_repeats": 4}, {"lane": "c", "share": 0.25, "max_repeats": 1}]
    held = {"a": 100, "b": 800, "c": 260}
    assert mixing.dealt_tokens(lanes, held, 1000) == [100, 250, 250]
    assert mixing.dealt_tokens(lanes, held, 1000, "scale") == [100, 50, 50]
    assert mixing.dealt_tokens(lanes, held, 1000, "fill") == [100, 640, 260]
    assert mixing.dealt_tokens(lanes, {}, 1000, "fill") == [0, 0, 0] and mixing.dealt_tokens([], {}, 5) == []
    with pytest.raises(ValueError):
        mixing.dealt_tokens(lanes, held, 1000, "other")


def test_repacking_is_an_option():
    def made(repack):
        bins = packing.Bins(10, 50)
        closed = [b for n in range(40) for b in bins.put((n, 0, 6 if n < 20 else 5), 6 if n < 20 else 5)]
        return closed + bins.put(("x", 0, 4), 4) + bins.rest(repack)

    for repack in (False, True):
        assert sorted(str(i[0]) for b in made(repack) for i in b) == sorted([*map(str, range(40)), "x"])
    assert len(made(True)) <= len(made(False))


def test_rows_whose_hash_is_shared_are_compared_whole(spark, monkeypatch):
    rows = [("s", k % 3, "d", [k % 3] * 5) for k in range(30)]
    df = spark.createDataFrame(rows, "shard_id string, pos int, doc_id string, tokens array<int>")
    monkeypatch.setattr(packing.F, "xxhash64", lambda *columns: packing.F.lit(1))
    assert sum(len(r.spans) for r in packing.pack(df).collect()) == 3
    monkeypatch.setattr(packing, "REPEATED_MOST", 0)
    assert sum(len(r.spans) for r in packing.pack(df).collect()) == 3


def test_patterns_that_join_words_and_spaces_are_applied_whole(own):
    whole = bpe.ByteBpe(bpe.default_vocabulary(), r"[\s\S]+?(?:  |$)|[\s\S]+")
    assert own.separable and not whole.separable
    assert whole.decode(whole.encode("a  b c  d")) == "a  b c  d" and whole.encode("") == []
    with pytest.raises(ValueError):
        splitting.boundaries("a b", whole)


@pytest.mark.parametrize("limit", [4, 8, 16, 40])
def test_no_piece_exceeds_the_limit(own, limit):
    text = "नमस्ते" * 60 + " word and more words. " * 5 + "😀" * 40
    found = splitting.pieces_of(text, own, limit, 1)
    assert found[0][0] == 0 and found[-1][1] == len(text) and all(a[1] >= b[0] for a, b in zip(found, found[1:]))
    assert all(len(own.encode(text[a:b])) <= limit for a, b, _ in found)


def test_round_trip_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (3, "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_ids > 0, r.same) for r in bpe.round_trip(df).collect()) == [(1, True, True), (2, False, True), (3, False, True), (3, True, True)]

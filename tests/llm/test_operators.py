"""Each operator against a brute-force version, and on the cases its docstring defines."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from foliospark.llm import chat_format, decontamination, license_scan, license_texts, near_dedup, packing, quality, shared, sharding, substring_dedup, textcore, topk_search, url_filter

DOCS = "doc_id long, text string, lang string"


def words_of(n, seed, vocabulary=5000):
    r = np.random.default_rng(seed)
    return [f"w{i}" for i in r.integers(0, vocabulary, n)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


LONG = " ".join(words_of(6000, 1))
PASSAGE = words_of(60, 2)
EDGE = [
    (None, "only text " + " ".join(words_of(50, 3)), None), (1, None, "en"), (2, "", None), (3, "  \n ", "en"), (4, "a", "x"), (5, "a b", "x"), (6, "a b", "x"),
    (7, LONG, "en"), (8, LONG, "en"), (9, LONG.replace("w17", "W17 "), "de"), (10, LONG, "en"), (10, LONG, "en"),
    (11, " ".join(words_of(30, 4) + PASSAGE + words_of(30, 5)), "en"), (12, " ".join(words_of(10, 6) + PASSAGE + words_of(3, 7)), "en"),
    (13, "z " * 200, "en"), (14, "É é Ü Α " * 30, "fr"), (15, "x" * 300_000 + " y", "en"),
]


# 7


def removed(rows, k):
    seen = collections.Counter()
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for _, w in split:
        seen.update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if seen[tuple(w[j : j + k])] > 1:
                gone[j : j + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((-1 if i is None else i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("k", [35, 5])
def test_substring_dedup(spark, k):
    got = substring_dedup.remove_repeats(frame(spark, EDGE), min_words=k, digest=True)
    rows = got.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == removed(EDGE, k)
    by = {r.doc_id: r for r in rows}
    assert by[1].dedup_text is None and by[2].dedup_text == "" and by[11].lang == "en"
    assert [tuple(s) for s in by[12].removed_spans] == [(10, 70)]
    assert by[12].dedup_text.split() == words_of(10, 6) + words_of(3, 7)


def test_substring_dedup_heavy_prefixes(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", 50)
    rows = [(i, "the same first words of every text for a good while here now " + " ".join(words_of(40, i % 7)), "en") for i in range(60)]
    got = substring_dedup.remove_repeats(frame(spark, rows), min_words=20, digest=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed(rows, 20)


def thue_morse(n):
    a = "ab"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = thue_morse(1024)
    words = words_of(40, 90)
    rows = [(1, " ".join([*words[:17], a, *words[17:34]]), "x"), (2, " ".join([*words[:17], b, *words[17:34]]), "x")]
    got = substring_dedup.remove_repeats(frame(spark, rows), digest=True).collect()
    assert [r.n_removed for r in got] == [0, 0]
    linked_rows = [(i, " ".join(words[:30] + [x] + words[30:33]), "x") for i, x in ((1, a), (2, b))]
    assert [r.component_id for r in near_dedup.near_duplicates(frame(spark, linked_rows), 3, (85, 100)).orderBy("doc_id").collect()] == [1, 2]
    long = words_of(700, 91, 2)  # two words only: sequences that repeat much
    assert len({textcore.rolling(textcore.Words(pa.array([t])).hashes, 2048)[0] for t in (" ".join(thue_morse(2048)[0]), " ".join(thue_morse(2048)[1]))}) == 2
    rows = [(1, " ".join(long), "x"), (2, " ".join(long[::-1]), "x")]
    got = substring_dedup.remove_repeats(frame(spark, rows), min_words=12, digest=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed(rows, 12)


@pytest.mark.parametrize("group", [3, 1 << 15])
def test_substring_dedup_hot_passages(spark, monkeypatch, group):
    """A passage in every document, with other words before, in and after it, and equal copies; as hot keys and heavy anchors."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(shared, "HOT", 7)
    monkeypatch.setattr(shared, "LEAST", 0)
    r, hot, rows = np.random.default_rng(12), words_of(45, 92), []
    for i in range(150):
        own = list(hot)
        if i % 3 == 0:
            own[int(r.integers(45))] = f"other{i % 9}"
        rows.append((i, " ".join(words_of(i % 4, i) + own[i % 5 :] + words_of(i % 7, 200 + i)), "x"))
    rows += [(200 + i, "equal copy " + "\n".join(hot) + "  \t end", "x") for i in range(40)]
    got = substring_dedup.remove_repeats(frame(spark, rows).repartition(6), min_words=20, digest=True).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got) == removed(rows, 20)


def test_suffix_trees_against_brute_force():
    r = np.random.default_rng(13)
    for k in (1, 3, 8):
        texts = [" ".join(r.choice(list("abc"), r.integers(k, 30))) for _ in range(12)]
        split = [t.split() for t in texts]
        seen = collections.Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
        want = {(d, i) for d, w in enumerate(split) for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1}
        who, at = substring_dedup.deep_suffixes(pa.array(texts, pa.large_string()), k)
        assert set(zip(who.tolist(), at.tolist(), strict=True)) == want


def test_texts_are_shuffled_once(spark):
    plan = substring_dedup.remove_repeats(frame(spark, EDGE))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_empty_tables_and_clashing_names(spark):
    none = frame(spark, [])
    assert substring_dedup.remove_repeats(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert license_scan.scan(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert quality.score(none, np.zeros(quality.BUCKETS, np.float32)).count() == 0
    bench = frame(spark, [], "item_id long, text string")
    assert decontamination.find_leaks(none, bench).count() == 0
    clash = frame(spark, [(1, "a b", 5, "x", "y", 2.0)], "doc_id long, text string, n_words int, leaks string, predicted string, score double")
    assert substring_dedup.remove_repeats(clash).first().n_words == 2
    assert quality.score(clash, np.zeros(quality.BUCKETS, np.float32)).first().score == 0.5
    assert decontamination.find_leaks(clash, frame(spark, [(1, "p q r s t u")], "item_id long, text string")).first().leaks == []
    for f in (near_dedup.near_duplicates, packing.pack_documents, license_scan.scan, sharding.shard):
        assert f(clash).count() == 1


# 4


def linked(rows, size, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        s = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        if i is not None:
            sets[i] = s
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows():
    rows, r = list(EDGE), np.random.default_rng(5)
    for base in range(4):
        text = words_of(120, 100 + base)
        for copy in range(25):
            new = list(text)
            for _ in range(int(r.integers(0, 8))):
                new[int(r.integers(0, len(new)))] = f"n{copy}{base}{r.integers(1000)}"
            rows.append((100 + 25 * base + copy, " ".join(new), "en"))
    return rows


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, num):
    rows = near_rows()
    got = near_dedup.near_duplicates(frame(spark, rows), size, (num, 100)).collect()
    assert len(got) == len(rows)
    want = linked(rows, size, num, 100)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_super_min_hash_estimates_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 900).astype(np.uint64))
    both, m = a[:600], 512
    b = np.unique(np.concatenate([both, r.integers(0, 2**63, 300).astype(np.uint64)]))
    same = np.mean(near_dedup.super_min_hash(a, m) == near_dedup.super_min_hash(b, m))
    assert abs(same - len(both) / len(np.union1d(a, b))) < 0.07
    few = near_dedup.super_min_hash(a[:3], 16)
    assert (few < 16 << 40).all()


def test_rows_that_share_an_id_stay_apart(spark):
    a, b = " ".join(words_of(40, 93)), " ".join(words_of(40, 94))
    rows = [(3, a, "x"), (7, a, "x"), (7, b, "x"), (9, b + " end", "x"), (7, b, "x"), (3, "", "x"), (3, None, "x")]
    got = near_dedup.near_duplicates(frame(spark, rows), 3, (85, 100)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(tuple(r) for r in got) == [(3, 0, 3, True), (3, 0, 3, True), (3, 38, 3, True), (7, 38, 3, False), (7, 38, 7, True), (7, 38, 7, True), (9, 39, 7, False)]


def test_near_duplicates_with_hot_keys(spark, monkeypatch):
    for module, name, value in ((shared, "HOT", 5), (shared, "LEAST", 0), (near_dedup, "FAN", 4), (near_dedup, "UNION", 10)):
        monkeypatch.setattr(module, name, value)
    rows = near_rows() + [(500 + i, LONG, "x") for i in range(60)]
    want = linked(rows, 3, 85, 100)
    got = near_dedup.near_duplicates(frame(spark, rows).repartition(6), 3, (85, 100)).filter("doc_id is not null").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got if (r.n_shingles, r.component_id) != want[r.doc_id]] == []


def test_bands_find_pairs_at_the_threshold():
    r = np.random.default_rng(14)
    m, missed = near_dedup.BANDS * near_dedup.ROWS, 0
    for _ in range(1500):
        x = r.integers(0, 2**63, 222).astype(np.uint64)
        a, b = np.unique(x[:204]), np.unique(np.concatenate([x[:186], x[204:]]))
        assert len(a) + len(b) - len(np.intersect1d(a, b)) == 222 and len(np.intersect1d(a, b)) == 186  # 0.838
        keys = [near_dedup.band_keys(near_dedup.super_min_hash(s, m), near_dedup.BANDS, near_dedup.ROWS) for s in (a, b)]
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (103, 102)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in near_dedup.components(edges).df.collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100, 103: 102}


# 1


def test_decontamination(spark):
    items = [(1, " ".join(words_of(30, 50))), (2, " ".join(words_of(14, 51))), (3, "too short"), (4, None), (None, "a b c d e f"), (5, " ".join(words_of(30, 50)))]
    exact = words_of(40, 52) + words_of(30, 50) + words_of(5, 53)
    near = words_of(40, 54) + words_of(30, 50)[:29] + ["other"] + words_of(5, 55)
    far = words_of(40, 56) + words_of(30, 50)[:12] + words_of(30, 57)
    rows = [(1, " ".join(exact).upper(), None), (2, ", ".join(near) + ".", "x"), (3, " ".join(far), "x"), (4, None, None), (5, "", "x"), (6, " ".join(words_of(20, 58) + words_of(14, 51)), "x"), (6, " ".join(words_of(20, 58) + words_of(14, 51)), "x"), (None, " ".join(exact), "x")]
    got = decontamination.find_leaks(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()
    said = sorted((-1 if r.doc_id is None else r.doc_id, [(h.item_id, round(h.similarity, 3), h.first_word, h.n_words) for h in r.leaks]) for r in got)
    both = [(1, 1.0, 40, 30), (5, 1.0, 40, 30)]
    assert said == [(-1, both), (1, both), (2, [(1, 0.926, 39, 30), (5, 0.926, 39, 30)]), (3, []), (4, []), (5, []), (6, [(2, 1.0, 20, 14)]), (6, [(2, 1.0, 20, 14)])]


def test_documents_shorter_than_the_item(spark):
    item, other = words_of(36, 60), words_of(20, 61)
    items = [(1, " ".join(item)), (2, " ".join(other)), (3, " ".join(item[:-1] + ["else"]))]
    texts = [item[:-1], item[1:], item[:30], item[2:-2], item[:29], other[:-3], other[:-4], item[:20] + ["x"] + item[21:35], item[:4], words_of(30, 62)]
    rows = [(i, " ".join(t), "x") for i, t in enumerate(texts)]

    def similar(a, b):
        x, y = (collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in (a, b))
        return sum((x & y).values()) / max(1, sum((x | y).values()))

    want = {i: [(k, similar(t, w.split())) for k, w in items if similar(t, w.split()) >= 0.8] for i, t in enumerate(texts)}
    assert want[0] == [(1, 31 / 32), (3, 31 / 32)] and want[2] and not want[4] and want[5] and not want[6]
    got = decontamination.find_leaks(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()
    assert {r.doc_id: [(h.item_id, h.similarity) for h in r.leaks] for r in got} == want
    assert all((h.first_word, h.n_words) == (0, len(texts[r.doc_id])) for r in got for h in r.leaks)


def test_decontamination_against_brute_force():
    """Of changed passages whose best window is similar enough, nearly all are found; no other ones are."""
    r = np.random.default_rng(18)
    items = [(i, words_of(int(n), 700 + i)) for i, n in enumerate(r.integers(12, 80, 40))]
    index = decontamination.Index([(i, " ".join(w)) for i, w in items])
    grams = lambda w: collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    asked = caught = 0
    for n in range(240):
        item, words = items[n % 40]
        new = list(words)
        for _ in range(int(r.integers(0, 3))):
            new[int(r.integers(len(new)))] = f"new{n}"
        text = words_of(n % 30, 800 + n) + new + words_of(n % 17, 1100 + n)
        hits = {h[0]: h[1] for h in index.hits(pa.array([" ".join(text)]))[0]}
        size, want = len(words), {}
        for i, own in items:
            theirs = grams(own)
            windows = [grams(text[a : a + len(own)]) for a in range(max(1, len(text) - len(own) + 1))]
            best = max(sum((x & theirs).values()) / sum((x | theirs).values()) for x in windows)
            if best >= decontamination.THRESHOLD:
                want[i] = best
        assert set(hits) <= set(want) and all(hits[i] <= want[i] + 1e-9 for i in hits) and size
        asked += len(want)
        caught += len(hits)
    assert asked > 100 and caught / asked >= 0.98, (caught, asked)


def test_very_long_texts(spark):
    long, passage = words_of(150_000, 19), words_of(30, 50)
    text = " ".join(long + passage)
    rows = [(1, text, "x"), (2, "y" * 2_000_000, "x")]
    leaks = decontamination.find_leaks(frame(spark, rows), frame(spark, [(1, " ".join(passage))], "item_id long, text string")).orderBy("doc_id").collect()
    assert [[(h.item_id, h.first_word) for h in r.leaks] for r in leaks] == [[(1, 150_000)], []]
    assert [(r.doc_id, r["size"]) for r in sharding.shard(frame(spark, rows), 2).orderBy("doc_id").collect()] == [(1, len(text) + 1), (2, 2_000_001)]
    assert quality.score(frame(spark, rows), np.zeros(quality.BUCKETS, np.float32)).count() == 2
    nodes, leaves = chat_format.prefix_tree(spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string"))
    assert chat_format.read_back(nodes, leaves).first().formatted_chars == len(chat_format.formatted("user", text)[0])


def test_hamming_blocks_find_every_print_in_the_radius():
    index = decontamination.Index([(i, " ".join(words_of(20, 200 + i))) for i in range(40)])
    r = np.random.default_rng(3)
    for k in range(200):
        item = k % 40
        bits = np.unpackbits(index.prints[item].view(np.uint8))
        bits[r.choice(128, decontamination.RADIUS, replace=False)] ^= 1
        assert item in index.found(np.packbits(bits).view(np.uint16)[None], 16)[0]


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS", 2)
    items = [(i, " ".join(words_of(12, 300 + i))) for i in range(5)]
    rows = [(i, " ".join(words_of(9, 400 + i) + words_of(12, 300 + i)), "x") for i in range(5)]
    got = decontamination.find_leaks(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()
    assert {r.doc_id: [h.item_id for h in r.leaks] for r in got} == {i: [i] for i in range(5)}


# 6


def test_quality(spark):
    rows = [(i, "|| " * 4 * (i % 4 == 0) + " ".join(words_of(40, i, 300)), "en") for i in range(400)] + [(1000, None, "x"), (1001, "", "x"), (None, "|| || || || a", None)]
    labels = [(i, 0 if i % 4 == 0 else 1) for i in range(400)] + [(None, 1), (5, None)]
    docs = frame(spark, rows)
    weights = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality.score(docs, weights).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 90 and np.mean([got[i].predicted == (i % 4 != 0) for i in held]) > 0.97
    assert got[1000].score == got[1001].score and got[None].predicted == 0
    assert not quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")).any()


# 10


def library_ids(path, texts):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    return [full.encode(t, add_special_tokens=False).ids for t in texts]


def encoded(encode, texts):
    ids, counts = encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name, monkeypatch):
    path = packing.tokenizer_file(name)
    texts = ["", "  ", "don't we'LL 'S it's''s ...a.b,c 12a½ x²", "ΣΑΣ ΟΔΟΣ.", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> c<|", "a\x1cb c d\xa0e", "E\u0301 é İstanbul ﬁ \u212b H\u0331", "日本語 テキスト, русский текст! ไทย नमस्ते", "a\tb\r\nc\x0bd", "x." * 3, "'d'm", "_a_ -b- (c)", "😀👍🏽 z", ".", " , ", "ǅ ǆ Ⅷ ⅷ", "w,, w., .w Hello World, it's 2024", "a×b ÷ ÀÉÞß àéþÿ!? Éa... b'. c'' straße,", "x" * 70 + ". " + "Y" * 64 + "!"]
    r = np.random.default_rng(9)
    texts += [" ".join("".join(r.choice(list("abcdeEinrstTéÜ"), r.integers(1, 20))) + ("", ".", ",!", "%%%")[r.integers(4)] for _ in range(300)) for _ in range(4)]
    want = library_ids(path, texts)
    encode = packing.Encoder(path)
    assert encode.cuts == name.startswith("word")
    assert encoded(encode, texts) == want and encoded(encode, texts[::-1]) == want[::-1]
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    monkeypatch.setattr(packing, "SLOTS", 64)
    small = packing.Encoder(path)
    assert [encoded(small, [t])[0] for t in texts * 2] == want * 2


def fewest(lengths, capacity):
    """The least number of sequences, by trying everything."""
    best = len(lengths)

    def put(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for j in {r: j for j, r in enumerate(room) if r >= lengths[i]}.values():
            put(i + 1, [*room[:j], room[j] - lengths[i], *room[j + 1 :]])
        put(i + 1, [*room, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


def test_plan_against_brute_force():
    r, more = np.random.default_rng(11), 0
    for _ in range(80):
        lengths = r.integers(1, 21, r.integers(1, 10)).tolist()
        used = sum(n for _, n in packing.plan(collections.Counter(lengths), 20))
        least = fewest(lengths, 20)
        assert least <= used <= least + 1
        more += used - least
    assert more <= 2


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    r = np.random.default_rng(seed)
    counts = collections.Counter(r.integers(1, 101, 400).tolist())
    plan = packing.plan(counts, 100)
    used = collections.Counter()
    for lengths, n in plan:
        assert n > 0 and sum(lengths) <= 100
        for x in lengths:
            used[x] += n
    # No packing is smaller: of pieces over 100 - t none share a sequence, and those from t to 50 fill at most what they leave.
    size = lambda low, high: sum(k * n for k, n in counts.items() if low <= k <= high)
    many = lambda low, high: sum(n for k, n in counts.items() if low <= k <= high)
    least = max(many(51, 100) + max(0, -(-(size(t, 50) - (100 * many(51, 100 - t) - size(51, 100 - t))) // 100)) for t in range(51))
    assert used == counts and sum(n for _, n in plan) <= least + 2
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


def test_packing(spark):
    rows = EDGE[:14] + [(20, LONG * 2, "en")]
    got = packing.pack_documents(frame(spark, rows), keep_ids=True)
    packed = got.collect()
    whole = library_ids(packing.tokenizer_file(), [t or "" for _, t, _ in rows])
    want = sorted((-1 if i is None else i, k // 4096, k, np.array(ids[k : k + 4096], "<u4").tobytes()) for (i, _, _), own in zip(rows, whole, strict=True) for ids in [[*own, 1]] for k in range(0, len(ids), 4096))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, bytes(r.ids)) for r in packed) == want
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 for r in packed)
    by = collections.defaultdict(list)
    for r in packed:
        by[r.sequence_id].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 4096
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(got).collect()}
    assert sum(map(len, whole.values())) == sum(len(r.ids) for r in packed) and max(map(len, whole.values())) <= 4 * 4096


# 2


def test_escapes_of_random_texts():
    r = np.random.default_rng(17)
    for _ in range(20000):
        text = "".join(r.choice(["<", "[", "|", ">", "]", "\\", "s", "/", "INST", "SYS", "a b", "im_end", "x" * 39], int(r.integers(1, 12))))
        segment, a, b = chat_format.formatted(text, text)
        assert chat_format.unescape(chat_format.escape(text)) == text and chat_format.parsed(segment) == [(text, text)] and chat_format.unescape(segment[a:b]) == text


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_start|>", "a\\", "<<s>", "[\\\\INST]", "<|im_start|>user\nx<|im_end|>\n", "[[INST]", "<\\<SYS>>", "<|reserved_special_token_0|>", "<start_of_turn>user", "<bos>", "<unused12>", "<think>x</think>", "[TOOL_CALLS]", "<｜end▁of▁sentence｜>", "a<b>c", "[/INST] [1]"])
def test_escapes_are_reversible(text):
    out = chat_format.escape(text)
    for control in ("<|reserved_special_token_0|>", "<start_of_turn>", "<bos>", "<unused12>", "</think>", "[TOOL_CALLS]", "<|im_end|>", "</s>", "[INST]", "<<SYS>>"):
        assert control not in out
    assert chat_format.unescape(out) == text
    for role in ("user", "a\nb", "<|im_end|>", "\\n", ""):
        segment, a, b = chat_format.formatted(role, text)
        assert chat_format.parsed(segment * 2) == [(role, text)] * 2 and chat_format.unescape(segment[a:b]) == text


def test_prefix_tree(spark):
    chats = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "assistant", "b"), (3, 0, "user", "q"), (4, 1, "assistant", None), (4, 0, None, "<|im_end|>"), (None, 0, "user", "n"), (5, 0, "user", "q"), (5, 1, "assistant", "a"), (6, 0, "user", "x"), (6, 0, "user", "x")]
    chats += [(7, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(150)]
    nodes, leaves = chat_format.prefix_tree(spark.createDataFrame(chats, "conv_id long, turn long, role string, text string"))
    got = nodes.collect()
    stream = "".join(r.segment for r in sorted(got, key=lambda r: r.place))
    for r in got:
        assert stream[r.place : r.place + r.units] == r.segment
        seen = "".join(stream[s.first : s.last] for s in r.attends)
        assert len(seen) == r.position
    assert sum(r.segment == chat_format.formatted("user", "q")[0] for r in got) == 1
    back = {r.conv_id: r for r in chat_format.read_back(nodes, leaves).collect()}
    assert set(back) == {None, 1, 2, 3, 4, 5, 6, 7}
    for conv, r in back.items():
        own = [(c[2] or "", c[3] or "") for c in sorted((c for c in chats if c[0] == conv), key=lambda c: c[1])]
        loss = "".join(t for role, t in own if role == "assistant")
        said = "".join(f"{a}\n{b}\n" for a, b in own)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat_format.formatted(a, b)[0]) for a, b in own)
    empty = chat_format.prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert empty[0].count() == empty[1].count() == 0


def test_token_positions(spark):
    path = packing.tokenizer_file("byte_bpe_50k.json")
    chats = [(c, i, ("user", "assistant")[i % 2], f"turn {i} of {'both' if i < 4 else c}") for c in range(5) for i in range(7)]
    nodes, leaves = chat_format.prefix_tree(spark.createDataFrame(chats, "conv_id long, turn long, role string, text string"), path)
    got = sorted(nodes.collect(), key=lambda r: r.place)
    assert len(got) == 4 + 5 * 3 and [r.ids for r in got] == library_ids(path, [r.segment for r in got])
    stream = [t for r in got for t in r.ids]
    assert [r.place for r in got] == [sum(len(x.ids) for x in got[:i]) for i in range(len(got))]
    ends = {r.node: r for r in got}
    for leaf in leaves.collect():
        own = library_ids(path, [chat_format.formatted(role, text)[0] for c, _, role, text in chats if c == leaf.conv_id])
        r = ends[leaf.node]
        assert [t for s in r.attends for t in stream[s.first : s.last]] + r.ids == list(itertools.chain(*own)) and r.position == sum(map(len, own[:-1]))


def test_long_chats_share_turns_at_every_depth(spark):
    turn = lambda i, t: (i, ("user", "assistant")[i % 2], t)
    common = [turn(i, f"t{i}") for i in range(100)]
    chats = {c: common[:n] + [turn(i, f"c{c} {i}") for i in range(n, n + 5)] for c, n in enumerate([100, 100, 70, 100, 3, 99, 64, 63])}
    chats |= {20: common, 21: common[:80], 22: common, 23: chats[0]}
    chats |= {30 + c: [turn(0, f"t{c % 3}"), turn(1, f"u{c}"), turn(2, "v")] for c in range(20)}
    rows = [(c, *t) for c, own in chats.items() for t in own]
    nodes, leaves = chat_format.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(nodes.collect(), key=lambda r: r.place)
    stream = "".join(r.segment for r in got)
    seen = ["".join(stream[s.first : s.last] for s in r.attends) + r.segment for r in got]
    want = {"".join(chat_format.formatted(*t[1:])[0] for t in own[:n]) for own in chats.values() for n in range(1, len(own) + 1)}
    assert len(seen) == len(want) and set(seen) == want
    assert [r.place for r in got] == [len("".join(x.segment for x in got[:i])) for i in range(len(got))] and [r.node for r in got] == list(range(len(got)))
    assert all(r.position == len(s) - r.units for r, s in zip(got, seen, strict=True))
    assert all(a.last < b.first for r in got for a, b in itertools.pairwise(r.attends))
    ends = {r.conv_id: seen[r.node] for r in leaves.collect()}
    assert ends == {c: "".join(chat_format.formatted(*t[1:])[0] for t in own) for c, own in chats.items()}


# 3


LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEMPLATES = [("one", " ".join(words_of(12, 400))), ("two", " ".join(words_of(40, 401))), ("mit", "released under the mit license"), ("bag", "a b a b a b a c")]


def words3(text):
    return LETTERS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def covered(text, template):
    """The largest share of a template's words covered by three-word hits aligned in order, near one diagonal, by trying all."""
    w, t = words3(text), words3(template)
    room = license_scan.slack(len(t))
    hits = [(i, j) for i in range(len(w) - 2) for j in range(len(t) - 2) if w[i : i + 3] == t[j : j + 3]]
    best = 0.0
    for d in {i - j for i, j in hits}:
        most: dict[tuple[int, int], int] = {}
        for i, j in sorted((i, j) for i, j in hits if d <= i - j <= d + room):
            most[i, j] = max([3, *(c + min(3, j - b) for (a, b), c in most.items() if a < i and b < j)])
        best = max(best, max(most.values()) / len(t))
    return best


def test_license_scan(spark, monkeypatch):
    r, rows = np.random.default_rng(15), []
    for n in range(60):
        body = words3(TEMPLATES[n % 4][1])
        for _ in range(int(r.integers(0, 4))):
            at = int(r.integers(len(body)))
            body = (body[:at] + [f"x{n}"] + body[at:], body[:at] + body[at + 1 :], body[:at] + [f"y{n}"] + body[at + 1 :], body[at:] + body[:at])[int(r.integers(4))]
        rows.append((n, " ".join(words_of(n % 5, n) + body + words_of(n % 3, n + 70)), "x"))
    rows += [(70, "released under the aa bb under the mit cc dd the mit license", "x"), (71, "", "x"), (72, None, None), (73, "license", "x"), (74, "a b " * 60 + "a c", "x"), (75, " ".join([TEMPLATES[1][1]] * 3).upper(), "x")]
    for most in (100_000, 3):  # broadcast, and shuffled
        monkeypatch.setattr(license_scan, "MOST", most)
        got = {x.doc_id: x for x in license_scan.scan(frame(spark, rows), TEMPLATES).collect()}
        for i, text, _ in rows:
            want = {label: covered(text, t) for label, t in TEMPLATES}
            assert got[i].labels == ",".join(sorted(k for k, share in want.items() if share >= license_scan.COVERED)), (i, want)
            assert abs(got[i].score - max([0.0, *(s for s in want.values() if s >= license_scan.COVERED)])) < 1e-9
    assert got[70].labels == "" and [(s.first, s.last) for s in got[75].spans] == [(0, 40), (40, 80), (80, 120)]


def test_license_scan_base_phrases(spark):
    mit = license_texts.TEMPLATES[1][1]
    changed = mit.replace("obtaining a copy", "who gets hold of a copy")
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    texts = ["CC BY cc-by, ALL rights  reserved", None, "", f"x {mit}. y", f"x {mit}. y", changed, "general public\nlicense", "license version free of charge", " ".join(words_of(20000, 8)) + " cc by", "cc cc by by all rights", "é" * 5000 + " general public license all rights reserved"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, mit, "x")]
    got = license_scan.scan(frame(spark, rows)).collect()
    for x in got:
        text = mit if x.doc_id is None else texts[x.doc_id]
        w = words3(text)
        found = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
        places = [i for i, _ in found]
        base = {label for _, label in found}
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted(base)))
        assert base <= set(x.labels.split(",")) | {""} and 0 <= x.score <= 1
        assert ("mit" in x.labels.split(",")) == (text is not None and "hereby granted" in text)
    assert len(got) == len(rows)


# 5


def test_sharding(spark):
    r = np.random.default_rng(2)
    rows = [(i, "x" * int(n), "en") for i, n in enumerate(r.integers(1, 4000, 3000))] + [(10_000 + i, "hot " * 20, "en") for i in range(900)] + [(None, None, None), (None, "é", "x")]
    got = sharding.shard(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, slots, groups = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for x in got:
        sizes[x.shard] += x["size"]
        slots[x.shard].append(x.slot)
        groups[x.text_crc32].add(x.shard)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) < 1.05 * min(sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sum(len(g) > 1 for g in groups.values()) <= 2
    texts = {i: t for i, t, _ in rows if i is not None}
    assert all(x.text_crc32 == zlib.crc32(texts[x.doc_id].encode()) and x["size"] == len(texts[x.doc_id].encode()) + 1 for x in got if x.doc_id is not None)


def test_kd_tree_against_plain_splits(spark):
    r = np.random.default_rng(16)
    words = ["ab", "éü", "日本", "x\ny", "\n"]
    texts = [" ".join(r.choice(words, int(n), p=(w := r.random(5)) / w.sum())) for n in r.integers(1, 400, 1500)] + [None, "", "日本 " * 3000]
    rows = sharding.metadata(frame(spark, [(i, t, "x") for i, t in enumerate(texts)])).persist()
    point = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        point[i] = {"size": len(raw) + 1, "density": len(t or "") * 65535 // max(1, len(raw)), "lines": (t or "").count("\n") * 65535 // max(1, len(raw)), "crc": zlib.crc32(raw)}
    assert {x.doc_id: {"size": x["size"], "density": x["density"], "lines": x["lines"], "crc": x.text_crc32} for x in rows.collect()} == point
    width = lambda ids, d: max(point[i][d] for i in ids) - min(point[i][d] for i in ids)
    inside, used = {"": set(point)}, collections.Counter()
    for node in sharding.kd_tree(rows, 8):
        ids, (dim, at, _) = inside[node.path], node.cut
        used[dim] += 1
        widest = max(width(ids, d) / width(point, d) for d in sharding.DIMENSIONS)
        assert width(ids, dim) / width(point, dim) == widest
        left = {i for i in ids if point[i][dim] * 2**32 + point[i]["crc"] <= at}
        total, weight = (sum(point[i]["size"] for i in x) for x in (ids, left))
        want = total * (node.shards // 2) / node.shards
        largest = max(point[i]["size"] for i in ids)
        assert abs(weight - want) <= max(sharding.EVEN * min(want, total - want), largest)
        inside[node.path + "0"], inside[node.path + "1"] = left, ids - left
    assert sum(used.values()) == 7 and len(used) > 1


def test_sharding_divides_a_group_that_outweighs_a_shard(spark):
    rows = [(i, "same text " * 10, "en") for i in range(4000)]
    sizes = collections.Counter(r.shard for r in sharding.shard(frame(spark, rows)).collect())
    assert len(sizes) == 8 and max(sizes.values()) < 1.1 * min(sizes.values())


# 8


def test_url_filter(spark):
    urls = ["https://A.Example.COM/en/71?x", "http://b.com/en/", "notcom/en/", None, "x://com", "https://net/de/1?utm_source=feed", "https://q.example.net/de/8#t", "https://a.org/fr?utm_source=feed", "https://a.org/docs/x?page=2&ref=x", "https://a.org/docs/x", "https://utm_source/", "https://a.org/en/EN/?Utm_Source=Z", "a://b/c://com/en/"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)] + [(0, urls[0], "v")], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.pattern) for r in url_filter.judge(pages).collect()}
    assert got == {
        0: ("a.example.com", "/en/71", "example.com/en/7", "allow", None), 1: ("b.com", "/en/", "com/en/", "block", None), 2: ("", "", None, "allow", None), 3: ("", "", None, "allow", None), 4: ("com", "", None, "allow", None),
        5: ("net", "/de/1", "net/de/", "allow", "tracked-copy"), 6: ("q.example.net", "/de/8", "example.net/de/8", "block", None), 7: ("a.org", "/fr", None, "block", "tracked-copy"), 8: ("a.org", "/docs/x", None, "block", "referred-page"),
        9: ("a.org", "/docs/x", None, "allow", "docs"), 10: ("utm_source", "/", None, "allow", None), 11: ("a.org", "/en/EN/", None, "block", "tracked-copy"), 12: ("b", "/c://com/en/", None, "allow", None),
    }
    assert url_filter.judge(pages).count() == len(urls) + 1 and url_filter.judge(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(pages, pattern_rules=[("x", "block", "a", [])])


def test_url_filter_hot_urls_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "HOT", 5)
    monkeypatch.setattr(url_filter, "LEAST", 0)
    urls = ["https://a.org/fr?utm_source=feed"] * 40 + ["https://a.org/plain"] * 30 + [None] * 20 + [f"https://a{i}.org/docs/x" for i in range(9)] + ["https://b.com/" + "x" * 200_000 + "/cart"]
    rows = [(i, u, "own", "low", "ruled", 5) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, own string, low string, ruled string, n int")
    got = url_filter.judge(pages).collect()
    want = {i: ("block", "tracked-copy") if i < 40 else ("allow", None) if i < 90 else ("allow", "docs") if i < 99 else ("block", "cart") for i in range(len(urls))}
    assert {r.page_id: (r.verdict, r.pattern) for r in got} == want and len(got) == len(urls)
    assert all((r.own, r.low, r.ruled, r.n) == ("own", "low", "ruled", 5) for r in got)


# 9


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "STEP", 3)
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    rows += [(302, [1.0] * 7 + [0.5]), (306, [1.0] * 3), (350, [2.0] * 3), (400, [1.0] * 5), (150, rows[150][1]), (150, rows[7][1]), (9, [3.0] * 8), (9, [2.0] * 8)]
    rows += [(500 + i, [2.5] * 8) for i in range(40)]
    odd = [(300, None), (301, []), (302, [1.0] * 7 + [None]), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [9.0] * 8)]
    got = topk_search.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == sorted(exact_top_k(rows, lambda i: i % 50 == 0))
    ties = topk_search.search(spark.createDataFrame([(i, [1.0, 1.0]) for i in range(20)], "vec_id long, embedding array<double>"), "vec_id = 3").orderBy("rank").collect()
    assert [x.vec_id for x in ties] == [0, 1, 2, 4, 5]
    assert topk_search.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def exact_top_k(rows, asks, k=5):
    whole = [(i, [int(x) * 256 if abs(x) >= 2**53 else int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for n, (q, x) in enumerate(whole):
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for m, (i, v) in enumerate(whole) if m != n and len(v) == len(x))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return want


def test_top_k_keeps_every_finite_vector(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(200)]
    rows += [(205, [300000.0] + [0.5] * 7), (206, [1e9] * 8), (207, [-1e9] * 7 + [3.5]), (250, [3.2e6, -3.2e6, 0.25] + [0.0] * 5), (300, [2e7, -2e7] + [0.0] * 6), (208, [2.0**18] * 3), (350, [1.5] * 3)]
    schema = "vec_id long, embedding array<double>"
    got = topk_search.search(spark.createDataFrame(rows, schema).repartition(5))
    want = exact_top_k(rows, lambda i: i % 50 == 0)
    assert any(i == 205 for _, _, i, _ in want) and any(q == 250 and s > 2**60 for q, _, _, s in want)
    assert sorted(tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)
    # Beyond what 256 * x may be in double precision: the rows are ranked, and don't raise where they aren't among the best.
    far = [(0, [1.0, 0.0]), (1, [-1.7e308, 3.0]), (2, [3.0, 1.7e308]), (3, [2.0, 0.0]), (4, [2.5, 1.0])]
    search = lambda k: topk_search.search(spark.createDataFrame(far, schema), "vec_id = 0", k).collect()
    assert sorted(tuple(x) for x in search(3)) == exact_top_k(far, lambda i: i == 0, 3)
    with pytest.raises(Exception, match="fit a long"):
        search(4)

"""Small cases of each operator: nulls, blanks, ties, repeats, empty tables, clashing columns; brute force where SQL fails."""

import datetime
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import clusters, copies, encode, groups, packing, residue, similar, survivors

SITES = ["dry cows", "heifers", "late calves", "bulls", "lactating cows", "young stock"]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# 3
def test_groups(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 620)]
    lines = [(2, 1), (1, 2), (2, 3), (5, 5), (None, 7), (8, None), (None, None), *chain, *star]
    df = spark.createDataFrame([(a, b, 0, "x") for a, b in lines], "kept_index bigint, dropped_index bigint, v int, to string")
    got = dict(rows(groups.linked_groups(df, "kept_index", "dropped_index"), "record_index", "group_index"))
    want = {1: 1, 2: 1, 3: 1, 5: 5, **{k: 100 for k in range(100, 161)}, **{k: 500 for k in range(500, 620)}}
    assert got == want
    assert groups.linked_groups(df.limit(0), "kept_index", "dropped_index").count() == 0
    assert rows(groups.linked_groups(df.where("kept_index = 5"), "kept_index", "dropped_index"), "*") == [(5, 5)]


def test_groups_random_graph(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(330)]
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for e in edges for x in e}
    assert dict(rows(groups.linked_groups(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b"), "*")) == want


# 1
@pytest.mark.parametrize(
    ("doi", "ok"),
    [("10.99116 / bov.2000.1261", True), ("doi: <10.9903/hm.2012.66>", True), ("10.99481%2Fj.mk.2008.87", True), ("10.99534/tba", False), ("10.99/x1", False), ("10.99352/", False), ("10.99213", False), ("https://r.example/10.99265/a.1", True), ("110.99265/a.1", False), ("", False), (None, False), ("10.1234567890/a1", False)],
)
def test_usable_doi(spark, doi, ok):
    assert spark.createDataFrame([(doi,)], "d string").select(survivors.usable_doi(F.col("d"))).first()[0] is ok


def test_survivors(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    log = spark.createDataFrame(
        [(1, 2, "10.9999/a", "10.9999/a1", "scopus", "PUB-med"), (2, 3, "10.9999/a1", "10.9999/a2", "PUB-med", "pubmed_2020"), (1, 2, "10.9999/a", "10.9999/a1", "scopus", "PUB-med"), (4, 5, None, "tba", "other", None), (6, 6, "10.9999/a3", "10.9999/a3", "pubmed", "pubmed"), (7, None, "10.9999/a3", None, "pubmed", None)],
        "kept_index bigint, dropped_index bigint, kept_doi string, dropped_doi string, kept_source string, dropped_source string",
    )
    corpus = spark.createDataFrame([(1, t(9), "c"), (2, t(2), "c"), (3, t(2), "c"), (4, None, "c")], "row_index bigint, retrieved_at timestamp, doi string")
    trust = spark.createDataFrame([("pubmed", 1), ("scopus", 2)], "source string, trust_rank int")
    g = groups.linked_groups(log, "kept_index", "dropped_index")
    got = rows(survivors.group_survivors(log, corpus, trust, g), "group_index", "doi_index", "source_index")
    assert got == [(1, 2, 2), (4, -1, -1)]  # 2 and 3 tie on rank and time: the smaller index
    assert survivors.group_survivors(log.limit(0), corpus.limit(0), trust.limit(0), g.limit(0)).count() == 0


# 5
def test_canonical():
    c = copies.canonical
    assert c("É-x ½") == c("éX 1⁄2") and c("Straße") == c("STRASSE") and c("é") != c("e") and c("ﬁ") == c("FI") and c("?!") == b""
    assert copies.canonical_record(("a", " ")) is None and copies.canonical_record((None, "a")) is None
    assert copies.canonical_record(("B b", "a")) == copies.canonical_record(("A", "bB."))


def test_trie_counts_like_a_dictionary():
    rnd = random.Random(1)
    keys = [bytes(rnd.choice(b"ab\n") for _ in range(rnd.randrange(9))) for _ in range(3000)]
    trie, seen = copies.Trie(), {}
    for k, key in enumerate(keys):
        first, n = seen.get(key, (k, 0))
        seen[key] = (first, n + 1)
        assert trie.add(key, k) == (first, n + 1)


def test_copies(spark):
    data = [(7, "Milk yield", "In cows."), (3, "MILK-YIELD!", "in  cows"), (9, "In cows", "milk​yield"), (4, "Milk yields", "In cows."), (5, None, "In cows."), (6, "Milk yield", " \n"), (None, "Milk yield", "In cows."), (10, "?", "-"), (11, "!!", "..")]
    data += [(k, "hot", "text " + "x" * 50) for k in range(1000, 1600)] + [(k, f"other {k}", "y" * 60) for k in range(2000, 2300)]
    df = spark.createDataFrame([(a, b, c, "k", 1) for a, b, c in data], "row_index bigint, Title string, Abstract string, digest string, record int")
    want = [(3, 7), (3, 9), (10, 11), *[(1000, k) for k in range(1001, 1600)]]
    for limit in (1 << 20, 4000):
        got = copies.copy_groups(df, "row_index", ["Title", "Abstract"], bucket_bytes=limit).where("row_index <> first_index")
        assert rows(got, "first_index", "row_index") == sorted(want, key=repr)
        counted = dict(rows(copies.copy_groups(df, "row_index", ["Title", "Abstract"], bucket_bytes=limit).where("copies IS NOT NULL"), "first_index", "copies"))
        assert counted[3] == 3 and counted[10] == 2 and counted[1000] == 600 and counted[2000] == 1 and sum(counted.values()) == len(data) - 3
    assert copies.copy_groups(df.limit(0), "row_index", ["Title", "Abstract"]).count() == 0


def test_counters_of_a_text_of_a_hundred_thousand_copies(spark):
    hot = spark.range(100_000).select((F.col("id") + 5).alias("row_index"), F.lit("One title").alias("Title"), F.lit("The same text begins alike").alias("Abstract"))
    rest = spark.range(2000).select((F.col("id") + 200_000).alias("row_index"), F.lit("One title").alias("Title"), F.concat(F.lit("The same text begins alike and goes on "), (F.col("id") % 1500).cast("string")).alias("Abstract"))
    df = hot.unionByName(rest)
    got = copies.copy_groups(df, "row_index", ["Title", "Abstract"], bucket_bytes=60_000)
    want = df.groupBy("Abstract").agg(F.min("row_index").alias("first_index"), F.count("*").alias("copies"))
    assert rows(got.where("copies IS NOT NULL"), "first_index", "copies") == rows(want, "first_index", "copies")
    assert got.where("first_index = 5").count() == 100_000 and got.count() == 102_000


# 2
def corpus(spark, n=160, seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(300)]
    out = []
    for k in range(n):
        if out and rnd.random() < 0.6:
            base = re.findall(r"\w+", " ".join(rnd.choice(out)[1:3]))
            rnd.shuffle(base)
            words = [w for w in base if rnd.random() > 0.08] + rnd.sample(vocabulary, rnd.randrange(0, 6))
        else:
            words = rnd.sample(vocabulary[:60], rnd.randrange(8, 40)) + rnd.sample(vocabulary[60:], rnd.randrange(0, 8))
        cut = rnd.randrange(1, max(2, len(words)))
        out.append((k, " ".join(words[:cut]), " ".join(words[cut:]) or "x"))
    return out


@pytest.mark.parametrize(("share", "threshold"), [(0.02, 0.7), (0.3, 0.7), (0.1, 0.5)])
def test_near_duplicates_against_brute_force(spark, share, threshold):
    data = corpus(spark)
    data += [(1000, data[0][1].upper(), data[0][2] + "."), (1001, None, "a b"), (1002, " ", "a b"), (1003, data[0][2], data[0][1] + " extra"), (1004, "?", "!"), (1005, "!!", "??"), (1006, "Éa　b", "c d e f g h i j k"), (1007, "éa b", "c d e f g h i j l")]
    df = spark.createDataFrame([(*r, "x", b"1") for r in data], "row_index bigint, Title string, Abstract string, id string, bag binary")
    bags = {i: set(re.findall(r"[^\W_]+", f"{t} {a}".lower())) for i, t, a in data if t and t.strip() and a and a.strip()}
    keys = {i: copies.canonical_record((t, a)) for i, t, a in data}
    want = [(a, b) for a in bags for b in bags if a < b and keys[a] != keys[b] and (bags[a] or bags[b]) and len(bags[a] & bags[b]) >= threshold * len(bags[a] | bags[b]) - 1e-9]
    got = similar.near_duplicates(df, "row_index", ["Title", "Abstract"], threshold, share)
    assert rows(got, "index_1", "index_2") == sorted(want, key=repr)


def test_near_duplicates_in_blocks_and_empty(spark, monkeypatch):
    data = corpus(spark, 120, 9)
    df = spark.createDataFrame(data, "row_index bigint, Title string, Abstract string")
    whole = rows(similar.near_duplicates(df, "row_index", ["Title", "Abstract"], 0.6), "*")
    monkeypatch.setattr(similar, "BLOCK_ROWS", 5)
    monkeypatch.setattr(similar, "TOLD", 1)
    monkeypatch.setattr(similar, "SLICE_ROWS", 7)
    assert rows(similar.near_duplicates(df, "row_index", ["Title", "Abstract"], 0.6), "*") == whole and whole
    assert similar.near_duplicates(df.limit(0), "row_index", ["Title", "Abstract"]).count() == 0


def test_near_duplicates_in_waves_that_leave_no_shuffle(spark, monkeypatch):
    root = Path(spark.conf.get("spark.local.dir"))
    shuffled = lambda: sum(p.stat().st_size for p in root.rglob("shuffle_*.data"))
    df = spark.createDataFrame(corpus(spark, 120, 9), "row_index bigint, Title string, Abstract string")
    docs = similar.texts(df, "row_index", ["Title", "Abstract"])
    filt = similar.Filter(np.zeros(0, np.uint64), 0.6)
    whole = rows(similar.candidates(docs, filt, 0.6), "*")
    monkeypatch.setattr(similar, "COPIES", 1)
    monkeypatch.setattr(similar, "BUCKET_BYTES", 1 << 12)
    before = shuffled()
    got = similar.candidates(docs, filt, 0.6)
    assert shuffled() - before < 1 << 16  # only the small sums of the rows per key stay
    assert rows(got, "*") == whole and whole


def test_texts_are_sent_packed_without_loss():
    rnd = np.random.default_rng(3)
    docs = np.zeros(500, similar.DOC)
    docs["id"], docs["n"], docs["rare"], docs["slack"] = np.arange(500) + 10**9, rnd.integers(60, 160, 500), rnd.integers(0, 30, 500), 20
    docs["bits"] = np.packbits(rnd.random((500, 512)) < 0.1, axis=1, bitorder="little").view("<u4")
    key, doc = rnd.integers(1 << 62, size=500, dtype=np.uint64), np.arange(500)
    blob = similar._blob(docs, key, np.zeros(500, np.uint8), doc)
    got, _, at = similar._unpack([blob])
    assert (got == docs).all() and sorted(at.tolist()) == doc.tolist()
    assert len(blob) < 0.75 * 500 * (similar.DOC.itemsize + similar.ROW.itemsize)


def test_texts_are_cut_into_words_twice_and_only_rows_of_pairs_made_canonical(spark, monkeypatch, tmp_path):
    cut, made = tmp_path / "cut", tmp_path / "made"

    def count(path, n):
        with open(path, "a") as f:
            f.write(f"{n}\n")

    split, canonical = similar._bags, similar.canonical_record
    monkeypatch.setattr(similar, "_bags", lambda b: (count(cut, len(b)), split(b))[1])
    monkeypatch.setattr(similar, "canonical_record", lambda f: (count(made, 1), canonical(f))[1])
    data = [(k, f"a{k} b{k}", f"c{k} d{k} e{k}") for k in range(200)] + [(900, "A7 b7", "c7 d7 e7"), (901, "b8 a8", "c8 d8 e8"), (902, "a9 b9", "c9 d9 e9 f9")]
    df = spark.createDataFrame(data, "row_index bigint, Title string, Abstract string")
    assert rows(similar.near_duplicates(df, "row_index", ["Title", "Abstract"]), "*") == [(8, 901), (9, 902)]
    # the row of a word set that another row has is not searched again
    assert sum(map(int, cut.read_text().split())) == 2 * len(data) - 2 and sum(map(int, made.read_text().split())) == 6


def test_parts_of_texts_are_kept_without_loss():
    texts = ["", "c1 c3 u1", "?", "u2 u3 u4", "c299 c0", *(" ".join([f"c{k}" for k in range(0, 300, s)] + [f"u{s}"]) for s in range(1, 40))]
    bags = similar.Bags(bags_ids(len(texts)), list(texts))
    for common in (similar.Bags(bags_ids(1), [" ".join(f"c{k}" for k in range(300))]).word, np.zeros(0, np.uint64)):
        filt = similar.Filter(np.sort(common), 0.7)
        parts = filt.parts(bags)
        for kind in (np.dtype("<u2"), np.dtype("<u4")):
            got = similar.Parts.unpacked(parts.packed(kind), kind)
            assert all(np.array_equal(v, getattr(got, k)) for k, v in vars(parts).items())
        assert (np.bincount(parts.doc, minlength=len(texts)) + parts.rare == bags.n).all()


def test_words_are_told_apart_as_by_the_pattern():
    texts = ["", "–", "A a\u2013b _c_ a", "\u0130x i\u0307x", "Stra\u00dfe STRASSE", "\u65e5\u672c a \u65e5\u672c", "ab ba aab aba baa", "x" * 300_000 + " y", "\U0001f404 cow", "\u00bd 1 2", *(f"w{k} w{k + 1} v{k}" for k in range(3000))]
    assert similar.Bags(bags_ids(len(texts)), texts).n.tolist() == [len(set(re.findall(r"[^\W_]+", t.lower()))) for t in texts]
    word = [similar.hashed_words([similar.spaced(t), similar.spaced("other"), similar.spaced(t)]) for t in texts]
    assert all(sorted(w[d == 0]) == sorted(w[d == 2]) for d, w in word)  # wherever a word stands it is the same


def test_long_texts_of_common_words_against_brute_force(spark):
    rnd = random.Random(8)
    vocabulary, data = [f"c{k}" for k in range(520)], []
    for k in range(24):  # two texts of one size share 0.70 to 0.75: more differences than the ring has quarters
        words = rnd.sample(vocabulary, rnd.randrange(250, 401))
        rest = [w for w in vocabulary if w not in words]
        edits = int(len(words) * rnd.choice([0.145, 0.165, 0.17, 0.176, 0.18, 0.2]))
        data += [(2 * k, " ".join(words), "c0"), (2 * k + 1, " ".join(words[edits:] + rnd.sample(rest, min(edits, len(rest))) + [f"u{k}"]), "c0")]
    data += [(100 + k, " ".join(rnd.sample(vocabulary, 30)), "c0") for k in range(10)]
    bags = {i: set(f"{t} {a}".split()) for i, t, a in data}
    want = [(a, b) for a in bags for b in bags if a < b and len(bags[a] & bags[b]) >= 0.7 * len(bags[a] | bags[b]) - 1e-9]
    far = [(a, b) for a, b in want if len(bags[a] ^ bags[b]) > 63]
    df = spark.createDataFrame(data, "row_index bigint, Title string, Abstract string")
    assert len(far) >= 8 and rows(similar.near_duplicates(df, "row_index", ["Title", "Abstract"]), "*") == sorted(want, key=repr)


def test_large_groups_are_compared_in_tiles():
    rnd = np.random.default_rng(1)
    base = [f"c{k}" for k in range(50)]
    texts = [" ".join([w for w in base if rnd.random() > 0.06] + ["shared", f"u{k}"]) for k in range(150)]
    bags = similar.Bags(bags_ids(150), texts)
    filt = similar.Filter(np.sort(np.unique(bags.word[np.isin(bags.word, similar.Bags(bags_ids(1), [" ".join(base)]).word)])), 0.7)
    docs, key, kind, doc = filt.rows(bags, {s: (-9.0, 99.0) for s in range(100)})
    got = {tuple(p) for p in similar.pairs_in(*similar._unpack([similar._blob(docs, key, kind, doc)]), 0.7).tolist()}
    sets = [set(t.split()) for t in texts]
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert want and want <= got


def test_pairs_without_a_shared_rare_word_are_found_by_the_ring_alone():
    rnd = random.Random(12)
    base, sets = [f"c{k}" for k in range(120)], []
    for k in range(40):
        words = rnd.sample(base, 44)
        other = [w for w in words if w not in rnd.sample(words, 3)] + rnd.sample([w for w in base if w not in words], 2)
        sets += [{*words, f"u{k}"}, {*other, f"v{k}"}]
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    bags = similar.Bags(bags_ids(80), [" ".join(sorted(s)) for s in sets])
    filt = similar.Filter(np.sort(similar.Bags(bags_ids(1), [" ".join(base)]).word), 0.7)
    slack = filt.split(bags)[3]
    reach = {s: (float(slack.min()), float(slack.max())) for s in range(100)}
    docs, key, kind, doc = filt.rows(bags, reach)
    found = lambda keep: {tuple(p) for p in similar.pairs_in(*similar._unpack([similar._blob(docs, key[keep], kind[keep], doc[keep])]), 0.7).tolist()}
    assert len(want) >= 40 and want <= found(kind >= 0) and not want & found(kind == 0)
    assert len(found(kind > 0)) < 3 * len(want)  # the chains let little else through


def bags_ids(n):
    import pyarrow as pa

    return pa.array(range(n))


# 6
@pytest.mark.parametrize("text", ["", "a", "it's 12ab  ok", "x " * 70_000 + "\n\n  y", " " * 40_000 + "x", "w" + " " * 40_000, "q\n" + " \n" * 30_000 + "z", "é" * 50_000, "<|endoftext|> 日本 🐄", "\r\n\t　\xa0 a"])
def test_encode_is_what_the_library_gives(text):
    assert encode.encode(text) == encode.encoding().encode_ordinary(text)
    assert encode.encoding().decode_bytes(encode.encode(text)) == text.encode()


def test_encode_survives_very_long_white_space():
    text = "a" + " " * 1_500_000 + "b"
    assert encode.encoding().decode_bytes(encode.encode(text)) == text.encode()


def test_token_ids(spark):
    df = spark.createDataFrame([(1, "Cows eat", "x"), (2, None, "x"), (3, "", "x"), (1, "Cows eat", "y"), (None, "a", "z")], "doc_id bigint, text string, ids string")
    ids = encode.encode("Cows eat")
    assert rows(encode.token_ids(df), "doc_id", "ids") == sorted([(1, ids), (1, ids), (2, []), (3, []), (None, encode.encode("a"))], key=repr)
    assert all(r.same for r in encode.round_trip(df).collect()) and encode.token_ids(df.limit(0)).count() == 0


# 7
def test_packing_is_valid_and_no_worse_than_best_fit():
    rnd = random.Random(2)
    for capacity, low, high in ((100, 1, 100), (100, 20, 60), (512, 30, 512), (10, 5, 5)):
        sizes = sorted((rnd.randint(low, high) for _ in range(200)), reverse=True)
        bins = packing.bin_completion(sizes, capacity)
        assert sorted(k for b in bins for k in b) == list(range(200)) and all(sum(sizes[k] for k in b) <= capacity for b in bins)
        assert packing.lower_bound(sizes, capacity) <= len(bins) <= len(packing.best_fit(sizes, capacity))
    assert packing.bin_completion([], 10) == []
    assert len(packing.bin_completion([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], 61)) == 3


def test_bound_and_dominance():
    def bound(sizes, capacity):  # by its definition
        out = 0
        for a in {0, *(s for s in sizes if 2 * s <= capacity)}:
            alone = [s for s in sizes if s > capacity - a]
            mid = [s for s in sizes if capacity - a >= s and 2 * s > capacity]
            small = sum(s for s in sizes if 2 * s <= capacity and s >= a)
            out = max(out, len(alone) + len(mid) + max(0, -(-(small - (len(mid) * capacity - sum(mid))) // capacity)))
        return out

    rnd = random.Random(11)
    for _ in range(60):
        capacity = rnd.randrange(5, 300)
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.choice([0, 3, 40, 900]))]
        assert packing.lower_bound(sizes, capacity) == bound(sizes, capacity)
    assert packing.dominates((7, 3), (4, 3, 3)) and packing.dominates((5,), (5,)) and not packing.dominates((7, 3), (4, 4)) and not packing.dominates((3, 3), (5,))
    fills = packing.completions({2: 2, 3: 1, 4: 1, 6: 1}, [2, 3, 4, 6], 6, packing.Budget())
    assert fills == [(6,)]
    many = dict.fromkeys(range(1, 900), 1)
    assert sum(packing.completions(many, sorted(many), 5000, packing.Budget(nodes=1))[0]) <= 5000


def test_containers_do_not_depend_on_the_partitioning(spark):
    items = spark.createDataFrame([(k % 40, (k * 37) % 90 + 1) for k in range(80)], "doc_id bigint, n_tokens bigint")
    specs = spark.createDataFrame([("a", 100)], "spec_name string, capacity_tokens int")
    one, two = (rows(packing.fill_containers(items.repartition(k), specs, chunk_items=20), "container", "doc_id", "piece", "n_tokens") for k in (1, 7))
    assert one == two


def test_containers(spark):
    sizes = [(k, (k * 37) % 90 + 1) for k in range(60)] + [(100, 250), (101, 0), (102, None), (100, 250), (None, 7)]
    items = spark.createDataFrame([(*s, "x") for s in sizes], "doc_id bigint, n_tokens bigint, chunk string")
    specs = spark.createDataFrame([("a", 100), ("b", 64), ("b", 64), ("no", 0), ("none", None)], "spec_name string, capacity_tokens int")
    for chunk in (4000, 12):
        got = packing.fill_containers(items, specs, chunk_items=chunk).collect()
        for name, cap in (("a", 100), ("b", 64)):
            mine = [r for r in got if r.spec_name == name]
            fill = {}
            for r in mine:
                fill[r.container] = fill.get(r.container, 0) + r.n_tokens
            assert max(fill.values()) <= cap and sum(fill.values()) == sum(s or 0 for _, s in sizes)
            whole = [r for r in mine if r.doc_id is not None and r.doc_id < 60]
            assert all(len([r for r in whole if r.doc_id == k]) == (1 if n <= cap else -(-n // cap)) for k, n in sizes[:60])
            assert {101, 102, None} <= {r.doc_id for r in mine}
            long = sorted(r.first_token for r in mine if r.doc_id == 100)
            assert long == sorted(2 * list(range(0, 250, cap)))
        assert {r.spec_name for r in got} == {"a", "b"}
    assert packing.fill_containers(items.limit(0), specs).count() == 0 and packing.fill_containers(items, specs.limit(0)).count() == 0


# 4
def subject_texts():
    rnd = random.Random(4)
    subjects = {t: [f"s{'abcd'[t]}word{chr(97 + j)}" for j in range(6)] for t in range(4)}
    common = [f"common{chr(97 + j)}{chr(97 + k)}" for j in range(5) for k in range(8)]
    data = []
    for t, n in ((0, 60), (1, 40), (2, 25), (3, 12)):
        for _ in range(n):
            hint = t if rnd.random() < 0.75 else rnd.choice([-1, None, (t + 1) % 4])
            data.append((len(data), " ".join(3 * rnd.sample(subjects[t], 4) + rnd.sample(common, 12)), hint, t))
    data += [(900, None, 0, None), (901, " ", 1, None), (902, "n/a", 2, None), (None, "x", 1, None)] + [(910 + k, " ".join(3 * [f"own{chr(97 + k)}subject"] + rnd.sample(common, 12)), -1, None) for k in range(4)]
    return data


def test_clusters(spark):
    data = subject_texts()
    df = spark.createDataFrame([(a, b, c, "x", "y") for a, b, c, _ in data], "doc_id bigint, Document string, Topic int, vec string, record string")
    got = dict(rows(clusters.subject_clusters(df), "doc_id", "topic"))
    want = {i: t for i, _, _, t in data if t is not None}
    assert sum(got.get(i) == t for i, t in want.items()) >= 0.97 * len(want) and not {900, 901, 902, None} & set(got)
    best = clusters.typical(clusters.subject_clusters(df)).collect()
    assert {r["rank"] for r in best} == {1, 2, 3, 4, 5} and {r.topic for r in best} == {0, 1, 2, 3}
    assert clusters.subject_clusters(df.limit(0)).count() == 0
    assert clusters.subject_clusters(df.withColumn("Topic", F.lit(None).cast("int"))).count() == 0


def test_members_of_clusters_come_from_the_texts_and_hints_only_name_them(spark):
    data = subject_texts()
    df = spark.createDataFrame([(a, b, c) for a, b, c, _ in data], "doc_id bigint, Document string, Topic int")
    whole = rows(clusters.subject_clusters(df), "doc_id", "topic")
    lost = df.withColumn("Topic", F.when(F.col("doc_id") % 2 == 0, -1).otherwise(F.col("Topic")))
    assert rows(clusters.subject_clusters(lost), "doc_id", "topic") == whole
    vecs = clusters.vectors(df.withColumn("Topic", F.lit(None).cast("int")), "doc_id", "Document", "Topic")
    n = vecs.count()
    seeds, found = clusters.seeding(vecs, n, 11), clusters.kmeans(vecs, n)
    of = {r.record: r.cluster for r in clusters.nearest(vecs, found).collect()}
    assert len(seeds) > 20 and 4 <= len(found) <= 8  # k-means makes few clusters of many seeds, each of one subject
    pure = {(of[i], t) for i, _, _, t in data if t is not None and i in of}
    assert len(pure) == len({c for c, _ in pure}) and len({t for _, t in pure}) == 4


def test_seeds_do_not_depend_on_the_partitioning(spark):
    df = spark.createDataFrame([(a, b, c) for a, b, c, _ in subject_texts()], "doc_id bigint, Document string, Topic int")
    vecs = clusters.vectors(df, "doc_id", "Document", "Topic")
    one, many = (clusters.seeding(vecs.repartition(k), 137, 3) for k in (1, 5))
    assert one.shape == many.shape and np.allclose(one, many)


# 8
BAD = ["see {{ author }} here", "In ${YEAR} cows", "[TBC - breed]", "HTTP status 503", "Error 404: no se ha encontrado la página solicitada.", "Veuillez activer JavaScript pour afficher le résumé.", "Text text text text", "Lorem pecus velit dolor", "Traceback (most recent call last):", "__TITLE_PLACEHOLDER__", "please enable js.", "Active content is required for the article viewer.", "Please enable\nJavaScript to go on", "Cows [Insert abstract here. At most 250 words.] ate"]
GOOD = ["The web questionnaire required JavaScript, so 9 older farmers answered by phone.", "Costs rose from $5 to $7 per case [95% interval].", "The set {calved, open, dry} was used.", "The marker <|endoftext|> separated the reports.", "Vitamin E 400 IU was given.", "The standard error was 404, and 3 records were not found in the herd book.", "<p>Milk &amp; cows</p>", "Access to pasture was denied to 9 herds.", "", " ", None]


def test_weak_labels():
    labels = residue.Labels()
    assert [any(labels.label(residue.segments(t))) for t in BAD + GOOD] == [True] * len(BAD) + [False] * len(GOOD)
    assert residue.Labels([], [], [], set()).label(["lorem ipsum {{ a }}"]) == [False]


def matching(parsed):
    """Texts that match a parsed pattern, one for each of its alternatives."""
    out = [""]
    for op, arg in parsed:
        name, more = str(op), [""]
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "SUBPATTERN":
            more = matching(arg[-1])
        elif name == "BRANCH":
            more = [x for b in arg[1] for x in matching(b)]
        elif name == "MAX_REPEAT":
            more = [arg[0] * x for x in matching(arg[2])]
        elif name == "IN":
            more = [chr(x[1] if str(x[0]) == "LITERAL" else x[1][0]) if str(x[0]) in ("LITERAL", "RANGE") else "w" for x in arg[:1]]
        elif name in ("ANY", "NOT_LITERAL"):
            more = ["'"]
        out = [a + b for a in out for b in more]
    return out


def test_every_pattern_passes_the_gate():
    from re import _parser

    labels = residue.Labels()
    texts = [(p, t) for p in residue.PLACEHOLDERS + residue.STATUSES + residue.PHRASES for t in matching(_parser.parse(p)) if re.search(p, t)]
    assert {*residue.STATUSES, *residue.PHRASES} <= {p for p, _ in texts}
    assert all(labels.label([t]) == [True] for _, t in texts)


def test_segments():
    s = residue.segments
    assert s("A b. C\r\nd é  f.") == ["a b.", "c", "d e f.", "c d e f."] and s(None) == [] and s(" \n") == []
    assert s("See [your text here]. Cows.") == ["see [your text here].", "cows."]


def herd_texts(n, rnd, bad, every=6):
    data = []
    for k in range(n):
        text = f"Herds near Place{k} were visited in {2000 + k % 20}. {SITES[k % 6].capitalize()} were scored for parity. The loss was {k}."
        data.append((k, text + rnd.choice(bad) if k % every == 0 else text, f"host{k % 11}"))
    return data


def test_residue(spark):
    rnd = random.Random(6)
    data = herd_texts(240, rnd, [" Please enable JavaScript to view this abstract.", " Die @@breed@@ betrug 3.", "\nLoading...", " Lorem ipsum dolor sit amet velit."])
    data += [(900, None, "host1"), (901, "", None), (902, " \n", "host2"), (0, data[0][1], "host0"), (None, "Loading...", "host3")]
    df = spark.createDataFrame([(*r, 1, "y") for r in data], "doc_id bigint, text string, source string, no int, seg string")
    assert sorted(r[0] for r in rows(residue.residue(df), "doc_id")) == [k for k in range(240) if k % 6 == 0]
    v = residue.validation(df).collect()
    assert v and all(r.recall is None or r.recall >= 0.8 for r in v)
    assert residue.residue(df.limit(0)).count() == 0 and residue.residue(df.where("doc_id % 6 = 1")).count() == 0


def test_the_classifier_finds_wordings_and_placeholders_without_a_pattern(spark):
    rnd = random.Random(9)
    known = [" Please enable JavaScript to view this abstract.", " Die @@breed@@ betrug 3.", " The value of @@herd@@ was kept.", " JavaScript is required to view this page."]
    texts = lambda data: residue._texts(spark.createDataFrame(data, "doc_id bigint, text string, source string"), "doc_id", "text", "source")
    data = herd_texts(300, rnd, known, 4)
    model = residue.train(residue.draw(texts(data), residue.Labels()))[0]
    new = [data[1][1] + " JavaScript is needed to view this page.", data[2][1] + " Use JavaScript to view the abstract here.", data[3][1] + " The value of ~~herd~~ was kept."]
    assert not any(any(residue.Labels().label(residue.segments(t))) for t in new)
    got = {r.record: r.score for r in residue.score(texts([(1000 + k, t, "h") for k, t in enumerate(new)] + data), model).collect()}
    assert min(got[k] for k in (1000, 1001, 1002)) >= residue.LEAST_THRESHOLD > max(got[k] for k in range(300) if k % 4)


def test_every_segment_is_learnt_from_whatever_the_weight(spark):
    data = [(k, f"Error 404: not found. Cow {k % 50} gave milk in the {k % 7}th month. No server lost page {k}.", f"h{k % 9}") if k % 5 == 0 else (k, f"Herd {k} was seen twice. Yield {k % 40} rose.\nLoss of a page {k % 3}", f"h{k % 9}") for k in range(400)]
    texts = residue._texts(spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(3), "doc_id", "text", "source")
    labels = residue.Labels()
    want = Counter(r.kind for r in residue.labelled(texts, labels).select("kind").collect())
    sample = residue.draw(texts, labels, most=40)
    got = {r.label: r for r in sample.groupBy("label").agg(F.sum("stands").alias("n"), F.sum(F.col("stands") * F.col("rate")).alias("mass"), F.count("*").alias("rows")).collect()}
    assert got[1.0].n == want[3] > 10 and got[0.0].n == sum(want.values()) - want[3] > got[0.0].rows
    assert abs(got[1.0].mass - 10) < 1e-9 and got[0.0].mass <= 30 + 1e-9
    x = sample.where("label = 1").first().features
    assert x.size == residue.DIMENSIONS + residue.EXTRA and list(x.indices) == sorted(set(x.indices)) and len(x.indices) > 10


def test_residue_of_one_held_out_host(spark):
    host = spark.range(50).select(F.concat(F.lit("h"), "id").alias("h")).where(residue.held_out(F.col("h"))).first().h
    data = [(k, f"Herds near Place{k} were visited in {2000 + k % 20}. The loss was {k}." + " Please enable JavaScript to view this abstract." * (k % 6 == 0), host) for k in range(120)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in residue.residue(df).collect()) == list(range(0, 120, 6))
    assert residue.residue(df.select("doc_id", F.lit("Loading...").alias("text"), "source")).count() == 120


def test_words_of_a_text_are_hashed_alike_everywhere():
    texts = ["", "  ", "Abc abc, ABC-x1", "Ünï 漢字 abc ÿ Ÿ ß", "a" * 5000 + " b", "\ud800x 漢", "naïve µ ©2 ²", "\x00a\x01b", "x_y"]
    sets = [set(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    bags = similar.Bags(bags_ids(len(texts)), texts)
    assert bags.n.tolist() == [len(s) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(set(bags.word[bags.doc == i]) & set(bags.word[bags.doc == j])) == len(a & b)

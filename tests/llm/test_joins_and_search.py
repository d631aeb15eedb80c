"""Jaccard join, ranked search, conversation trie, and what changed beside them, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tillbridge.llm import dedup, jaccard_join, language, licenses, ranking, warc, ztrie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def smallest_of_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_components_of_paths_stars_and_rings(spark):
    pick = random.Random(4)
    links = [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 240)] + [(300 + k, 300 + (k + 1) % 20) for k in range(20)]
    links += [(pick.randrange(400, 500), pick.randrange(400, 500)) for _ in range(60)] + [(1, 1)]
    pick.shuffle(links)
    found = {r["node"]: r["component"] for r in dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest_of_components({n for link in links for n in link}, links)
    assert found == {n: c for n, c in want.items() if n != 1 and n in found} and set(want) - set(found) <= {1} | {a for a, b in links if a == b}


# -- Jaccard join --------------------------------------------------------------

def shingles(text):
    words = (text or "").translate(LOWER).split(" ")
    words = [w for part in words for w in re.findall("[^\x20\x09-\x0D]+", part)]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + 3]) for k in range(len(words) - 2)) if len(words) > 2 else frozenset([tuple(words)])


def near_texts():
    pick = random.Random(11)
    common = " ".join(f"c{k}" for k in range(120))
    texts = []
    for group in range(14):
        words = [f"w{pick.randrange(30)}" for _ in range(pick.choice([9, 11, 14, 25, 60, 200]))]
        for _ in range(pick.choice([1, 3, 6])):
            copy = list(words)
            for _ in range(pick.choice([0, 1, 1, 2, 4])):
                copy[pick.randrange(len(copy))] = f"x{pick.randrange(1000)}"
            texts.append(" ".join(copy))
    texts += [f"{common} tail{k} of{k} its{k} own{k}" for k in range(25)]  # one passage, little else
    texts += [f"{common[:300]} " + " ".join(f"own{k}x{i}" for i in range(60)) for k in range(10)]
    return texts + [None, "", " \t\n", "one", "One", "one two", "two one", "a b c", "A  b\nC"] + texts[:5]


@pytest.mark.parametrize("options", [{}, {"boundary": -1, "split_rows": 3}, {"boundary": 1000, "split_rows": 1}])
def test_jaccard_join_equals_brute_force(spark, options):
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = smallest_of_components(range(len(sets)), links)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, n_shingles string").repartition(3)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_documents(docs, **options).collect()}
    assert found == {k: (len(sets[k]), want[k]) for k in range(len(sets))}
    assert len(set(want.values())) < len(want) - 20


def test_jaccard_join_of_odd_rows(spark):
    big = 2**60 + 1
    long = " ".join(f"l{k % 4000}" for k in range(9000))
    rows = [(None, "same words stand here"), (big, "same words stand here"), (7, "same words stand here"), (7, "same words stand here"), (7, None), (None, None), (3, long), (2, long + " more")]
    found = jaccard_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found)
    n = len(shingles(long))
    assert got == Counter([(None, 2, 7), (big, 2, 7), (7, 2, 7), (7, 2, 7), (7, 0, 7), (None, 0, None), (3, n, 2), (2, n + 1, 2)])
    assert jaccard_join.join_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_never_part_what_is_alike():
    pick = np.random.default_rng(1)
    for n in (30, 1900, 2100, 9000):
        a = np.unique(pick.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 20:], pick.integers(0, 2**63, n // 20, dtype=np.uint64)]))
        bits = min(jaccard_join.sketch_bits(len(a)), jaccard_join.sketch_bits(len(b)))
        parity = [np.bincount((x % np.uint64(bits)).astype(np.int64), minlength=bits) & 1 for x in (a, b)]
        assert (parity[0] ^ parity[1]).sum() <= len(np.setxor1d(a, b))


# -- ranked search -------------------------------------------------------------

def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 25 + (75 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -score) for k, (score, none, doc) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize("options", [{"first_wave": 1}, {"block_terms": 7, "first_wave": 3}])
def test_ranked_search_equals_brute_force(spark, options, monkeypatch):
    pick = random.Random(2)
    words = [f"t{int(pick.paretovariate(0.7)) % 60}" for _ in range(4000)]
    docs = [(k, " ".join(words[(k * 37) % 3500:][:pick.choice([3, 8, 20, 80])])) for k in range(150)]
    docs += [(2**60 + 1, "t1 t2 Zeta"), (None, "t1 t2 zeta"), (2**60 + 3, "t1 t2 zETA"), (5, docs[5][1]), (900, None), (901, "... --"), (902, "é É zeta")]
    items = [(1, "zeta t1 t1"), (2, docs[3][1] + " " + docs[9][1]), (2, "t1"), (3, None), (4, ""), (None, "É nothing"), (5, " ".join(words[:60])), (6, "nowhere")]
    monkeypatch.setattr(ranking, "SHARD_PLACES", 300)
    found = ranking.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **options)
    assert Counter(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect())) == Counter(ranked(docs, items, 10))


def test_ranked_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b", 3)], "item_id long, text string, score long")
    assert ranking.search(none, some).count() == 0
    assert ranking.search(some.withColumnRenamed("item_id", "doc_id"), spark.createDataFrame([], "item_id long, text string")).count() == 0


# -- conversation trie ----------------------------------------------------------

def plain_trie(sequences):
    """Rows of the contract from {conv_id: [(role, text), ...]}."""
    members, last = defaultdict(list), defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        last[tuple(turns)].append(conv)
    kids = Counter(p[:-1] for p in members if p)
    below, leaves = Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            below[p[:d]] += (len(own) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += not kids[p]
    return Counter(
        (min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids[p], leaves[p], below[p], hashlib.sha256(",".join(map(str, sorted(last[p]))).encode()).hexdigest())
        for p, own in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("batches", [1, 3])
def test_trie_equals_brute_force(spark, batches, monkeypatch):
    monkeypatch.setattr(ztrie, "BLOCK_BITS", 2)
    monkeypatch.setattr(ztrie, "CHUNK_BITS", 3)
    pick = random.Random(6)
    stem = [("user", f"é{k}") for k in range(23)]
    sequences = {}
    for conv in range(70):
        turns = stem[:pick.choice([0, 1, 2, 5, 9, 16, 23])] + [(pick.choice(["user", "bot"]), pick.choice(["", "a", "bb"])) for _ in range(pick.choice([0, 0, 1, 3]))]
        sequences[conv * 3 - 40] = turns
    rows = [(c, k, r, t) for c, turns in sequences.items() for k, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "of nobody")]
    turns = ztrie.number_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    ids = spark.createDataFrame([(c,) for c in [*sequences, -40, None]], "conv_id long")
    found = ztrie.build(turns, ids, batches)
    assert Counter(map(tuple, found.select(*COLUMNS).collect())) == plain_trie(sequences)


def test_trie_of_shared_heads_and_odd_rows(spark):
    rows = [(c, t, r, f"{c % 7} {t}") for c in (0, 3, 40, 99, 100, 101, 205, 207, -7) for t, r in ((0, "user"), (1, "bot"), (2, "user"))]
    rows += [(3, None, None, None), (40, 1, "bot", "tie"), (40, 1, "bot", "tie"), (5, 0, "u", "only one")]
    held = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        held[c].append((r or "", x or ""))
    sequences = {}
    for c in held:
        h = zlib.crc32(str(c).encode()) % 6
        sequences[c] = held.get(c - int(math.fmod(c, 100)), [])[:h] + held[c][h:]
    turns, ids = ztrie.share_heads(ztrie.number_turns(spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string")))
    assert Counter(map(tuple, ztrie.build(turns, ids).select(*COLUMNS).collect())) == plain_trie(sequences)


def test_trie_of_nothing(spark):
    turns, ids = ztrie.share_heads(ztrie.number_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))
    assert [tuple(r) for r in ztrie.build(turns, ids).select(*COLUMNS).collect()] == [(None, 0, None, 0, 0, 1, 0, hashlib.sha256(b"").hexdigest())]


# -- licenses, WARC, language ------------------------------------------------------

def test_templates_of_any_length(spark):
    pick = random.Random(1)
    unique = [f"w{k}" for k in range(30)]
    templates = {
        **licenses.TEMPLATES, "repeated": " ".join(unique[:15] + ["same"] * 80 + unique[15:]), "whole": " ".join(f"t{k % 700}" for k in range(1500)),
        "exactly-64": " ".join(f"e{k}" for k in range(64)), "empty": " ... ",
    }
    fill = lambda n: " ".join(pick.choice(["alpha", "beta", "gamma"]) for _ in range(n))
    texts = [f"{fill(pick.randrange(90))} {t} {fill(pick.randrange(90))}" for t in templates.values()]
    texts += [" ".join(w for w in templates["whole"].split() if pick.random() > drop) for drop in (0.05, 0.1, 0.3)] + [fill(500), None, ""]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()}
    split = {label: terms(t) for label, t in templates.items() if terms(t)}
    for k, text in enumerate(texts):
        words = terms(text)
        want = {label for label, p in licenses.PHRASES.items() if any(words[i:i + len(p.split())] == p.split() for i in range(len(words)))}
        for label, template in split.items():
            half, own = licenses.half_for(len(template)), set(template)
            if any(len(own & set(words[i:i + 2 * half])) >= licenses.THRESHOLD * len(own) for i in range(0, len(words), half)):
                want.add(label)
        assert found[k]["labels"] == ",".join(sorted(want)), k
    assert all(label in found[k]["labels"].split(",") for k, label in enumerate(templates) if label in split)


def test_revisits_of_equal_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 1500)
    big = 2**60 + 1
    rows = [(3, "http://a/ x y", "same"), (1, "http://b/é", "same"), (None, "u", "same"), (big, None, "same"), (5, "c", "other"), (6, "d", None), (7, "", ""), (1, "http://b/é", "same"), (8, "x\r\ny", "<p>\r\n\r\n\ud83d</p>".replace("\ud83d", "ß"))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    index = warc.write(pages)
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    want = []
    for page, url, html in rows:
        response = page == first[html or ""]
        want.append((page, url or "", "response" if response else "revisit", None if response else first[html or ""], html or "" if response else None))
    read = warc.read(index)
    assert Counter((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["html"]) for r in read.collect()) == Counter(want)
    assert Counter(r["page_id"] for r in index.collect()) == Counter(r[0] for r in rows)
    assert index.agg({"length": "sum"}).first()[0] > 1500 and read.rdd.getNumPartitions() > 1  # tasks grow with the records' bytes
    bundles = {r["bundle"] for r in index.collect()}
    looked = [r for b in bundles for r in warc.lookup(b, 8)]
    assert [(r[0], r[3], r[5]) for r in looked] == [(8, "response", "x\r\ny")]
    assert sum(len(warc.record_index(b)) for b in bundles) == len(rows)
    start = sorted(bundles)[0]
    files, path = warc.open_uri(start)
    with files.open_input_file(path) as source:
        _, packed, plain = warc.seek_table(start)[0]
        begun = warc.zstandard.ZstdDecompressor().decompress(source.read_at(packed, 0), max_output_size=plain).decode()
    assert begun.startswith("WARC/1.1\r\nWARC-Type: warcinfo\r\n") and begun.count("WARC-Date: ") == begun.count("WARC-Type: ") == len(set(re.findall("urn:uuid:[0-9a-f-]+", begun)))


def test_language_tables_in_pieces_and_whole(monkeypatch):
    pick = random.Random(3)
    texts = {"aa": "the cat sat on the mat and ate the rat ", "bb": "le chat est assis sur le tapis et mange "}
    codes, ns, which = [], [], []
    for k, (_, text) in enumerate(sorted(texts.items())):
        data = np.frombuffer(b"\0\0\0" + ("".join(pick.sample(text.split(" "), 9)) + text * 3).encode(), np.uint8).astype(np.uint32)
        code, n = np.unique(data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:], return_counts=True)
        codes, ns, which = [*codes, code], [*ns, n], [*which, np.full(len(code), k, np.int32)]
    counts = [np.concatenate(x) for x in (codes, ns, which)]
    pruned, whole = language.build(("aa", "bb"), *counts, 4, 1000), language.build(("aa", "bb"), *counts, None, None)
    monkeypatch.setattr(language, "NODES", 3)
    pieces = language.build(("aa", "bb"), *counts, 4, 1000)
    assert np.array_equal(pieces.costs, pruned.costs) and len(whole.costs) > len(pruned.costs)
    for name, text in texts.items():
        assert language.judge(pruned, text)[0] == language.judge(whole, text)[0] == name


def test_code_length_is_the_trees_bits():
    """Every byte's bits under the whole tree, counted context by context from the escape rule."""
    text = "abab abba abab cab"
    data = b"\0\0\0" + text.encode()
    window = np.frombuffer(data, np.uint8).astype(np.uint32)
    code, n = np.unique(window[:-3] << 24 | window[1:-2] << 16 | window[2:-1] << 8 | window[3:], return_counts=True)
    model = language.build(("x",), code, n, np.zeros(len(code), np.int32), None, None)
    after = defaultdict(Counter)
    for k in range(3, len(data)):
        for order in range(4):
            context = data[k - order:k]
            if 0 not in context:
                after[context][data[k]] += 1

    def bits(context, byte):
        seen = after.get(context)
        if seen is None:
            return bits(context[1:], byte)
        total, distinct = sum(seen.values()), len(seen)
        if seen[byte]:
            return -math.log2(seen[byte] / (total + distinct))
        return -math.log2(distinct / (total + distinct)) + (bits(context[1:], byte) if context else 8.0)

    for probe in ("abab", "cabbage", "zz"):
        coded = b"\0\0\0" + probe.encode()
        want = 0.0
        for k in range(3, len(coded)):
            context = coded[k - 3:k].lstrip(b"\0")
            known = bytes(b for b in context)
            while any(b not in text.encode() for b in known):
                known = known[1:]
            want += bits(known, coded[k])
        assert language.code_lengths(model, probe)[0] == pytest.approx(want, rel=1e-5)

"""Corpus operators against brute force, round trips and held-out accuracy, and on odd rows."""

import base64
import hashlib
import re
import struct
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tillbridge.llm import chat, common, decontaminate, dedup, fingerprints, language, licenses, pieces, quality, queries, secrets, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "palabra uno dos " * 9000 + "token = abcdefgh12345678"
ODD = [
    (1, None, None, "a", 0), (2, "", "en", None, 0), (3, "one two", "en", "a", 7), (4, LONG, "es", "a", len(LONG)), (5, LONG, "es", "b", len(LONG)),
    (6, "Released under the MIT License.\n\npassword: hunter2hunter2", None, "a", 1), (6, "Released under the MIT License.\n\npassword: hunter2hunter2", None, "a", 1),
    (7, "12 34 !!", "en", "a", 8), (None, "no id here but words enough for sets", "en", "a", 36),
    (8, "client_id = shop-main\nendpoint: pay.example.net\nAb3dEf6hIj9lMn2pQr5t", "en", "a", 1), (9, "a lone Ab3dEf6hIj9lMn2pQr5t stays", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def got(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] or "" for r in table("documents")}


def plain_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets_base(spark, texts):
    rows = got(spark, "op1_secret_scan")
    assert len(rows) == len(texts)
    assert all(r["base_sha256"] == sha(plain_spans(texts[r["doc_id"]])) for r in rows)


def test_secrets_odd(odd, nothing):
    found = secrets.find(odd).collect()
    assert len(found) == len(ODD) and secrets.find(nothing).count() == 0
    by = {r["doc_id"]: r["spans"] for r in found}
    assert by[8] == "identity:0:21,endpoint:22:47,mixed:48:68"  # three weak parts that need each other
    assert by[9] == "" and by[1] == "" and by[4].startswith("assign:")
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(odd).collect()}
    assert masked[1] is None and masked[6].endswith("[secret]") and masked[9] == ODD[-1][1]
    assert secrets.redact(odd).columns == odd.columns


def test_secrets_do_not_confirm_themselves(spark):
    token, url = "Ab3dEf6hIj9lMn2pQr5t", "https://example.com/Docs/Guide2024Intro"
    wanted = {
        f"user_id: {token}": "", f"Login: {url}": "", url: "", f"user_id: {token} https://example.com/": "", f"Login: {url} and https://example.org/": "",
        f"user_id: {token} account_id: 12345": "", f"user_id: {token}\nXy3dEf6hIj9lMn2pQr5t": "identity:0:29,mixed:30:50",
        f"Login: bob {url}": "identity:0:10,mixed:27:50",  # two strings; the endpoint has no secret but its own
        f"https://example.com/?client_id=shop&sig={token}": "identity:21:35,mixed:40:60",
        f"{token} client_id: shop ftp://a.example/": "mixed:0:20,identity:21:36,endpoint:37:53",
        f"client_id: shop {'.' * 200} ftp://a.example/ {'.' * 200} {token}": "endpoint:217:233", f"client_id: shop {'.' * 300} {token}": "",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(wanted)], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.find(docs).collect()}
    assert [found[i] for i in range(len(wanted))] == list(wanted.values())
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert masked[0] == f"user_id: {token}" and masked[1] == f"Login: {url}"


def test_pieces_equal_the_library(odd, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for size in (pieces.CHUNK, 50):
        rows = pieces.round_trip(odd, chunk=size).collect()
        assert len(rows) == len(ODD)
        wanted = Counter((r[0], tuple(library.encode(r[1] or ""))) for r in ODD)
        assert Counter((r["doc_id"], tuple(r["pieces"])) for r in rows) == wanted
        assert all(r["exact"] for r in rows)
    assert pieces.round_trip(nothing).count() == 0


def test_pieces_without_spaces():
    """Chunks of one long word: states, matrices and backtrace against the whole encoding."""
    with open(pieces.MODEL, "rb") as source:
        codec = pieces.Codec(source.read())
    rng = np.random.default_rng(3)
    for alphabet in ("ab", "thernd", "aé漢 ", "x▁ y"):
        for _ in range(20):
            raw = codec.raw("".join(rng.choice(list(alphabet), rng.integers(60, 140))))
            m, n = codec.longest, 37
            chunks = [(raw[max(0, i - m):i], raw[i:i + n], raw[i + n:i + n + m]) for i in range(0, len(raw), n)]
            path = pieces.best_states([codec.transfer(*c) for c in chunks], 0, 0)
            joined = np.concatenate([codec.backtrace(*c, *p) for c, p in zip(chunks, path)])
            assert joined.tolist() == codec.segment(raw).tolist()


def test_pieces_new_words_in_one_call(monkeypatch):
    with open(pieces.MODEL, "rb") as source:
        codec = pieces.Codec(source.read())
    library, calls = codec.processor, []

    class Counted:
        def encode(self, given, **how):
            calls.append([given] if isinstance(given, str) else given)
            return library.encode(given, **how)

    codec.processor = Counted()
    texts = ["", " ", *(f"one two w{i} x{i}.\n  three▁four é漢 {'y' * 60}{i} " for i in range(500))]
    found = codec.segments([codec.raw(t) for t in texts])
    assert [f.tolist() for f in found] == library.encode(texts)
    assert len(calls) == 1 and len(set(calls[0])) == len(calls[0])
    assert pieces.as_lists(found).to_pylist() == [f.tolist() for f in found] and pieces.as_lists([]).to_pylist() == []
    assert max(map(len, codec.kept)) <= pieces.KEPT_SIZE
    monkeypatch.setattr(pieces, "KEPT_WORDS", 100)
    calls.clear()
    for i in range(50):  # a word of every text outlives the caches' turns, which keep the others few
        text = "often " + " ".join(f"{i}q{j}" for j in range(20))
        assert codec.segment(codec.raw(text)).tolist() == library.encode(text)
    assert sum(word == codec.guard + " often" for call in calls for word in call) == 1
    assert len(codec.kept) + len(codec.older) < 2 * 130


def test_licenses(spark, odd, nothing, texts):
    for r in got(spark, "op3_license_scan"):
        words = WORD.findall(low(texts[r["doc_id"]]))
        places = [(i, label) for label, p in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        wanted = set(label for _, label in places)
        for label, template in licenses.TEMPLATES.items():
            t = set(template.split())
            if any(len(t & set(words[i:i + 64])) >= licenses.THRESHOLD * len(t) for i in range(0, len(words), 32)):
                wanted.add(label)
        assert r["labels"] == ",".join(sorted(wanted))
    rows = licenses.scan(odd).collect()
    assert len(rows) == len(ODD) and licenses.scan(nothing).count() == 0
    assert [r["labels"] for r in rows if r["doc_id"] == 6] == ["mit,mit-notice"] * 2


def test_decontamination(spark, odd, nothing, texts):
    windows = {}
    for r in table("benchmark"):
        words = WORD.findall(low(r["text"]))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add(str(r["item_id"]))
    for r in got(spark, "op4_decontaminate"):
        words = WORD.findall(low(texts[r["doc_id"]]))
        hit, items = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if found := windows.get(tuple(words[i:i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(words), len(hit), len(items), sha(",".join(sorted(items))))
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "uno dos palabra " * 8), (4, "uno dos palabra " * 8)], "item_id long, text string")
    for size in (decontaminate.BLOCK_WORDS, 5):  # one block of items, and several
        rows = decontaminate.find(odd, items, block_words=size).collect()
        assert Counter((r["doc_id"], r["n_items"], r["contaminated"]) for r in rows if r["n_hit"]) == Counter([(3, 1, True), (4, 1, True), (5, 1, True)])
    assert {r["longest_match"] for r in rows if r["doc_id"] == 4} == {24}
    assert decontaminate.remove(odd, items).columns == odd.columns and decontaminate.remove(odd, items).count() == len(ODD) - 3
    assert decontaminate.remove(odd, items.limit(0)).count() == len(ODD) and decontaminate.find(nothing, items).count() == 0


def test_longest_match_of_each_document(spark):
    """Documents of one shard with matches of several lengths, in two partitionings and block sizes."""
    rng = np.random.default_rng(9)
    items = {str(i): [f"w{k}" for k in rng.integers(0, 6, n)] for i, n in enumerate((40, 25, 10, 4, 1))}
    items |= {"a": [f"v{k}" for k in range(30)], "b": [f"v{k}" for k in range(30)]}
    texts = {0: items["a"][:10], 1: items["a"][3:15], 2: items["a"], 3: [*items["0"][5:19], "x", *items["1"][2:16]], 4: items["a"][:9], 5: []}
    for i in range(6, 60):
        parts = [items[k][s:s + n] for k, s, n in zip(rng.choice(list(items), 3), rng.integers(0, 15, 3), rng.integers(5, 25, 3))]
        texts[i] = [w for p in parts for w in [*p, *(["x"] if rng.random() < 0.5 else [])]]

    def longest(words):
        best = (0, None, None)
        for name, item in items.items():
            for s in range(len(item)):
                for at in range(len(words)):
                    n = 0
                    while s + n < len(item) and at + n < len(words) and item[s + n] == words[at + n]:
                        n += 1
                    if n >= min(10, len(item)):
                        best = min(best, (-n, at, name))
        return -best[0], best[2], best[1]

    benchmark = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id string, text string")
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    for parts, size in ((1, decontaminate.BLOCK_WORDS), (7, 20)):
        rows = {r["doc_id"]: r for r in decontaminate.find(docs.coalesce(1).repartition(parts), benchmark, block_words=size).collect()}
        for i, w in texts.items():
            assert (rows[i]["longest_match"], rows[i]["longest_item"], rows[i]["longest_at"]) == longest(w), i
    assert [rows[i]["longest_match"] for i in range(6)] == [10, 12, 30, 14, 0, 0]


def test_suffix_array_sorts():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 4, 300).astype(np.int32)
    order = decontaminate.suffix_array(text, 300)
    assert [tuple(text[i:]) for i in order] == sorted(tuple(text[i:]) for i in range(300))


def test_chat(spark):
    said = table("conversations") + [{"conv_id": -7, "turn": i, "role": r, "text": "</s>[INST] ok [/INST]"} for i, r in enumerate(("user", "assistant"))]
    by = {k: sorted(g, key=lambda r: r["turn"]) for k, g in groupby(sorted(said, key=lambda r: r["conv_id"]), key=lambda r: r["conv_id"])}
    rows = got(spark, "op5_chat_format")
    assert len(rows) == len(by)
    for r in rows:
        turns = by[r["conv_id"]]
        learned = "".join(t["text"] or "" for t in turns if t["role"] == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{t['role']}\n{t['text'] or ''}\n" for t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), sha(learned))


def test_chat_trees_and_odd_turns(spark):
    nodes = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.5), (1, 3, 1, "assistant", "<s>good\\", 2.0), (1, 4, 3, "user", "x", 0.0), (1, 5, 2, "user", "y", 1.0), (2, 9, 8, "user", None, 0.0)]
    path = chat.best_paths(spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double"), branches=2)
    rows = {(r["conv_id"], r["branch"]): r for r in chat.read_back(chat.format_paths(path)).collect()}
    assert [t["text"] for t in rows[1, 1]["turns"]] == ["q", "<s>good\\", "x"] and [t["text"] for t in rows[1, 2]["turns"]] == ["q", "bad", "y"]
    (span,) = rows[1, 1]["loss_spans"]
    assert rows[1, 1]["formatted"][span["start"]:span["end"]] == "<\\s>good\\\\"
    assert rows[2, 1]["path_score"] == 0.0 and rows[2, 1]["turns"][0]["text"] == ""
    odd = spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "a"), (3, None, None, None), (3, 0, "assistant", "\n")] + [(4, i, "user", str(i)) for i in range(300)], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["n_turns"] for r in chat.digest_conversations(odd).collect()} == {None: 2, 3: 2, 4: 300}
    assert chat.digest_conversations(odd.limit(0)).count() == 0


def test_fingerprints(spark, odd, nothing, texts):
    rows = {r["doc_id"]: r for r in got(spark, "op6_fingerprints")}
    ids = sorted(texts, reverse=True)
    for i, following in zip(ids, ids[1:] + ids[:1]):
        third = len(texts[i]) // 3
        changed = texts[i][:len(texts[i]) - third] + texts[following][:third]
        assert (rows[i]["n_chars"], rows[i]["edited_sha256"]) == (len(texts[i]), sha(changed))
        assert rows[i]["edited_fingerprint"] == fingerprints.fingerprint(changed)
        assert rows[i]["near_next"] == fingerprints.likeness(rows[i]["fingerprint"], rows[following]["fingerprint"])
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows.values()]) > 0.95
    found = fingerprints.compare_with_next(odd).collect()
    assert len(found) == len(ODD) and all(0 <= r["near_next"] <= 1 for r in found)
    assert fingerprints.compare_with_next(nothing).count() == 0
    assert fingerprints.compare_with_next(odd.where("doc_id = 4")).first()["near_next"] == 1.0


def test_quality(spark, odd, nothing):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    rows = [r for r in queries.op7_quality(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.93
    assert all(r["held_out"] == (common.plain_fold(r["doc_id"]) == 2) for r in rows)
    some = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    assert quality.classify(odd, some).count() == len(ODD) and quality.classify(nothing, some).count() == 0
    assert {r["score"] for r in quality.classify(odd, some.limit(0)).collect()} == {0.5}


def brute_components(sets):
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i in sets:
        for j, n in Counter(j for x in sets[i] for j in holders[x] if j < i).items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def word_sets(texts):
    out = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        out[i] = {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    return out


def test_near_duplicates(spark, odd, nothing, texts):
    sets = word_sets(texts)
    root = brute_components(sets)
    for r in got(spark, "op8_near_dedup"):
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])
    by = {r["doc_id"]: r for r in dedup.group_documents(odd).collect()}
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[1]["n_shingles"] == 0 and by[2]["kept"] and by[None]["n_shingles"] == 4
    assert dedup.group_documents(nothing).count() == 0 and dedup.keep_one(odd).columns == odd.columns


def test_one_row_of_each_group_stays_without_unique_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(None, a), (None, a + " more"), (None, a), (None, b), (None, b), (7, c), (7, c + " more"), (7, c), (8, c), (None, c), (7, d), (7, d), (9, d), (None, None), (None, None), (3, " "), (3, " ")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    found = [(r["doc_id"], (r["text"] or " ")[0]) for r in dedup.keep_one(docs).collect()]
    assert Counter(found) == Counter({(None, "a"): 1, (None, "b"): 1, (7, "c"): 1, (7, "d"): 1, (None, " "): 2, (3, " "): 2})
    assert dedup.keep_one(docs).columns == docs.columns


def test_near_duplicates_in_one_large_group(spark, monkeypatch):
    """A group of edited copies with outliers, in blocks much smaller than the group."""
    monkeypatch.setattr(dedup, "OUTER", 8)
    monkeypatch.setattr(dedup, "INNER", 16)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for k in rng.choice(120, rng.integers(0, 9), replace=False):
            words[k] = f"x{i}_{k}"
        texts[i] = " ".join(words)
    sets = word_sets(texts)
    root = brute_components(sets)
    assert len(set(root.values())) > 5  # some copies are edited too much
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in dedup.group_documents(docs).collect()} == root


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100), (7, 7)]
    found = {r["node"]: r["component"] for r in dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def test_warc(spark, tmp_path):
    first = {}
    rows = table("pages")
    for r in sorted(rows, key=lambda r: r["page_id"]):
        first.setdefault(r["html"] or "", r["page_id"])
    read = {r["page_id"]: r for r in got(spark, "op9_warc")}
    assert len(read) == len(rows)
    for r in rows:
        data, own = (r["html"] or "").encode(), read[r["page_id"]]
        assert (own["payload_bytes"], own["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    odd = spark.createDataFrame([(1, "u", "same\r\n\r\nx"), (2, None, "same\r\n\r\nx"), (3, "a\nb", None), (4, "", ""), (None, "u", "same\r\n\r\nx"), (5, "u", "z" * 3_000_000), (5, "u", "z" * 3_000_000)], "page_id long, url string, html string")
    index = warc.write(odd, str(tmp_path / "bundles"))
    found = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(index).collect())
    assert found == Counter({(1, "response", None, 9): 1, (2, "revisit", 1, 9): 1, (3, "response", None, 0): 1, (4, "revisit", 3, 0): 1, (None, "revisit", 1, 9): 1, (5, "response", None, 3_000_000): 2})
    one = index.where("page_id = 5").first()
    table_rows = warc.seek_table(one["bundle"])
    assert (one["frame_start"], one["frame_bytes"], one["frame_plain"]) in table_rows
    files, path = warc.open_uri(one["bundle"])
    with files.open_input_file(path) as source:
        end = table_rows[-1][0] + table_rows[-1][1]
        assert struct.unpack("<I", source.read_at(4, end))[0] == warc.SKIPPABLE_MAGIC
    assert warc.read(index.where("page_id = 2")).first()["refers_to"] == 1
    assert warc.archive_and_read(odd.limit(0)).count() == 0


def test_language(spark, odd, nothing):
    folder = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    rows = [r for r in queries.op10_language(spark, folder).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in rows]) > 0.98
    found = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert language.identify(odd).count() == len(ODD) and found[7]["lang_pred"] == found[1]["lang_pred"] == "und" and found[1]["score"] == 0.0
    assert language.identify(nothing).count() == 0
    assert set(r["lang_pred"] for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()) == {"und"}


def test_code_length_is_the_escape_chain(spark):
    docs = spark.createDataFrame([("abababab", "x")], "text string, lang string").withColumn("doc_id", F.lit(1))
    model = language.train(docs, min_context=1)
    # root: a and b 4 times each, 2 distinct; then contexts of one and more bytes
    assert np.isclose(language.code_lengths(model, "a")[0], -np.log2(4 / 10))
    assert np.isclose(language.code_lengths(model, "c")[0], -np.log2(2 / 10) + 8)


def test_pipeline(spark, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "piece_codec"]
    rows = corpus_pipeline.run(spark, SF).collect()
    root = brute_components(word_sets(texts))
    hit = {r["doc_id"] for r in got(spark, "op4_decontaminate") if r["contaminated"]}
    assert {r["doc_id"] for r in rows} == {i for i in texts if root[i] == i and i not in hit and any(map(str.isalpha, texts[i]))}
    assert all(r["exact"] for r in rows)


def test_pipeline_stages_keep_columns_on_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        rows = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == docs.columns, name
        assert {r["doc_id"] for r in rows.collect()} == ({3, 4, 6, 8, 9, None} if docs is odd else set())

"""Training-data operators against brute force, libraries and defined edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from handtrace.llm import (
    ann, chat, decontaminate, html_density, language, near_dup, quality, sentencepiece_bpe, substring_dup, textvec,
    token_files,
)
from handtrace.llm.common import components
from handtrace.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, component int"
PIECE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


BASE = words(120, 1)
EDITED = [*BASE[:60], "changed", *BASE[61:]]
PASSAGE = words(60, 2)
TEXTS = [
    (1, " ".join(BASE)), (2, " ".join(EDITED)), (3, " ".join(BASE)), (3, " ".join(BASE)),
    (4, " ".join(words(30, 3) + PASSAGE + words(30, 4))), (5, " ".join(words(25, 5) + PASSAGE + words(40, 6))),
    (6, None), (7, ""), (8, ""), (9, "one two"), (10, "one two"), (11, "¿?!"), (None, " ".join(words(40, 7))),
    (12, " ".join(words(30_000, 8))), (13, " ".join(words(200, 9)) + "\nß é 日本 😀 </s>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i and i % 2 else "fr", None, len(t or ""), 1, "k", 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 201), (200, 202)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {0} and got[101] == 100 and got[202] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_follow_the_word_pattern():
    texts = ["The cat, the CAT", "", "naïve 日本 x1", "a" * 3_000_000, "the cat"]
    seen = {}
    for first, end, data, offsets in textvec.byte_slices(pa.array(texts)):
        own = textvec.Words(data, offsets)
        for row in range(first, end):
            low, high = own.first[row - first], own.first[row - first + 1]
            want = WORD.findall(texts[row].translate({c: c + 32 for c in range(65, 91)}))
            assert high - low == len(want)
            for h, w in zip(own.hash[low:high].tolist(), want):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_near_duplicates(docs, empty):
    rows = near_dup.duplicate_classes(docs).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(rows) == len(TEXTS)
    assert got[1] == got[2] == got[3] == 1 and got[7] == got[8] == 7 and got[9] == got[10] == 9
    assert got[4] == 4 and got[5] == 5 and got[6] == 6 and got[12] == 12 and got[None] is None
    kept = near_dup.keep_one(docs, near_dup.duplicate_classes(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 9, 11, 12, 13]
    assert near_dup.duplicate_classes(empty).count() == 0


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "PIVOT_ROUNDS", 1)
    rng, rows = random.Random(5), []
    for family in range(6):
        base = words(80, 50 + family)
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(80)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf = near_dup.inverse_frequencies(docs)
    sets = near_dup.weighted_sets(pa.array([t for _, t in rows]), idf)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if near_dup.similarity(sets[a], sets[b]) >= near_dup.THRESHOLD:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r["doc_id"]: r["class_id"] for r in near_dup.duplicate_classes(docs).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_weighted_sampling_estimates_similarity():
    rng = np.random.default_rng(3)
    value = textvec.mix(np.arange(400, dtype=np.uint64))
    one, two = rng.uniform(0.5, 3, 300).astype(np.float32), rng.uniform(0.5, 3, 300).astype(np.float32)
    a, b = value[:300], value[100:]
    both = np.concatenate([near_dup.consistent_samples(v, w, np.array([0]), np.array([300]), 3000)
                           for v, w in ((a, one), (b, two))])
    shared = np.minimum(one[100:], two[:200]).sum()
    want = shared / (one.sum() + two.sum() - shared)
    assert abs((both[0] == both[1]).mean() - want) < 0.04


def test_repeated_passages(docs, empty):
    rows = substring_dup.remove_passages(docs).collect()
    assert len(rows) == len(TEXTS)
    text = {r["doc_id"]: r["text"] for r in rows}
    original = dict(TEXTS)
    holders = [i for i in (4, 5) if " ".join(PASSAGE) in text[i]]
    assert len(holders) == 1
    other = ({4, 5} - set(holders)).pop()
    assert text[other].split() == [w for w in original[other].split() if w not in PASSAGE]
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    assert classes[4] == classes[5] == 4 and classes[1] == classes[2] == classes[3] == 1
    for i in (6, 7, 8, 9, 10, 11, 12, 13, None):
        assert text[i] == original[i] and classes[i] == i
    assert substring_dup.remove_passages(empty).count() == 0


def test_passages_shared_only_among_later_documents(spark):
    """The first document of a shared piece lacks the passage of the others."""
    long = words(51, 77)
    rows = [(1, " ".join(words(20, 1) + long[:49] + words(20, 2)))]
    rows += [(i, " ".join(words(20, 10 * i) + long + words(20, 10 * i + 1))) for i in (2, 3, 4)]
    got = substring_dup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(" ".join(long) in r["text"] for r in got) == 1
    assert [r["n_words_removed"] for r in got if r["doc_id"] == 1] == [0]


@pytest.mark.parametrize("rounds", [0, 2])
def test_similar_lines_equal_brute_force(spark, monkeypatch, rounds):
    """The first lines of a family collide with the others, but are not similar to them."""
    monkeypatch.setattr(substring_dup, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(substring_dup, "BLOCK", 5)
    rng, base, lines = random.Random(8), words(99, 400), []
    for k in range(36):  # an edit in the middle leaves no common window
        edits = [49, *(rng.sample((8, 20, 32, 66, 78, 90), 2) if k < 24 else ())]
        lines.append([f"e{k}x{i}" if i in edits else w for i, w in enumerate(base)])
    sets = [{tuple(w[i:i + 5]) for i in range(95)} for w in lines]
    root, removed = list(range(36)), [0] * 36
    for b, a in itertools.combinations(range(36), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            removed[a] = 99
            root = [root[b] if x == root[a] else x for x in root]
    assert sum(removed) == 1089
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(lines)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_words_removed"], r["class_id"]) for r in substring_dup.remove_passages(docs).collect()}
    assert got == {k: (removed[k], root[k]) for k in range(36)}


def test_repeated_rows_keep_their_passages(spark):
    """Rows with one id and text are one document, which is not a repetition of itself."""
    own, shared, bare = (" ".join(words(80, s)) for s in (301, 302, 303))
    rows = [(1, own), (1, own), (2, shared), (3, shared), (3, shared), (None, bare), (None, bare)]
    got = substring_dup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    texts = sorted((r["doc_id"] or 0, r["text"], r["class_id"]) for r in got)
    assert texts == [(0, bare, None), (0, bare, None), (1, own, 1), (1, own, 1), (2, shared, 2), (3, "", 2), (3, "", 2)]


def brute_contamination(texts, items):
    found = {}
    low = {c: c + 32 for c in range(65, 91)}
    windows = [(i, WORD.findall((t or "").translate(low))) for i, t in items]
    for key, text in texts:
        w, hit, ids = WORD.findall((text or "").translate(low)), set(), set()
        for item, v in windows:
            n = min(10, len(v))
            grams = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k:k + n]) in grams:
                    hit.update(range(k, k + n))
                    ids.add(item)
        found.setdefault(key, []).append((len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return {k: sorted(v) for k, v in found.items()}


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_decontamination_equals_brute_force(spark, docs, empty, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    items = [(1, " ".join(BASE[10:40])), (2, "one TWO"), (3, ""), (4, None), (10, " ".join(PASSAGE[:10])),
             (None, " ".join(PASSAGE[20:31])), (2, "日本"), (5, "absent words here"), (6, "w1 w2 w3 w4 w5 w6 w7")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontaminate.contamination(docs, bench).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], list(r["item_names"])))
    assert {k: sorted(v) for k, v in got.items()} == brute_contamination(TEXTS, items)
    if limit:
        clean = decontaminate.keep_clean(docs, bench)
        dirty = {k for k, v in brute_contamination(TEXTS, items).items() if v[0][1]}
        assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in TEXTS} - dirty
        assert decontaminate.contamination(empty, bench).count() == 0
        assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_sentencepiece_equals_the_library(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = sentencepiece_bpe.encode_documents(docs, PIECE).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = model.encode(r["text"] or "")
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(want).encode()).hexdigest()
    assert sentencepiece_bpe.encode_documents(empty, PIECE).count() == 0
    own, rng = sentencepiece_bpe.model(PIECE), random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "日", "▁", "😀", "ing", "http://", "0", "́", "\x00", "e.g.", "ق"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        ids, _ = own.encode(*next(textvec.byte_slices(pa.array([text])))[2:])
        assert ids.tolist() == model.encode(text) and own.decode(ids) == model.decode(ids.tolist())


def test_token_files(docs, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    manifest = token_files.write_tokens(docs, f"file://{tmp_path}/a", WORD_BPE, end=1)
    got = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([i for i, _ in TEXTS], key=lambda i: (i is not None, i))
    start, left = 0, list(TEXTS)
    for r in got:
        options = [t for i, t in left if i == r["doc_id"]]
        ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in options]
        match = [k for k, x in enumerate(ids) if zlib.crc32(x.tobytes()) == r["ids_crc32"]]
        assert match and r["start"] == start and r["n_tokens"] == len(ids[match[0]])
        left.remove((r["doc_id"], options[match[0]]))
        start += r["n_tokens"]
    assert token_files.read_tokens(token_files.write_tokens(empty, f"file://{tmp_path}/b", WORD_BPE, end=1)).count() == 0
    file = manifest.orderBy(F.desc("n_ids")).first()["path"]
    ids = token_files.read_file(file)[1]
    assert token_files.read_block(file, 1).tolist() == ids[token_files.BLOCK:2 * token_files.BLOCK].tolist()
    tricky = ["don't x.'s", "x<|endoftext|>y <|STARTOFTEXT|>", "É́COLE café a", "'s 'll''", "½ 3.14 a1", "İΣ ß", "<|"]
    own = token_files.tokenizer(WORD_BPE)
    for text in tricky:
        ids = own.encode(*next(textvec.byte_slices(pa.array([text])))[2:])[0]
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_packed_words():
    rng = np.random.default_rng(1)
    for ids in ([], [0] * 1000, [2**64 - 1, 0, 2**60, 2**60 - 1] * 40, rng.integers(0, 49_408, 5000).tolist(),
                rng.integers(0, 3, 3000).tolist()):
        packed, lengths = token_files.pack(np.array(ids, np.uint64))
        assert token_files.unpack(packed).tolist() == ids and lengths.sum() == len(packed)


def test_main_text(spark):
    body = "<p>" + "Good words of the article. " * 12 + "</p>"
    page = (f"<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use</div>"
            f"<article><h1>T &amp; t</h1>{body}<p>a<br>b  c{body}<ul><li>one<li>two</ul></article>"
            f"<div id=comments><p>{'reader says this. ' * 20}</p></div><aside>side</aside><footer>foot")
    good = ("Good words of the article. " * 12).strip()
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "plain  text\n here"), (4, "u", "plain  text\n here"),
            (5, "u", "<script>var t='</p>';</script>"), (6, "u", "<div><p>x<p>y &#233; &copy"), (None, "u", "<b>z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_density.extract(pages)
    texts = {r["page_id"]: r["text"] for r in got.collect()}
    assert texts[1] == f"T & t\n{good}\na b c\n{good}\none\ntwo"
    assert (texts[2], texts[3], texts[4], texts[5], texts[6], texts[None]) == ("", "", "plain text here", "", "x\ny é ©", "z")
    assert got.count() == len(rows) and html_density.extract(pages.limit(0)).count() == 0


def test_language(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(table)
    right = language.predict(table, model).join(table, "doc_id").where("lang = lang_pred").count()
    assert right >= 0.95 * table.count()
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (6, 7, 11))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language.fit(empty)
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_quality(spark, docs, empty):
    folder = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored = QUERIES["op9_quality"](spark, folder).join(labels, "doc_id").where("held_out")
    assert scored.where("predicted = quality").count() >= 0.9 * scored.count()
    none = quality.fit(docs, labels.limit(0))
    assert {r["quality_score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty, none).count() == 0 and quality.score(docs, none).columns[:-1] == docs.columns
    assert table.count() == QUERIES["op9_quality"](spark, folder).count()


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)) * rng.uniform(0.5, 2, (400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(400, None), (401, []), (402, [0.0] * 8), (403, [None] + [1.0] * 7), (404, [float("nan")] + [1.0] * 7),
           (405, [float("inf")] * 8), (406, [1.0] * 3), (None, [1.0] * 8), (0, rows[0][1])]
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, id int")
    got = {}
    for r in ann.nearest(table, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 400, 20):
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:20]
        hits += len({i for i, _ in got[q]} & set(best))
        assert len(got[q]) == 20 and all(abs(s - score[i]) < 1e-9 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda y: (-y[1], y[0]))
    assert hits >= 0.95 * 400 and set(got) == set(range(0, 400, 20))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.nearest(few, F.col("id") % 20 == 0, 20).collect()].__len__() == 2
    assert ann.nearest(few.limit(0), F.col("id") % 20 == 0, 20).count() == 0


def test_nearest_among_copies(spark):
    """The copies with the least ids come first, also for a query outside their group."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, x[0].tolist() if i < 300 else x[i - 299].tolist()) for i in range(350)]
    table = spark.createDataFrame([*rows, (1000, (2 * x[0]).tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, F.col("id").isin(0, 200, 1000), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1000, *range(1, 20)], 200: [1000, *range(19)], 1000: list(range(20))}


def test_chat(spark):
    tools = spark.createDataFrame([("t", "q", "string", True, 1, 3), ("t", "n", "integer", False, 0, 5)],
                                  "name string, field string, kind string, required boolean, least int, most int")
    rows = [
        (1, 0, "system", "be", None, None, None, None), (1, 3, "call", None, "b", "a", "t", '{"n": 9, "q": "abcd"}'),
        (1, 1, "call", None, "a", "none", "t", '{"q" : "x", "z": [1]}'), (1, 1, "call", None, "a", "none", "t", '{"q" : "x", "z": [1]}'),
        (1, 2, "tool", "r", "a", None, None, None), (1, 9, "tool", None, "lost", None, None, None),
        (1, 4, "call", None, "c", "d", "t", '{"n": "1"}'), (1, 5, "call", None, "d", "c", "no", "broken"),
        (None, 1, None, None, None, None, None, None), (2, 1, "call", None, "a", None, "t", None),
    ] + [(3, k, "call", None, f"k{k}", f"k{k - 1}", "t", '{"q":"x"}') for k in range(40)]
    kind = "conv_id long, turn long, role string, content string, call_id string, after string, name string, arguments string"
    messages = spark.createDataFrame(rows, kind).withColumn("rank", F.lit(5))
    got = {(r["conv_id"], r["role"], r["call_id"]): r for r in chat.format_messages(messages, tools).collect()}
    a, b, c, d = (got[1, "call", x] for x in "abcd")
    assert (a["rank"], a["status"], a["problems"]) == (0, "linked", "unknown:z")
    assert a["json"] == '{"arguments":{"q":"x","z":[1]},"call_id":"a","name":"t","role":"assistant"}'
    assert (b["rank"], b["status"], b["problems"]) == (2, "unanswered", "range:n,range:q")
    assert c["status"] == d["status"] == "cycle" and c["problems"] == "missing:q,type:n" and d["problems"] == "json,tool"
    assert (got[1, "tool", "a"]["rank"], got[1, "tool", "lost"]["status"]) == (1, "orphan")
    assert got[2, "call", "a"]["problems"] == "json,missing:q" and got[None, None, None]["json"] == "{}"
    assert [got[3, "call", f"k{k}"]["rank"] for k in range(40)] == [2 * k for k in range(40)]
    assert chat.format_messages(messages.limit(0), tools).count() == 0


def test_chat_keeps_different_calls_of_one_id(spark, tmp_path):
    """A row for every message; the rows of calls are those of the SQL, which repeats them."""
    import duckdb

    rows = [(1, 0, "user", "abc"), (1, 0, "user", "abcd"), (1, 1, "assistant", "yes"), (1, 2, "user", "next"),
            (1, 2, "user", "next"), (1, 3, "system", "s"), (2, 0, "user", "alone"), (2, 0, "user", "twos")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in QUERIES["op1_chat"](spark, str(tmp_path)).select(
        "conv_id", "turn", "role", "call_id", "rank", "status", "problems", "json").collect()]
    assert len(got) == len(set(rows)) == len(set(got))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = set(base.execute(ORACLES["op1_chat"]).fetchall())
    assert {r for r in got if r[2] != "tool"} == {r for r in want if r[2] != "tool"} and set(got) <= want


def test_chat_keeps_calls_without_an_id(spark):
    tools = spark.createDataFrame([("t", "q", "string", True, 1, 3)],
                                  "name string, field string, kind string, required boolean, least int, most int")
    rows = [(1, 0, "call", None, None, None, "t", '{"q":"long"}'), (None, 0, "call", None, "a", None, "t", '{"q":"x"}')]
    kind = "conv_id long, turn long, role string, content string, call_id string, after string, name string, arguments string"
    got = {r["conv_id"]: r for r in chat.format_messages(spark.createDataFrame(rows, kind), tools).collect()}
    assert (got[1]["status"], got[1]["problems"]) == ("unanswered", "range:q")
    assert got[1]["json"] == '{"arguments":{"q":"long"},"name":"t","role":"assistant"}'
    assert got[None]["json"] == '{"arguments":{"q":"x"},"call_id":"a","name":"t","role":"assistant"}'


def test_pipeline_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < docs.count() <= before.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    last = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in docs.collect():
        assert r["ids"] == model.encode(last[r["doc_id"]])


def test_intermediate_tables_go_with_their_last_reader(spark):
    """One table is left of the near-duplicate step and one of the repeated passages: those the results read."""
    from pathlib import Path

    from handtrace.llm import substring_dup
    from handtrace.llm.common import SHUFFLE_CLEANUP
    from handtrace.session import shared_dir
    folder = Path(shared_dir(spark).removeprefix("file://"))
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), " ".join(words[:79]), " ".join(words[::-1]), "short one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for step in (near_dup.duplicate_classes, substring_dup.remove_passages):
        before = {p.name for p in folder.iterdir()}
        assert step(docs).count() == 4
        assert len({p.name for p in folder.iterdir()} - before) == 1
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"

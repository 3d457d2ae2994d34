"""Each operator against a brute-force version, and its defined results for nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tesserae.llm import ann, bitpack, brown, chat, chunks, common, decontaminate, langid, neardup, packing, queries, simhash, token_count, urlfilter

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [None, "", " ", "  \n\t ", "a", "The cat, the cat; the cat's hat.  Two  spaces \n and\r\n lines ", "<|endoftext|> x<|endoftext|>", "école ÉCOLE \u00a0 x\x85y \x1c z", "中文 字", "\U0001f600 🙂", "́ e\u0301", "x" * 5000, "word " * 3000, "12 345 6,7"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, repeats, null ids, and columns whose names the operators use themselves."""
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "  \n\t "), (100, ODD[5]), (101, ODD[5] + " more"), (None, "no id"), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 8, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n long, part long, length long, word string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def ids_of(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_chunks_are_compacted_in_little_memory():
    """Hashing and compacting a worker's chunks takes little more than the chunks themselves, and changes neither numbers nor ids."""
    import tracemalloc

    r = random.Random(7)
    names = pa.array(sorted({f" {r.getrandbits(100):x}" for _ in range(200_000)}))
    coder = chunks.ChunkEncoder(BYTES)
    coder.keys.of(names)
    coder.sizes, coder.hits = np.ones(len(names), np.int64), np.ones(len(names), np.int64)
    coder.starts, coder.pool = np.arange(len(names)), np.arange(len(names), dtype=np.uint32)
    coder.hits[::2] = 2
    tracemalloc.start()
    coder.compact()
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 8 * names.nbytes
    assert len(coder.keys) == len(names) and (coder.keys.find(names) == np.arange(len(names))).all() and (coder.pool == np.arange(len(names))).all()
    assert (chunks.hashes(names) == np.concatenate([chunks.hashes(names[:70_001]), chunks.hashes(names[70_001:])])).all()


SIGNS = ["a", "b", "\0", "é", "ß", " ", "  ", "\n", " \n", "\t", "1", "23", ",", ".'s", "'ll", "<|endoftext|>", "<|", "\x1c", "\x85", "\xa0", "\u2003", "İ", "\u0301", "中", "😀", "ﬁ", "Σ", " ς"]


def odd_texts(n):
    r = random.Random(3)
    return [t or "" for t in ODD] + ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("budget", "step"), [(1 << 26, 1 << 23), (20_000, 3000)])
def test_chunk_encoder_is_exact(monkeypatch, budget, step):
    """Also where little is kept and texts come in small slices."""
    monkeypatch.setattr(chunks, "BUDGET", budget)
    texts = odd_texts(3000)
    for path in (BYTES, WORDS):
        coder, got = chunks.ChunkEncoder(path), []
        for part in chunks.slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), 0, step):
            got += coder.encode(part.column(0).to_pylist())
            assert coder.keys.nbytes < 200_000 or budget > 20_000
        assert got == ids_of(path, texts)


def test_pre_tokens_are_the_librarys():
    own = Tokenizer.from_file(BYTES)
    cutter, texts = chunks.PreTokens(BYTES), [t for t in odd_texts(2000) if "<|endoftext|>" not in t]
    codes, ends = cutter.run(pa.array(texts))
    words = cutter.words.to_pylist()
    assert [[words[k] for k in codes[a:b]] for a, b in zip(ends, ends[1:])] == [[t[a:b] for _, (a, b) in own.pre_tokenizer.pre_tokenize_str(t)] for t in texts]


@pytest.mark.parametrize("hot", [3, 50])
def test_token_counts(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(token_count, "HOT", hot)  # most pre-tokens take the shuffled join
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*odd_texts(300), "a \0b", "b", "\0b", "\0\0", "x\0 \0y", "a 1", "a 68719476737"])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    own = pairs(both)
    want = [(i, len(t.encode()), len(x), len(x) > 1024) for (i, t), x in zip(own, ids_of(BYTES, [t for _, t in own]))]
    same([tuple(r) for r in token_count.token_counts(both, BYTES).collect()], want)
    same([tuple(r) for r in token_count.token_counts(docs, WORDS).collect()], [(i, len(t.encode()), len(x), len(x) > 1024) for (i, t), x in zip(pairs(docs), ids_of(WORDS, [t for _, t in pairs(docs)]))])
    assert token_count.token_counts(empty, BYTES).count() == 0


@pytest.mark.parametrize("k", [1, 5, 40, 1000])
def test_most_frequent(spark, k):
    rows = [(f"w{i:03d}", 1 + 3000 // (i + 1) ** 2) for i in range(200)]
    found = common.most_frequent(spark.createDataFrame(rows, "word string, n long"), k, "n", "word").collect()
    assert [tuple(r) for r in found] == sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
    assert common.most_frequent(spark.createDataFrame([], "word string, n long"), k, "n", "word").count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 24, 32])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        x = rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
        data = bitpack.pack(x, bits)
        assert len(data) == math.ceil(n * bits / 8) and (bitpack.unpack(data, bits, n) == x).all()


def test_shards_random_access(tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 49408, n).astype("<u4") for n in (0, 5, 20_000, 1, 9000)]
    w = bitpack.ShardWriter(f"file://{tmp_path}/a.bits", 16)
    w.add([1, None], np.concatenate(docs[:2]), np.cumsum([len(x) for x in docs[:2]]))
    w.add([3, 4, 5], np.concatenate(docs[2:]), np.cumsum([len(x) for x in docs[2:]]))
    w.close()
    r, whole = bitpack.ShardReader(f"file://{tmp_path}/a.bits"), np.concatenate(docs)
    assert r.n_tokens == len(whole) and r.nulls.tolist() == [False, True, False, False, False]
    for a, b in ((0, 0), (0, 10), (8191, 8193), (100, 25_000), (28_000, len(whole))):
        assert (r.ids(a, b) == whole[a:b]).all()


def test_bitpack(docs, empty):
    own = sorted(pairs(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, start = [], 0
    for (i, _), x in zip(own, ids_of(WORDS, [t for _, t in own])):
        data = np.array([*x, 2], "<u4").tobytes()
        want.append((i, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    same([tuple(r) for r in bitpack.round_trip(docs, WORDS, 2).collect()], want)
    assert bitpack.round_trip(empty, WORDS, 2).count() == 0


def brute_best_fit(lengths, size):
    room, sequences = [], 0
    for x in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= x
        else:
            room.append(size - x)
            sequences += 1
    return sequences, sorted(room)


def test_plan_is_best_fit_decreasing():
    r = random.Random(9)
    for size in (10, 64, 300):
        for _ in range(30):
            lengths = [r.randint(1, size) for _ in range(r.randint(0, 200))]
            slots = packing.plan(collections.Counter(lengths), size)
            used = collections.defaultdict(list)
            for length, rank, n, first, each, offset in slots:
                for k in range(n):
                    used[first + k // each].append((offset + k % each * length, length))
            for places in used.values():
                at = 0
                for offset, length in sorted(places):
                    assert offset == at
                    at += length
                assert at <= size
            assert sorted(x for p in used.values() for _, x in p) == sorted(lengths)
            assert (len(used), sorted(size - sum(x for _, x in p) for p in used.values())) == brute_best_fit(lengths, size)


def test_packing(docs, empty):
    got = packing.pack_documents(docs, BYTES, 2048, 0).toPandas()
    own = pairs(docs)
    by = collections.defaultdict(list)
    for (i, _), x in zip(own, ids_of(BYTES, [t for _, t in own])):
        by[i].append(np.array([*x, 0], "<u4"))
    assert got.length.sum() == sum(len(x) for xs in by.values() for x in xs)
    for r in got.itertuples():
        i = None if pd.isna(r.doc_id) else int(r.doc_id)
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in by[i])
        n = {len(x) for x in by[i]}
        assert r.length == 2048 or r.piece == 0
        assert max(n) > 2048 or r.piece == 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() <= 2048
    assert got.sequence_id.nunique() == brute_best_fit(got.length.tolist(), 2048)[0]
    assert packing.pack_documents(empty, BYTES).count() == 0


def words10(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items, window):
    windows = collections.defaultdict(list)
    for k, (i, t) in enumerate(items):
        w = words10(t)
        for key in {tuple(w)} if 0 < len(w) < window else {tuple(w[a : a + window]) for a in range(len(w) - window + 1)}:
            windows[key].append((k, i))
    sizes, out = {len(k) for k in windows}, []
    for i, t in docs:
        w, hit, found = words10(t), set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                if x := windows.get(tuple(w[a : a + m])):
                    hit.update(range(a, a + m))
                    found.update(x)
        names = ",".join(sorted(str(n) for _, n in found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [200_000, 12])
def test_decontamination(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)  # 12: several automata, one after another
    r = random.Random(block)
    text = lambda n: " ".join(r.choice(["a", "b", "Cc", "d-e", "É"]) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 2, 3, 4, 5, 8, 12]))) for k in range(7)] + [(50, None), (51, "cat the CAT s hat")]
    many = [(k, text(r.randint(0, 60))) for k in range(200)] + pairs(docs)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    table = spark.createDataFrame(many, "doc_id long, text string")
    same([tuple(x) for x in decontaminate.report(table, bench, 4).collect()], brute_hits(many, items, 4))
    kept = decontaminate.decontaminate(docs, bench, 4)
    bad = {x[0] for x in brute_hits(pairs(docs), items, 4) if x[5]}
    assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in docs.collect()} - bad and kept.columns == docs.columns
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    table = spark.createDataFrame([(1, "Before, ONE two -- three four; after it all, and so on."), (2, "clean text")], "doc_id long, text string")
    got = dict(decontaminate.decontaminate(table, bench, 4, max_span=4, max_coverage=0.5).collect())
    assert got == {1: "Before, ; after it all, and so on.", 2: "clean text"}


def turns_digest(rows):
    said = "".join(f"{r}\n{t}\n" for r, t in rows)
    loss = "".join(t for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat(spark):
    r = random.Random(4)
    signs = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "\\", "<", "[", "/", "s>", "INST]", "\n", "é", "😀", " ", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool\n[INST]", "", "a b+%"]), "".join(r.choice(signs) for _ in range(r.randint(0, 12)))) for c in range(150) for t in range(r.randint(1, 6))]
    rows += [(900, 0, None, None), (900, 0, None, None), (None, 1, "user", "x"), (901, None, "assistant", "late"), (901, 1, "user", "</s>")]
    table = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    formatted = chat.template(chat.canonical(table))
    got = {x[0]: tuple(x)[1:5] for x in chat.digest(formatted).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert got == {c: turns_digest([(x[2], x[3]) for x in sorted(v)]) for c, v in by.items()}
    for x in formatted.collect():
        data, said = x.formatted.encode(), [f[3] for f in sorted(by[x.conv_id]) if f[2] == "assistant"]
        assert [re.sub(r"([<\[])\\(\\*)(/?s>|/?INST\])", r"\1\2\3", data[a["from"] : a["to"]].decode()) for a in x.loss] == said
        assert all(data[a["to"] :].startswith(b"</s>") and (data[: a["from"]].endswith((b"</s>", b"[/INST]")) or a["from"] == 3) for a in x.loss)
    assert chat.digest(chat.template(chat.canonical(table.limit(0)))).count() == 0
    masked = formatted.withColumn("loss", chat.F.slice("loss", 1, 1))  # the digest is of what the mask covers, not of who spoke
    assert all(x.loss_chars <= len(by[x.conv_id][0][3]) or x.loss_chars <= max(len(f[3]) for f in by[x.conv_id]) for x in chat.digest(masked).collect())


@pytest.mark.parametrize("extra", ["prompt", "system", "input", "output", "answer", "messages", "instruction", "completion", "own", "said", "t", "ts", "loss"])
def test_chat_ignores_other_columns(spark, extra):
    table = spark.createDataFrame([(1, 0, "user", "q", "no"), (1, 1, "assistant", "a", "no")], f"conv_id long, turn long, role string, text string, {extra} string")
    assert [tuple(x)[1:5] for x in chat.digest(chat.template(chat.canonical(table))).collect()] == [turns_digest([("user", "q"), ("assistant", "a")])]


def test_chat_layouts(spark):
    rows = [(1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}'), (2, '{"instruction":"do","input":"it","output":"done"}'), (3, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"id":"7"}'),
            (4, '{"prompt":"p","completion":"c","meta":{"role":1}}'), (5, "broken"), (6, None), (7, '{"other":1}'), (8, '{"question":"q","answer":null}'), (9, '{"messages":[{"from":"user","value":"hi"}]}'), (10, '{"messages":[{"role":"user","content":"x","name":"n"},{"role":"tool"}]}'),
            (11, '{"messages":[]}'), (12, '{"messages":"text","prompt":"p","response":"r","system":"s"}'), (13, "[1]"), (14, "")]
    got = collections.defaultdict(list)
    for x in chat.from_json_lines(spark.createDataFrame(rows, "conv_id long, value string")).orderBy("conv_id", "turn").collect():
        got[x.conv_id].append((x.layout, x.role, x.text))
    none = [(None, None, None)]
    assert got == {
        1: [("messages", "user", "hi"), ("messages", "assistant", "yo")], 2: [("instruction_input", "user", "do\nit"), ("instruction_input", "assistant", "done")], 3: [("conversations", "user", "q"), ("conversations", "assistant", "a")],
        4: [("prompt_completion", "user", "p"), ("prompt_completion", "assistant", "c")], 5: none, 6: none, 7: none, 8: [("question_answer", "user", "q")], 9: none,
        10: [("messages", "user", "x"), ("messages", "tool", None)], 11: none, 12: [("system_prompt_response", r, r[0] if r != "user" else "p") for r in ("system", "user")] + [("system_prompt_response", "assistant", "r")], 13: none, 14: none,
    }
    table = spark.sql("select 1L as conv_id, array(struct('user' as role, 'hi' as content)) as messages, 5 as other")
    assert [tuple(x) for x in chat.canonical(table).collect()] == [(1, 0, "user", "hi")]
    with pytest.raises(ValueError):
        chat.canonical(spark.sql("select 1L as conv_id, 'x' as output"))


@pytest.mark.parametrize(("sample", "split"), [(40_000, 16_384), (250, 100)])  # the small sample is thinned by hash first, and its lists are split
def test_ann(spark, monkeypatch, sample, split):
    monkeypatch.setattr(ann, "SAMPLE", sample)
    monkeypatch.setattr(ann, "SPLIT", split)
    monkeypatch.setattr(ann, "LEAF", 40)
    monkeypatch.setattr(ann, "BLOCK", 50)  # lists are cut into several blocks
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)).astype("float32")
    x[300:600] = x[0]  # a third of all are one vector
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)] + [(2000, None, "x", 1), (2001, [0.0] * 8, "x", 1), (2002, [float("nan")] * 8, "x", 1), (2003, [None, *[1.0] * 7], "x", 1), (2004, [float("inf")] * 8, "x", 1), (None, [1.0] * 8, "x", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string, score int")
    got = ann.search(table, table.where("vec_id % 20 = 0"), 5).toPandas()
    own = x.astype(float)
    unit = own / np.linalg.norm(own, axis=1, keepdims=True)
    hit = n = 0
    for q in range(0, 900, 20):
        s = np.round(unit @ unit[q], 12)
        want = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:5]
        g = got[got.query_id == q].sort_values("rank")
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(g.score, (unit @ unit[q])[g.vec_id])
        hit += len(set(want) & set(g.vec_id))
        n += 5
    assert hit / n >= 0.9 and set(got.query_id) == set(range(0, 900, 20))
    assert got[got.query_id == 300].sort_values("rank").vec_id.tolist() == [0, 301, 302, 303, 304]
    with pytest.raises(ValueError, match="lengths"):
        ann.search(table.unionByName(spark.sql("select 9999L as vec_id, array(cast(1 as float)) as embedding, 'x' as list, 1 as score")), table.limit(5), 5)
    few = ann.search(table.where("vec_id < 3"), table.where("vec_id = 0"), 5)
    assert few.count() == 2 and ann.search(table.limit(0), table.limit(0)).count() == 0


def test_ann_lists_stay_short(spark, monkeypatch):
    """Ten times the vectors of a first level's lists, some far from all others: lists are split, none is lost, every query finds k, recall holds."""
    monkeypatch.setattr(ann, "SAMPLE", 300)
    monkeypatch.setattr(ann, "SPLIT", 400)
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.4 * rng.normal(size=(1000, 16)) for c in rng.normal(size=(6, 16))] + [10 * rng.normal(size=(40, 16))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = {}
    monkeypatch.setattr(ann, "_split_lists", lambda *a, f=ann._split_lists: seen.setdefault("out", f(*a)))
    got = ann.search(table, table.where("vec_id % 30 = 0"), 5).toPandas()
    filed = seen["out"][0].toPandas()
    assert filed.groupby("list").size().max() <= 500 and set(filed.ids.explode()) == set(range(len(x)))
    unit, hit, n = x / np.linalg.norm(x, axis=1, keepdims=True), 0, 0
    for q, g in got.groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -9
        hit, n = hit + len(set(np.argsort(-s)[:5]) & set(g.vec_id)), n + 5
        assert len(g) == 5
    assert got.query_id.nunique() == -(-len(x) // 30) and hit / n >= 0.9


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def brute_fingerprint(text):
    w = text.encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    own = pairs(docs)
    prints = [brute_fingerprint(t) for _, t in own]
    roots = brute_components(prints)
    least = {r: min((i for (i, _), x in zip(own, roots) if x == r and i is not None), default=None) for r in roots}
    same([tuple(r) for r in simhash.near_duplicates(docs).collect()], [(i, f"{f:016x}", least[r]) for (i, _), f, r in zip(own, prints, roots)])
    kept = simhash.deduplicate(docs)
    stay = {r: min((i is None, i or 0) for (i, _), x in zip(own, roots) if x == r) for r in roots}
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(stay.values())
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("operator", [simhash, neardup])
def test_one_row_of_each_component_stays(spark, operator):
    """Repeated ids with unrelated texts, exact repeats, null ids beside others and alone, and columns named like the operator's own."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a b c d"), (1, "x y z w q"), (7, "q w e r t y"), (7, "q w e r t y"), (None, long), (5, long), (None, "l o n e l y"), (None, "l o n e l y"), (None, "other words are here"), (9, None), (8, ""), (None, None)]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _text_hash0 long, _id0 string")
    got = sorted(((r.doc_id, r.text) for r in operator.deduplicate(table).collect()), key=repr)
    assert got == sorted([(1, "a b c d"), (1, "x y z w q"), (7, "q w e r t y"), (5, long), (None, "l o n e l y"), (None, "other words are here"), (8, "")], key=repr)
    assert operator.deduplicate(table).columns == table.columns and operator.deduplicate(table.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_lose_nothing(spark, monkeypatch, bucket):
    """Clusters of near fingerprints; with a bucket of 2, nearly all are linked by their neighbourhoods."""
    from tesserae.llm.components import components

    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(bucket)
    prints = set()
    for _ in range(25):
        c = r.getrandbits(64)
        for _ in range(20):
            prints.add(c)
            for _ in range(r.randint(1, 3)):
                c ^= 1 << r.randrange(64)
    prints = sorted(p - (1 << 64) * (p >> 63) for p in prints)
    found = dict(components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect())
    groups, want = collections.defaultdict(set), collections.defaultdict(set)
    for p, x in zip(prints, brute_components(prints)):
        groups[found.get(p, p)].add(p)
        want[x].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def brute_shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


@pytest.mark.parametrize("bucket", [32, 4])
def test_planted_near_copies(spark, monkeypatch, bucket):
    """The stage links exactly what a similarity of 0.8 on five words links; with a bucket of 4, mostly by centres and blocks."""
    import corpus_pipeline

    monkeypatch.setattr(neardup, "BUCKET", bucket)
    monkeypatch.setattr(neardup, "CENTRES", 1 if bucket == 4 else neardup.CENTRES)
    r = random.Random(bucket)
    own = []
    for _ in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(120)]
        for k in range(12):
            words = list(base)
            for _ in range(k % 5):
                words[r.randrange(120)] = f"x{r.randrange(5000)}"
            own.append(" ".join(words))
    r.shuffle(own)
    sets, root = [brute_shingles(t) for t in own], list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    least = {x: root.index(x) for x in root}
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(own)], SCHEMA)
    same([tuple(x) for x in neardup.near_duplicates(table).collect()], [(i, least[x]) for i, x in enumerate(root)])
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, table, DIR).collect()) == sorted(least.values())
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_near_dedup_asks_simhash_first(spark):
    """Without any min-hash key the stage links exactly the texts whose fingerprints the ring finds and whose shingles are similar."""
    r = random.Random(5)
    own = []
    for _ in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(600)]
        own += [" ".join(words), " ".join([*words[:300], "other", *words[301:]])]
    own += ["one two three", "four five six"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(own))), pa.array(own), pa.array(range(len(own)))], ["doc_id", "text", "text_hash"])
    kinds = [(x["fp"], x["text_hash"], x["size"], [], x["sig"], x["print"]) for b in neardup._sketches([batch]) for x in b.to_pylist()]
    sets = [{xxhash.xxh64_intdigest(b" ".join(g), 42) for g in brute_shingles(t)} for t in own]
    prints = [sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in x) > len(x)) for x in sets]
    assert [x[5] % (1 << 64) for x in kinds] == prints
    want = {frozenset((kinds[i][0], kinds[j][0])) for i in range(len(own)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    table = spark.createDataFrame(kinds, "fp long, text_hash long, size long, keys array<long>, sig binary, print long")
    got = {frozenset(x) for x in neardup.links(table, spark.createDataFrame(list(enumerate(own)), "text_hash long, text string")).collect()}
    assert got == want and len(want) > 5


def test_simhash_decides_which_pairs_are_verified(spark):
    """Wide fingerprints against plain Python; no similar pair of any size is beyond their distance, unrelated ones of one size all are."""
    r = random.Random(7)
    for n in (0, 1, 2, 255, 256, 700):
        hashes = np.array(sorted(r.getrandbits(64) for _ in range(n)), "<u8")
        words = [[h] for h in map(int, hashes)]
        for row in words:
            for salt in map(int, neardup._SALTS):
                x = (row[0] ^ salt) * 0x9E3779B97F4A7C15 % (1 << 64)
                x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % (1 << 64)
                row.append(x ^ x >> 32)
        want = [sum(1 << k for k in range(64) if 2 * sum(row[w] >> k & 1 for row in words) > n) for w in range(neardup.PRINT)]
        assert neardup.fingerprint(hashes).tolist() == want and want[0] % (1 << 64) == simhash.majority(hashes) % (1 << 64)
    rows, like = [], []
    for k in range(600):
        both = [r.getrandbits(64) for _ in range(4 + k % 200)]
        own = [np.unique(np.array(both + [r.getrandbits(64) for _ in range(m)], "<u8")) for m in (len(both) // 8, len(both) // 4 - len(both) // 8)]
        other = np.unique(np.array([r.getrandbits(64) for _ in own[0]], "<u8"))
        for y in (own[1], other):
            rows.append((k, len(like), len(own[0]), len(y), neardup.fingerprint(own[0]).tobytes(), neardup.fingerprint(y).tobytes()))
            like.append(neardup.similar(own[0], y))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["a", "b", "size_a", "size_b", "sig_a", "sig_b"])
    found = {x["b"] for x in next(neardup._looks([batch])).to_pylist()}
    assert sum(like) == 600 and found == {k for k, x in enumerate(like) if x or rows[k][2] < neardup.TINY}


def test_similar_texts_whose_minima_differ_by_chance(spark):
    """Pairs at a similarity of just 0.8 that agree in a band but in under 0.66 of their minima."""
    own = []
    for seed in (3034, 3489, 5081, 7059):
        r = random.Random(seed)
        words = [f"w{r.randrange(10**6)}" for _ in range(94)]
        own += [" ".join(words), " ".join([*words[:30], f"x{seed}", *words[31:60], f"y{seed}", *words[61:]])]
    sets = [neardup.shingles(x) for x in own]
    assert all(neardup.similar(x, y) and (neardup.minima(x) == neardup.minima(y)).mean() < 0.66 for x, y in zip(sets[::2], sets[1::2]))
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(own)], SCHEMA)
    same([tuple(x) for x in neardup.near_duplicates(table).collect()], [(i, i // 2 * 2) for i in range(len(own))])


def test_blocks_give_no_more_pairs_than_join_them():
    """A group of near copies of which many are similar: pairs that join what similar pairs join, fewer than classes, and none that is false."""
    r = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    own = [[f"x{r.randrange(9000)}" if r.random() < 0.012 else w for w in base] for _ in range(60)]
    sets = [neardup.shingles(" ".join(x)) for x in own]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if neardup.similar(sets[i], sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    sig = [neardup.minima(x).astype(np.uint8).tobytes() for x in sets]
    table = pa.table({"left": [True] * 60, "fp": range(60), "root": range(60), "sig": sig, "hashes": [x.tobytes() for x in sets]})
    got = neardup._across(table).to_pylist()
    assert (neardup._common(sets[:9], sets[9:]) == [[len(np.intersect1d(x, y)) for y in sets[9:]] for x in sets[:9]]).all()
    assert all(neardup.similar(sets[x["a"]], sets[x["b"]]) for x in got) and len(got) == 60 - len(set(root)) > 0


def test_components_of_a_chain_and_a_star(spark):
    from tesserae.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


@pytest.mark.parametrize("whole", [0, 1 << 19])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, whole):
    """The same from both; edges that one task takes don't cost the driver round after round of jobs."""
    from tesserae.llm import components as own

    monkeypatch.setattr(own, "WHOLE", whole, raising=False)
    rng = random.Random(5)
    ids = [-(1 << 63), (1 << 63) - 1, *(rng.getrandbits(63) - (1 << 62) for _ in range(600))]
    edges = [tuple(rng.sample(ids, 2)) for _ in range(280)] + [(ids[0], x) for x in ids[2:40]] + [(i, i + 1) for i in range(-30, 30)] + [(7, 7), (ids[1], ids[1])]
    edges += [(y, x) for x, y in edges[:50]]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for x, y in edges:
        if x != y and root[x] != root[y]:
            least, other = sorted((root[x], root[y]))
            root = {k: least if v == other else v for k, v in root.items()}
    table = spark.createDataFrame(edges, "a long, b long")
    spark.sparkContext.setJobGroup(group := f"components-{whole}", "")
    try:
        got = own.components(table).collect()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(got) == len(root) and {r.node: r.root for r in got} == root
    assert own.components(table.limit(0)).count() == own.components(table.where("a = b")).count() == 0
    assert not whole or len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 8


def test_language_id(spark, docs, empty):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.fit(table.where(~langid.held_out(table)))
    got = langid.identify(table, model, keep=["lang"]).where(langid.held_out(table)).toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.95 and got.score.between(0, 1).all()
    odd = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert odd[0] == odd[1] == odd[3] == odd[13] == "und" and odd[5] == "en" and odd[12] != "und"
    assert langid.identify(docs, model).count() == docs.count() and langid.identify(empty, model).count() == 0
    none = langid.fit(empty)
    assert none is None and {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    one = langid.fit(docs)
    assert {r.lang_pred for r in langid.identify(docs, one).collect()} == {"en", "und"}
    kept = langid.keep_known(docs, model, 0.0)
    assert kept.columns == docs.columns and {0, 1, 3, 13}.isdisjoint({r.doc_id for r in kept.collect()})


@pytest.mark.parametrize("codes", [langid.FAMILIES["slavic"].split(), [f"x{c}" for c in "abcdefghijkl"]])
def test_clear_texts_of_a_dozen_languages_are_kept(spark, codes):
    """Languages of one family, and of a family each: the score of a clear text doesn't shrink with their number."""
    import corpus_pipeline

    r = random.Random(4)
    words = {c: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)] for c in codes}
    own = [(i, " ".join(r.choices(words[c], k=40)), c, "s", 1) for i, c in enumerate(codes * 30)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(own, SCHEMA), DIR)
    assert len(codes) == 12 and kept.count() == len(own)


URLS = ["http://A.Example.COM/en/7x?a#b", "https://example.net/de/81", "http://x.net/de/1", "http://xnet/de/1", "ftp://net/de/?q", "http://a.org/es/", "http://a.org/es", None, "", "no scheme", "http://", "http://h#f", "x://y://z/en/", "a:b://c/x", "http://b.a.com:8/en/?x=1&y"]


def brute_split(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :])[0]


def brute_rule(host, path, rules):
    fits = [(len(h + p), h + p, k, kind) for k, (kind, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[1], max(fits)[3]) if fits else (None, None)


@pytest.fixture(scope="module")
def trees(spark):
    """Fitted like the query's, but for the hosts held out."""
    labelled = urlfilter.weak_labels(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), queries.TERMS)
    host = urlfilter.host_and_path(common.F.col("url"))[0]
    held = common.id_crc(host, 3) == 1
    return urlfilter.fit(labelled.where(~held)), labelled.where(held).toPandas()


@pytest.mark.parametrize("most", [1000, 2])  # with 2, rules are looked up by host
def test_url_filter(spark, trees, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "RULES", most)
    rules = [*queries.RULES, ("allow", "org", "/es/"), ("block", "b.a.com:8", ""), ("block", "c", "/x"), ("allow", "c", "/x")]
    table = spark.createDataFrame([(k, u, "<p>", "r", "h", 1) for k, u in enumerate([*URLS, URLS[0]])] + [(None, URLS[0], "", "", "", 1)], "page_id long, url string, html string, rule string, host string, row int")
    own = trees[0]
    chance = dict(zip(URLS, own.chance(own.matrix(URLS))))
    want = []
    for k, u in [*enumerate([*URLS, URLS[0]]), (None, URLS[0])]:
        host, path = brute_split(u)
        rule, verdict = brute_rule(host, path, rules)
        want.append((k, host, path, rule, verdict or ("block" if chance[u] >= 0.5 else "allow"), round(chance[u], 9)))
    same([(*x[:5], round(x[5], 9)) for x in urlfilter.judge(table, rules, own).collect()], want)
    assert urlfilter.judge(table.limit(0), rules, own).count() == 0


def test_url_trees_against_plain_ones(trees):
    """Every tree walked node by node, and the first split against a search through all features and cuts."""
    own, held = trees
    x = own.matrix(held.url.tolist()[:300])
    for row, got in zip(x, own.chance(x)):
        score = own.base
        for tree in own.trees:
            f, cut, a, b, value = tree[0]
            while f >= 0:
                f, cut, a, b, value = tree[a if row[f] <= cut else b]
            score += value
        assert abs(1 / (1 + math.exp(-score)) - got) < 1e-12
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 9, (200, 4)).astype(float), None
    y = ((x[:, 2] > 4) ^ (rng.random(200) < 0.2)).astype(float)
    small = urlfilter.Trees(rounds=1, depth=1).fit(x, y)
    g, h = y - y.mean(), np.full(200, y.mean() * (1 - y.mean()))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    best = max((gain(x[:, f] <= c), f) for f in range(4) for c in np.unique(x[:, f])[:-1])
    f, cut = small.trees[0][0][:2]
    assert f == best[1] == 2 and abs(gain(x[:, f] <= cut) - best[0]) < 1e-9


def test_url_trees_on_hosts_held_out(spark, trees):
    own, held = trees
    x, y = own.matrix(held.url.tolist()), held.label.to_numpy()
    assert y.sum() > 20 and ((own.chance(x) >= 0.5) == y).mean() >= 0.98
    lost = {}
    for group, columns in urlfilter.GROUPS.items():
        mixed = x.copy()
        mixed[:, columns] = x[np.random.default_rng(1).permutation(len(x))][:, columns]
        lost[group] = np.abs(own.chance(mixed) - own.chance(x)).mean()
    assert max(lost.values()) > 1e-3 and sorted(sum(urlfilter.GROUPS.values(), [])) == list(range(x.shape[1]))  # on these hosts hyphens nearly decide alone
    labelled = spark.createDataFrame([(u, 1) for u in URLS], "url string, label int")
    assert (urlfilter.fit(labelled).chance(x) < 0.5).all()


def test_brown(spark, docs, empty):
    table = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    both = table.unionByName(docs.select("doc_id", "text"))
    got = brown.score(both).toPandas()
    own = pairs(both)
    tokens = [(i, [*t.encode().lower().split(), b""], i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t in own]
    c = collections.Counter(w for _, ws, held in tokens if not held for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held, len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for i, ws, held in tokens)
    assert sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got.itertuples()) == want
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score < 0).all()
    assert brown.score(empty).count() == 0


def test_brown_is_a_distribution_and_scores_by_it(spark, docs):
    """Every score against plain Python, given the classes; what follows any class sums to one, unseen words included."""
    both = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    own = common.texts(both).withColumn("held_out", common.id_crc("doc_id", 5) == 1)
    model, _ = brown.fit(own)
    words = {r.word: (r.n, r["class"]) for r in model.words.collect()}
    assert sum(n for n, c in words.values() if c >= brown.CLASSES) < 0.03 * model.total  # contexts give the classes but where all neighbours are rare, too
    class_of = lambda w: words[w][1] if w in words else brown.CLASSES + brown.ending(w)
    texts = [(r.doc_id, [*(w.decode() for w in r.text.encode().lower().split()), ""], r.held_out) for r in own.collect()]
    moves = np.zeros((brown.ALL, brown.ALL))
    for _, ws, held in texts:
        for v, w in zip(["", *ws], ws):
            moves[class_of(v), class_of(w)] += not held
    said, types = np.zeros(brown.ALL), np.zeros(brown.ALL)
    for n, c in words.values():
        said[c] += n
        types[c] += 1
    types[brown.CLASSES :] += 1
    share = (said + 0.5) * (types > 0)
    chance = (moves + brown.PRIOR * share / share.sum()) / (moves.sum(axis=1, keepdims=True) + brown.PRIOR)
    total = sum(n for n, _ in words.values())

    def p(v, w):
        n, c = words.get(w, (0, class_of(w)))[0], class_of(w)
        return brown.MIX * chance[v, c] * (n + 0.5) / (said[c] + 0.5 * types[c]) + (1 - brown.MIX) * (n + 0.5) / (total + 0.5 * (len(words) + brown.RARE))

    unseen = {brown.ending(f"~~{k:03d}"): f"~~{k:03d}" for k in range(1000)}
    assert len(unseen) == brown.RARE and not set(unseen.values()) & set(words)
    for v in range(0, brown.ALL, 9):
        assert abs(sum(p(v, w) for w in [*words, *unseen.values()]) - 1) < 1e-9
    want = sorted((-1 if i is None else i, round(sum(math.log10(p(class_of(v), w)) for v, w in zip(["", *ws], ws)), 5)) for i, ws, _ in texts)
    got = sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 5)) for r in brown.score(both).collect())
    assert all(i == j and abs(x - y) < 2e-5 for (i, x), (j, y) in zip(got, want)) and len(got) == len(want)


def test_brown_places_words_beyond_every_rank(spark):
    """Two halves whose words only follow their own, and 101,000 words more frequent than some that occur three times in one half: those score better beside it."""
    r = random.Random(2)
    halves = [[f"{h}{k}" for k in range(10)] for h in "ab"]
    teach = [r.choices(halves[k % 2], k=60) for k in range(240)]
    for k, text in enumerate(teach):
        text[30] = f"{'ab'[k % 2]}q{k // 2 % 40}zzz"
    others = [f"o{k}" for k in range(brown.KNOWN + 1000)] * 4
    r.shuffle(others)
    texts = [" ".join(t) for t in teach] + [" ".join(others[i : i + 1000]) for i in range(0, len(others), 1000)]
    held = [f"{a}1 {b}q{k}zzz {a}2" for k in range(40) for a, b in ("aa", "ab")]
    ids = [[i for i in range(9000) if (zlib.crc32(str(i).encode()) % 5 == 1) == h] for h in (False, True)]
    table = [*zip(ids[0], texts), *zip(ids[1], held)]
    got = {x.doc_id: x.score for x in brown.score(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    tail = [got[i] for i, _ in table[len(texts) :]]
    assert sum(x > y + 0.1 for x, y in zip(tail[::2], tail[1::2])) == 40


def test_exchange_finds_classes():
    """Two languages whose words only follow their own."""
    rng = np.random.default_rng(0)
    pairs_ = np.zeros((40, 40))
    for _ in range(6000):
        half = rng.integers(2) * 20
        pairs_[half + rng.integers(20), half + rng.integers(20)] += 1
    classes = brown.exchange(pairs_, 2)
    assert len({*classes[:20]}) == 1 and len({*classes[20:]}) == 1 and classes[0] != classes[39]


def test_lookup_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 3)
    rows = spark.createDataFrame([(i, 7 if i % 2 else i) for i in range(100)], "i long, k long")
    table = rows.groupBy("k").count().withColumn("v", common.F.col("k") * 10)
    assert sorted((r.i, r.v) for r in common.lookup(rows, table, "k", "count").collect()) == [(i, 70 if i % 2 else 10 * i) for i in range(100)]


def test_registered_queries_and_pipeline(spark):
    if not Path(DIR).exists():
        pytest.skip("no test data")
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DIR).toPandas()
    table = pd.read_parquet(f"{DIR}/documents.parquet")
    bench = pd.read_parquet(f"{DIR}/benchmark.parquet")
    own = [(int(i), t or "") for i, t in zip(table.doc_id, table.text) if any(map(str.isalpha, t or ""))]
    sets, roots = [brute_shingles(t) for _, t in own], list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if roots[i] != roots[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                roots = [roots[j] if x == roots[i] else x for x in roots]
    least = {r: min(i for (i, _), x in zip(own, roots) if x == r) for r in roots}
    own = [(i, t) for i, t in own if i in least.values()]
    own = [x for x, h in zip(own, brute_hits(own, list(zip(bench.item_id, bench.text)), 10)) if not h[5]]
    assert set(got.doc_id) == {i for i, _ in own}
    assert got.length.sum() == sum(len(x) + 1 for x in ids_of(BYTES, [t for _, t in own])) and got.sequence_id.nunique() == brute_best_fit(got.length.tolist(), 2048)[0]


def test_unsure_texts_are_rejected(spark, docs):
    """A bound keeps exactly the texts with letters whose score reaches it."""
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.fit(table)
    scores = langid.identify(table, model).toPandas()
    bound = float(np.median(scores.score))
    kept = {r.doc_id for r in langid.keep_known(table, model, bound).select("doc_id").collect()}
    assert kept == set(scores.doc_id[(scores.score >= bound) & (scores.lang_pred != "und")]) and 0 < len(kept) < len(scores)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for n in ("documents", "benchmark"):
        spark.read.parquet(f"{DIR}/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/{n}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns(spark, docs):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns

"""Each operator against a brute-force version, on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ferrule.llm import chat, decontaminate, language_id, line_dedup, neighbours, packing, queries, secret_scan, simhash, token_counts, token_files, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, fp string"
LONG = " ".join(f"word{k}" for k in range(3000))
TEXTS = [None, "", " \n\t", "!!! 123", "The quick brown fox", "The quick brown fox", "Ünï ﬁ 日本 😀 it's <|endoftext|>x", LONG, "secret=token: abcdefgh password='hunter22' " + "a1" * 20 + " AKIA" + "Z9" * 9]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, "s", 0, "x", "y") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id here", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def ids(docs):
    tok = Tokenizer.from_file(tokens.vocab_path())
    return [(r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_tokens_any_vocabulary():
    for name in (tokens.VOCAB, "byte_bpe_50k.json"):
        enc = tokens.Encoder(name)
        for n, at, out in enc.texts(pa.array(TEXTS), 9):
            for k in range(n):
                assert out[at[k] : at[k + 1]].tolist() == [*enc.tokenizer.encode(TEXTS[k] or "", add_special_tokens=False).ids, 9]


def test_packing(docs, ids, empty):
    got = packing.pack(docs).collect()
    want = Counter((d, p, p * 2048, len(c), crc(c)) for d, x in ids for x in [[*x, 0]] for p in range(-(-len(x) // 2048)) for c in [x[p * 2048 : (p + 1) * 2048]])
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_holds_all_in_no_more_bins_than_first_fit(seed):
    r = np.random.RandomState(seed)
    hist = {int(k): int(r.randint(1, 6)) for k in r.randint(1, 101, 25)}
    patterns = packing.plan(hist, 100)
    held = Counter()
    for bins, slots in patterns:
        assert bins > 0 and sum(n * q for n, q in slots) <= 100
        for n, q in slots:
            held[n] += bins * q
    assert held == Counter(hist)
    room: list[int] = []  # first-fit decreasing
    for k in sorted((k for k, n in hist.items() for _ in range(n)), reverse=True):
        at = next((x for x, r in enumerate(room) if r >= k), None)
        if at is None:
            room.append(100 - k)
        else:
            room[at] -= k
    assert sum(b for b, _ in patterns) <= len(room)


def test_token_files(spark, docs, ids, empty, tmp_path):
    manifest = token_files.write(docs, str(tmp_path))
    got = sorted(token_files.read(spark, str(tmp_path), manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in ids), key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(x) + 1, crc([*x, 1])) for d, x in ids)
    assert token_files.lookup(str(tmp_path), manifest.first()["name"], 7)[0].tolist() == [*dict(ids)[7], 1]
    assert token_files.round_trip(empty).count() == 0


def test_token_counts(docs, ids, empty):
    table = token_counts.totals(token_counts.histogram(docs))
    sizes = [len(x) for _, x in ids]
    for r in table.collect():
        n = r["n_tokens"]
        assert (r["n_docs"], r["docs_le"], r["docs_ge"]) == (sizes.count(n), sum(s <= n for s in sizes), sum(s >= n for s in sizes))
        assert (r["tokens_ge"], r["tokens_truncated"]) == (sum(s for s in sizes if s >= n), sum(min(s, n) for s in sizes))
    limits = {r["limit"]: r["tokens_truncated"] for r in token_counts.at_limits(table, [3, 100]).collect()}
    assert limits == {x: sum(min(s, x) for s in sizes) for x in (3, 100)}
    assert token_counts.totals(token_counts.histogram(empty)).count() == 0


def test_decontamination(spark, docs, empty):
    item = "Which river flows through the old city of stone? The answer is the slow green river named Aln."
    other = "What metal is liquid at room temperature on an ordinary day? It is mercury and nothing else at all."
    text = f"some words before {item.upper()} and after"
    rows = spark.createDataFrame([(100, text, None, None, 0, "", ""), (101, LONG + " " + other + " " + LONG, None, None, 0, "", ""), (102, item.split("?")[0], None, None, 0, "", "")], SCHEMA)
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "")], "item_id long, text string")
    every = docs.unionByName(rows)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(every, items).collect()} == {(100, 1), (101, 2)}
    left = decontaminate.clean(every, items)
    assert left.columns == every.columns and left.count() == every.count() - 2
    assert decontaminate.find(empty, items).count() == 0 and decontaminate.find(docs, items.limit(0)).count() == 0


def test_secret_scan(spark, docs, empty):
    got = {r["doc_id"]: r for r in secret_scan.scan_all(docs).collect()}
    assert (got[8]["n_assign"], got[8]["n_access"], got[8]["n_hex"]) == (1, 1, 1)
    assert got[8]["spans"].startswith("assign:23:41,hex:43:83,access:84:106")
    assert all(got[k]["spans"] == "" for k in (0, 1, 2, 4, 7, None)) and len(secret_scan.scan_all(docs).collect()) == docs.count()
    assert secret_scan.scan_all(empty).count() == 0


def test_neighbours(spark):
    r = np.random.RandomState(1)
    rows = [(k, r.randn(8).tolist(), "x") for k in range(300)]
    rows[7] = (7, rows[50][1], "x")
    bad = [(400, None, "x"), (450, [0.0] * 8, "x"), (500, [float("nan")] * 8, "x"), (550, [1.0] * 3, "x"), (None, [1.0] * 8, "x")]
    t = spark.createDataFrame([*rows, *bad, rows[9]], "vec_id long, embedding array<double>, rank string")
    got = neighbours.search_table(t, share=1.0).collect()
    x = np.array([v for _, v, _ in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        s = u @ u[q]
        s[q] = -9
        own = sorted((g["rank"], g["vec_id"]) for g in got if g["query_id"] == q)
        assert [v for _, v in own] == np.lexsort((np.arange(300), -s.round(12)))[:5].tolist()
    assert neighbours.search_table(t.limit(0)).count() == 0


def test_neighbours_recall(spark):
    d = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    p = t.toPandas()
    x = np.stack(p["embedding"]).astype(float)
    u, ids = x / np.linalg.norm(x, axis=1, keepdims=True), p["vec_id"].to_numpy()
    hits = total = 0
    got = neighbours.search_table(t).toPandas().groupby("query_id")["vec_id"].agg(set)
    for q, found in got.items():
        k = int(np.flatnonzero(ids == q)[0])
        s = u @ u[k]
        s[k] = -9
        hits += len(found & set(ids[np.argsort(-s)[:5]].tolist()))
        total += 5
    assert hits / total >= 0.9


def test_language(spark, docs, real, empty):
    got = language_id.identify(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert [odd[k] for k in range(4)] == ["und"] * 4 and odd[4] == "en"
    # learned from here are a long text of one word and numbers, and few short ones: texts of other letters are foreign
    assert {r["doc_id"] for r in language_id.accept(docs).collect()} == {4, 5, 7}
    assert language_id.identify(empty).count() == 0


def test_language_accepts_without_a_model(spark):
    texts = [None, "", " 12 !", "a word", "日本", "x" * (language_id.TRAIN_BYTES + 1)]
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 0)
    for rows in ([(k, t, None) for k, t in enumerate(texts)], [(held, t, "en") for t in texts], [(None, t, "en") for t in texts], [(held + 1, texts[0], "en"), (held + 1, texts[5], "en")]):
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert language_id.learn(d) is None
        assert {r["text"] for r in language_id.accept(d).collect()} == {t for _, t, _ in rows} & set(texts[3:])
    labelled = spark.createDataFrame([(1, "abc " * 50, "en"), (2, "xyz " * 50, "und"), (3, "abc abc", None), (4, "xyz xyz", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in language_id.accept(labelled).collect()} == {1, 3}


def test_code_lengths_are_of_a_distribution():
    m = language_id.train({"a": [b"abracadabra" * 40], "b": [b"banana band" * 40]})
    for context in (b"abr", b"zzz", b"\0\0\0"):
        bits = [m.bits(np.frombuffer(context + bytes([c]), np.uint8), np.array([0, 4]))[0] for c in b"abcdrnz "]
        assert (np.exp2(-np.array(bits)).sum(0) <= 1 + 1e-6).all()


def test_line_dedup(spark, real, empty):
    para = " ".join(f"w{k}" for k in range(60))
    short = "\n".join(" ".join(f"s{k}x{n}" for n in range(9)) for k in range(8))
    rows = [(1, f"head one\n{para}\ntail one"), (2, f"{para}\nown line here"), (3, f"a\n\n{short}\nb"), (4, f"c\n{short}\nd"), (5, para), (6, "head one\nhead one"), (7, None), (8, ""), (None, para)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.report(d).collect()}
    assert got[None] == para and got[1] == "head one\ntail one" and got[2] == "own line here" and got[5] == ""
    assert got[3] == dict(rows)[3] and got[4] == "c\nd" and got[6] == "head one\nhead one" and got[7] is None and got[8] == ""
    assert {r["doc_id"] for r in line_dedup.clean(d).collect()} == {None, 1, 2, 3, 4, 6, 7, 8}
    assert line_dedup.report(empty).count() == 0


def test_simhash(docs, real, empty):
    from xxhash import xxh64_intdigest

    def fingerprint(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ")
        w = [x for x in w if x]
        h = [xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for table in (docs, real):
        rows = [(r["doc_id"], fingerprint(r["text"])) for r in table.collect()]
        comp = list(range(len(rows)))
        for a in range(len(rows)):
            for b in range(a):
                if bin(rows[a][1] ^ rows[b][1]).count("1") <= 3 and comp[a] != comp[b]:
                    old, new = comp[a], comp[b]
                    comp = [new if c == old else c for c in comp]
        least = {c: min((d for (d, _), x in zip(rows, comp, strict=True) if x == c and d is not None), default=None) for c in comp}
        want = Counter((d, f, least[c]) for (d, f), c in zip(rows, comp, strict=True))
        assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.group(table).collect()) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 3, 4, 6, 7, 8, None}
    assert simhash.group(empty).count() == 0


def test_simhash_null_and_repeated_ids(spark):
    texts = [" ".join(f"{name}{k}" for k in range(40)) for name in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[3]), (5, texts[4]), (None, texts[4]), (9, texts[5]), (7, texts[5])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, simhash.keep_one(d).collect())) == Counter([*rows[:2], *rows[3:5], rows[7], rows[10]])
    # fingerprints whose smallest doc_id is the same stay apart: 9 is named by 7, 4 by its own
    d = spark.createDataFrame([*rows, (4, texts[2])], "doc_id long, text string")
    names = Counter((r["doc_id"], r["component_id"]) for r in simhash.group(d).collect())
    assert names == Counter([(None, None)] * 3 + [(7, 4), (4, 4), (7, 7), (7, 7), (8, 7), (5, 5), (None, 5), (9, 7), (7, 7)])


def test_covering_masks_cover():
    r = np.random.RandomState(0)
    for round_ in range(3):
        masks = np.array(simhash.masks(3, round_)).view(np.uint64)
        for _ in range(2000):
            diff = np.uint64(0)
            for b in r.choice(64, r.randint(1, 4), replace=False):
                diff |= np.uint64(1) << np.uint64(b)
            assert ((masks & diff) == 0).any()


def test_large_buckets_lose_no_link(spark):
    r = np.random.RandomState(3)
    fps = {int(np.int64(1 << int(a)) ^ np.int64(1 << int(b)) ^ np.int64(1 << int(c))) for a, b, c in r.randint(0, 20, (900, 3))}
    nodes = spark.createDataFrame([(f, k) for k, f in enumerate(sorted(fps))], "fp long, node long")
    comp = {r["node"]: r["comp"] for r in simhash.components(simhash.links(nodes)).collect()}
    f = np.array(sorted(fps)).view(np.uint64)
    want, todo = {}, set(range(len(f)))
    while todo:
        seen, front = set(), [min(todo)]
        while front:
            k = front.pop()
            if k not in seen:
                seen.add(k)
                front += np.flatnonzero(np.bitwise_count(f ^ f[k]) <= 3).tolist()
        want |= dict.fromkeys(seen, min(todo))
        todo -= seen
    assert {k: comp.get(k, k) for k in want} == want


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (2, 0, "user", "hi"), (2, 1, "assistant", "a"), (2, 2, "user", "b"), (3, 0, "user", "hi"), (4, 0, None, None), (4, None, "user", "<|im_end|>"), (5, 0, "user", "hi"), (5, 1, "assistant", "a"), (5, 2, "user", "b")]
    t = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, i string")
    got = {r["conv_id"]: r for r in chat.render(t).collect()}
    assert set(got) == {2, 4} and got[2]["n_turns"] == 3
    assert got[4]["text"] == "<|im_start|>user\n<| im_end|><|im_end|>\n<|im_start|>\n<|im_end|>\n"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = sorted(con.sql(chat.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op10_chat(spark, SF).select("conv_id", "part", "n_turns", "text").collect()) == want
    assert chat.render(t.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == kept and 0 < len(kept) < docs.count()

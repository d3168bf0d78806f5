import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from rankatlas.llm import arrays, blocks, bpe, context_tree, forest, line_rules, near_lines, packing, pivots, queries, site_quality, suffixes

from . import brute

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.mark.parametrize("seed, hot", [(1, 16_384), (2, 16_384), (2, 2)])
def test_byte_repeats(spark, seed, hot):
    r = random.Random(seed)
    base = ["".join(r.choice("ab") for _ in range(60)) for _ in range(6)]
    rows = [(i if i % 17 else None, "".join(r.choice(base)[r.randint(0, 30) : r.randint(30, 60)] + r.choice(["", "x", "é"]) for _ in range(r.randint(0, 8)))) for i in range(100)]
    rows += [(500, None), (501, ""), (502, "a" * 300), (502, "a" * 300), (503, "q" * 39)]
    got = suffixes.digests(suffixes.remove_repeats(frame(spark, rows), 40, 20, hot=hot)).collect()
    assert sorted(tuple(x)[1:] for x in got) == sorted(brute.byte_repeats([t for _, t in rows], 40))


def test_suffix_sort():
    r = random.Random(6)
    data = bytes(r.choice(b"ab") for _ in range(3000)) * 2 + bytes(40)
    start, group = np.arange(6000), np.array([r.randrange(7) for _ in range(6000)])
    places = {}
    for s, g in zip(start.tolist(), group.tolist()):
        places.setdefault((g, data[s : s + 37]), []).append(s)
    want = {s for p in places.values() if len(p) > 1 for s in p}
    got = suffixes.repeated_suffixes(data, group, start, 37, shallow=16)
    assert set(np.nonzero(got)[0].tolist()) == want


def test_blind_trie():
    r = random.Random(4)
    strings = [bytes(r.choice(b"ab") for _ in range(8)) for _ in range(300)]
    classes = suffixes.blind_trie(strings)
    assert [strings[c[0]] for c in classes] == sorted(set(strings))
    assert all(len({strings[i] for i in c}) == 1 for c in classes) and sum(map(len, classes)) == 300


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed):
    r = random.Random(seed)
    base = [[r.choice("ab cd é x1 zz".split()) for _ in range(40)] for _ in range(6)]
    rows = [(i, r.choice([" ", "\n "]).join(w for _ in range(r.randint(0, 6)) for w in r.choice(base)[r.randint(0, 20) : r.randint(20, 40)] + r.choice([[], ["q"], ["w"]]))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "a " * 300), (503, "b")]
    got = blocks.digests(blocks.remove_passages(frame(spark, rows), 8)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.passages(rows, 8))


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    r = random.Random(seed)
    base = [[r.choice("ab cd é x1 zz".split()) for _ in range(r.randint(1, 14))] for _ in range(12)]
    rows = []
    for i in range(150):
        made = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 1)] = r.choice([[], ["q"], ["w"]]) or (["e"] if len(w) < 2 else [])
            made.append(r.choice([" ", "  "]).join(w) + r.choice(["", " ", "\n"]))
        rows.append((i, "\n".join(made)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "b")]
    got = near_lines.digests(near_lines.drop_repeated_lines(frame(spark, rows))).collect()
    assert sorted(map(tuple, got)) == sorted(brute.lines(rows, 8, near_lines.within_one_word))


def near_texts(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(n):
        w = [word() for _ in range(r.randint(20, 120))]
        texts.append(" ".join(w))
        for _ in range(r.randint(0, 4)):
            v = list(w)
            for _ in range(r.randint(0, 4)):
                v[r.randrange(len(v))] = word()
            texts.append(" ".join(v))
    return texts


def test_near_duplicates_lose_no_link(spark):
    texts = [*near_texts(3), "short text", "short text", ""]
    found = {r.doc_id: r for r in forest.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    pairs = brute.similar_pairs(texts, 5, 0.8)
    assert len(pairs) > 20 and all(found[a].class_id == found[b].class_id for a, b in pairs)
    parent = list(range(len(texts)))
    root = lambda i: i if parent[i] == i else root(parent[i])
    for a, b in [*pairs, *((i, j) for j in range(len(texts)) for i in range(j) if texts[i] == texts[j])]:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert [found[i].class_id for i in range(len(texts))] == [root(i) for i in range(len(texts))]
    links = {i: {texts[b] for a, b in pairs if a == i} | {texts[a] for a, b in pairs if b == i} for i in range(len(texts))}
    assert all(found[i].n_links == len(links[i] - {texts[i]}) for i in links)


def test_depth_follows_the_measured_recall():
    assert forest.shortened(0.8, 16, 8, 0.999, {}) == 4 and forest.shortened(0.8, 16, 8, 0.9, {8: 100}) == 8
    assert forest.shortened(0.8, 16, 8, 0.9, {8: 100, 6: 50}) == 6 and forest.shortened(0.8, 16, 8, 0.999, {8: 100, 2: 1}) == 2
    assert forest.meeting_chance(0.8, 8, forest.more_trees(0.8, 8, 0.99999)) >= 0.99999


def test_measured_pairs_are_those_of_brute_force(spark):
    texts = near_texts(9)
    keyed = frame(spark, [(str(i).encode(), t) for i, t in enumerate(texts)], "text_key binary, text string")
    met = forest.measure(keyed, 10_000, 1 << 16, 5, 0.8, 16, 8)
    assert sum(met.values()) == 2 * len(brute.similar_pairs(texts, 5, 0.8)) and sum(n for d, n in met.items() if d >= 4) >= 0.99 * sum(met.values())


def test_near_duplicates_in_a_crowd(spark):
    r = random.Random(5)
    base = ["w%d" % i for i in range(200)]
    texts = []
    for i in range(150):
        v = list(base)
        v[r.randrange(200)] = f"x{i}"
        texts.append(" ".join(v))
    found = forest.near_duplicates(frame(spark, list(enumerate(texts)))).collect()
    assert {x.class_id for x in found} == {0} and all(x.n_links > 0 for x in found)
    kept = forest.keep_one(frame(spark, [*enumerate(texts), (0, texts[0]), (None, texts[3]), (None, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted((x.doc_id, x.text) for x in kept if x.doc_id is not None) == [(0, texts[0])] and sum(x.doc_id is None for x in kept) == 1


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    r = random.Random(1)
    odd = "aaeethñüß'sßİıǅ ſ0123456789.,!?<|endoftext|>日本語한국́  \x1c\x85​😀 \n\t\x0bͅΣςÅÅ'LL'd"
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(r.choice("abcdehilnorst") for _ in range(r.randint(1, 40))) for _ in range(1500)]
    texts += ["x<|endoftext|>y <|startoftext|>", "<|endoftext|>" * 3, "a" * 3000, "don't DON'T we'LL", ""]
    rows = list(enumerate(texts)) + [(-1, None)]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = {x.doc_id: x for x in bpe.encode_decode(frame(spark, rows), queries.tokenizer_path()).collect()}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_a_small_memory_of_words_changes_nothing():
    from tokenizers import Tokenizer

    r = random.Random(3)
    words_of, library = bpe.WordEncoder(queries.tokenizer_path(), keep=40), Tokenizer.from_file(queries.tokenizer_path())
    for _ in range(30):
        texts = [" ".join(r.choice(["the", "of", "w%d" % r.randrange(60)]) for _ in range(8)) for _ in range(5)]
        ids, at = words_of.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        assert len(words_of.known) <= 60 and len(words_of.older) <= 60


def test_texts_that_share_a_key_with_a_token_are_not_it():
    words_of = bpe.WordEncoder(queries.tokenizer_path())
    keys, ids, bytes_ = words_of.inner[2]
    first = {i: t for i, t in zip(ids.tolist(), map(bytes, bytes_), strict=True) if t.isalpha()}
    words = [t + b"zq" for t in first.values()]
    begins = {w: int(np.frombuffer(p, "<u4")[0]) for w, p in words_of.encode_pieces(words).items()}
    held = [t for i, t in first.items() if begins[t + b"zq"] == i]
    assert len(held) > 50
    # the same keys, but of other texts: none of these tokens may be found any more
    words_of.inner[2] = (keys, ids, bytes_ ^ np.uint8(1))
    for t in held[:50]:
        with pytest.raises(ValueError, match="lacks"):
            words_of.encode_pieces([t + b"zq"])


def test_packing_covers_every_id(spark):
    from tokenizers import Tokenizer

    rows = [(1, "the cat " * 3000), (2, None), (3, ""), (4, "one two three"), (4, "one two three")]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack(frame(spark, rows), queries.tokenizer_path()).collect()
    assert len({x.sequence_id for x in got}) == len(got) and all(x.length == 1 << x.bucket and x.length <= 2048 and x.offset == 0 for x in got)
    for i, t in rows[:4]:
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted({x.start: x for x in got if x.doc_id == i}.items())
        assert [j for _, x in mine for j in np.frombuffer(bytes(x.ids), "<u4").tolist()] == want and {x.doc_tokens for _, x in mine} == {len(want)}


def test_language_model(spark):
    r = random.Random(1)
    rows = [(i if i % 13 else None, " ".join(r.choice("The the cat Dog sat é on mat x y".split()) for _ in range(r.randint(0, 20)))) for i in range(50)]
    rows += [(77, None), (78, ""), (79, "only here"), (79, "only here")]
    got = [tuple(x)[:7] for x in context_tree.score(frame(spark, rows), depth=3).collect()]
    order = lambda x: (str(x[0]), x[2], round(x[5], 6), round(x[6], 6))
    for a, b in zip(sorted(got, key=order), sorted(brute.language_model(rows, 3), key=order), strict=True):
        # values of contexts travel in single precision
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6)


def test_language_model_at_the_depth_of_the_query(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("The the cat Dog sat é on mat".split()) for _ in range(r.randint(0, 12)))) for i in range(30)]
    got = sorted((x.doc_id, x.score) for x in context_tree.score(frame(spark, rows)).collect())
    want = sorted((x[0], x[6]) for x in brute.language_model(rows, 5))
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-6)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    got = context_tree.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg({"score": "sum", "base_score": "sum", "n_bytes": "sum"}).first()
    # bits a byte; uniform bytes would need 8
    assert -got["sum(score)"] / got["sum(n_bytes)"] / np.log10(2) < 2.4


def test_search(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(r.normal(size=(700, 8)).round(1))]
    rows += [(700, None), (720, []), (740, [1.0] * 7 + [float("nan")]), (760, [1.0] * 7 + [None]), (None, [1.0] * 8), (780, rows[20][1])]
    # ids and whole rows that repeat: each is a query and a candidate of the others
    rows += [(20, rows[33][1]), (40, rows[40][1]), (40, rows[40][1]), (41, rows[41][1]), (800, [0.5] * 3)]
    got = pivots.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=100).collect()
    whole = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v and None not in v and not np.isnan(v).any()]
    want = []
    for n, (i, q) in enumerate(whole):
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for m, (j, v) in enumerate(whole) if m != n and len(v) == len(q))[:20]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["op5_line_rules", "op9_pivot_search"])
def test_matches_sql(spark, name):
    got = queries.queries()[name](spark, FOLDER)
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(x[k] for k in columns) for x in got.collect()) == sorted(cursor.fetchall())


def test_line_rules():
    assert [line_rules.line_fails(x) for x in ("A good line ends here.", "Home | About | News | Login", "a### b*** c$$$", "THIS IS SHOUTED LOUDLY.", "no end", "Subscribe to us now.", "x x x x x x x.", "")] == ["", "navigation", "symbols", "capitals", "punctuation", "boilerplate", "repetition", ""]


def test_site_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = site_quality.classify(docs, labels).join(labels.withColumnsRenamed({"quality": "good", "toxic": "bad"}), "doc_id").select("good", "bad", "quality", "toxic", "kept").toPandas()
    assert found[found.bad == 1].kept.mean() < 0.2 and found[(found.good == 1) & (found.bad == 0)].kept.mean() > 0.97
    assert found[found.good == 1].quality.mean() - found[found.good == 0].quality.mean() > 0.4


def test_site_posteriors(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = site_quality.classify(docs, labels).collect()
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    for t in ("quality", "toxic"):
        p = np.array([r[f"doc_{t}"] for r in rows])
        mean, inner = p.mean(), max((p**2).mean() - p.mean() ** 2, 1e-9)
        keys = {"host": [(r.host,) for r in rows], "path": [(r.host, r.path) for r in rows]}
        groups = {k: {x: p[[i for i, y in enumerate(v) if y == x]] for x in set(v)} for k, v in keys.items()}
        strength = {}
        for k, g in groups.items():
            between = np.mean([(v.mean() - mean) ** 2 - inner / len(v) for v in g.values() if len(v) >= 2])
            strength[k] = min(max(inner / max(between, 1e-9), 1.0), 1e6)
        host = {x: (v.sum() + strength["host"] * mean) / (len(v) + strength["host"]) for x, v in groups["host"].items()}
        path = {x: (v.sum() + strength["path"] * host[x[:1]]) / (len(v) + strength["path"]) for x, v in groups["path"].items()}
        for r in rows:
            want = path[r.host, r.path]
            assert r[f"host_{t}"] == pytest.approx(host[r.host,]) and r[f"path_{t}"] == pytest.approx(want)
            assert r[t] == pytest.approx(1 / (1 + np.exp(-(logit(r[f"doc_{t}"]) + logit(want) - logit(mean)))))
    assert all(r.kept == (r.quality >= 0.5 and r.toxic < 0.5) for r in rows)


def test_marks_and_evidence():
    texts = ["Good good WORD", "bad bad bad!", ""]
    data, at = arrays.text_bytes(pa.array(texts))
    owner, key = site_quality.marks(data, at)
    of = lambda w: arrays.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)])).view(np.int64)[0]
    held = [set(key[owner == i].tolist()) for i in range(3)]
    assert {of("good"), of("word")} < held[0] and of("bad") in held[1] and not {of("good"), of("bad")} & held[2]
    assert [len(h) for h in held] == [8, 7, 6]
    known = np.sort(np.array([of("good"), of("bad")]))
    weight = np.where(known == of("good"), 2.0, -3.0)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "text"])
    found = pa.Table.from_batches(list(site_quality._evidence([(known, weight), (known[:0], weight[:0])])([batch])))
    assert found.column("quality_evidence").to_pylist() == [2.0, -3.0, 0.0] and found.column("toxic_evidence").to_pylist() == [0.0] * 3


def test_buckets(spark, tmp_path):
    rows = [(i, "word " * (37 * i)) for i in range(40)]
    got = packing.pack(frame(spark, rows), queries.tokenizer_path())
    packing.write_buckets(got, f"{tmp_path}/b", size=4096)
    back = spark.read.parquet(f"{tmp_path}/b")
    assert back.count() == got.count() and back.filter("length <> shiftleft(1L, bucket)").count() == 0
    assert {f.name for f in (tmp_path / "b").iterdir() if f.is_dir()} == {f"bucket={r.bucket}" for r in got.select("bucket").distinct().collect()}


EDGES = [(None, None, None, None), (1, "", "a", "b"), (1, "", "a", "b"), (2, "word " * 40_000, "a", None), (3, "x" * 200_000, None, "b"), (4, "A line of nine plain words that ends well here.\n" * 3, "a", "b"), (4, "A line of nine plain words that ends well here.\n" * 3, "a", "b"), (None, "A line of nine plain words that ends well here.", "c", "b")]
OPERATORS = {
    "suffixes": lambda d, s: suffixes.remove_repeats(d),
    "packing": lambda d, s: packing.pack(d, queries.tokenizer_path()),
    "blocks": lambda d, s: blocks.remove_passages(d),
    "passages kept": lambda d, s: blocks.dedup_passages(d),
    "site quality": lambda d, s: site_quality.classify(d, s.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")),
    "rules": lambda d, s: line_rules.judge_documents(d),
    "cleaning": lambda d, s: line_rules.clean_documents(d),
    "bpe": lambda d, s: bpe.encode_decode(d, queries.tokenizer_path()),
    "forest": lambda d, s: forest.near_duplicates(d),
    "one of each": lambda d, s: forest.keep_one(d),
    "lines": lambda d, s: near_lines.drop_repeated_lines(d),
    "lines kept": lambda d, s: near_lines.dedup_lines(d),
    "context tree": lambda d, s: context_tree.score(d),
}
ONE_A_ROW = {"suffixes", "blocks", "site quality", "rules", "bpe", "forest", "lines", "context tree"}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    clash = "doc_id long, text string, source string, lang string, row_key string, batch int, carried int, text_key int, found int, kept int, n_chars int, train int, host int, prefix int"
    rows = [(*r, "k", 1, 2, 3, 4, 5, 6, 7, 8, 9) for r in EDGES]
    docs = spark.createDataFrame(rows, clash)
    got = OPERATORS[name](docs, spark).collect()
    assert len(got) == len(EDGES) if name in ONE_A_ROW else len(got) >= 1 or name == "cleaning"
    assert not OPERATORS[name](docs.limit(0), spark).collect()


def test_search_of_far_clusters(spark):
    r = np.random.default_rng(7)
    centres = r.normal(size=(6, 8)) * 1e6
    v = (centres[r.integers(0, 6, 600)] + r.normal(size=(600, 8))).astype(np.float32).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = pivots.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=150).collect()
    e = np.floor(64 * v)
    for i in range(0, 600, 20):
        want = sorted((-int(sum(int(a) * int(b) for a, b in zip(e[i], e[j], strict=True))), j) for j in range(600) if j != i)[:20]
        mine = sorted((x.rank, x.vec_id) for x in got if x.query_id == i)
        assert len(mine) == 20 and {j for _, j in mine} <= {j for s, j in want} | {j for j in range(600) if abs(float(e[i] @ e[j]) + want[-1][0]) <= 1e-9 * abs(want[-1][0])}


def test_search_of_nothing(spark):
    assert not pivots.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect()


@pytest.mark.parametrize("gathered, block", [(1024, 1024), (1024, 25), (32, 25)])
def test_all_links_in_a_crowd(spark, gathered, block):
    r = random.Random(8)
    base = ["w%d" % i for i in range(250)]

    def changed(words, n):
        words = words[:]
        for i in r.sample(range(len(words)), n):
            words[i] = "x%d" % r.randrange(10**9)
        return words

    families = [changed(base, 3) for _ in range(90)]
    planted = [changed(f, 2) for f in [changed(base, 3) for _ in range(15)] for _ in range(2)]
    tight = [changed(["v" + w for w in base], 1) for _ in range(60)]
    texts = [" ".join(w) for w in families + planted + tight]
    found = {x.doc_id: x for x in forest.near_duplicates(frame(spark, list(enumerate(texts))), gathered=gathered, block=block).collect()}
    pairs = brute.similar_pairs(texts, 5, 0.8)
    degree, root = [0] * len(texts), list(range(len(texts)))
    for a, b in pairs:
        degree[a], degree[b] = degree[a] + 1, degree[b] + 1
        low, high = sorted((root[a], root[b]))
        root = [low if x == high else x for x in root]
    assert [found[i].n_links for i in range(len(texts))] == degree
    assert [found[i].class_id for i in range(len(texts))] == root

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex

from rankatlas.llm import arrays, merkle, queries, spellings, token_counts

from .test_operators import EDGES, FOLDER, frame

BITS = ["'s", "'t", "'re", "'ve", "'ll", "'m", "'d", "'S", "'", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "a", "Sta", "re", "12", "٣", "é", "ÿ", "漢字", "😀", "!", "..", "<|endoftext|>", "<|endof", "text|>", "́", "x" * 40, "s", "₏", "ՠ"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.byte_tokenizer_path())


def odd_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("share", [16_384, 50])
def test_token_counts_equal_the_library(spark, share):
    texts = [*odd_texts(1, 3000), "", "a" * 70_000, " " * 5000, "word " * 300_000, "<|endoftext|>" * 3, "don't can't we'll they've I'm"]
    rows = [*enumerate(texts), (-1, None), (None, "two words"), (5, texts[5])]
    got = token_counts.count_tokens(frame(spark, rows), queries.byte_tokenizer_path(), share=share).collect()
    n = [len(x.ids) for x in library().encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want = [(i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(rows, n, strict=True)]
    order = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("size", [64, 1000])
def test_long_texts_are_cut_where_pre_tokens_end(size):
    texts = [" ".join(odd_texts(seed, 60)) for seed in range(30)]
    data, at = arrays.text_bytes(pa.array(texts))
    cut, table = token_counts.PreTokens(queries.byte_tokenizer_path()), token_counts.Table([], [])
    got = np.zeros(len(texts), np.int64)
    for a, b, edges, owners in token_counts.windows(data, at, size):
        begin, end, special = cut.split(data[a:b], edges)
        sums = np.concatenate([[0], np.cumsum(cut.lengths(data[a:b], begin, end, table))])
        np.add.at(got, owners, np.diff(sums[np.searchsorted(begin, edges)]) + np.diff(np.searchsorted(special, edges)))
    assert got.tolist() == [len(x.ids) for x in library().encode_batch(texts, add_special_tokens=False)]


def test_exact_keys_and_table():
    words = sorted({x.encode()[:15] for x in [*BITS, "a", "aa", "abcdefgh", "abcdefghi", "abcdefghijklmno"]})
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    keys = [(int(a), int(b)) for a, b in zip(*token_counts.exact_keys(data, np.concatenate([[0], ends[:-1]]), ends), strict=True)]
    assert len(set(keys)) == len(words) and [token_counts.key_bytes(*k) for k in keys] == words
    table = token_counts.Table(keys[::2], list(range(1, len(keys[::2]) + 1)))
    low, high = (np.array([k[i] for k in keys], np.uint64) for i in (0, 1))
    assert table.find(low, high).tolist() == [i // 2 + 1 if i % 2 == 0 else 0 for i in range(len(keys))]


def test_frequent_pre_tokens(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "of", "and", "w%d" % r.randrange(5000)]) for _ in range(200)) for _ in range(200)]
    table = token_counts.frequent(frame(spark, [*enumerate(texts)]).select("text"), queries.byte_tokenizer_path(), share=100, tracked=400)
    held = {token_counts.key_bytes(int(a), int(b)) for a, b in zip(table.low, table.high, strict=True) if b}
    assert {b" the", b" of", b" and", b" w"} <= held and len(held) <= 100


def spelled(rows, least=3, every=97):
    count = Counter()
    for i, t in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    form, close = {}, {}
    for w in n:
        close[w] = [o for o in n if near(w, o)]
        best = min(close[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("seed, least", [(1, 64), (2, 0), (3, 3)])
def test_spellings(spark, seed, least):
    r = random.Random(seed)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(5, 9))) for _ in range(40)] + ["z" * 60, "preamble" * 8, "École", "×÷×÷×"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = r.choice(stems)
            for _ in range(r.choice([0, 0, 1, 2])):
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", "a", "b", w[k] + "c"]) + w[k + 1 :]
            words.append(r.choice([w, w.upper(), w.capitalize()]))
        rows.append((i if i % 11 else None, r.choice([" ", ", ", "_", "1"]).join(words)))
    rows += [(500, None), (501, ""), (502, "y" * 30_000), (503, "y" * 30_000), (504, "y" * 30_001), (505, "y" * 30_000), (506, "y" * 30_001 + " " + "y" * 30_001)]
    got = spellings.spelling_variants(frame(spark, rows), every=13, index_least=least).collect()
    want = spelled(rows, every=13)
    key = lambda x: x[0]
    assert len(want) > 300 and sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("least", [0, 5, 64])
def test_no_pair_is_lost_at_any_gram_length(spark, least):
    r = random.Random(least)
    words = {"".join(r.choice("ab") for _ in range(r.randint(5, 12))) for _ in range(900)} | {"ab" * 30, "ab" * 29 + "b", "a" * 41, "a" * 42, "a" * 40 + "b"}
    found = spellings.near_pairs(frame(spark, [(w, 3) for w in words], "word string, n long"), least=least).collect()
    want = set()
    for w in words:
        for i in range(len(w)):
            other = w[:i] + w[i + 1 :]
            want |= {(w, other), (other, w)} if other in words else set()
            want |= {(w, w[:i] + c + w[i + 1 :]) for c in "ab" if c != w[i] and w[:i] + c + w[i + 1 :] in words}
    assert {(x.word, x.near) for x in found} == want and len(found) == len(want)


def test_no_edit_affects_both_grams():
    r = random.Random(5)
    none = spellings.Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)
    for n in range(5, 60):
        word = bytes(r.choice(b"abcdefg") for _ in range(n)).decode()
        ((_, _, marked),) = spellings.by_length(pa.RecordBatch.from_pydict({"word": [word]}))
        keys = np.concatenate([k[0][inside] for _, _, k, inside in spellings.grow(marked, n, 0)])
        for frequent in (none, spellings.Frequent(keys, np.full(len(keys), 9), 1)):
            left = spellings.grams(marked, n, 0, frequent)
            (i,), (j,) = spellings.cheapest_pair(left, left)
            at, _, end, _ = left
            assert at[i] < end[0, i] <= at[j] < end[0, j] <= n + 2


def tree_root(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([merkle.digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 37])
def test_witnesses_grow_with_appends(n):
    nodes = [merkle.digest(str(i)) for i in range(n)]
    levels, frontier = tree_root(nodes), merkle.Frontier()
    for i, x in enumerate(nodes):
        frontier.append(x)
        assert len(frontier.open) == bin(i + 1).count("1")  # open subtrees are the ones of the count's binary digits
    assert frontier.close() == levels[-1][0]
    for i in range(n):
        assert frontier.witness[i] == [level[i >> k ^ 1] for k, level in enumerate(levels) if i >> k ^ 1 < len(level)]
        assert merkle.fold(nodes[i], i, n, frontier.witness[i] + ["rest"]) == (levels[-1][0], ["rest"])


MANIFEST = "doc_id long, text string, source string, lang string, n_chars long"


def manifest_of(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, text, source, lang, n: merkle.digest(*map(field, (i, source, lang, n, text)))
    langs = sorted({r[3] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, members = [], []
    for g in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[3] == g), key=lambda x: x[:3])
        members.append(mine)
        trees.append(tree_root([x[2] for x in mine]))
    top, out = tree_root([t[-1][0] for t in trees]), []
    for t, (levels, mine) in enumerate(zip(trees, members, strict=True)):
        for i, (_, _, own, r) in enumerate(mine):
            siblings = [lv[i >> k ^ 1] for k, lv in enumerate(levels) if i >> k ^ 1 < len(lv)] + [lv[t >> k ^ 1] for k, lv in enumerate(top) if t >> k ^ 1 < len(lv)]
            node = leaf(*r[:4], r[4] + 1) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            node, rest = merkle.fold(node, i, len(mine), siblings)
            node, rest = merkle.fold(node, t, len(trees), rest)
            assert not rest
            out.append((r[0], own, levels[-1][0], top[-1][0], merkle.digest(*siblings), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest(spark, bits):
    r = random.Random(bits)
    rows = [(i, r.choice(["", "text é %d" % i, None]), r.choice(["s", None]), r.choice(["en", "en", "de", "é", None, ""]), r.choice([i, None])) for i in range(90)]
    rows += [(3, "again", "s", "en", 1), rows[5], rows[5], (None, None, None, None, None), (None, None, None, None, None), (None, "x", "s", "en", 7), (-4, "minus", "s", "en", 2)]
    got = merkle.digests(merkle.manifest(frame(spark, rows, MANIFEST), merkle.altered(), bits)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, manifest_of(rows)))
    assert {x.verified for x in got} == {True, False}


def test_appends_give_the_root_of_all_rows(spark, tmp_path):
    langs = ["en", "de", None, "fr"]
    rows = [(i, f"t{i}", "s", langs[i % 2] if i < 30 else langs[i % 4], i) for i in range(70)]
    for number, (a, b) in enumerate([(0, 1), (1, 30), (30, 33), (33, 33), (33, 70)]):
        for _ in range(2 if number == 2 else 1):  # a repeated batch replaces itself
            root = merkle.append(frame(spark, rows[a:b], MANIFEST), str(tmp_path), number, bits=2)
        assert root == manifest_of(rows[:b])[0][3]
    with pytest.raises(ValueError, match="greater"):
        merkle.append(frame(spark, [(50, "x", "s", "en", 1)], MANIFEST), str(tmp_path), 5, bits=2)
    assert merkle.append(frame(spark, [(50, "x", "s", "es", 1)], MANIFEST), str(tmp_path), 5, bits=2) == manifest_of([*rows, (50, "x", "s", "es", 1)])[0][3]


def test_one_row_is_its_own_root(spark):
    (x,) = merkle.digests(merkle.manifest(frame(spark, [(1, "t", "s", "en", 1)], MANIFEST))).collect()
    assert x.leaf == x.subroot == x.root == x.folded_root and x.verified and x.proof_sha256 == merkle.digest()


@pytest.mark.parametrize("name", ["op12_spellings", "op13_merkle"])
def test_matches_sql(spark, name):
    got = queries.queries()[name](spark, FOLDER)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cursor = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(x[k] for k in columns) for x in got.collect()))) == sorted(map(repr, cursor.fetchall()))


@pytest.mark.parametrize("name", ["counts", "spellings", "manifest"])
def test_edges(spark, name):
    run = {"counts": lambda d: token_counts.count_tokens(d, queries.byte_tokenizer_path()), "spellings": spellings.spelling_variants, "manifest": merkle.manifest}[name]
    clash = "doc_id long, text string, source string, lang string, n_chars long, tree int, index int, size int, hash int, word int, n int, key int, batch int, place int"
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for r in EDGES], clash)
    got = run(docs).collect()
    if name == "spellings":
        want = spelled([r[:2] for r in EDGES])
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and want
    else:
        assert len(got) == len(EDGES)
    assert not run(docs.limit(0)).collect()

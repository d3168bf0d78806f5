"""Spelling variants by a variable-length gram index.

A word stands between two marks. At each place it has one gram: the shortest run of characters from
there that is not frequent among words of its length at that place, so that common beginnings are
told apart by more letters than rare ones. Grams are lists of words; a word looks into few of them,
chosen so that no single edit can affect all, and what it meets there is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let_go, mix
from .frames import checkpoint, written

LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fewest and most characters of a gram; words of over LONG characters have grams at EDGE places at either end only.
SHORTEST, LONGEST, LONG, EDGE = 2, 8, 40, 8


def lowered(text: Column) -> Column:
    """A-Z only."""
    return F.translate(text, _UPPER, _LOWER)


def word_counts(docs: DataFrame, every: int = 97, least_chars: int = 5, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: the corpus's runs of letters, some of them with one letter dropped, that are long and frequent enough.

    A run loses a letter where `every` divides the crc32 of its document's id, a colon and itself.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(lowered(F.col(text_col).cast("string")), F.lit(LETTERS), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    slip = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, slip).otherwise(F.col("run"))
    found = hashed.select(word.alias("word")).filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n"))
    return found.filter(F.col("n") >= least)


def longest_gram(size: int) -> int:
    """Half of a marked word of `size` letters at most, so that any word has two grams that don't overlap."""
    return min(LONGEST, (size + 3) // 2)


def places(size: int) -> np.ndarray:
    """Where a marked word of `size` letters has grams: everywhere, or near the ends of a long one."""
    every = np.arange(size + 1)
    return every if size <= LONG else every[(every < EDGE) | (every >= size - EDGE)]


class Frequent:
    """The frequent part of the gram dictionary: sorted keys and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, limit: int):
        order = np.argsort(keys)
        self.keys, self.counts, self.limit = keys[order], counts[order], limit

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Words that share each gram, 0 if they are few."""
        if not len(self.keys):
            return np.zeros(keys.shape, np.int64)
        spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[spot] == keys, self.counts[spot], 0)


def grow(marked: np.ndarray, target: int, shift: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of the runs from each place of marked words, a character longer each time, as words of `target` letters have them.

    Yields length, places, keys and which of these lie inside the word. A place of these words is
    `shift` later than in words of the target's length.
    """
    rows, width = marked.shape
    at = places(target) + shift
    keys = np.broadcast_to(mix((at - shift + (target << 32)).astype(np.uint64) + np.uint64(1)), (rows, len(at)))
    for n in range(1, longest_gram(target) + 1):
        inside = at + n <= width
        letters = marked[:, np.minimum(at + n - 1, width - 1)].astype(np.uint64)
        keys = np.where(inside, mix(keys + letters * np.uint64(0x9E3779B97F4A7C15)), keys)
        yield n, at, keys, inside


def grams(marked: np.ndarray, target: int, shift: int, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words' grams, and for each word and place: key, end and how many words may share it."""
    live = None
    for n, at, keys, inside in grow(marked, target, shift):
        if live is None:
            live, end = np.ones(keys.shape, bool), np.zeros(keys.shape, np.int64)
            found, cost = keys.copy(), np.zeros(keys.shape, np.int64)
        live = live & inside
        found, end = np.where(live, keys, found), np.where(live, at + n, end)
        if n >= SHORTEST:
            held = np.zeros(keys.shape, np.int64)
            held[live] = frequent.count(keys[live])
            cost = np.where(live, np.maximum(held, frequent.limit), cost)
            live = live & (held > 0)
    return at, found, end, cost


def cheapest_pair(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each word the two grams, by index, that don't overlap and whose lists are shortest together.

    A set of grams is safe if fewer of them are affected by an edit than there are. Ranges without a
    common character hold two that are disjoint, so the cheapest safe set is such a pair.
    """
    (at, _, end, cost), (at_right, _, end_right, cost_right) = left, right
    none = np.int64(1) << 62
    best = np.full((len(cost), int(max(end.max(), at_right.max())) + 1), none)
    rows = np.arange(len(cost))
    for i in range(len(at)):
        whole = end[:, i] - at[i] >= SHORTEST
        best[rows, end[:, i]] = np.minimum(best[rows, end[:, i]], np.where(whole, cost[:, i] << 20 | i, none))
    best = np.minimum.accumulate(best, axis=1)
    before = best[:, at_right]
    both = np.where((before < none) & (end_right - at_right >= SHORTEST), (before >> 20) + cost_right, none)
    chosen = both.argmin(1)
    return before[rows, chosen] & ((1 << 20) - 1), chosen


def by_length(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Rows of words of one length, the length, and the words between marks as a matrix of their characters."""
    texts = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
    size = np.array([len(w) for w in texts], np.int64)
    for n in np.unique(size).tolist():
        all_ = np.nonzero(size == n)[0]
        step = max(1, min(rows, (rows << 4) // n))
        for i in range(0, len(all_), step):
            at = all_[i : i + step]
            marked = np.zeros((len(at), n + 2), np.uint8)
            marked[:, 0], marked[:, -1] = 1, 2
            marked[:, 1:-1] = np.frombuffer(b"".join(texts[j] for j in at.tolist()), np.uint8).reshape(len(at), n)
            yield at, n, marked


def dictionary(words: DataFrame, least: int = 64, share: int = 131_072) -> Frequent:
    """The frequent grams: shared by more than `least` words, and by one in `share` of all places.

    Grams of a length are at most as many as places, so at most `share` of each length are kept, seven
    times `share` in all, whatever the corpus. A task reports only grams with such a share among its own; a count that
    falls short by it moves the border, never the result, as all words are cut by one dictionary.
    """
    def run(batches):
        let_go()
        sums = {n: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for n in range(SHORTEST, LONGEST + 1)}
        total = 0
        for batch in batches:
            for _, n, marked in by_length(batch):
                total += len(marked) * len(places(n))
                for k, _, keys, inside in grow(marked, n, 0):
                    if k >= SHORTEST:
                        had, count = sums[k]
                        new, times = np.unique(keys[:, inside], return_counts=True)
                        both, where = np.unique(np.concatenate([had, new]), return_inverse=True)
                        sums[k] = both, np.bincount(where, np.concatenate([count, times]), len(both)).astype(np.int64)
        for had, count in sums.values():
            often = count * share >= total
            yield pa.RecordBatch.from_arrays([pa.array(had[often].view(np.int64)), pa.array(count[often])], ["key", "n"])

    total = words.agg(F.sum(F.when(F.length("word") <= LONG, F.length("word") + 1).otherwise(2 * EDGE + 1))).first()[0] or 0
    limit = max(least, total // share)
    counted = words.select("word").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).toArrow()
    return Frequent(np.asarray(counted.column("key")).astype(np.int64).view(np.uint64), np.asarray(counted.column("n")).astype(np.int64), limit)


def near_pairs(words: DataFrame, least: int = 64, share: int = 131_072) -> DataFrame:
    """word, n, near and near_n: all pairs that differ by one inserted, deleted or replaced character, both ways.

    A word looks for words of its own length and for those one letter shorter. For each it takes two
    disjoint grams: an edit after the left one leaves it in its place, any other leaves the right one
    as far from the end, so at least one of the two lists holds the partner. Words are compared only
    where they share a list, and each pair is verified.
    """
    spark = words.sparkSession
    dealt = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    shared = spark.sparkContext.broadcast(dictionary(dealt, least, share))

    def rows(keys: np.ndarray, at: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        of = pa.array(at)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("word").take(of), batch.column("n").take(of)], ["key", "word", "n"])

    def lists(batches):
        let_go()
        for batch in batches:
            for at, n, marked in by_length(batch):
                where, keys, end, _ = grams(marked, n, 0, shared.value)
                whole = end - where >= SHORTEST
                yield rows(keys[whole], np.repeat(at, whole.sum(1)), batch)

    def probes(batches):
        let_go()
        for batch in batches:
            for at, n, marked in by_length(batch):
                for target in (n, n - 1):
                    left = grams(marked, target, 0, shared.value)
                    right = left if target == n else grams(marked, target, 1, shared.value)
                    i, j = cheapest_pair(left, right)
                    each = np.arange(len(at))
                    yield rows(np.concatenate([left[1][each, i], right[1][each, j]]), np.concatenate([at, at]), batch)

    side = lambda f, by: dealt.mapInArrow(f, "key long, word string, n long").toDF("key", by, f"{by}_n")
    met = side(probes, "a").join(side(lists, "b"), "key").filter((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    a, b = F.struct(F.col("a").alias("word"), F.col("a_n").alias("n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"))
    pairs = met.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    ways = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    return pairs.select(ways.alias("p")).select("p.x.word", "p.x.n", F.col("p.y.word").alias("near"), F.col("p.y.n").alias("near_n"))


def followed(links: DataFrame) -> DataFrame:
    """word and root from word and form: forms are followed to the last, twice as far each round."""
    ends = checkpoint(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = checkpoint(ends.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ends.filter("moved").isEmpty():
            return ends.select("word", "root")
        ends = ends.drop("moved")


def spelling_variants(docs: DataFrame, every: int = 97, least_chars: int = 5, least: int = 3, times: int = 2, index_least: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and their commoner spellings: word, form, root, n, n_near and form_n.

    `form` is the near word (one edit away) of largest n, ties to the smaller in code-point order, if its
    n is at least `times` the word's; `root` follows forms to the last, and is the word itself if there is
    none. Null and empty texts have no words; a null id counts as an empty one; repeated rows count each;
    texts of any length are read whole; words of any length take part; other columns are ignored,
    whatever their names; an empty table gives no rows. Only words and their counts are
    shuffled, and lists of words that share a gram, length and place; n grows along forms, so the
    rounds that follow them are few.
    """
    if least_chars < 5:
        raise ValueError("words of fewer than five letters may lack two grams that don't overlap")
    words = written(word_counts(docs, every, least_chars, least, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    found = near_pairs(words, index_least).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(found, "word", "left")
    good = -F.col("best.minus") >= times * F.col("n")
    formed = checkpoint(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n")))
    roots = followed(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 of a blob in DuckDB, which has no such function: its table of 256 entries made by the rule, then a step a byte.
CRC32_SQL = """
crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"""


def crc32_sql(bytes_: str) -> str:
    """The crc32 of a list of byte values; needs CRC32_SQL's table t in scope."""
    return f"xor(list_reduce([4294967295::BIGINT] || {bytes_}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


#: The bytes of a text of Latin-1 characters in UTF-8.
_UTF8_SQL = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))"

ORACLE_SQL = rf"""
WITH RECURSIVE {CRC32_SQL.strip()},
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  GROUP BY ALL),
hashed AS (SELECT run, times, {crc32_sql(_UTF8_SQL.format("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM runs, crc_table),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cuts AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
top AS (SELECT word, near, near_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near) WHERE r = 1),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word) LEFT JOIN top USING (word)),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT chain.word, chain.root FROM chain JOIN formed g ON g.word = chain.root WHERE g.form IS NULL) c ON c.word = f.word"""

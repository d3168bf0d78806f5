"""Line-first cleaning: rules judge each line, failed lines go, and a document that loses too much is rejected."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import let_go, pieces
from .frames import rest_of, restored, schema_of

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"
#: Phrases of page furniture, matched without case in lines of at most BOILERPLATE_WORDS words.
BOILERPLATE = ("cookie", "javascript", "privacy policy", "terms of use", "terms of service", "all rights reserved", "licensed under", "copyright", "click here", "read more", "sign in", "sign up", "log in", "subscribe", "share this", "back to top", "skip to content", "lorem ipsum", "page not found", "enable js")
BOILERPLATE_WORDS = 30
_FURNITURE = regex.compile("(?i)" + "|".join(map(regex.escape, BOILERPLATE)))
_UPPER, _LETTER, _MARK = regex.compile(r"\p{Lu}"), regex.compile(r"\p{L}"), regex.compile(r"[.!?。！？؟…]")
_ENDS = tuple(".!?:;\"'”’»)。！？؟…")


def line_fails(line: str) -> str:
    """The first rule that a line fails, or an empty string. Lines without words pass."""
    words = line.encode().split()
    n = len(words)
    if not n:
        return ""
    bars = sum(map(line.count, "|»›>"))
    if bars >= 2 and 5 * bars >= n:
        return "navigation"
    symbols = sum(map(line.count, SYMBOLS))
    if symbols >= 3 and symbols >= n:
        return "symbols"
    upper = len(_UPPER.findall(line))
    if upper >= 10 and 2 * upper > len(_LETTER.findall(line)):
        return "capitals"
    shouts = line.count("!")
    if shouts >= 3 and 3 * shouts > n:
        return "exclamations"
    if n >= 6 and 2 * sum(a == b for a, b in zip(words, words[1:], strict=False)) > n:
        return "repetition"
    if n <= BOILERPLATE_WORDS and _FURNITURE.search(line):
        return "boilerplate"
    if not line.rstrip(BLANK).endswith(_ENDS) and 40 * len(_MARK.findall(line)) < n:
        return "punctuation"
    return ""


def measure(text: str, max_lost: float) -> tuple:
    """One text's base counts, verdicts and cleaned text."""
    words = text.encode().split()
    n, lines = len(words), text.split("\n")
    inked = [x for x in lines if x.strip(BLANK)]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    count, repeated, upto = Counter(triples), 0, 0
    for i, t in enumerate(triples):
        if count[t] > 1:
            repeated += i + 3 - max(i, upto)
            upto = i + 3
    base_failed = n < 50 or 100 * repeated > 50 * n
    failed = [bool(line_fails(x)) for x in lines]
    lost = sum(len(x.encode().split()) for x, bad in zip(lines, failed, strict=True) if bad)
    kept = not base_failed and lost <= max_lost * n
    cleaned = "\n".join(x for x, bad in zip(lines, failed, strict=True) if not bad) if any(failed) else text
    return (n, len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), len(inked) - len(set(inked)), repeated, base_failed, kept, sum(failed), lost, cleaned)


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bad_lines long, lost_words long, cleaned string"


def _judge(max_lost: float):
    """Small pieces of a batch at a time, so that a worker holds few texts as Python strings."""
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in _FIELDS.split(", ")]

    def run(batches):
        let_go()
        for batch in batches:
            for part in pieces(batch, "text", 1 << 18):
                rows = [measure(x, max_lost) for x in part.column("text").to_pylist()]
                carried = [c for c in part.schema.names if c == "carried"]
                found = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found, *map(part.column, carried)], ["doc_id", *names, *carried])

    return run


def judge_documents(docs: DataFrame, max_lost: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """A row a row of docs: doc_id, base counts, base_failed, kept, and the cleaned text; with `carry` a struct of the other columns.

    Null and empty texts have no words and fail; repeated rows and texts are judged each; null ids
    stay; other columns are ignored; an empty table gives no rows. Every text is judged whole, in
    its own row, however long: no shuffle and no state.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *(rest_of(docs, text_col) if carry else []))
    return plain.mapInArrow(_judge(max_lost), schema_of("doc_id long, " + _FIELDS, plain))


def clean_documents(docs: DataFrame, max_lost: float = 0.5, text_col: str = "text", **more) -> DataFrame:
    """The rows that pass, with all their columns; failed lines are gone from the text, and n_chars follows.

    Null and empty texts fail; null ids and repeated rows are judged like others; an empty table gives no rows.
    """
    return restored(judge_documents(docs, max_lost, text_col=text_col, carry=True, **more).filter("kept"), docs, "cleaned", text_col)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from judge_documents()'s."""
    return found.drop("cleaned")


def _sql() -> str:
    word, furniture = r"[^\x20\x09-\x0D]+", "|".join(BOILERPLATE)
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
split_ AS (SELECT *, regexp_extract_all(t, '{word}') AS w, string_split(t, chr(10)) AS ls FROM texts),
line_rows AS (SELECT r, unnest(ls) AS ln, generate_subscripts(ls, 1) AS pos FROM split_),
features AS (
  SELECT r, pos, ln, regexp_extract_all(ln, '{word}') AS w,
    length(regexp_replace(ln, '[^|»›>]', '', 'g')) AS bars, length(regexp_replace(ln, '[^#*$%&|<>]', '', 'g')) AS symbols,
    length(regexp_replace(ln, '\P{{Lu}}', '', 'g')) AS up, length(regexp_replace(ln, '\P{{L}}', '', 'g')) AS letters,
    length(regexp_replace(ln, '[^!]', '', 'g')) AS shouts, length(regexp_replace(ln, '[^.!?。！？؟…]', '', 'g')) AS marks,
    regexp_matches(ln, '(?i){furniture}') AS furniture, regexp_matches(ln, '[.!?:;"''”’»)。！？؟…][\x20\x09-\x0D]*$') AS ended
  FROM line_rows),
judged AS (
  SELECT r, pos, ln, len(w) AS n,
    len(w) > 0 AND ((bars >= 2 AND 5 * bars >= len(w)) OR (symbols >= 3 AND symbols >= len(w)) OR (up >= 10 AND 2 * up > letters)
      OR (shouts >= 3 AND 3 * shouts > len(w))
      OR (len(w) >= 6 AND 2 * len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > len(w))
      OR (len(w) <= {BOILERPLATE_WORDS} AND furniture) OR (NOT ended AND 40 * marks < len(w))) AS bad
  FROM features),
by_text AS (
  SELECT r, count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(n) FILTER (bad), 0)::BIGINT AS lost_words,
    count(*) FILTER (n > 0) - count(DISTINCT ln) FILTER (n > 0) AS n_dup_lines
  FROM judged GROUP BY r),
triples AS (SELECT r, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS t3 FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split_)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t3) AS c FROM triples) WHERE c > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
counts AS (
  SELECT s.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_bad_lines, lost_words
  FROM split_ s JOIN by_text USING (r) LEFT JOIN repeated USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost_words <= n_words AS kept, n_bad_lines, lost_words
FROM counts"""


ORACLE_SQL = _sql()

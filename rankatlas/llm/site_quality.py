"""Quality and toxicity by hierarchical empirical Bayes over documents, paths and hosts.

A classifier of marks (words and shape) gives each document's evidence. Its probabilities are
averaged for each host and each path of a host; sparse hosts are shrunk toward the global mean and
sparse paths toward their host, by strengths estimated from how far the means really differ. The
document's posterior combines its own evidence with how far its path's odds are from the global.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_VALUES, Rolling, mix, pieces, text_bytes, words
from .frames import checkpoint

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER, _SYMBOL, _BAR, _SHOUT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#*$%&<>", "|", "!"
#: Shares at which a shape's step changes.
_STEPS = (0.002, 0.01, 0.05, 0.1, 0.2, 0.4)
TARGETS = ("quality", "toxic")


def marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct mark of texts that lie end to end.

    Marks are the words, letters only and in lower case, and steps of the shares of capitals,
    symbols, bars, exclamations and words that repeat their neighbour, and of the length.
    """
    n = len(at) - 1
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    letters = np.where(_LETTERS[data], low, np.uint8(32))
    start, end, first = words(letters, at)
    word = Rolling(BYTE_VALUES[letters]).ranges(start, end)
    text = np.repeat(np.arange(n), np.diff(first))
    key, owner = [word], [text]
    size = np.maximum(np.diff(at), 1)
    count = np.diff(first)
    total = lambda flags, cuts: np.diff(np.concatenate([[0], np.cumsum(flags)])[cuts])
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    shares = [total(np.isin(data, np.frombuffer(c.encode(), np.uint8)), at) / size for c in (_UPPER, _SYMBOL, _BAR, _SHOUT)]
    shares.append(total(again, first) / np.maximum(count, 1))
    steps = [np.digitize(share, _STEPS) for share in shares] + [np.log2(count + 1).astype(np.int64)]
    for i, step in enumerate(steps):
        key.append(mix(step.astype(np.uint64) + np.uint64(64 * i + 1)))
        owner.append(np.arange(n))
    key, owner = np.concatenate(key), np.concatenate(owner)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], key[new].view(np.int64)


def _mark_counts(batches):
    for batch in batches:
        for part in pieces(batch, "text", 2 << 20):
            owner, key = marks(*text_bytes(part.column("text")))
            found, at = np.unique(key, return_inverse=True)
            columns = []
            for target in TARGETS:
                label = np.asarray(part.column(target).fill_null(-1))[owner]
                columns += [np.bincount(at, label == 1, len(found)).astype(np.int64), np.bincount(at, label == 0, len(found)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, columns)], ["mark", "quality1", "quality0", "toxic1", "toxic0"])


def _evidence(models: list[tuple[np.ndarray, np.ndarray]]):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                owner, key = marks(*text_bytes(part.column("text")))
                out = []
                for known, weight in models:
                    if not len(known):
                        out.append(pa.array(np.zeros(part.num_rows)))
                        continue
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    out.append(pa.array(np.bincount(owner, weight[at] * (known[at] == key), part.num_rows)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in part.schema.names if c != "text"] + out, [c for c in part.schema.names if c != "text"] + [f"{t}_evidence" for t in TARGETS])

    return run


def _calibrate(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps that are halved until the loss falls; weak priors keep both finite."""
    scale = max(float(evidence.std()), 1e-9)
    x = np.stack([evidence / scale, np.ones(len(evidence))], 1)
    prior = np.array([0.05, 0.001])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - label @ (x @ w) + (prior * w * w).sum() / 2
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(prior + 1e-9), x.T @ (p - label) + prior * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if abs(size * step).max() < 1e-9:
            break
    return float(w[0]) / scale, float(w[1])


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = 50_000, features: int = 50_000, certainty: float = 4.0, effect: float = 1.5, pull: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Posterior quality and toxicity of every document.

    The classifier is fitted on at most `sample` labelled rows (those of least id hash), with four
    fifths for the marks' weights and one fifth for calibration; it keeps at most `features` marks
    whose log-odds lie `certainty` standard errors, and `effect`, from zero: frequent words that
    lean a little one way depend on each other and would outvote a telling mark. These are the only things the driver
    or a broadcast holds. Every document's whole text is scored, and all enter the host and path
    means. Returns doc_id, host, path, and for each target the document's probability, the host's
    and path's posterior means, the posterior; then kept: quality at least and toxicity under a half.

    Null texts are empty; null hosts or paths are groups of their own; rows without id are scored
    but can't be labelled; an id labelled twice counts once, by its lowest labels, and one of several
    rows with it is fitted; repeated rows are scored each; a text of any length is scored in its own
    row; other columns are ignored; an empty table gives no rows; without labels of both kinds a target's evidence is zero.
    """
    columns = {id_col: "doc_id", host: "host", path: "path"}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) if n != "doc_id" else F.col(c).cast("long").alias(n) for c, n in columns.items()), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.min(F.col(t).cast("long")).alias(t) for t in TARGETS)).filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = plain.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)))
    # one row an id, of the least text, so that ids which repeat add nothing to what the driver holds
    labelled = labelled.groupBy("doc_id", "fold", *TARGETS).agg(F.min("text").alias("text"))
    fields = ["quality1", "quality0", "toxic1", "toxic0"]
    fitted = labelled.filter("fold > 0")
    sizes = fitted.agg(*(F.count_if(F.col(t) == v).alias(f"{t}{v}") for t in TARGETS for v in (1, 0))).first()
    counts = fitted.select("text", *TARGETS).mapInArrow(_mark_counts, "mark long, " + ", ".join(f"{f} long" for f in fields)).groupBy("mark").agg(*(F.sum(f).alias(f) for f in fields))
    models = []
    for t in TARGETS:
        n1, n0 = sizes[f"{t}1"], sizes[f"{t}0"]
        if not n1 or not n0:
            models.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        a, b = F.col(f"{t}1") + 0.5, F.col(f"{t}0") + 0.5
        weight = F.log(a / (n1 - F.col(f"{t}1") + 0.5)) - F.log(b / (n0 - F.col(f"{t}0") + 0.5))
        error = F.sqrt(1 / a + 1 / b + 1 / (n1 - F.col(f"{t}1") + 0.5) + 1 / (n0 - F.col(f"{t}0") + 0.5))
        strong = counts.select("mark", weight.alias("weight"), (F.abs(weight) / error).alias("z")).filter((F.col("z") >= certainty) & (F.abs("weight") >= effect))
        best = strong.orderBy(F.desc("z"), "mark").limit(features).toPandas().sort_values("mark")
        models.append((best["mark"].to_numpy(np.int64), best["weight"].to_numpy(float)))
    kind = {f.name: f.dataType.simpleString() for f in plain.schema}
    held = labelled.filter("fold = 0").select("text", *TARGETS).mapInArrow(_evidence(models), "quality long, toxic long, quality_evidence double, toxic_evidence double").toPandas()
    scored = plain.mapInArrow(_evidence(models), f"doc_id long, host {kind['host']}, path {kind['path']}, quality_evidence double, toxic_evidence double")
    for t in TARGETS:
        own = held[held[t].notna()]
        slope, offset = _calibrate(own[f"{t}_evidence"].to_numpy(float), own[t].to_numpy(float)) if len(own) else (1.0, 0.0)
        scored = scored.withColumn(f"doc_{t}", 1 / (1 + F.exp(-(F.col(f"{t}_evidence") * slope + offset)))).drop(f"{t}_evidence")
    scored = checkpoint(scored)
    sums = [F.count("*").alias("n"), *(F.sum(f"doc_{t}").alias(f"{t}_sum") for t in TARGETS), *(F.sum(F.col(f"doc_{t}") ** 2).alias(f"{t}_squares") for t in TARGETS)]
    paths = checkpoint(scored.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in paths.columns if c not in ("host", "path")))
    world = hosts.agg(F.count("*").alias("hosts"), *(F.sum(c).alias(c) for c in hosts.columns if c != "host")).first()
    host_columns, path_columns, means = [], [], {}
    for t in TARGETS:
        n = world["n"] or 1
        means[t] = mean = (world[f"{t}_sum"] or 0.0) / n
        inner = max((world[f"{t}_squares"] or 0.0) / n - mean**2, 1e-9)
        strength = {}
        for name, groups in (("host", hosts), ("path", paths)):
            between = groups.filter("n >= 2").agg(F.avg((F.col(f"{t}_sum") / F.col("n") - mean) ** 2 - inner / F.col("n"))).first()[0]
            strength[name] = min(max(inner / max(between or 0.0, 1e-9), 1.0), 1e6)
        host_columns.append(((F.col(f"{t}_sum") + strength["host"] * mean) / (F.col("n") + strength["host"])).alias(f"host_{t}"))
        path_columns.append(((F.col(f"{t}_sum") + strength["path"] * F.col(f"host_{t}")) / (F.col("n") + strength["path"])).alias(f"path_{t}"))
    posterior = paths.join(hosts.select(F.col("host").alias("h"), *host_columns), F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias("h"), F.col("path").alias("p"), *(f"host_{t}" for t in TARGETS), *path_columns)
    out = scored.join(posterior, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    for t in TARGETS:
        shift = pull * (_logit(F.col(f"path_{t}")) - _logit(F.lit(means[t])))
        out = out.withColumn(t, 1 / (1 + F.exp(-(_logit(F.col(f"doc_{t}")) + shift))))
    return out.select("doc_id", "host", "path", *(f"{x}{t}" for t in TARGETS for x in ("doc_", "host_", "path_", "")), ((F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)).alias("kept"))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "host", "path", *(F.round(c, 6).alias(c) for c in found.columns if c not in ("doc_id", "host", "path", "kept")), "kept")

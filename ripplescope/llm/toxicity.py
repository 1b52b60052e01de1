"""Toxicity by compression distance.

Two raw-content zstd dictionaries are trained on a bounded sample of labelled texts, one on toxic and one on
ordinary ones, by the same rule: first what sets the class apart (runs of 5-byte grams within words that its
documents hold far more often than the other class's, most common last; nothing, if there are none), then a
common part, trained by zstd on ordinary text, so that everyday matter costs the same with either. Dictionaries
that zstd trains on either class's whole text differ mostly in which everyday matter they happen to hold, which
drowns what tells the classes apart: the README has the figures.
Every whole text is lower-cased (A-Z) and cut at white space into windows of about `WINDOW` bytes. For each
window the length under the ordinary dictionary minus that under the toxic one is its distance. A logistic
function of a document's largest distance, its three largest, and its excess over chance (fitted on labelled
texts that the dictionaries haven't seen, set to the share of toxic rows among all training labels) is the
score; labels, lang, source and doc_id are no inputs.

Bounds: at most SAMPLE_TOXIC + SAMPLE_ORDINARY texts, none of over SAMPLE_BYTES, reach the driver; three of
four train the dictionaries. Texts are scored whole, whatever their length. Null or empty text has no
windows and gets the score of distance 0. Without labels of both kinds every score is the share of toxic
rows (0 without labels). A document labelled more than once counts as toxic if one label says so. Repeated
rows give repeated results; no rows give no rows; other columns of the inputs are ignored.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplescope.llm import _common as C

WINDOW, GRAM, BASE_BYTES, OWN_BYTES = 64, 5, 8192, 2048
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 3600, 9000, 32768
_WINDOW = re.compile(rb"\S[\s\S]{0,%d}(?=\s|\Z)|\S{%d}" % (WINDOW - 1, WINDOW))


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _grams(text: str) -> set[bytes]:
    found: set[bytes] = set()
    for w in set(_words(text)):
        w = b" " + w
        found.update(w[i : i + GRAM] for i in range(len(w) - GRAM + 1))
    return found


def _runs(word: bytes, marked: set[bytes]) -> Iterator[bytes]:
    start, end = 0, -1
    for i in range(len(word) - GRAM + 1):
        if word[i : i + GRAM] in marked:
            if end < i:
                if end > 0:
                    yield word[start:end]
                start = i
            end = i + GRAM
    if end > 0:
        yield word[start:end]


def _trained(windows: list[bytes], size: int) -> bytes:
    """What zstd makes of windows of text, `size` bytes; the text itself where there is too little to train on."""
    import zstandard

    try:
        made = zstandard.train_dictionary(size + 512, windows[:: max(1, len(windows) // 60_000)], level=3).as_bytes()
    except zstandard.ZstdError:
        made = b" ".join(windows)
    return made[-size:]


def _own(texts: list[str], found: Counter[bytes], others: Counter[bytes], other_texts: int) -> bytes:
    """What sets a class apart, most common last: runs of grams that its texts (as `found` counts) hold far more often than others."""
    n, told = len(texts), {}
    for g, a in found.items():  # how far apart the shares are, in standard errors
        b = others[g]
        if a * other_texts >= 30 * b * n:
            p = (a + b) / (n + other_texts)
            told[g] = (a / n - b / other_texts) / math.sqrt(p * (1 - p) * (1 / n + 1 / other_texts) + 1e-12)
    least = max(6.0, max(told.values(), default=0) / 4)
    marked = {g for g, z in told.items() if z >= least}
    runs = Counter(r for t in texts for r in {r for w in set(_words(t)) for r in _runs(b" " + w, marked)})
    own = b""
    for run, k in sorted(runs.items(), key=lambda x: (-x[1], x[0])):
        if k < 0.01 * n or len(own) + len(run) > OWN_BYTES:
            break
        if run not in own:
            own = run + own
    return own


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary contents."""
    with_t, with_o = (Counter(g for t in x for g in _grams(t)) for x in (toxic, ordinary))
    common = _trained([w for t in ordinary for w in _WINDOW.findall(t.encode().lower())], BASE_BYTES)
    return _own(toxic, with_t, with_o, len(ordinary)) + common, _own(ordinary, with_o, with_t, len(toxic)) + common


class _Distances:
    def __init__(self, dictionaries: tuple[bytes, bytes]):
        import zstandard

        how = zstandard.ZstdCompressionParameters(
            window_log=15, hash_log=15, chain_log=15, search_log=6, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_checksum=0, write_content_size=0, write_dict_id=0
        )
        self.both = []
        for content in dictionaries:
            d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.both.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)

    def features(self, text: str) -> tuple[float, float, float]:
        """Largest distance, sum of the three largest, excess over 2 for the number of windows."""
        toxic, ordinary = self.both
        d = [len(ordinary(w)) - len(toxic(w)) for w in (b" " + w + b" " for w in _WINDOW.findall(text.encode().lower()))]
        if not d:
            return 0.0, 0.0, 0.0
        top = sorted(d, reverse=True)[:3]
        return float(top[0]), float(sum(top)), sum(x - 2 for x in d if x > 2) / math.sqrt(len(d) + 5)


def fit(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic model with intercept, which is shifted from the sample's share of 1 to `share`."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w[0] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return w


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", training: Column | None = None) -> tuple[tuple[bytes, bytes], list[float]] | float:
    """Dictionaries and weights, or the share of toxic rows where there are not labels of both kinds."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).dropna().filter(training if training is not None else ~held_out("__id"))
    known = known.groupBy("__id").agg(F.max(F.when(F.col("__y") == 1, 1).otherwise(0)).alias("__y"))
    count = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    total = sum(count.values())
    order = F.xxhash64(F.col("__id").cast("string"))
    picked = [known.filter(F.col("__y") == y).orderBy(order, "__id").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most SAMPLE_TOXIC + SAMPLE_ORDINARY ids
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).filter(F.octet_length("__text") <= SAMPLE_BYTES)
    rows = sorted({(r["__y"], str(r["__id"]), r["__text"]) for r in own.join(sample, "__id").collect()}, key=lambda r: (_order(r[1]), r))
    by = {y: [r[2] for r in rows if r[0] == y] for y in (0, 1)}
    if min(len(by[0]), len(by[1])) < 4:
        return count.get(1, 0) / total if total else 0.0
    dictionaries = train_dictionaries(*([t for i, t in enumerate(by[y]) if i % 4] for y in (1, 0)))
    distances = _Distances(dictionaries)
    rest = [(t, y) for y in (0, 1) for t in by[y][::4]]
    x, y = np.array([distances.features(t) for t, _ in rest]), np.array([y for _, y in rest], float)
    share = min(max(count[1] / total, 1e-3), 1 - 1e-3)
    return dictionaries, fit(x, y, share).tolist()


def _order(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode()[::-1])


_READY: dict[tuple[bytes, bytes], _Distances] = {}


def score(docs: DataFrame, model: tuple[tuple[bytes, bytes], list[float]] | float, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out_col: str = "score") -> DataFrame:
    """(id, *keep, score as `out_col`) for each row of `docs`, in its partitioning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(texts: list[str]) -> list[float]:
            if isinstance(model, float):
                return [model for _ in texts]
            dictionaries, (w0, w1, w2, w3) = model
            if dictionaries not in _READY:
                _READY.clear()  # a worker keeps those of the last model only
                _READY[dictionaries] = _Distances(dictionaries)
            features = _READY[dictionaries].features
            return [1 / (1 + math.exp(-max(-30.0, min(30.0, w0 + w1 * a + w2 * b + w3 * c)))) for a, b, c in map(features, texts)]

        for batch in batches:
            for at, texts in C.text_groups(batch.column(place).cast(pa.string())):
                kept = batch.slice(at, len(texts)).columns[: len(keep) + 1]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(each(texts), pa.float64())], names=[*batch.schema.names[: len(keep) + 1], out_col])

    text = [] if text_col in keep else [docs[text_col].cast("string").alias("__text")]
    place = keep.index(text_col) + 1 if text_col in keep else len(keep) + 1
    source = docs.select(id_col, *keep, *text)
    return source.mapInArrow(run, T.StructType([*source.schema.fields[: len(keep) + 1], T.StructField(out_col, T.DoubleType())]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

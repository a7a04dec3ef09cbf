"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on samples of toxic texts and one on samples of ordinary texts. Samples of
toxic texts keep the words that a likelihood test finds to tell the classes apart: most of a toxic text is ordinary, and a
dictionary trained on whole windows learns that part. Overlapping windows of a text are compressed with the ordinary
dictionary alone and with the toxic one in front of it; the bytes saved are the distance, so what both know tells nothing.
Words are counted by texts and by the words before them, whichever are fewer, so neither a long text nor copies of one
weigh more. A threshold on the saved bytes and a logistic curve over a text's windows are calibrated on labelled texts that
the dictionaries have not seen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm import words
from rowloom.llm.common import bounded_sample, logistic, text_batches
from rowloom.session import settle

WINDOW, OVERLAP = 80, 14
#: bytes of the ordinary dictionary; the toxic one has ``OWN_SHARE`` bytes for each byte of the words that tell, and no limit
SHARED_BYTES, OWN_SHARE, LEAST_OWN = 24_000, 4, 384
#: lengths of the strings that training counts, and of the pieces that it puts into a dictionary
STRING, OWN_PIECE, SHARED_PIECE = 8, 16, 32
PRIMER, PAD = 32, 10
#: labelled rows per class that the dictionaries and the calibration may see
MAX_ROWS = 20_000
#: one labelled text in so many calibrates, the others train
PARTS = 4
#: samples that a dictionary is trained on, those with the smallest hash, and words in one
MAX_SAMPLES, SAMPLE_WORDS = 60_000, 8
#: words that chance may add to those that tell, over all words tested; log of how much likelier such a word is in toxic texts
CHANCE, LEAST_RATIO = 0.01, 2.0
FEATURES = 5


@dataclass
class CompressionModel:
    toxic: bytes
    ordinary: bytes
    #: saved bytes from which a window counts as toxic
    threshold: float = 0.0
    weights: tuple[float, ...] = (0.0,) * (FEATURES + 1)

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if not hasattr(self, "_made"):
            params = zstandard.ZstdCompressionParameters(
                window_log=17, chain_log=16, hash_log=16, search_log=6, min_match=5, target_length=16,
                strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            self._made = []
            for content in (self.ordinary, self.toxic):
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=params)
                self._made.append(zstandard.ZstdCompressor(compression_params=params, dict_data=held))
        return self._made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def saved(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each span."""
        if not len(starts):
            return np.zeros(0)
        # familiar words in front make every window compressible, so that a match is not lost to a raw block;
        # blanks follow, since no match is sought in the last bytes
        primer = np.frombuffer(self.ordinary[-PRIMER:], np.uint8)
        rows = np.full((len(starts), PRIMER + WINDOW + PAD), 32, np.uint8)
        rows[:, :PRIMER] = primer
        place = np.arange(WINDOW)
        inside = place < sizes[:, None]
        rows[:, PRIMER : PRIMER + WINDOW][inside] = data[(starts[:, None] + place)[inside]]
        bounds = np.column_stack([np.arange(len(rows)) * rows.shape[1], PRIMER + sizes + PAD]).astype(np.uint64)
        spans = zstandard.BufferWithSegments(rows.tobytes(), bounds.tobytes())
        lengths = []
        for compressor in self._compressors():
            out = compressor.multi_compress_to_buffer(spans)
            lengths.append(np.array([len(out[i]) for i in range(len(out))]))
        return (lengths[0] - lengths[1]).astype(float)

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text: most saved in a window, windows from the threshold (log, and share), bytes saved in them (log), all
        windows of a text in which one saves (log): the more there are, the likelier that is chance."""
        out = np.zeros((len(column), FEATURES))
        for first, last, data, offsets in words.slices(column, 1 << 20):
            row, starts, sizes = windows(offsets)
            gain = self.saved(words.lower_ascii(data), starts, sizes)
            n = last - first
            top = np.zeros(n)
            np.maximum.at(top, row, gain)
            over = gain >= max(self.threshold, 1.0)
            count = np.bincount(row[over], minlength=n)
            total = np.bincount(row[over], gain[over], minlength=n)
            held = np.bincount(row, minlength=n)
            out[first:last] = np.column_stack([top, np.log1p(count), count / np.maximum(held, 1), np.log1p(total), np.log1p(held) * (top > 0)])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.weights[0] + x @ np.array(self.weights[1:]))


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, size) of windows that cover each row; neighbours overlap."""
    size = np.diff(offsets)
    step = WINDOW - OVERLAP
    count = np.where(size > 0, np.maximum(-(-(size - OVERLAP) // step), 1), 0)
    row = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(row)) - np.concatenate([[0], np.cumsum(count)])[row]
    starts = offsets[:-1][row] + place * step
    return row, starts, np.minimum(WINDOW, offsets[1:][row] - starts)


def trained(samples: list[str], size: int, piece: int) -> bytes:
    """A dictionary of at most ``size`` bytes that zstandard trains; of samples too few to train on, their own bytes."""
    data = [f" {s} ".encode() for s in samples]
    try:
        return zstandard.train_dictionary(size, data, k=piece, d=STRING).as_bytes()
    except zstandard.ZstdError:
        return b"".join(data)[-size:]


def _samples(rows: DataFrame) -> list[str]:
    """At most ``MAX_SAMPLES`` samples of a few words from (_id, place, word), those with the smallest hash."""
    at = F.row_number().over(Window.partitionBy("_id").orderBy("place")) - 1
    parts = rows.withColumn("_part", F.floor(at / SAMPLE_WORDS)).groupBy("_id", "_part").agg(
        F.sort_array(F.collect_list(F.struct("place", "word"))).alias("_words")
    )
    joined = parts.select(F.concat_ws(" ", "_words.word").alias("sample"))
    return [r.sample for r in joined.orderBy(F.xxhash64("sample"), "sample").limit(MAX_SAMPLES).collect()]


def dictionaries(seen: DataFrame) -> CompressionModel:
    """Both dictionaries from (_id, text, _y)."""
    listed = F.split(F.concat(F.lit(" "), F.lower("text")), r"[^\p{L}]+")
    pairs = F.arrays_zip(listed.alias("before"), F.slice(listed, 2, F.greatest(F.size(listed) - 1, F.lit(0))).alias("word"))
    each = seen.select("_id", "_y", F.posexplode(pairs).alias("place", "x")).select("_id", "_y", "place", "x.*").where("length(word) >= 3")
    each = settle(each, "toxicity-words")
    texts = {r._y: r["count"] for r in seen.groupBy("_y").count().collect()}
    spread = each.groupBy("word", "_y").agg(F.count_distinct("_id").alias("texts"), F.count_distinct("before").alias("contexts"))
    by_class = {k: F.coalesce(F.max(F.when(F.col("_y") == k, F.least("texts", "contexts"))), F.lit(0)) for k in (0, 1)}
    counted = spread.groupBy("word").agg(by_class[1].alias("t"), by_class[0].alias("o"))
    ratio = F.log((F.col("t") + 0.5) / (texts.get(1, 0) + 1.0)) - F.log((F.col("o") + 0.5) / (texts.get(0, 0) + 1.0))
    counted = settle(counted, "toxicity-counts")
    # a log-likelihood of x is passed by chance with probability e^-x
    least = math.log(max(counted.count(), 1) / CHANCE)
    told = settle(counted.where((ratio > LEAST_RATIO) & (F.col("t") * ratio > least)).select("word"), "toxicity-told")
    own = told.agg(F.coalesce(F.sum(F.octet_length("word") + 1), F.lit(0))).first()[0]
    toxic = trained(_samples(each.where("_y = 1").join(told, "word")), OWN_SHARE * own + LEAST_OWN, OWN_PIECE)
    ordinary = trained(_samples(each.where("_y = 0")), SHARED_BYTES, SHARED_PIECE).rjust(PRIMER)
    return CompressionModel(toxic + ordinary, b" " * len(toxic) + ordinary)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, ridge: float = 0.05, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression of weighted rows by Newton steps; one class alone gives its smoothed share."""
    weight = np.ones(len(y)) if weight is None else weight
    share = ((weight * y).sum() + 0.5) / (weight.sum() + 1)
    beta = np.zeros(x.shape[1] + 1)
    beta[0] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        a = np.column_stack([np.ones(len(x)), x])
        penalty = np.diag([1e-9, *[ridge] * x.shape[1]])
        for _ in range(steps):
            p = logistic(a @ beta)
            h = (a * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ a + penalty
            move = np.linalg.solve(h, a.T @ (weight * (y - p)) - penalty @ beta)
            beta += np.clip(move, -2, 2)
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_column: str = "doc_id", max_rows: int = MAX_ROWS) -> CompressionModel:
    """Fit on at most ``max_rows`` labelled rows of each class, those with the smallest hash of the id.

    All but one in ``PARTS`` train the dictionaries, the others calibrate, its rows weighted by the counts of the classes over all
    labels, so that the score's prior does not depend on ``max_rows``. Null labels and ids without a text are left out; without
    labels the score is one half everywhere.
    """
    text_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(
        F.max(label).cast("int").alias("_y")
    )
    counts = {r._y: r["count"] for r in known.groupBy("_y").count().collect()}
    sample = bounded_sample(known.where("_y = 1"), F.col("_id"), max_rows).unionByName(bounded_sample(known.where("_y = 0"), F.col("_id"), max_rows))
    seen = settle(
        docs.select(F.col(id_column).alias("_id"), "text").join(F.broadcast(sample), "_id").withColumn("_part", F.expr(f"pmod(xxhash64(3, _id), {PARTS})")), "toxicity"
    )
    model = dictionaries(seen.where("_part > 0"))

    def measured(current: CompressionModel) -> tuple[np.ndarray, np.ndarray]:
        @F.arrow_udf("array<double>")
        def x(column: pa.Array) -> pa.Array:
            values = current.features(column)
            return pa.ListArray.from_arrays(np.arange(0, values.size + 1, FEATURES, dtype=np.int32), values.ravel())

        rows = seen.where("_part = 0").select("_id", F.col("_y").cast("double"), x(F.col("text")).alias("_x")).toArrow()
        if not rows.num_rows:
            return np.zeros((0, FEATURES)), np.zeros(0)
        return np.stack(rows.column("_x").combine_chunks().to_numpy(zero_copy_only=False)), rows.column("_y").to_numpy()

    values, y = measured(model)
    if (y == 0).any():
        # a window counts from the saving that few ordinary texts reach in any window
        model.threshold = float(np.quantile(values[y == 0, 0], 0.99)) + 1
        values, y = measured(model)
    if len(y):
        # each calibrating row stands for so many labelled ones of its class; the mean over these rows is 1
        held = np.array([counts.get(k, 0) for k in (0, 1)], float)
        taken = np.bincount(y.astype(int), minlength=2)
        held[taken == 0] = 0
        each = held / np.maximum(taken, 1) * taken.sum() / held.sum()
        model.weights = calibrate(values, y, each[y.astype(int)])
    return model


def score_column(text: Column, model: CompressionModel) -> Column:
    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(model.features(column)))

    return scored(text)


def score(docs: DataFrame, model: CompressionModel, *, id_column: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted), a row for each of ``docs``; null and empty texts have no windows and score as such.

    Repeated rows stay, an empty table stays empty, other columns are ignored.
    """
    text_batches(docs.sparkSession)
    return docs.select(F.col(id_column), score_column(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )

"""Language identification by Bayesian fusion of evidence.

The likelihood of a page's main text comes from byte trigrams counted over all documents of known language. It is
combined with the language the markup declares, the suffix of the address, and a prior of the host. The
prior is smoothed in levels: a host's counts towards its suffix's, those towards all pages'. All
counts are grouped aggregations over the text's own verdicts, and a page never votes for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm import words
from rowloom.llm.common import text_batches
from rowloom.llm.html import main_text
from rowloom.session import settle

BUCKETS = 1 << 15
#: languages whose counts a task holds at a time, 256 KB each; then it passes them on and begins anew
HELD_LANGUAGES = 64
#: trigrams overlap, so a text says less than the sum of its trigrams
TEMPER = 1 / 3
#: pseudo-counts: pages that a host's and a suffix's prior are worth before any page is seen; confusion of declarations
HOST_WEIGHT, SUFFIX_WEIGHT, GLOBAL_WEIGHT, DECLARED_WEIGHT = 5.0, 20.0, 1.0, 1.0


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all byte trigrams of lower-cased texts, blanks for what is no letter."""
    data = words.lower_ascii(data)
    data = np.where((data >= 97) & (data <= 122) | (data >= 128), data, 32).astype(np.uint64)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = (row[:-2] == row[2:]) & (code != 0x202020)
    bucket = (words.mixed(code[whole]) >> np.uint64(64 - 15)).astype(np.int64)
    return row[:-2][whole], bucket


def _counter(languages: list[str]):
    index = {lang: k for k, lang in enumerate(languages)}

    def rows(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
        k = np.array(list(totals), np.int32)
        table = np.stack(list(totals.values())) if totals else np.zeros((0, BUCKETS), np.int64)
        row, bucket = np.nonzero(table)
        return pa.RecordBatch.from_arrays([pa.array(k[row]), pa.array(bucket.astype(np.int32)), pa.array(table[row, bucket])], ["k", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            which = np.array([index[v] for v in batch.column("lang").to_pylist()], np.int64)
            for first, last, data, offsets in words.slices(batch.column("text")):
                row, bucket = trigrams(data, offsets)
                lang = which[first:last][row]
                for k in np.unique(lang).tolist():
                    if k not in totals:
                        if len(totals) >= HELD_LANGUAGES:
                            yield rows(totals)
                            totals = {}
                        totals[k] = np.zeros(BUCKETS, np.int64)
                    totals[k] += np.bincount(bucket[lang == k], minlength=BUCKETS)
        yield rows(totals)

    return run


def likelihoods(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of each trigram bucket in each, from all documents with a language."""
    text_batches(documents.sparkSession)
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not languages:
        return [], np.zeros((0, BUCKETS))
    counted = known.select("lang", "text").mapInArrow(_counter(languages), "k int, bucket int, n bigint")
    table = counted.groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros((len(languages), BUCKETS))
    totals[table.column("k").to_numpy(), table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return languages, np.log((totals + 0.5) / (totals + 0.5).sum(1, keepdims=True))


def _evidence(page: Column, table: np.ndarray) -> Column:
    """Tempered log-likelihood of a page's main text in each language, relative to the best; zeros for no text."""
    n = len(table)

    @F.arrow_udf("array<double>")
    def text(column: pa.Array) -> pa.Array:
        out = np.zeros((len(column), n))
        mains = pa.array([main_text(v) for v in column.to_pylist()], pa.string())
        for first, last, data, offsets in words.slices(mains):
            row, bucket = trigrams(data, offsets)
            for k in range(n):
                out[first:last, k] = TEMPER * np.bincount(row, table[k][bucket], last - first)
        out -= out.max(1, keepdims=True)
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, n, dtype=np.int32), out.ravel())

    return text(page)


def _votes(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Per key, how many pages' texts speak for each language; written, so that joins with hot keys can be split."""
    votes = rows.groupBy(*keys).agg(F.array(*[F.sum((F.col("vote") == k).cast("double")) for k in range(n)]).alias(name))
    return settle(votes, "votes") if keys else votes


def identify(
    pages: DataFrame, documents: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """(page_id, url, lang, score, declared, text_lang), a row for each of ``pages``.

    score is the posterior probability of lang, and ties go to the language first in the alphabet. Pages without text, declaration or url lack
    that evidence and no other. Without any document of known language lang and score are null. Repeated rows vote each for
    itself; other columns are ignored.
    """
    text_batches(pages.sparkSession)
    languages, table = likelihoods(documents)
    n = len(languages)
    declared = F.nullif(F.lower(F.regexp_extract(F.col(html_column), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]{2,3})""", 1)), F.lit(""))
    host = F.lower(F.regexp_extract(F.col(url_column), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    base = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.coalesce(declared, F.lit("")).alias("declared"), F.coalesce(host, F.lit("")).alias("host"), F.col(html_column).alias("html"))
    if not n:
        none = F.lit(None).cast("string")
        return base.select("page_id", "url", none.alias("lang"), F.lit(None).cast("double").alias("score"), F.nullif("declared", F.lit("")).alias("declared"), none.alias("text_lang"))
    rows = base.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1)).withColumn("said", _evidence(F.col("html"), table)).drop("html")
    # a text that says nothing has no vote
    spoken = F.when(F.array_min("said") < 0, F.array_position("said", F.array_max("said")) - 1).cast("int")
    rows = settle(rows.withColumn("vote", spoken), "language")
    everything = F.array(*[F.lit(float(v)) for v in _total(rows, n)])
    # hosts join the table of their suffix, so that one join brings both levels
    hosts = _votes(rows, ["host", "suffix"], n, "host_votes")
    suffixes = _votes(rows, ["suffix"], n, "suffix_votes")
    declarations = _votes(rows, ["declared"], n, "declared_votes")
    joined = rows.join(hosts.drop("suffix"), "host").join(suffixes, "suffix").join(declarations, "declared")
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce((k == F.col("vote")).cast("double"), F.lit(0.0)))
    less = lambda votes: F.zip_with(votes, own, lambda a, b: a - b)
    total = lambda votes: F.aggregate(votes, F.lit(0.0), lambda a, b: a + b)
    columns = joined.withColumns({"g": less(everything), "s": less(F.col("suffix_votes")), "h": less(F.col("host_votes")), "d": less(F.col("declared_votes"))})
    for name in "gshd":
        columns = columns.withColumn(f"{name}_n", total(F.col(name)))
    columns = columns.withColumn("g", F.transform("g", lambda v: (v + GLOBAL_WEIGHT) / (F.col("g_n") + GLOBAL_WEIGHT * n)))
    columns = columns.withColumn("s", F.zip_with("s", "g", lambda v, p: (v + SUFFIX_WEIGHT * p) / (F.col("s_n") + SUFFIX_WEIGHT)))
    columns = columns.withColumn("h", F.zip_with("h", "s", lambda v, p: (v + HOST_WEIGHT * p) / (F.col("h_n") + HOST_WEIGHT)))
    # how a declaration shifts the odds: its pages' languages against those of all pages
    shift = F.zip_with("d", "g", lambda v, p: F.log((v + DECLARED_WEIGHT * p) / (F.col("d_n") + DECLARED_WEIGHT)) - F.log(p))
    shift = F.when(F.col("declared") == "", F.transform("d", lambda v: F.lit(0.0))).otherwise(shift)
    columns = columns.withColumn("sum", F.zip_with(F.zip_with("said", F.transform("h", lambda p: F.log(p)), lambda a, b: a + b), shift, lambda a, b: a + b))
    top = F.array_max("sum")
    named = F.array(*map(F.lit, languages))
    return columns.select(
        "page_id", "url", F.element_at(named, F.array_position("sum", top).cast("int")).alias("lang"),
        (1 / total(F.transform("sum", lambda v: F.exp(v - top)))).alias("score"),
        F.nullif("declared", F.lit("")).alias("declared"), F.when(F.col("vote").isNotNull(), F.element_at(named, F.col("vote") + 1)).alias("text_lang"),
    )


def _total(rows: DataFrame, n: int) -> list[float]:
    found = _votes(rows, [], n, "v").first()
    return [x or 0.0 for x in found.v]

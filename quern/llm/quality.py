"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets a few measures. Quantile sketches (KLL) of each measure are built per language
and source, and merged upwards (language, then everything). A group's quantiles are its own and those of its
language, and these in turn those of everything, each weighed by its number of documents against ``PRIOR``: a small group
leans on what is above it, a large one stands on its own, and there is no size at which the rule changes. A document is kept if each
measure lies within its group's fences, which are joined back to it. Sketches of more than some hundred values are approximate
(ranks to about 1.3 %) and depend a little on the order they were merged in, so a text right at a fence may fall on either side.
"""

from __future__ import annotations

from collections import Counter

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, task, text_of, written

#: White space that parts words: space, and tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ALL_COUNTS = [*COUNTS, "n_lines"]
FEATURES = "doc_id bigint, key bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in ALL_COUNTS)
_FEATURES = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *[(c, pa.int64()) for c in ALL_COUNTS]])



@dataclass(frozen=True)
class Fence:
    """Bounds ``times`` the distance of two quantiles outside of them; never nearer than ``least``.

    ``low``: whether low values count against a text as well. ``least`` decides only where a group hardly varies.
    """

    low: bool
    quantiles: tuple[float, float]
    times: float
    least: float


#: The expressions are in ``with_measures``. Upper-tail quantiles for shares that most texts have none of, but the third quartile where
#: the texts to find are more than a twentieth.
MEASURES = {
    "mean_word": Fence(True, (0.25, 0.75), 8.0, 0.5), "symbol_share": Fence(False, (0.5, 0.75), 8.0, 0.03),
    "repeat_share": Fence(False, (0.5, 0.95), 8.0, 0.3), "dup_lines_share": Fence(False, (0.5, 0.95), 8.0, 0.5),
}
#: Documents that what is above a group counts for.
PRIOR = 200
#: Size parameter of the sketches: ranks are right to about 1.3 %.
SKETCH_K = 200


def counts(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (those with a word) of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: at just the six white-space bytes
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES.decode()))
    repeats = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        found = Counter(windows)
        last = -1  # the last word already counted
        for k, w in enumerate(windows):
            if found[w] > 1:
                repeats += k + 2 - max(last, k - 1)
                last = k + 2
    duplicates, lines = 0, int(n > 0)
    if "\n" in text:
        seen = set()
        for line in text.split("\n"):
            if line in seen:
                duplicates += 1
            elif line.encode("utf-8", "surrogatepass").split():
                seen.add(line)
        lines = len(seen) + duplicates
    return n, chars, sum(map(text.count, SYMBOLS)), duplicates, repeats, lines


def features(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), lang, source and the counts of every whole text (null: empty). Other columns go."""

    @task("counts")
    def count(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                rows = [counts(t) for t in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], schema=_FEATURES)

    keyed = text_of(docs, "doc_id", "lang", "source").select("doc_id", F.xxhash64("text").alias("key"), "lang", "source", "text")
    return keyed.mapInArrow(count, FEATURES)


def with_measures(found: DataFrame) -> DataFrame:
    """Adds base_failed and the measures."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return found.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_lines_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    })


def _sketched(df: DataFrame, merge: bool, *keys: str) -> DataFrame:
    """Documents that passed the base, and sketches of their measures, for each of the keys."""
    ok = ~F.col("base_failed") if not merge else None
    own = [F.kll_merge_agg_double(m) if merge else F.kll_sketch_agg_double(F.when(ok, F.col(m)), SKETCH_K) for m in MEASURES]
    n = F.sum("n") if merge else F.count_if(ok)
    return df.groupBy(*keys).agg(n.alias("n"), *[c.alias(m) for c, m in zip(own, MEASURES, strict=True)])


def thresholds(measured: DataFrame) -> DataFrame:
    """_lang, _source and, for each measure, its low and high bound (null: none)."""
    groups = written(_sketched(measured, False, "_lang", "_source"), "sketches")  # a row for each group, read three times
    names = [(m, k) for m in MEASURES for k in (0, 1)]

    def quantiles(df: DataFrame, prefix: str, *keys: str) -> DataFrame:
        """Two quantiles of each measure; null without documents."""
        return df.select(*keys, F.col("n").alias(f"{prefix}n"), *[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(m, F.lit(MEASURES[m].quantiles[k]))).alias(f"{prefix}{m}{k}") for m, k in names])

    top = quantiles(_sketched(groups, True), "t_").first()  # one row of numbers
    own = quantiles(groups, "g_", "_lang", "_source").join(quantiles(_sketched(groups, True, "_lang"), "l_", "_lang"), "_lang")

    def leaning(prefix: str, m: str, k: int, above) -> object:
        n, q = F.col(f"{prefix}n"), F.col(f"{prefix}{m}{k}")
        return F.when(n > 0, (n * q + PRIOR * above) / (n + PRIOR)).otherwise(above)

    out = []
    for m, fence in MEASURES.items():
        q = [leaning("g_", m, k, leaning("l_", m, k, F.lit(top[f"t_{m}{k}"]).cast("double"))) for k in (0, 1)]
        width = F.greatest(F.lit(fence.times) * (q[1] - q[0]), F.lit(fence.least))
        out += [(q[0] - width if fence.low else F.lit(None).cast("double")).alias(f"{m}_low"), (q[1] + width).alias(f"{m}_high")]
    return own.select("_lang", "_source", *out)


def _judged(docs: DataFrame) -> DataFrame:
    found = with_measures(written(features(docs), "features")).withColumns({"_lang": F.coalesce("lang", F.lit("")), "_source": F.coalesce("source", F.lit(""))})
    joined = found.join(thresholds(found), ["_lang", "_source"])
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True)) & F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    kept is false where base_failed is true, else whether every measure lies within the fences of
    the document's language and source. A null text has no words and so fails; null languages and
    sources are groups like any other. Repeated rows are judged each; other columns go. An empty
    table gives an empty one.
    """
    return _judged(docs).select("doc_id", *COUNTS, "base_failed", "kept")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, as they are, whose text is kept. A text of which some rows are kept (under other languages, say) keeps those of its doc_id."""
    judged = written(_judged(docs).groupBy("doc_id", "key").agg(F.max("kept").alias("kept")), "judged")
    gone = judged.filter("not kept").select(F.col("doc_id").alias("_gone"), F.col("key").alias("_text"))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(few(gone), docs["doc_id"].eqNullSafe(F.col("_gone")) & (key == F.col("_text")), "left_anti")

"""Reading levels from a Rasch-style latent difficulty model.

A document has a level t, a word a difficulty b, on one scale. As in a Rasch model only
their difference counts: a running word of the document is w with a probability
proportional to exp(a_w - (t - b_w)^2 / 2). The square's first part cancels, so given the
words' parameters a document's likelihood is a function of t with one maximum, which
rests on the mean difficulty of its words; given the levels a word's likelihood is that
of a Poisson regression on t. The two are optimised in turn, each step distributed over
documents or over words; what passes the driver are sums over a fixed grid of levels.
Labelled documents hold the scale: during estimation they are kept at their mean label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.session import discard, materialise

#: Levels at which word counts are gathered, and the finer ones that documents may have.
GRID = np.linspace(0.5, 5.5, 21)
FINE = np.linspace(-0.5, 6.5, 351)
CENTRE = 3.0
#: Variance of difficulties a priori.
SPREAD = 4.0
#: Rows of a word that share a key; more are salted.
ROWS_PER_KEY = 200_000
#: Words up to which the table of difficulties is broadcast; beyond it is shuffled.
SMALL = 100_000
STEP = 0.02


_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&#?[A-Za-z0-9]+;")
_WORD = re.compile(r"[a-z][a-z'-]+")


def words_of(text: str | None) -> list[str]:
    """A text's running words in lower case, without markup, entities, soft hyphens, and
    what isn't prose: pasted readings and identifiers (anything with = or _ inside).
    Marks of emphasis around a word are stripped."""
    if not text:
        return []
    t = _MARKUP.sub(" ", text).replace("\xad", "").lower()
    if "=" in t or "_" in t:
        t = " ".join(x for x in (w.strip("_*.,;:!?()\"'") for w in t.split()) if "=" not in x and "_" not in x)
    return _WORD.findall(t)


def _word_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, words, ns): each document's distinct words and how often they occur, which
    needs no shuffle; documents without words are left out."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [Counter(words_of(t)) for t in b.column(1).to_pylist()]
            keep = pa.array([bool(c) for c in counts])
            words = pa.array([list(c) for c in counts], pa.list_(pa.string()))
            ns = pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), words, ns], names=["doc", "words", "ns"]).filter(keep)

    return materialise(docs.select(doc_id, text).mapInArrow(run, f"doc {kind}, words array<string>, ns array<int>"), "tokens")


def _word_rows(df: DataFrame, *keep: Column | str) -> DataFrame:
    """A row for each word of what _word_counts gives."""
    return df.select(*keep, F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("ns").alias("n"))))


def detect_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, detected) for the texts without `lang`: the language whose texts make
    their words likeliest. A word's probability in a language is nine tenths its share
    there and one tenth its share over all, languages counting alike whatever their size.
    Texts without a word that occurs in a text with `lang` give no row."""
    by = _word_rows(_word_counts(docs.where(F.col(lang).isNotNull()), lang, text), F.col("doc").alias("detected"))
    by = materialise(by.groupBy("detected", "word").agg(F.sum("n").alias("c")), "language-words")
    by = by.join(F.broadcast(by.groupBy("detected").agg(F.sum("c").alias("total"))), "detected").withColumn("share", F.col("c") / F.col("total"))
    by = by.withColumn("gain", F.log1p(9 * F.col("share") / F.sum("share").over(Window.partitionBy("word"))))
    unknown = _word_rows(_word_counts(docs.where(F.col(lang).isNull() & F.col(doc_id).isNotNull()), doc_id, text), "doc")
    gains = unknown.join(by, "word").groupBy("doc", "detected").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
    return gains.groupBy(F.col("doc").alias(doc_id)).agg(F.max_by("detected", F.struct("gain", "detected")).alias("detected"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def _fit_words(exposure: np.ndarray, log_z: np.ndarray):
    """Newton's method for the difficulties of a batch of words, given their counts by
    level. The frequency is the one at which expected and actual totals agree."""
    x = GRID - CENTRE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.log(exposure + 1e-9) - log_z
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(GRID))], axis=1)
            total, b = c.sum(1), np.zeros(len(c))
            for _ in range(12):
                e = base + b[:, None] * x
                p = np.exp(e - e.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                mean = p @ x
                slope = c @ x - total * mean - b / SPREAD
                b = b + np.clip(slope / (total * (p @ (x * x) - mean**2) + 1 / SPREAD), -1, 1)
            e = base + b[:, None] * x
            top = e.max(1)
            a = np.log(total) - top - np.log(np.exp(e - top[:, None]).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(b), pa.array(a)], names=["word", "b", "a"])

    return run


def _partition_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words' share in the normaliser, at each fine level."""
    z = np.zeros(len(FINE))
    for batch in batches:
        b, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i in range(0, len(b), 4096):
            z += np.exp(a[i : i + 4096, None] + b[i : i + 4096, None] * (FINE - CENTRE)).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array([z.tolist()], pa.list_(pa.float64()))], names=["z"])


def _place(log_z: np.ndarray):
    """The level at which a document's words are most probable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            t = np.empty(len(s))
            for i in range(0, len(s), 4096):
                t[i : i + 4096] = FINE[(s[i : i + 4096, None] * (FINE - CENTRE) - n[i : i + 4096, None] * log_z).argmax(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t)], names=["doc", "t"])

    return run


def _cuts(by_label: dict[int, dict[int, int]], density: np.ndarray) -> list[float]:
    """Where one reading level ends and the next begins: where fewest labels are on the
    wrong side, and of about equally good places where fewest documents are."""
    smooth = np.convolve(density, np.ones(5), "same")
    out = []
    for level in range(1, 5):
        low, high = np.zeros(len(FINE)), np.zeros(len(FINE))
        for bin_, counts in by_label.items():
            for label, n in counts.items():
                (low if label <= level else high)[bin_] += n
        wrong = np.append(low[::-1].cumsum()[::-1], 0)[:-1] + np.append(0, high.cumsum())[:-1]  # cut below bin i
        good = np.flatnonzero(wrong <= wrong.min() * 1.02 + 1)
        sparse = good[smooth[good] == smooth[good].min()]
        out.append(float(FINE[sparse[len(sparse) // 2]] - STEP / 2))
    return out


def reading_levels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "level", tolerance: float = 0.05, least: int = 3, most_rounds: int = 50, also: DataFrame | None = None) -> DataFrame:
    """(doc_id, difficulty, level) for every document of `docs`: the latent level as a
    number, and the label scale's level 1 to 5.

    docs: texts of one language, ids unique. labels: rows with a document's id and a
    level, several of one document allowed; those of documents that aren't in `docs`,
    and null ones, don't count. At least one label must be there if there is a word.
    Empty, null and wordless texts have difficulty and level null, and so have those all of
    whose words occur fewer than `least` times, from which no difficulty can be told (1:
    every word counts). All texts take part in full. Words and documents are fitted in
    turn until 99 of 100 documents move by no more than `tolerance`, a twentieth of a
    level; if most_rounds are not enough it is an error. Texts of `also` (same language and columns,
    other ids) get their rows by the fitted words but don't take part in the fit."""
    ids = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(doc_id, text).where(F.col(doc_id).isNotNull())
    docs_words = _word_counts(d, doc_id, text)
    # frequent words have their rows spread over several keys; how many is a matter of counts only
    hot = _word_rows(docs_words).groupBy("word").agg(F.ceil(F.count("*") / ROWS_PER_KEY).cast("int").alias("salts")).where("salts > 1")
    hot = materialise(hot, "hot-words")
    lab = labels.select(F.col(doc_id).alias("doc"), F.col(label).cast("int").alias("label")).where("doc is not null and label between 1 and 5")
    anchors = materialise(lab.groupBy("doc").agg(F.avg("label").alias("t")).join(docs_words.select("doc"), "doc", "left_semi"), "anchors")
    more = None if also is None else also.select(doc_id, text).where(F.col(doc_id).isNotNull())
    every = d if more is None else d.unionByName(more)
    none = every.select(doc_id, F.lit(None).cast("double").alias("difficulty"), F.lit(None).cast("int").alias("level"))
    if anchors.isEmpty():
        if not docs_words.isEmpty():
            raise ValueError("no document has a label")
        return none
    placed, log_z = anchors, np.zeros(len(GRID))
    kind = "string" if ids == "string" else ids

    def place(docs_words: DataFrame, words: DataFrame, fine: np.ndarray) -> DataFrame:
        if words.count() <= SMALL:
            scored = _word_rows(docs_words, "doc").join(F.broadcast(words.select("word", "b")), "word")
        else:
            spread = words.select("word", "b").join(_small(hot, SMALL), "word", "left").select("word", "b", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
            salted = _word_rows(docs_words, "doc").join(_small(hot, SMALL), "word", "left")
            salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc"), F.coalesce("salts", F.lit(1))).cast("int"))
            scored = salted.join(spread, ["word", "salt"])
        means = scored.groupBy("doc").agg(F.sum(F.col("n") * F.col("b")).alias("s"), F.sum("n").cast("double").alias("n"))
        return materialise(means.mapInArrow(_place(fine), f"doc {kind}, t double"), "levels")

    before = None
    for _ in range(most_rounds):
        grid = F.least(F.greatest(F.round((F.col("t") - float(GRID[0])) / float(GRID[1] - GRID[0])), F.lit(0.0)), F.lit(len(GRID) - 1.0)).cast("int")
        by = _word_rows(docs_words.join(placed.select("doc", grid.alias("g")), "doc"), "g")
        counts = by.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("g") == k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(len(GRID))])
        counts = materialise(counts.where(reduce(lambda x, y: x + y, [F.col(f"c{k}") for k in range(len(GRID))]) >= least), "by-level")
        exposure = np.array(counts.agg(*[F.sum(f"c{k}") for k in range(len(GRID))]).first(), float)
        words = materialise(counts.mapInArrow(_fit_words(exposure, log_z), "word string, b double, a double"), "words")
        z = np.sum([r["z"] for r in words.select("b", "a").mapInArrow(_partition_sums, "z array<double>").collect()], axis=0)
        fine = np.log(z)
        log_z = np.interp(GRID, FINE, fine)
        levels = place(docs_words, words, fine)
        placed = levels.join(anchors.select("doc", F.col("t").alias("held")), "doc", "left").select("doc", F.coalesce("held", "t").alias("t"))
        if before is not None:
            step = F.round(F.abs(F.col("t") - F.col("was")) / STEP).cast("int")
            steps = {r["s"]: r["count"] for r in levels.join(before.select("doc", F.col("t").alias("was")), "doc").groupBy(step.alias("s")).count().collect()}
            discard(before)
            far = sum(n for s, n in steps.items() if s * STEP > tolerance + 1e-9)
            if far <= 0.01 * sum(steps.values()):
                break
        before = levels
        for t in (counts, words):
            discard(t)
    else:
        raise RuntimeError(f"levels still move after {most_rounds} rounds")
    bin_ = F.round((F.col("t") - float(FINE[0])) / STEP).cast("int")
    density = np.zeros(len(FINE))
    for r in levels.groupBy(bin_.alias("b")).count().collect():
        density[r["b"]] = r["count"]
    by_label: dict[int, dict[int, int]] = {}
    for r in levels.join(lab, "doc").groupBy(bin_.alias("b"), "label").count().collect():
        by_label.setdefault(r["b"], {})[r["label"]] = r["count"]
    level = F.lit(1)
    for cut in _cuts(by_label, density):
        level = level + (F.col("t") >= cut).cast("int")
    if more is not None:
        levels = levels.unionByName(place(_word_counts(more, doc_id, text), words, fine))
    out = levels.select(F.col("doc").alias(doc_id), F.col("t").alias("difficulty"), level.alias("level"))
    return every.select(doc_id).join(out, doc_id, "left")

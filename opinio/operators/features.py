"""Features (M1, M2, M7, M8, M12): label codes, TF-IDF, sequence ids,
hybrid vectors and sentence vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, IndexToString,
                                Normalizer, StringIndexer, VectorAssembler)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.functions.arrays import explode_rows
from opinio.sources.tables import bounded_broadcast

PAD_ID = 0
UNKNOWN_ID = 1


# ----------------------------------------------------------------- M1
def fit_label_encoder(df: DataFrame, label_col: str, out: str = "label_index"):
    """M1: alphabetical codes (negatif 0, netral 1, positif 2); unseen labels
    raise at transform time, as the original encoder does."""
    return StringIndexer(inputCol=label_col, outputCol=out, stringOrderType="alphabetAsc",
                         handleInvalid="error").fit(df)


def label_decoder(model, index_col: str, out: str) -> IndexToString:
    """M1 inverse."""
    return IndexToString(inputCol=index_col, outputCol=out, labels=model.labels)


def label_codes(df: DataFrame, label_col: str) -> DataFrame:
    """M1 for any number of labels: ``(label, code)``, codes in alphabetical order from 0.

    The distinct labels are numbered by ranges, and the table is written once: nothing per
    label is on the driver.  Null labels have no code.
    """
    from opinio.operators.metrics import dense_index
    from opinio.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    labels = df.select(F.col(label_col).alias("label")).where("label IS NOT NULL").distinct()
    return dense_index(labels, "label", "code").select("label", "code").checkpoint()


def encode_labels(df: DataFrame, label_col: str, codes: DataFrame, out: str = "label_index") -> DataFrame:
    """``df`` with its labels' codes: a join with the table, broadcast when it is measured small.

    A label that the table does not have is an error, as in the original encoder; a null label
    has a null code.
    """
    side = bounded_broadcast(codes.select(F.col("label").alias("_label"), F.col("code").alias("_code")))
    joined = df.join(side, F.col(label_col) == F.col("_label"), "left")
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.col(label_col).cast("string")))
    code = F.when(F.col("_code").isNull() & F.col(label_col).isNotNull(), unseen.cast("long")).otherwise(F.col("_code"))
    return joined.withColumn(out, code).drop("_label", "_code")


def decode_labels(df: DataFrame, index_col: str, codes: DataFrame, out: str) -> DataFrame:
    """M1 inverse: the label of each code, null where there is none."""
    side = bounded_broadcast(codes.select(F.col("code").alias("_code"), F.col("label").alias(out)))
    return df.join(side, F.col(index_col) == F.col("_code"), "left").drop("_code")


# ----------------------------------------------------------------- M2
@dataclass(frozen=True)
class TfidfVocab:
    words: tuple[str, ...]
    idf: tuple[float, ...]
    n_docs: int

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(w, i, float(v)) for i, (w, v) in enumerate(zip(self.words, self.idf))],
            "word string, term_index int, idf double")


def term_pairs(df: DataFrame, ws_col: str, row_id: str) -> DataFrame:
    """``(row_id, word, tf)``: per-row term counts.  A row's tokens sit in one
    task, so the partial aggregate already yields the final pairs."""
    return (explode_rows(df, ws_col, "word", row_id)
            .groupBy(row_id, "word").agg(F.count(F.lit(1)).alias("tf")))


def corpus_stats(df: DataFrame, ws_col: str) -> DataFrame:
    """``(word, cf, df)``: corpus frequency and document frequency per word.

    One pass, one shuffle keyed by word: each token adds to ``cf`` and each
    distinct word of a row (``array_distinct``, computed inside the row) adds
    to ``df``; the aggregate combines map-side, so every task ships at most
    one row per word -- no ``(row, word)`` pairs are shuffled.
    """
    marks = F.concat(
        F.transform(ws_col, lambda w: F.struct(w.alias("word"), F.lit(1).alias("c"), F.lit(0).alias("d"))),
        F.transform(F.array_distinct(ws_col),
                    lambda w: F.struct(w.alias("word"), F.lit(0).alias("c"), F.lit(1).alias("d"))))
    return explode_rows(df, marks, "_m").groupBy(F.col("_m.word").alias("word")).agg(
        F.sum("_m.c").cast("long").alias("cf"), F.sum("_m.d").cast("long").alias("df"))


def fit_tfidf(df: DataFrame, ws_col: str, row_id: str, max_features: int = 500) -> TfidfVocab:
    """M2 fit: the ``max_features`` words with the highest corpus frequency
    (ties by word), smoothed idf ``ln((1+n)/(1+df)) + 1``.

    Only the bounded top-``max_features`` rows reach the driver.
    """
    stats = corpus_stats(df, ws_col)
    top = stats.orderBy(F.col("cf").desc(), F.col("word")).limit(max_features).collect()
    n = df.count()
    top = sorted(top, key=lambda r: (-r["cf"], r["word"]))
    return TfidfVocab(tuple(r["word"] for r in top),
                      tuple(math.log((1.0 + n) / (1.0 + r["df"])) + 1.0 for r in top), n)


def tfidf_weights(df: DataFrame, ws_col: str, row_id: str, vocab: TfidfVocab) -> DataFrame:
    """M2 long form ``(row_id, word, term_index, weight)``: tf x idf,
    L2-normalised per row, one output row per vocabulary word present.

    Derived from :func:`tfidf_vectors`, so after the fit there is no shuffle
    at all: counting, scaling and normalising happen per row against the
    bounded vocabulary, and the index -> word lookup is an inlined array.
    """
    vec = tfidf_vectors(df.select(row_id, ws_col), ws_col, vocab, "_vec")
    words = F.array(*[F.lit(w) for w in vocab.words])
    return explode_rows(vec, F.filter(cells("_vec"), lambda c: c["x"] != 0.0), "_c", row_id).select(
        row_id, F.element_at(words, F.col("_c.i") + 1).alias("word"), F.col("_c.i").alias("term_index"),
        F.col("_c.x").alias("weight"))


def cells(vector_col: str) -> Column:
    """``array<struct<i, x>>`` of an ML vector's own cells: of a sparse one those it holds."""
    v = F.unwrap_udt(vector_col)
    pair = lambda i, x: F.struct(i.cast("int").alias("i"), x.alias("x"))
    return F.when(v["type"] == 0, F.zip_with(v["indices"], v["values"], pair)).otherwise(
        F.transform(v["values"], lambda x, i: pair(i, x)))


def tfidf_vectors(df: DataFrame, ws_col: str, vocab: TfidfVocab, out: str = "features") -> DataFrame:
    """M2 vector form: per-row ML stages (term counts over a fixed
    vocabulary, idf scaling, L2 normaliser) -- no shuffle.  Rows without
    vocabulary words keep a zero vector."""
    cv = CountVectorizerModel.from_vocabulary(list(vocab.words), inputCol=ws_col, outputCol="_tf")
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(list(vocab.idf)), inputCol="_tf", outputCol="_tfidf")
    norm = Normalizer(p=2.0, inputCol="_tfidf", outputCol=out)
    return norm.transform(scaled.transform(cv.transform(df))).drop("_tf", "_tfidf")


# ----------------------------------------------------------------- M7
def sequence_vocab(df: DataFrame, ws_col: str, size: int) -> DataFrame:
    """``(word, id)`` for the ``size`` most frequent words (ties by word);
    ids start after the pad and unknown ids.  The numbering window runs
    over at most ``size`` rows."""
    counts = (explode_rows(df, ws_col, "word").groupBy("word")
              .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("word")).limit(size))
    w = Window.orderBy(F.col("n").desc(), F.col("word"))
    return counts.select("word", (F.row_number().over(w) + UNKNOWN_ID).cast("int").alias("id"))


# Literal maps are searched linearly, so only small vocabularies are inlined.
INLINE_VOCAB_MAX = 64


def encode_sequences(df: DataFrame, ws_col: str, row_id: str, vocab: DataFrame,
                     max_len: int = 128, inline_max: int = INLINE_VOCAB_MAX,
                     pad_to: str = "max_len") -> DataFrame:
    """M7: ``(row_id, input_ids, attention_mask)``, both of length ``max_len``:
    known words map to their id, others to the unknown id; sequences are cut
    at ``max_len`` (the encoder's truncation) and padded with the pad id.

    A vocabulary of at most ``inline_max`` words (checked) is inlined as a
    map literal: encoding is then a projection with no shuffle.  Larger
    vocabularies use explode -> join -> regroup by row.  Both forms agree: a null
    word array is an empty one, and of a word's several ids the least counts.

    ``pad_to="longest"`` pads to the longest sequence after truncation
    instead (the encoder's ``padding=True``): one max aggregate over the
    frame, a single number to the driver.
    """
    from opinio.session import checkpoint_root
    df = df.select(row_id, F.coalesce(F.col(ws_col), F.expr("CAST(array() AS array<string>)")).alias(ws_col))
    if pad_to == "longest":
        longest = df.select(F.least(F.size(ws_col), F.lit(max_len)).alias("_n")).agg(F.max("_n")).first()[0]
        width = max(int(longest or 0), 0)
    elif pad_to == "max_len":
        width = max_len
    else:
        raise ValueError(f"pad_to must be 'max_len' or 'longest', not {pad_to!r}")
    # The vocabulary is a corpus job: written once to the shared checkpoint
    # folder so the size check and the lookup read it rather than recount
    # the corpus.  One bounded count picks the strategy.
    checkpoint_root(df.sparkSession)
    vocab = vocab.groupBy("word").agg(F.min("id").alias("id")).checkpoint()
    if vocab.limit(inline_max + 1).count() <= inline_max:
        pairs = [(r["word"], int(r["id"])) for r in vocab.collect()]
        m = F.create_map(*[F.lit(x) for kv in pairs for x in kv]) if pairs else None
        toks = F.slice(ws_col, 1, max_len)
        ids = F.transform(toks, lambda w: F.coalesce(F.try_element_at(m, w), F.lit(UNKNOWN_ID))) \
            if m is not None else F.transform(toks, lambda w: F.lit(UNKNOWN_ID))
        out = df.select(row_id, ids.alias("_ids"))
        pad = F.array_repeat(F.lit(PAD_ID), F.lit(width) - F.size("_ids"))
        return out.select(row_id, F.concat("_ids", pad).alias("input_ids"),
                          F.concat(F.array_repeat(F.lit(1), F.size("_ids")), pad).alias("attention_mask"))
    side = bounded_broadcast(vocab)
    toks = df.select(row_id, F.posexplode_outer(F.slice(ws_col, 1, max_len)).alias("pos", "word"))
    joined = toks.join(side, "word", "left")
    grouped = joined.groupBy(row_id).agg(F.array_sort(F.collect_list(F.when(
        F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNKNOWN_ID)).alias("id"))))).alias("_s"))
    ids = F.transform("_s", lambda s: s["id"])
    pad = F.array_repeat(F.lit(PAD_ID), F.lit(width) - F.size("_s"))
    return grouped.select(
        row_id, F.concat(ids, pad).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("_s")), pad).alias("attention_mask"))


# ----------------------------------------------------------------- M8
def hybrid_features(df: DataFrame, vector_col: str, extra_cols: Sequence[str],
                    out: str = "hybrid") -> DataFrame:
    """M8: text vector concatenated with scalar features (lexicon score)."""
    return VectorAssembler(inputCols=[vector_col, *extra_cols], outputCol=out,
                           handleInvalid="keep").transform(df)


# ----------------------------------------------------------------- M12
def sentence_vectors(df: DataFrame, ws_col: str, row_id: str = "row_id", size: int = 32,
                     out: str = "sentence_vector") -> DataFrame:
    """``(row_id, out)``, the mean word vector per row.

    A word's vector is ``size`` signs (at most 32) taken from the bits of its MD5
    digest: nothing is trained, no vocabulary is gathered, every word counts, and
    the vectors are the same on any cluster.  Random signs keep the angles between
    bags of words (a random projection).  A row without words gets zeros.

    A word's digest is taken once; all its signs are added in one pass by a generated
    aggregate, which a task combines to one row per document before its shuffle.
    """
    if not 1 <= size <= 32:
        raise ValueError("size must be between 1 and 32")
    words = df.select(row_id, F.explode_outer(ws_col).alias("_w"))
    bits = words.select(row_id, F.conv(F.substring(F.md5(F.col("_w").cast("binary")), 1, 8), 16, 10).cast("long").alias("_b"))
    one = F.lit(1).cast("long")
    sums = bits.groupBy(row_id).agg(F.count("_b").alias("_n"), *[
        F.coalesce(F.sum(F.shiftright("_b", i).bitwiseAND(one)), F.lit(0)).alias(f"_s{i}") for i in range(size)])
    n = F.greatest(F.col("_n"), one)
    return sums.select(row_id, F.array(*[(2 * F.col(f"_s{i}") - F.col("_n")) / n for i in range(size)]).alias(out))

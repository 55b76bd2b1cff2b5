"""Language identification by words first, then by shorter and shorter character n-grams.

A word seen in training scores the logarithm of its frequency in each language. An unseen word is read from the left: at each
place the longest known n-gram (from `MAX_GRAM` letters down to one) scores instead. A document's scores add up over its
words; the language of the highest sum wins, ties going to the first by name, and `score` is its share of the total likelihood.

Training reads labelled rows only: at most about `DOCS_PER_LANGUAGE` whole texts for each language, drawn by hash of the id. That bound alone
keeps the model small: every word and n-gram that they hold is in it. Prediction reads every document whole, partition by partition, with no shuffle.

Defined results: null text, or text without a letter: `und` with score 0; with no training rows every text is `und`. Repeated rows
are predicted row by row; columns of docs that are named as the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import discard, materialize

DOCS_PER_LANGUAGE = 1_000
MAX_GRAM = 4
SMOOTHING = 0.5
MEMO_WORDS = 400_000
#: Letters are what str.isalpha() accepts; this also takes other numerals in, which `_remember` takes out again.
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_scores: np.ndarray
    gram_scores: np.ndarray
    memo: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)


def _table(items: list[str], langs: list[str], n: list[int], languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Items and their log frequencies: a row per item, a column per language."""
    index = {k: i for i, k in enumerate(sorted(set(items)))}
    counts = np.zeros((len(index), len(languages)))
    at = {lang: i for i, lang in enumerate(languages)}
    counts[[index[x] for x in items], [at[x] for x in langs]] = n
    return index, np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * max(1, len(index)))


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the rows where `train` holds and a language is given."""
    labelled = docs.where(train & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("l_lang"), F.col(text_col).alias("l_text"), F.xxhash64(F.col(id_col)).alias("l_hash")
    )
    share = labelled.groupBy("l_lang").agg((F.lit(float(DOCS_PER_LANGUAGE)) / F.count(F.lit(1))).alias("l_share"))
    sample = labelled.join(F.broadcast(share), "l_lang").where(F.pmod("l_hash", F.lit(1_000_003)) < F.col("l_share") * 1_000_003)
    counted_words = (
        sample.select("l_lang", F.explode(F.regexp_extract_all(F.lower("l_text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        .groupBy("l_lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    words = materialize(counted_words, "words")
    marked = words.select("l_lang", "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("w"))
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(MAX_GRAM)),
            lambda k: F.when(
                F.length("w") >= k, F.transform(F.sequence(F.lit(1), F.length("w") - k + 1), lambda i: F.substring(F.col("w"), i, k))
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    counted = marked.select("l_lang", "n", F.explode(grams).alias("gram")).groupBy("l_lang", "gram").agg(F.sum("n").alias("n"))
    # Bounded by DOCS_PER_LANGUAGE texts of each language.
    tables = [f.select("l_lang", "n", F.col(c).alias("item")).toArrow() for f, c in ((words, "word"), (counted, "gram"))]
    discard(words)
    columns = [[t.column(c).to_pylist() for c in ("item", "l_lang", "n")] for t in tables]
    languages = sorted({x for _, langs, _ in columns for x in langs})
    (word_index, word_scores), (gram_index, gram_scores) = (_table(*c, languages) for c in columns)
    return Model(languages, word_index, gram_index, word_scores, gram_scores)


def _grams_of(word: str, known: dict[str, int]) -> list[int]:
    """The longest known n-gram at each place of an unseen word."""
    text, found, i = f" {word} ", [], 0
    while i < len(text):
        for k in range(MAX_GRAM, 0, -1):
            gram = known.get(text[i : i + k])
            if gram is not None and i + k <= len(text):
                found.append(gram)
                break
        i += 1
    return found


def _remember(model: Model, words: list[str]) -> None:
    """Puts the scores of words not met before into the model's memo; row 0 is that of a run without a letter."""
    flat: list[int] = []
    sizes: list[int] = []
    new: list[str] = []
    base = sum(map(len, model.rows))
    scores: list[np.ndarray] = []
    for word in words:
        letters = word if word.isalpha() else "".join(c for c in word if c.isalpha())
        if not letters:
            model.memo[word] = 0
        elif (at := model.words.get(letters)) is not None:
            model.memo[word] = base + len(scores)
            scores.append(model.word_scores[at])
        else:
            grams = _grams_of(letters, model.grams)
            new.append(word)
            sizes.append(len(grams))
            flat += grams
    if scores:
        model.rows.append(np.array(scores))
        base += len(scores)
    if new:
        held = np.array(sizes)
        sums = np.zeros((len(new), len(model.languages)))
        if flat:
            filled = np.flatnonzero(held)
            starts = (np.cumsum(held) - held)[filled]
            sums[filled] = np.add.reduceat(model.gram_scores[np.array(flat)], starts, axis=0)
        # As one word would: the mean over its n-grams, scaled to the usual weight of a word.
        sums /= np.maximum(1, held)[:, None]
        model.memo.update(zip(new, range(base, base + len(new)), strict=True))
        model.rows.append(sums)


def predict_batch(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    split = [WORD.findall((t or "").lower()) for t in texts]
    seen = set().union(*split) if split else set()
    missing = [w for w in seen if w not in model.memo]
    if not model.rows or len(model.memo) + len(missing) > MEMO_WORDS:
        model.memo, model.rows, missing = {}, [np.zeros((1, len(model.languages)))], list(seen)
    _remember(model, missing)
    model.rows = [np.concatenate(model.rows)]
    langs, shares = [], []
    for words in split:
        at = np.fromiter(map(model.memo.__getitem__, words), np.int64, len(words))
        if not at.any() or not model.languages:
            langs.append("und")
            shares.append(0.0)
            continue
        total = model.rows[0][at].sum(0)
        best = int(np.argmax(total))
        langs.append(model.languages[best])
        shares.append(float(1 / np.exp(total - total[best]).sum()))
    return langs, shares


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without its text, with lang_pred and score."""
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for k in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(k, 1000)
                langs, shares = predict_batch(held, texts.slice(k, 1000).to_pylist())
                kept = [part.column(part.schema.get_field_index(c)) for c in rest]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(shares, pa.float64())], [*rest, "lang_pred", "score"])

    return docs.select(*rest, text_col).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def language_report(docs: DataFrame) -> DataFrame:
    model = fit(docs, ~F.coalesce(held_out(), F.lit(False)))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

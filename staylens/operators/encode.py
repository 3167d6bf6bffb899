"""Data-dependent columns: phrase indicators (F4, A10) and one-hot levels.

Both are two-pass operators. ``fit_*`` runs one distributed pass and returns the list of
columns to make (vocabulary or levels); like the names and importances of a model's
features, that list is held by the driver, whatever its length. ``apply_*`` makes one
column for each entry; ``encoded_vector`` makes one sparse vector instead, whose cost
follows the phrases of a row and not the width.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._util import as_list, qcol, require_columns, spread, unique_names
from ..functions.phrases import phrase_set


def _long_form(df: DataFrame, cols, value_expr) -> DataFrame:
    """(column, value) pairs for several columns with one Expand, no per-column scan."""
    parts = [F.struct(F.lit(c).alias("column"), value_expr(c).alias("value")) for c in cols]
    return df.select(F.explode(F.array(*parts)).alias("p")).select("p.column", "p.value")


# --------------------------------------------------------------------------- A10

def phrase_vocabulary(df: DataFrame, col: str, name: str = "phrase", count_name: str = "documents",
                      key: str | None = None, partitions: int | None = None) -> DataFrame:
    """A10: every phrase of the column with the number of rows containing it.

    The rows are dealt out first (see :func:`staylens._util.spread`): a file's row groups
    may be few, and the regex is the work.
    """
    cols = [qcol(col)] + ([qcol(key)] if key and key != col else [])
    return (spread(df.select(*cols), key, partitions).select(F.explode(phrase_set(qcol(col))).alias(name))
            .groupBy(name).agg(F.count(F.lit(1)).alias(count_name)))


def phrases_long(df: DataFrame, key: str, col: str, name: str = "phrase",
                 partitions: int | None = None) -> DataFrame:
    """(key, phrase) for every distinct phrase of every row (rows dealt out by the key)."""
    src = spread(df.select(qcol(key), qcol(col)), key, partitions)
    return src.select(qcol(key), F.explode(phrase_set(qcol(col))).alias(name))


# --------------------------------------------------------------------------- F4

@dataclass(frozen=True)
class PhraseVocabulary:
    phrases: dict = field(default_factory=dict)  # column -> sorted phrases
    sep: str = "-"
    column_names: dict = field(default_factory=dict)  # column -> generated names

    def names(self, col: str) -> list[str]:
        return self.column_names.get(col) or unique_names(col, self.phrases[col], self.sep)


def _name_phrases(phrases: dict, sep: str, taken) -> dict:
    used, out = list(taken), {}
    for c, values in phrases.items():
        out[c] = unique_names(c, values, sep, used)
        used += out[c]
    return out


def fit_phrase_indicators(df: DataFrame, cols, sep: str = "-") -> PhraseVocabulary:
    """First pass: the distinct phrases of every column."""
    cols = as_list(cols)
    require_columns(df, cols)
    pairs = (_long_form(df, cols, lambda c: phrase_set(qcol(c)))
             .select("column", F.explode("value").alias("phrase")).distinct())
    rows = pairs.collect()
    vocab = {c: sorted(r["phrase"] for r in rows if r["column"] == c) for c in cols}
    others = [x for x in df.columns if x not in cols]
    return PhraseVocabulary(vocab, sep, _name_phrases(vocab, sep, others))


def apply_phrase_indicators(df: DataFrame, vocab: PhraseVocabulary) -> DataFrame:
    """One 0/1 column ``<col>-<phrase>`` per phrase; the text columns are dropped.

    Missing text has no phrase, so all its indicators are 0.
    """
    cols = list(vocab.phrases)
    sets = df.select(*[qcol(c) for c in df.columns if c not in cols],
                     *[phrase_set(qcol(c)).alias(f"__set_{i}") for i, c in enumerate(cols)])
    keep = [qcol(c) for c in df.columns if c not in cols]
    flags = []
    for i, c in enumerate(cols):
        s = F.col(f"__set_{i}")
        for phrase, name in zip(vocab.phrases[c], vocab.names(c)):
            flags.append(F.array_contains(s, F.lit(phrase)).cast("int").alias(name))
    return sets.select(*keep, *flags)


def phrase_indicators(df: DataFrame, cols, sep: str = "-") -> DataFrame:
    """fit the vocabulary, then add the indicator columns."""
    return apply_phrase_indicators(df, fit_phrase_indicators(df, cols, sep))


# --------------------------------------------------------------------------- F5

@dataclass(frozen=True)
class Levels:
    levels: dict = field(default_factory=dict)  # column -> sorted distinct non-missing values
    drop_first: bool = True
    dummy_null: bool = True
    column_names: dict = field(default_factory=dict)  # column -> generated names

    def encoded(self, col: str) -> list:
        """Encoded levels in order: sorted values, then None for missing; first dropped."""
        full = list(self.levels[col]) + ([None] if self.dummy_null else [])
        return full[1:] if self.drop_first else full

    def names(self, col: str) -> list[str]:
        return self.column_names.get(col) or unique_names(col, self.encoded(col))


def _name_levels(levels: Levels, taken) -> Levels:
    used, names = list(taken), {}
    for c in levels.levels:
        names[c] = unique_names(c, levels.encoded(c), "_", used)
        used += names[c]
    return Levels(levels.levels, levels.drop_first, levels.dummy_null, names)


def fit_one_hot(df: DataFrame, cols, drop_first: bool = True, dummy_null: bool = True) -> Levels:
    """First pass: distinct non-missing levels of every column."""
    cols = as_list(cols)
    require_columns(df, cols)
    pairs = (_long_form(df, cols, lambda c: qcol(c).cast("string"))
             .where(F.col("value").isNotNull()).distinct())
    rows = pairs.collect()
    levels = {c: sorted(r["value"] for r in rows if r["column"] == c) for c in cols}
    others = [x for x in df.columns if x not in cols]
    return _name_levels(Levels(levels, drop_first, dummy_null), others)


def apply_one_hot(df: DataFrame, levels: Levels) -> DataFrame:
    """One 0/1 column per encoded level, replacing the source columns, in one projection."""
    cols = list(levels.levels)
    out = [qcol(c) for c in df.columns if c not in cols]
    for c in cols:
        v = qcol(c).cast("string")
        for level, name in zip(levels.encoded(c), levels.names(c)):
            flag = v.isNull() if level is None else F.coalesce(v == F.lit(level), F.lit(False))
            out.append(flag.cast("int").alias(name))
    return df.select(*out)


def one_hot(df: DataFrame, cols, drop_first: bool = True, dummy_null: bool = True) -> DataFrame:
    """levels sorted, first dropped, a missing-level column ``<col>_nan`` added."""
    return apply_one_hot(df, fit_one_hot(df, cols, drop_first, dummy_null))


# --------------------------------------------------------------------------- F4 + F5 in one pass

def fit_encoders(df: DataFrame, phrase_cols, level_cols, sep: str = "-", drop_first: bool = True,
                 dummy_null: bool = True) -> tuple[PhraseVocabulary, Levels]:
    """Phrase vocabulary and one-hot levels from one scan and one shuffle.

    Every row becomes (kind, column, value) pairs for all listed columns at
    once (a phrase column gives its phrase set, a level column its value);
    the distinct pairs are fetched.
    """
    phrase_cols, level_cols = as_list(phrase_cols), as_list(level_cols)
    require_columns(df, [*phrase_cols, *level_cols])
    empty = F.array().cast("array<string>")
    parts = [F.struct(F.lit("p").alias("kind"), F.lit(c).alias("column"),
                      phrase_set(qcol(c)).alias("values")) for c in phrase_cols]
    parts += [F.struct(F.lit("l").alias("kind"), F.lit(c).alias("column"),
                       F.when(qcol(c).isNotNull(), F.array(qcol(c).cast("string")))
                       .otherwise(empty).alias("values")) for c in level_cols]
    if not parts:
        return PhraseVocabulary({}, sep), Levels({}, drop_first, dummy_null)
    pairs = (df.select(F.explode(F.array(*parts)).alias("p"))
             .select("p.kind", "p.column", F.explode("p.values").alias("value")).distinct())
    rows = pairs.collect()
    phrases = {c: sorted(r["value"] for r in rows if r["kind"] == "p" and r["column"] == c)
               for c in phrase_cols}
    encoded = set(phrase_cols) | set(level_cols)
    others = [x for x in df.columns if x not in encoded]
    vocab = PhraseVocabulary(phrases, sep, _name_phrases(phrases, sep, others))
    taken = others + [n for names in vocab.column_names.values() for n in names]
    levels = _name_levels(Levels(
        {c: sorted(r["value"] for r in rows if r["kind"] == "l" and r["column"] == c)
         for c in level_cols}, drop_first, dummy_null), taken)
    return vocab, levels


def _each(phrases, col: str, entry):
    return F.transform(phrases, lambda p: entry("p", col, p))


def encoded_vector(df: DataFrame, vocab: PhraseVocabulary, levels: Levels, out: str) -> tuple[DataFrame, list[str]]:
    """F4 + F5 as one sparse 0/1 vector column, and its slots' names in order.

    A row becomes the list of its entries (its phrases and levels); a count vectorizer
    with the fitted entries as vocabulary turns the list into the vector.
    """
    from pyspark.ml.feature import CountVectorizerModel

    def entry(kind: str, col: str, value):
        text = F.coalesce(value, F.lit("")) if kind == "l" else value
        return F.concat(F.when(value.isNull(), F.lit("n")).otherwise(F.lit(kind)), F.lit(f"\u0001{col}\u0001"), text)

    slots, names, lists = [], [], []
    for c, phrases in vocab.phrases.items():
        lists.append(_each(phrase_set(qcol(c)), c, entry))
        slots += [f"p\u0001{c}\u0001{p}" for p in phrases]
        names += vocab.names(c)
    for c in levels.levels:
        lists.append(F.array(entry("l", c, qcol(c).cast("string"))))
        slots += [f"n\u0001{c}\u0001" if v is None else f"l\u0001{c}\u0001{v}" for v in levels.encoded(c)]
        names += levels.names(c)
    if not slots:
        return df, []
    tmp = f"__entries_{out}"
    model = CountVectorizerModel.from_vocabulary(slots, inputCol=tmp, outputCol=out, minTF=1.0)
    model.setBinary(True)
    return model.transform(df.withColumn(tmp, F.concat(*lists))).drop(tmp), names

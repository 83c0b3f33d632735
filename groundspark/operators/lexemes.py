"""Lexeme normalisation of texts and the inverted index built from it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.functions.stemming import stem
from groundspark.runtime import freed_shuffles, in_slices

# English stop words of the Snowball project.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()
# A task keeps the stems of so many words; rare ones are cheap to stem again.
MAX_CACHED_WORDS = 100_000
TOKEN = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class TextConfig:
    """How words become lexemes: stop words dropped, the rest stemmed or not."""

    stopwords: tuple[str, ...]
    stemmed: bool


CONFIGS = {
    "simple": TextConfig(tuple(STOPWORDS), False),
    "english": TextConfig(tuple(STOPWORDS), True),
}


def stem_words(words: Column) -> Column:
    """Stems of an array of words; a task stems each distinct word of a slice at most once."""

    def stems_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stems: dict[str, str] = {}

        def stem_of(word: str | None) -> str | None:
            known = stems.get(word)
            if known is None and word is not None:
                if len(stems) >= MAX_CACHED_WORDS:
                    stems.clear()
                known = stems[word] = stem(word)
            return known

        for part in in_slices(batches):
            coded = part.flatten().dictionary_encode()
            found = pa.array([stem_of(word) for word in coded.dictionary.to_pylist()], pa.string())
            ends = np.zeros(len(part) + 1, np.int32)
            np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False), out=ends[1:])
            yield pa.ListArray.from_arrays(pa.array(ends), found.take(coded.indices), mask=part.is_null())

    return F.arrow_udf(stems_of, "array<string>")(words)


def lexeme_positions(text: Column, config: str = "english") -> Column:
    """array<struct<word, position>> without stop words; positions count them."""
    chosen = CONFIGS[config]
    words = F.transform(
        F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)),
        lambda word, i: F.struct(word.alias("word"), (i + 1).alias("position")),
    )
    return F.filter(words, lambda w: ~w["word"].isin(*chosen.stopwords))


def with_lexemes(rows: DataFrame, config: str = "english", text_column: str = "text") -> DataFrame:
    """Add ``lexemes`` (in text order, repeats kept) and their ``positions``."""
    if config not in CONFIGS:
        raise ValueError(f"unknown text config {config!r}, expected one of {sorted(CONFIGS)}")
    kept = rows.withColumn("_kept", lexeme_positions(F.col(text_column), config))
    words = F.col("_kept.word")
    lexemes = stem_words(words) if CONFIGS[config].stemmed else words
    return kept.withColumn("lexemes", lexemes).withColumn("positions", F.col("_kept.position")).drop("_kept")


ENTRIES = pa.list_(pa.struct([("lexeme", pa.string()), ("tf", pa.int32()), ("positions", pa.list_(pa.int32()))]))
ENTRIES_DDL = "array<struct<lexeme:string,tf:int,positions:array<int>>>"


def count_entries(lexemes: pa.ListArray, positions: pa.ListArray) -> pa.ListArray:
    """Entries of each row in order of lexemes; rows are counted together, as sorted codes."""
    sizes = pc.fill_null(pc.list_value_length(lexemes), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lexemes)), sizes)
    coded = lexemes.flatten().dictionary_encode()
    words = coded.dictionary
    # Codes in order of the words' bytes.
    by_bytes = pc.array_sort_indices(words.cast(pa.binary())).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[by_bytes] = np.arange(len(words))
    word = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(row) else np.zeros(0, np.int64)
    place = positions.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((place, word, row))
    row, word, place = row[order], word[order], place[order]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
    ends = np.append(first, len(row)).astype(np.int32)
    entries = pa.StructArray.from_arrays(
        [words.take(pa.array(by_bytes[word[first]])), pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))],
        fields=list(ENTRIES.value_type),
    )
    held = np.zeros(len(lexemes) + 1, np.int32)
    np.cumsum(np.bincount(row[first], minlength=len(lexemes)), out=held[1:])
    return pa.ListArray.from_arrays(pa.array(held), entries)


def lexeme_entries(lexemes: Column, positions: Column) -> Column:
    """array<struct<lexeme, tf, positions>> of one row: its distinct lexemes in order."""

    @F.arrow_udf(ENTRIES_DDL)
    def entries(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for part in in_slices(pa.StructArray.from_arrays(pair, names=["words", "places"]) for pair in batches):
            yield count_entries(*part.flatten())

    return entries(lexemes, positions)


def postings(chunks: DataFrame) -> DataFrame:
    """(lexeme, document_id, chunk_index, tf, positions) of an indexed chunk table."""
    return chunks.select(
        "document_id",
        "chunk_index",
        F.inline(lexeme_entries(F.col("lexemes"), F.col("positions"))),
    ).select("lexeme", "document_id", "chunk_index", "tf", "positions")


def write_postings(table: DataFrame, path: str) -> None:
    """Store postings clustered by lexeme; a frequent lexeme spans many files."""
    order = ["lexeme", "document_id", "chunk_index"]
    with freed_shuffles(table.sparkSession):
        table.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
